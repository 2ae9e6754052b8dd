"""Map projections as SQL expressions (Snyder, Map Projections; Krueger series for transverse Mercator), on GRS80/WGS84."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import geometry as G

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)


def _tm(lon: Column, lat: Column, lon0: float) -> tuple[Column, Column]:
    """Transverse Mercator by Krueger's series in the third flattening."""
    n = FLAT / (2 - FLAT)
    a = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    s = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - s * F.atanh(s * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * a * x, 0.9996 * a * y


def _q(phi: Column) -> Column:
    s = F.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - 1 / (2 * E) * F.log((1 - E * s) / (1 + E * s)))


def _q0(phi: float) -> float:
    s = math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - 1 / (2 * E) * math.log((1 - E * s) / (1 + E * s)))


def _laea(lon: Column, lat: Column, lon0: float, lat0: float, x0: float, y0: float) -> tuple[Column, Column]:
    """Lambert azimuthal equal area."""
    qp, p0 = _q0(math.pi / 2), math.radians(lat0)
    beta0 = math.asin(_q0(p0) / qp)
    rq = A * math.sqrt(qp / 2)
    d = A * math.cos(p0) / math.sqrt(1 - E2 * math.sin(p0) ** 2) / (rq * math.cos(beta0))
    beta, lam = F.asin(_q(F.radians(lat)) / qp), F.radians(lon - lon0)
    b = rq * F.sqrt(2 / (1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(lam)))
    return x0 + b * d * F.cos(beta) * F.sin(lam), y0 + b / d * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(lam))


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """(x, y) in metres of WGS84 degrees, for EPSG 4326, 3857, 3035, 6933, 326xx, 327xx and 258xx."""
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return A * F.radians(lon), A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))
    if epsg == 3035:
        return _laea(lon, lat, 10.0, 52.0, 4321000.0, 3210000.0)
    if epsg == 6933:
        p = math.radians(30)
        k = math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
        return A * k * F.radians(lon), A * _q(F.radians(lat)) / (2 * k)
    zone = epsg % 100
    if epsg // 100 in (326, 327, 258) and 1 <= zone <= 60:
        x, y = _tm(lon, lat, 6.0 * zone - 183)
        return x, y + 1e7 if epsg // 100 == 327 else y
    raise ValueError(f"no formula for EPSG:{epsg}")


def _from_tm(x: Column, y: Column, lon0: float) -> tuple[Column, Column]:
    n = FLAT / (2 - FLAT)
    a = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi0, eta0 = y / (0.9996 * a), (x - 500000) / (0.9996 * a)
    xi, eta = xi0, eta0
    for j, c in enumerate(beta, 1):
        xi = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, c in enumerate(delta, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return lon0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def _from_authalic(beta: Column) -> Column:
    """Geodetic latitude in degrees of an authalic one."""
    e4, e6 = E2**2, E2**3
    terms = (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360)
    phi = beta
    for j, c in enumerate(terms, 1):
        phi = phi + c * F.sin(2 * j * beta)
    return F.degrees(phi)


def _from_laea(x: Column, y: Column, lon0: float, lat0: float, x0: float, y0: float) -> tuple[Column, Column]:
    qp, p0 = _q0(math.pi / 2), math.radians(lat0)
    beta0 = math.asin(_q0(p0) / qp)
    rq = A * math.sqrt(qp / 2)
    d = A * math.cos(p0) / math.sqrt(1 - E2 * math.sin(p0) ** 2) / (rq * math.cos(beta0))
    dx, dy = (x - x0) / d, (y - y0) * d
    rho = F.hypot(dx, dy)
    c = 2 * F.asin(rho / (2 * rq))
    beta = F.asin(F.cos(c) * math.sin(beta0) + F.when(rho > 0, dy * F.sin(c) * math.cos(beta0) / rho).otherwise(0.0))
    lam = F.atan2(dx * F.sin(c), rho * math.cos(beta0) * F.cos(c) - dy * math.sin(beta0) * F.sin(c))
    return lon0 + F.degrees(lam), _from_authalic(beta)


def unproject(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """(longitude, latitude) in WGS84 degrees of coordinates in a reference system that project() knows."""
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)
    if epsg == 3035:
        return _from_laea(x, y, 10.0, 52.0, 4321000.0, 3210000.0)
    if epsg == 6933:
        p = math.radians(30)
        k = math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
        return F.degrees(x / (A * k)), _from_authalic(F.asin(2 * k * y / A / _q0(math.pi / 2)))
    zone = epsg % 100
    if epsg // 100 in (326, 327, 258) and 1 <= zone <= 60:
        return _from_tm(x, y - 1e7 if epsg // 100 == 327 else y, 6.0 * zone - 183)
    raise ValueError(f"no formula for EPSG:{epsg}")


def between(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one reference system in another; also what warp() asks for, from the target's to the source's."""
    return (x, y) if source == target else project(*unproject(x, y, source), target)


def utm_epsg(lon: float, lat: float) -> int:
    """The UTM zone of a place, as EPSG code; an error beyond 84 degrees of latitude."""
    if abs(lat) > 84:
        raise ValueError(f"there is no UTM zone at {lat:.1f} degrees of latitude")
    return (32600 if lat >= 0 else 32700) + min(60, int((lon + 180) // 6) + 1)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of value, which is worked out once."""
    return F.transform(F.array(value), then)[0]


#: Edges are halved at most this often.
HALVINGS = 16


def densify(g: Column, epsg: int, within: float, source: int = 4326) -> Column:
    """A geometry with vertices added on its edges, so that the edges stay within a distance (in units of the reference system
    epsg) of where they belong there.

    An edge is cut into 1, 2, 4, ... equal pieces until the projected quarter points and midpoint of each piece are as near
    as that to the same points of the projected piece; points stay as they are. An edge that is not there after HALVINGS
    is an error.
    """
    def between_ends(s: Column, t: Column) -> Column:
        return G.xy(*[s["a"][k] + (s["b"][k] - s["a"][k]) * t for k in "xy"])

    def off(s: Column, n: Column) -> Column:
        """How far the n pieces are off at most."""
        def moved(j: Column) -> Column:
            v = between_ends(s, j / (4 * n))
            return G.xy(*between(v["x"], v["y"], source, epsg))

        def gap(p: Column, j: Column) -> Column:
            first, t = (F.floor(j / 4) * 4).cast("int"), (j % 4) / 4
            straight = lambda k: p[first][k] + (p[first + 4][k] - p[first][k]) * t
            return F.when(j % 4 == 0, 0.0).otherwise(F.hypot(p[j]["x"] - straight("x"), p[j]["y"] - straight("y")))

        steps = F.sequence(F.lit(0), (4 * n).cast("int"))
        return _let(F.transform(steps, moved), lambda p: F.array_max(F.transform(steps, lambda j: gap(p, j))))

    def tried(s: Column, acc: Column) -> Column:
        def judged(d: Column) -> Column:
            # What is not finite is told by the projection itself.
            done = (d <= within) | F.isnan(d) | (d == float("inf"))
            return G.named(done=done, n=F.when(done, acc["n"]).otherwise(acc["n"] * 2))

        return F.when(acc["done"], acc).otherwise(_let(off(s, acc["n"]), judged))

    def pieces(s: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.lit(HALVINGS))
        found = F.aggregate(rounds, G.named(done=F.lit(False), n=F.lit(1)), lambda acc, _: tried(s, acc))
        n = _let(found, lambda f: F.when(f["done"], f["n"]).otherwise(F.raise_error(F.lit("an edge stays too far off")).cast("int")))
        return _let(n, lambda m: F.transform(F.sequence(F.lit(0), m - 1), lambda i: between_ends(s, i / m)))

    def ring(r: Column) -> Column:
        return F.concat(F.flatten(F.transform(G.segments(r), pieces)), F.slice(r, -1, 1))

    parts = F.transform(g["parts"], lambda p: F.transform(p, ring))
    return F.when(g["dim"] == 0, g).otherwise(F.when(g.isNotNull(), G.named(kind=g["kind"], dim=g["dim"], parts=parts).cast(G.GEOMETRY)))


def reproject(g: Column, epsg: int, source: int = 4326, within: float | None = None) -> Column:
    """A geometry in another reference system; an error if a vertex is not finite there. within: densify() first."""
    if within is not None:
        g = densify(g, epsg, within, source)

    def move(v: Column) -> Column:
        x, y = between(v["x"], v["y"], source, epsg)
        ok = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
        return F.when(ok, G.named(x=x, y=y)).otherwise(F.raise_error(F.lit("a vertex cannot be projected")).cast(G.XY))

    parts = F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, move)))
    return F.when(g.isNotNull(), G.named(kind=g["kind"], dim=g["dim"], parts=parts).cast(G.GEOMETRY))
