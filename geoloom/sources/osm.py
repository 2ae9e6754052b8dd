"""Areas of map relations: member ways joined at shared ends into closed rings, and rings nested into polygons with holes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.sources.files import tag_filter

Point = tuple[float, float]


def rings_of(lines: Sequence[list[Point]]) -> tuple[list[list[Point]], int]:
    """(closed rings, lines that belong to none): lines, in either direction, are joined where they end at the same place.

    Where more than two lines end at a place, a ring is closed as soon as the way comes back to a place it has been at, so
    rings that touch stay apart. A line that stands twice counts once.
    """
    unique = {min(tuple(x), tuple(reversed(x))): x for x in lines if len(x) > 1}
    rings = [x for x in unique.values() if x[0] == x[-1] and len(x) > 3]
    left = [x for x in unique.values() if x[0] != x[-1]]
    lost = len(unique) - len(rings) - len(left)
    at: dict[Point, list[int]] = {}
    for i, x in enumerate(left):
        at.setdefault(x[0], []).append(i)
        at.setdefault(x[-1], []).append(i)
    used = [False] * len(left)
    for start in range(len(left)):
        if used[start]:
            continue
        used[start] = True
        way, places = [left[start]], [left[start][0], left[start][-1]]
        while way:
            end = places[-1]
            if end in places[:-1]:  # back at a place: what lies between is a ring
                k = places.index(end)
                ring = way[k][:1] + [p for part in way[k:] for p in part[1:]]
                if len(ring) > 3:
                    rings.append(ring)
                else:
                    lost += len(way) - k
                del way[k:], places[k + 1 :]
                continue
            more = next((i for i in at[end] if not used[i]), None)
            if more is None:  # a dead end
                lost += 1
                way.pop()
                places.pop()
                continue
            used[more] = True
            part = left[more] if left[more][0] == end else left[more][::-1]
            way.append(part)
            places.append(part[-1])
    return rings, lost


def _area(ring: list[Point]) -> float:
    (x0, y0) = ring[0]
    return abs(sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:], strict=False))) / 2


def _inside(p: Point, ring: list[Point]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


def nested(rings: list[list[Point]]) -> list[list[list[Point]]]:
    """Polygons (outer ring, holes): a ring in an odd number of larger ones is a hole of the smallest of these."""
    rings = sorted((r for r in rings if _area(r) > 0), key=_area, reverse=True)
    boxes = [(min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r)) for r in rings]
    outer: dict[int, list[list[Point]]] = {}
    for i, ring in enumerate(rings):
        around = []
        for j in range(i):
            if boxes[j][0] <= boxes[i][0] and boxes[j][1] <= boxes[i][1] and boxes[j][2] >= boxes[i][2] and boxes[j][3] >= boxes[i][3]:
                own = set(rings[j])
                # A corner that the rings share says nothing; the middle of an edge does where all are shared.
                p = next((q for q in ring if q not in own), ((ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2))
                if _inside(p, rings[j]):
                    around.append(j)
        if len(around) % 2 and around[-1] in outer:
            outer[around[-1]].append(ring)
        else:
            outer[i] = [ring]
    return list(outer.values())


def relation_areas(relations: DataFrame, ways: DataFrame, tags: dict | Sequence[dict] | None = None) -> DataFrame:
    """(id, tags, geometry, lost) of relations (id, tags map, members array<struct<type, ref, role>>) with ways (id, geometry).

    Roles aren't needed: rings tell by where they lie whether they are outer or holes. lost: how many members are missing
    or belong to no closed ring; a relation without a closed ring has no geometry. A relation is put together in one task;
    relations have at most some ten thousand members.
    """
    rows = relations if tags is None else relations.filter(tag_filter(F.col("tags"), tags))
    asked = rows.select("id", F.explode("members").alias("m")).filter("m.type = 'way'").select("id", F.col("m.ref").alias("ref")).distinct()
    lines = ways.filter("geometry.dim = 1").select(F.col("id").alias("ref"), "geometry.parts")
    met = asked.join(lines, "ref", "left").select("id", "ref", "parts")
    kind = dict(rows.dtypes)["id"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        parts = [[(p["x"], p["y"]) for p in part[0]] for of in f["parts"] if of is not None for part in of]
        rings, lost = rings_of(parts)
        areas = nested(rings)
        shape = None
        if areas:
            xy = [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in areas]
            shape = {"kind": "Polygon" if len(xy) == 1 else "MultiPolygon", "dim": 2, "parts": xy}
        return pd.DataFrame({"__id": [f["id"].iloc[0]], "geometry": [shape], "lost": [lost + int(f["parts"].isna().sum())]})

    made = met.groupBy("id").applyInPandas(run, f"__id {kind}, geometry {G.GEOMETRY}, lost long")
    return rows.join(made, F.col("id") == F.col("__id"), "left").select("id", "tags", "geometry", F.coalesce("lost", F.lit(0).cast("long")).alias("lost"))
