"""Repaired polygons: many at once give what each by itself gives."""

import random

import pytest

from geoloom.functions import geometry as G
from geoloom.operators import polygons as P


def rings(rng):
    out = [[(0, 0), (n, n), (n, 0), (0, n), (0, 0)] for n in (1, 2, 7, 50)]  # bow ties
    out += [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (3, 0), (6, 0), (0, 0)], [(0, 0), (0, 5), (0, 9), (0, 0)], [(2, 2)]]
    # Intervals that touch, and one that begins where another one ends.
    out += [[(0, 0), (4, 0), (4, 2), (0, 2), (0, 0), (0, 2), (4, 2), (4, 5), (0, 5), (0, 0)], [(0, 0), (5, 0), (5, 1), (1, 1), (1, 3), (5, 3), (5, 4), (0, 4), (0, 0)]]
    for n in (3, 4, 5, 6, 9, 40):
        for _ in range(6):
            ring = [(rng.choice([rng.uniform(-9, 9), float(rng.randint(-3, 3))]), rng.choice([rng.uniform(-9, 9), float(rng.randint(-3, 3))])) for _ in range(n)]
            out.append([*ring, ring[0]])
    return out


def test_side_by_side_as_one_by_one(spark, monkeypatch):
    shapes = [[[r]] for r in rings(random.Random(2))]
    shapes += [[a[0], b[0]] for a, b in zip(shapes[:20], shapes[20:40], strict=True)] + [[[a[0][0], b[0][0]]] for a, b in zip(shapes[5:15], shapes[25:35], strict=True)]
    one = [P.trapezoids([[s]], lambda n: n[0] > 0) for s in shapes]
    asked = []
    real = P.trapezoids
    monkeypatch.setattr(P, "trapezoids", lambda *a: asked.append(1) or real(*a))
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(f"g {G.GEOMETRY}")).field("g").type
    given = pa.array([[[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in s] for s in shapes], kind.field("parts").type)
    for column in (given, pa.concat_arrays([given[:7], given])[7:]):
        got, area = P._rebuilt_batch(column, kind)
        assert got.to_pylist() == [P.multi(c) for c in one]
        assert area.tolist() == pytest.approx([P.total_area(c) for c in one], rel=1e-12, abs=1e-12)
    assert len(asked) < len(shapes)  # most of them side by side: before, each was cut by itself, twice over
    assert P._rebuilt_batch(given[:0], kind)[0].to_pylist() == []
