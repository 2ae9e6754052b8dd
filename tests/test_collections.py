"""FeatureCollections in pieces: the same features as from the whole text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from geoloom.sources import collections as C
from geoloom.sources import files


def collection(rng, n, *, nested=False, typed_last=False, long=0):
    rows = []
    for i in range(n):
        text = rng.choice(["plain", 'quote " and {"type":"Feature"} in text', "Größe ✓ 東京", "back\\slash", "]},{"]) + "x" * rng.randint(0, 40)
        f = {"type": "Feature", "properties": {"id": i, "t": text}, "geometry": {"type": "Point", "coordinates": [i, -i]}}
        if nested:
            f["properties"]["inner"] = [{"type": "Feature", "id": 1}, {"type": "Feature", "id": 2}]
        if typed_last and i % 3 == 0:
            f = dict(reversed(f.items()))
        if long and i == n // 2:
            f["properties"]["t"] = "y" * long
        rows.append(f)
    head = {"type": "FeatureCollection", "crs": {"features": [1]}, "name": "ä"}
    return head | {"features": rows, "after": {"type": "Feature"}}


@pytest.mark.parametrize("case", [{}, {"nested": True}, {"typed_last": True}, {"long": 5000}])
@pytest.mark.parametrize("style", [{"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_pieces_equal_the_whole(spark, tmp_path, monkeypatch, case, style):
    made = collection(random.Random(3), 120, **case)
    (tmp_path / "a.geojson").write_text(json.dumps(made, **style), encoding="utf-8")
    columns = {"id": "integer", "t": "string"}
    rows = lambda df: df.select("id", "t", F.to_json("geometry")).orderBy("id").collect()
    got = rows(files.read_geojson(spark, str(tmp_path), columns, piece=1000))
    assert [(r.id, r.t) for r in got] == [(f["properties"]["id"], f["properties"]["t"]) for f in made["features"]]
    assert got == rows(files.read_geojson(spark, str(tmp_path), columns))


def test_many_tasks_read_one_file(spark, tmp_path):
    made = collection(random.Random(5), 400)
    made.pop("after")
    (tmp_path / "a.geojson").write_text(json.dumps(made))
    size = (tmp_path / "a.geojson").stat().st_size
    texts = C.feature_texts(spark, str(tmp_path), size // 16)
    assert texts.count() == 400
    per = texts.groupBy(F.spark_partition_id()).count().collect()
    assert len(per) >= 12 and max(r[1] for r in per) < 80


def test_blocks_cut_characters_and_objects(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    made = collection(random.Random(8), 30)
    data = json.dumps(made, ensure_ascii=False).encode()
    at = lambda o, n: data[o : o + n]
    start = C.array_start(at, len(data))
    found = list(C.objects(at, start, C.ENDED))
    assert [json.loads(t) for _, t in found[:-1]] == made["features"] and found[-1] == (C.ENDED, None)
    assert all(data[p : p + 1] == b"{" for p, _ in found[:-1])
    assert C.first_start(at, start, len(data)) == start == found[0][0]
    with pytest.raises(ValueError):
        list(C.objects(lambda o, n: data[:-60][o : o + n], start, C.ENDED))
    with pytest.raises(ValueError, match="no FeatureCollection"):
        C.array_start(lambda o, n: b'{"type": "Feature"}'[o : o + n], 19)
