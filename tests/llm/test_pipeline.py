"""The pipeline stage by stage: what each keeps of its own input."""

import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as cp
from geoloom.llm import simhash
from geoloom.llm._common import shared_dir
from tests.llm.test_groups import brute_groups
from tests.llm.test_text import AWKWARD, DOC, brute_lines, brute_repeats, brute_targets, clashing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        made = stage(spark, docs, SF)
        path = str(tmp_path_factory.mktemp("p") / name)
        made.write.parquet(path)
        out.append((docs.toPandas(), spark.read.parquet(path).toPandas()))
        docs = spark.read.parquet(path)
    return out


def test_stages(steps):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "bpe_encode"]
    for before, after in steps[:4]:
        assert list(before.columns) == list(after.columns)


def test_quality_stage(steps):
    before, after = steps[0]
    kept = set(after.doc_id)
    for d, t in zip(before.doc_id, before.text, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        if len(words) < 10 or 100 * brute_repeats(words) > 20 * len(words):
            assert d not in kept
    assert len(after) > 0.8 * len(before)


def test_line_stage(steps):
    before, after = steps[1]
    want = brute_lines(list(zip(before.doc_id, before.text, strict=True)))
    assert {d: (t, n) for d, t, n in zip(after.doc_id, after.text, after.n_chars, strict=True)} == {d: (t, len(t)) for d, (t, _) in want.items()}


def test_near_stage(steps):
    before, after = steps[2]
    texts = dict(zip(before.doc_id, before.text, strict=True))
    kept = set(after.doc_id)
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = {d: " ".join(re.findall(r"[^\x20\x09-\x0D]+", fold(t))) for d, t in texts.items()}
    assert kept == set(brute_groups(words, simhash.SIMILAR, cp.SHINGLE).values())
    assert all(texts[d] == t for d, t in zip(after.doc_id, after.text, strict=True))


def test_mixing_stage(steps):
    before, after = steps[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, after = before.assign(size=before.text.map(size)), after.assign(size=after.text.map(size))
    want = brute_targets(before.groupby("source")["size"].sum().to_dict())
    got = after.groupby("source")["size"].sum().to_dict()
    for s, t in want.items():
        assert abs(got.get(s, 0) - t) <= 5 or abs(got.get(s, 0) - t) <= before["size"].max()
    assert max(Counter(after.doc_id).values()) <= 3


def test_run_leaves_only_its_result(spark):
    # A running session does not take another shared folder, so what is new in its own one counts.
    held = Path(shared_dir(spark).removeprefix("file:"))
    before = set(held.iterdir()) if held.exists() else set()
    assert cp.run(spark, SF).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(held.iterdir()) - before] == ["pipeline-bpe_encode"]


def test_tokens_stage(steps):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    _, after = steps[4]
    for t, ids, text in zip(after.text, after.ids, after.decoded, strict=True):
        want = ref.encode(t, add_special_tokens=False).ids
        assert list(ids) == want
        assert text == ref.decode(want, skip_special_tokens=False)


def test_awkward_rows_pass_all_stages(spark):
    docs = clashing(spark.createDataFrame(AWKWARD, DOC))
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    empty = spark.createDataFrame([], DOC)
    for _, stage in cp.STAGES:
        empty = spark.createDataFrame([], stage(spark, empty, SF).schema)
    assert "ids" in empty.columns
