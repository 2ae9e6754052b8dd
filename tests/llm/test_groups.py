"""Operators that compare documents or vectors with each other, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import ann, simhash, substring
from geoloom.llm._common import materialize
from tests.llm.test_text import AWKWARD, DOC, clashing

SF = "/root/testdata/sf0.001"


# --- near copies ------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for t in ("", None, "One", "one two three", "a b c d e f g a b c d", "É É x y z É", "  a\x0bb"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_masks_cover_every_pair(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    assert any((x & m % 2**64) == (y & m % 2**64) for m in simhash.masks())


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(d, low.get(find(i), d))
    return [low[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("block", [4096, 8])
def test_links_and_components(spark, block):
    rng = random.Random(11)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):  # chains of near fingerprints
            fps.append(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = materialize(spark.createDataFrame([(f, f) for f in signed], "low long, fp long").distinct(), "test")
    roots = {r.node.fp: r.root.low for r in simhash.components(simhash.links(df, block=block)).collect()}
    want = brute_components(fps, signed)
    assert [roots.get(f, f) for f in signed] == want


def test_near_duplicates_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    want = list(zip([d for d, _ in rows], [f"{f:016x}" for f in fps], brute_components(fps, [d for d, _ in rows]), strict=True))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_stage_catches_edited_copies(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, lost, groups = [], 0, 60
    for g in range(groups):
        words = [word() for _ in range(300)]
        rows.append((1000 + g, " ".join(words)))
        words[rng.randrange(300)], words[rng.randrange(300)] = word(), word()  # a similarity of about 0.93
        rows += [(2000 + g, " ".join(words)), (g, " ".join(word() for _ in range(200)))]
    rows += [(3000, rows[0][1]), (3001, rows[0][1].upper())]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in rows if d < 2000} <= kept  # first ones and all clean documents stay
    assert not {3000, 3001} & kept
    lost = len({d for d in kept if 2000 <= d < 3000})
    assert lost <= groups * 0.05


def brute_groups(texts, least=0.8, width=5):
    """The smallest id of each id's group: closure of all pairs with a Jaccard similarity of at least ``least``."""
    sets = {}
    for d, t in texts.items():
        words = t.split()
        sets[d] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in texts}


def test_stage_checks_similarity(spark):
    """Template texts of a similarity just below 0.8 stay, those above go, as brute force says; chains are followed."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = {}
    for _ in range(12):  # families of texts with a long passage in common
        passage = [word() for _ in range(300)]
        own = rng.choice([10, 25, 34, 36, 40, 50])
        for _ in range(12):
            texts[len(texts)] = " ".join(passage + [word() for _ in range(own)])
    words = [word() for _ in range(300)]
    for _ in range(20):  # a chain whose ends share little
        texts[len(texts)] = " ".join(words)
        at = rng.randrange(0, 280)
        words[at : at + 20] = [word() for _ in range(20)]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == set(brute_groups(texts).values())


def test_stage_finds_pairs_at_the_threshold(spark):
    """Nearly all pairs of a similarity from 0.8 to 0.85 are found."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = {}
    for g in range(200):
        passage = [word() for _ in range(300)]
        for i in (0, 1):
            texts[2 * g + i] = " ".join(passage + [word() for _ in range(30)])
    want = brute_groups({d: texts[d] for d in (0, 1)})
    assert want == {0: 0, 1: 0}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert {2 * g for g in range(200)} <= kept
    assert len(kept) <= 202


def test_refused_links_do_not_hide_others(spark):
    """A second round takes the links that a unit's spanning forest left out."""
    sk = np.zeros((5, 8), np.uint64)
    for i, bits in enumerate((0, 1, 3, 7, 15)):
        sk[i, 0] = bits
    rows = [(i, [7], sk[i].tobytes(), 10) for i in range(5)]
    kinds = spark.createDataFrame(rows, "node long, bands array<long>, sk binary, size long")
    # 1 to 4 are near in bits but share nothing with each other; 0 and 4, the ends, are alike.
    sets = {0: range(10), 4: range(11), **{i: range(100 * i, 100 * i + 10) for i in (1, 2, 3)}}
    made = spark.createDataFrame([(i, np.array(list(s), "<u8").tobytes()) for i, s in sets.items()], "node long, grams binary")
    for block in (4096, 2):
        got = simhash.similar_groups(kinds, lambda nodes: made.join(nodes, "node"), block=block).collect()
        assert {(r.node, r.root) for r in got} == {(0, 0), (4, 0)}


def test_stage_finds_copies_by_fingerprints_alone(spark):
    """Without min-wise keys the covering tables give all pairs within the radius; the sets are checked then."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for g in range(40):
        words = [word() for _ in range(400)]
        rows.append((2 * g, " ".join(words)))
        words[-1 - g % 3] = word()
        rows.append((2 * g + 1, " ".join(words)))
    rows += [(80, "a b c d e f g " * 9), (81, "a b c d e f g " * 2 + "a b c d " * 9)]
    fps = {d: simhash.fingerprint(t, 5) for d, t in rows}
    near = {d for d in range(1, 80, 2) if (fps[d] ^ fps[d - 1]).bit_count() <= simhash.RADIUS}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tables=0).collect()}
    assert len(near) > 20
    assert not near & kept
    assert {0, *range(2, 80, 2), 80, 81} <= kept  # some that are just outside the radius meet as well, and are alike


def test_near_duplicates_awkward(spark):
    df = spark.createDataFrame(AWKWARD, DOC)
    got = simhash.near_duplicates(clashing(df)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    kept = simhash.drop_near_duplicates(clashing(df))
    assert kept.columns == clashing(df).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "7", "8", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


# --- repeated passages ------------------------------------------------------------------------------------------


def brute_substrings(rows):
    seen, out = set(), {}
    for d, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            words += p[a : rng.randint(a, len(p))] if rng.random() < 0.6 else [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        rows.append((d, " ".join(words)))
    return [*rows, (60, "the " * 50), (61, "the " * 19), (62, "the " * 20), (63, rows[3][1])]


@pytest.mark.parametrize(("seed", "batches"), [(1, 1), (2, 2), (3, 4)])
def test_substrings(spark, seed, batches):
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring.digests(df, batches).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_substrings(rows)


def test_index_grows_and_compacts(spark):
    """What an index holds counts as earlier; compaction changes no result."""
    rows = passages(4)
    index = substring.FingerprintIndex(spark, buckets=3)
    got = {}
    for k in range(8):
        part = spark.createDataFrame(rows[k * 8 : (k + 1) * 8], "doc_id long, text string")
        out = substring.substring_dedup(part, 1, index)
        got |= {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()}
    assert got == brute_substrings(rows)
    assert len(index.runs) <= substring.FANOUT
    index.compact()
    assert len(index.runs) == 1
    twice = substring.substring_dedup(spark.createDataFrame([(0, rows[5][1])], "doc_id long, text string"), 1, index).first()
    assert twice.n_removed == (twice.n_words if twice.n_words >= 20 else 0)
    index.close()


def test_ranking_sorts_once(spark):
    """The ranking of a run takes one sort and one window; late marks all but the first row of a kind."""
    rows = [(1, 5, 3, 0, 0, False), (1, 5, 2, 0, 0, False), (1, 7, 1, 0, 0, False), (2, 5, 9, 0, 0, False), (2, 5, 0, 0, 0, True)]
    ranked = substring._ranked(spark.createDataFrame(rows, substring.FingerprintIndex.RUN))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Sort ["), plan.count("Window [")) == (1, 1)
    got = sorted((r.f, r.g, r.o, r.late, r.low, r.high) for r in ranked.collect())
    assert got == [(1, 5, 2, False, 5, 7), (1, 5, 3, True, 5, 7), (1, 7, 1, False, 5, 7), (2, 5, 9, False, 5, 5)]


def test_window_hashes_come_in_few_batches():
    """Documents that are verified share batches of rows."""
    zip_, text = zstandard.ZstdCompressor(), " ".join(f"w{i}" for i in range(40)).encode()
    n = 600
    place = 3 << substring.C_BITS + substring.N_BITS | 2
    columns = [pa.array(range(n)), pa.array([0] * n), pa.array([zip_.compress(text)] * n), pa.array([[place]] * n)]
    out = list(substring._windows_of(iter([pa.RecordBatch.from_arrays(columns, ["o", "k", "z", "places"])])))
    assert len(out) == 3
    assert sum(b.num_rows for b in out) == 2 * n


def test_index_opens_again(spark, tmp_path):
    rows = passages(7)
    whole = brute_substrings(rows)
    take = lambda a, b: spark.createDataFrame(rows[a:b], "doc_id long, text string")
    got = {}
    for a, b in ((0, 20), (20, 40), (40, 64)):  # a new index object, as in a new session, for every batch
        with substring.FingerprintIndex(spark, str(tmp_path / "index"), 3, keep=True) as index:
            out = substring.substring_dedup(take(a, b), 1, index).collect()
        got |= {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out}
    assert got == whole
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints_")]


def test_many_rows_without_id(spark):
    """Texts without an id, or with one id, are documents of their own; which of equal passages stays is not fixed."""
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(None, " ".join(f"n{rng.randrange(10**9)}" for _ in range(rng.randint(0, 45)))) for _ in range(5000)]
    rows += [(5, f"a{i} b{i} {shared}") for i in range(40)] + [(None, f"c{i} {shared}") for i in range(40)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert all(r.kept == r.text for r in got if shared not in r.text)
    hit = [r for r in got if shared in r.text]
    assert sorted(r.n_removed for r in hit) == [0] + [30] * 79
    assert [r.doc_id for r in hit if not r.n_removed] == [5]


def test_substrings_awkward(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [*AWKWARD, (9, long, "en", "a", 1), (9, long, "en", "a", 1), (9, long + " more", "en", "a", 1), (None, long, "en", "a", 1)]
    df = spark.createDataFrame(rows, DOC)
    got = substring.substring_dedup(clashing(df)).collect()
    assert len(got) == len(rows)
    nine = sorted((r.n_words, r.n_removed) for r in got if r.doc_id == 9)
    assert nine in ([(30, 0), (30, 0), (31, 30)], [(30, 30), (30, 30), (31, 0)])
    assert [r.n_removed for r in got if r.doc_id is None and r.n_words == 30] == [30]
    # The same row in several partitions is one document, too.
    apart = spark.createDataFrame([(1, long)], "doc_id long, text string")
    apart = apart.union(apart).union(apart).union(spark.createDataFrame([(2, "x " + long)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in substring.substring_dedup(apart).collect()) == [(1, 0), (1, 0), (1, 0), (2, 30)]
    assert [r.n_words for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert substring.digests(df.limit(0)).count() == 0


# --- vectors ----------------------------------------------------------------------------------------------------


def brute_nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), d[i]) for i in order]


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = rows.toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float)
    out = ann.nearest(rows).toPandas()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        want, got = brute_nearest(ids, x, q), out[out.query_id == q].sort_values("rank")
        assert list(got["rank"]) == list(range(1, 11))
        at = {int(v): i for i, v in enumerate(ids)}
        for v, s in zip(got.vec_id, got.score, strict=True):
            assert s == pytest.approx(np.sqrt(((x[at[q]] - x[at[v]]) ** 2).sum()), rel=1e-12)
        hit += len({v for v, _ in want} & set(got.vec_id))
        total += 10
    assert hit / total >= 0.95


@pytest.mark.parametrize("kind", ["shift 10", "shift 100", "uneven", "huge", "two far groups", "many groups"])
def test_recall_wherever_vectors_lie(spark, kind):
    rng = np.random.default_rng(11)
    n = 6000
    x = rng.normal(size=(n, 64))
    if kind.startswith("shift"):
        x += float(kind.split()[1])
    if kind == "uneven":
        x *= np.exp(rng.normal(0, 1, (n, 1)))
    if kind == "huge":
        x *= 1e20
    if kind == "two far groups":
        x += 1000 * rng.choice([-1, 1], (n, 1))
    if kind == "many groups":
        x += 100 * rng.normal(size=(200, 64))[rng.integers(0, 200, n)]
    out = ann.nearest(spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)})), every=200).toPandas()
    hit = sum(len({v for v, _ in brute_nearest(np.arange(n), x, q)} & set(out[out.query_id == q].vec_id)) for q in range(0, n, 200))
    assert len(out) == 300 and hit / len(out) >= 0.95


def test_many_tiles_and_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 7))
    x[50:250] = x[50]  # a large group of copies
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.usable(df)
    quantizer = ann.train(rows)
    table = ann.indexed(rows, quantizer)
    out = ann.search(table, table.filter("vec_id % 50 = 0"), quantizer, block=60, query_block=3).toPandas()
    ids = np.arange(400)
    for q in range(0, 400, 50):
        got = out[out.query_id == q].sort_values("rank")
        if 50 <= q < 250:
            assert list(got.vec_id) == [i for i in range(50, 62) if i != q][:10]
        else:
            assert len({v for v, _ in brute_nearest(ids, x, q)} & set(got.vec_id)) >= 9


def test_recall_at_full_blocks(spark):
    """Several blocks of the default size, random vectors, which are the hardest."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2 * ann.BLOCK, 32))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    out = ann.nearest(df, every=2000).toPandas()
    hit = sum(len({v for v, _ in brute_nearest(np.arange(len(x)), x, q)} & set(out[out.query_id == q].vec_id)) for q in range(0, len(x), 2000))
    assert hit / len(out) >= 0.93
    # With a rerank of the whole table the search is exact.
    few = df.filter("vec_id < 3000")
    out = ann.nearest(few, every=500, rerank=3000).toPandas()
    for q in range(0, 3000, 500):
        assert list(out[out.query_id == q].sort_values("rank").vec_id) == [v for v, _ in brute_nearest(np.arange(3000), x[:3000], q)]


def test_one_id_for_many_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(7, [float(v) for v in rng.normal(size=4)]) for _ in range(300)] + [(100, [0.5, 0.5, 0.5, 0.5]), (100, [0.5, 0.5, 0.5, 0.4]), (8, [9.0, 9.0, 9.0, 9.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.query_id for r in out] == [100] * 10
    assert [r.vec_id for r in out] == [7] * 10
    assert [r.score for r in out] == sorted(r.score for r in out)


def test_vectors_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0]), (7, [1.0, 0.5]), (None, [1.0, 0.1]), (8, [1.0, 0.5]), (8, [1.0, 0.5]), (100, [nan, 0.0]), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in ann.nearest(df).orderBy("rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 8)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_codes_penalise_parallel_errors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    own = ann.Quantizer.fit(x)
    plain = ann.Quantizer(own.centroids, 1.0)
    u = x / np.linalg.norm(x, axis=1)[:, None]

    def along(q):
        codes = q.encode(x)
        near = q.centroids[np.arange(32), codes].reshape(len(x), -1)
        return (((x - near) * u).sum(1) ** 2).mean()

    assert along(own) < along(plain)
    assert own.pack(own.encode(x)).shape == (3000, 16)
