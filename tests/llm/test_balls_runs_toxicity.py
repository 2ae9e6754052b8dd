"""Ball k-means, periodic runs and toxicity: brute force, held-out accuracy and awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import balls, queries, runs, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
VEC = "vec_id long, embedding array<double>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- clusters -----------------------------------------------------------------------------------------------------


def plain_rounds(rows, k=16, rounds=3, dimensions=64):
    """Lloyd's rounds on (vec_id, vector): by vec_id, (cluster, distance, own inertia, inertia, digest)."""
    good = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    centroids = [r[1] for r in order[:k]]
    for turn in range(rounds + 1):
        d = np.array([[((v - c) ** 2).sum() for c in centroids] for _, v in good])
        of = d.argmin(1)
        if turn < rounds:
            centroids = [np.array([v for (_, v), c in zip(good, of, strict=True) if c == j]).sum(0) // (of == j).sum() if (of == j).any() else c0 for j, c0 in enumerate(centroids)]
    best, out = d.min(1), []
    for (i, _), c, x in zip(good, of, best, strict=True):
        digest = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        out.append((i, int(c), int(x), int(best[of == c].sum()), int(best.sum()), digest))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_query_equals_plain_rounds(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert rows_of(queries.op11_ball_kmeans(spark, SF)) == plain_rounds([(r.vec_id, r.embedding) for r in table.collect()])


@pytest.mark.parametrize("kind", ["normal", "far", "grid", "copies", "few"])
def test_ball_kmeans_equals_plain_rounds(spark, kind):
    rng = np.random.default_rng(5)
    n = 6 if kind == "few" else 400
    x = rng.normal(0, 1, (n, 4))
    if kind == "far":
        x = x * 0.01 + rng.integers(0, 5, (n, 1)) * 1000.0 - 2000
    if kind == "grid":  # many equal distances
        x = rng.integers(-1, 2, (n, 4)) / 64
    if kind == "copies":
        x[: n // 2] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert rows_of(balls.ball_kmeans(spark.createDataFrame(rows, VEC), dimensions=4)) == plain_rounds(rows, dimensions=4)


def test_far_members_meet_few_centroids():
    centroids = np.arange(10)[:, None] * np.array([[1000, 0]])
    of = balls.Balls.of(centroids, np.full(10, 100.0))
    assert all(len(n) == 0 for n in of.neighbours)
    of = balls.Balls.of(centroids, np.full(10, 501.0))
    assert [n.tolist() for n in of.neighbours][:2] == [[1], [0, 2]]


def test_ball_kmeans_awkward_rows(spark):
    zero = [0.0, 0.0]
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 0.0]), (7, [1e9, 0.0]), (8, zero), (8, zero), (None, [1.0, 2.0]), (9, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, VEC).withColumns({n: F.lit(1) for n in ("v", "cluster", "distance", "inertia", "h", "n")})
    out = balls.ball_kmeans(df, k=3, dimensions=2).collect()
    assert sorted((r.vec_id or 0) for r in out) == [0, 8, 8, 9]
    empty = balls.ball_kmeans(df.filter("vec_id < 8"), dimensions=2)
    assert empty.columns == balls.ball_kmeans(df, dimensions=2).columns and empty.count() == 0


def test_rounds_leave_one_table(spark, tmp_path):
    from geoloom.plans.stages import scratch

    with scratch(spark) as left:
        before = len(left)
        assert balls.ball_kmeans(spark.read.parquet(f"{SF}/embeddings.parquet")).count() > 0
        kept = [p for p in left[before:] if spark.sparkContext._jvm.java.io.File(p).exists()]
    assert len(kept) == 1


# --- runs ---------------------------------------------------------------------------------------------------------


def brute_runs(words, least=24, times=3):
    """Every stretch by trying all periods at all places; (start, length, period) by start, then period."""
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, k, p) for (s, k), p in found.items()), key=lambda r: (r[0], r[2]))


words_with_runs = st.lists(
    st.one_of(
        st.lists(st.integers(0, 2), max_size=12),
        st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(10, 70)).map(lambda t: (t[0] * 70)[: t[1]]),
    ),
    max_size=5,
).map(lambda parts: [w for p in parts for w in p])


@settings(max_examples=150, deadline=None)
@given(st.lists(words_with_runs, min_size=1, max_size=5), st.sampled_from([24, 6, 1]))
def test_runs_equal_brute_force(texts, least):
    got = runs.find_runs([np.array(t, np.int64) for t in texts], least)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(t, least) for t in texts]


def test_long_periods_and_texts():
    w = list(range(2000)) * 3
    assert runs.find_runs([np.array(w)])[0].tolist() == [[0, 6000, 2000]]
    assert runs.find_runs([np.zeros(300_000, np.int64)])[0].tolist() == [[0, 300_000, 1]]
    assert [len(r) for r in runs.find_runs([np.arange(5), np.empty(0, np.int64), np.zeros(23, np.int64), np.zeros(24, np.int64)])] == [0, 0, 0, 1]


def brute_row(doc_id, text):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, k, p in found for i in range(s + p, s + k)}
    best = None
    for r in found:  # the greatest quotient, compared without division
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda b: hashlib.sha256(b).hexdigest()
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{k},{p}\n" for s, k, p in found)
    return (doc_id, len(found), *facts, digest(listed.encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_equals_brute_force(spark, docs):
    got = queries.op12_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == {brute_row(r.doc_id, r.text) for r in docs.collect()}
    assert got.filter("n_runs > 0").count() > 10


def test_runs_awkward_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one two", "a " * 50, "ab cd ef " * 30, "a\ud800b x " * 20, "x" * 100_000, " ".join(rng.choice("ab") for _ in range(3000)), "a b c " * 20 + "d " * 30 + "a b c " * 20]
    texts = [t.encode("utf-8", "ignore").decode() if t else t for t in texts]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(4, "a " * 50, None, None, None), (None, "b c " * 30, None, None, None), (10**15, "q r s t " * 40, "x", "y", 1)]
    df = spark.createDataFrame(rows, DOC).withColumns({n: F.lit(1) for n in ("n_runs", "start", "period", "Length", "x", "slot")})
    got = sorted(map(str, (tuple(r) for r in runs.run_documents(df).collect())))
    assert got == sorted(str(brute_row(r[0], r[1])) for r in rows)
    assert runs.run_documents(df.filter("false")).count() == 0
    wide = runs.periodic_runs(df)
    assert wide.count() == len(rows) and wide.columns[:2] == ["doc_id", "text"] and "n_runs" in wide.columns


# --- toxicity -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return toxicity.CharModel.of(toxicity.count_chars(docs.filter(~toxicity.held_out())))


def test_toxic_held_out_accuracy(spark):
    out = queries.op13_toxicity(spark, "/root/testdata/sf0.1")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.join(labels, "doc_id", "left").toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    held = rows[rows.held_out & rows.toxic.notna()]
    assert (held.toxic == held.predicted).mean() > 0.97
    assert held[held.toxic == 0].predicted.mean() < 0.005
    # Ranked by score, nearly all toxic ones come first.
    order = held.score.rank()
    pos, neg = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (order[held.toxic == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) > 0.92
    by_id = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id}
    assert (rows.held_out == rows.doc_id.map(by_id)).all()


HIDDEN = ["1d10t", "m.o.r.o.n", "stuuuupid", "l o s e r", "st*pid", "$tup1d", "p@thet1c", "looooser", "d1sgu5ting", "w0rthless", "S C U M", "i-d-i-o-t", "TRA5H", "cl0wn"]
PLAIN = ["idiot", "moron", "stupid", "loser", "stupid", "stupid", "pathetic", "loser", "disgusting", "worthless", "scum", "idiot", "trash", "clown"]


def test_hidden_words_are_restored_and_scored(spark, model):
    read = toxicity.Restorer(model)
    assert [read(h) for h in HIDDEN] == PLAIN
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.train(docs.filter(~toxicity.held_out()).select("doc_id", "text"), labels.filter(~toxicity.held_out()), model)
    ahead, behind = "The tion of and then hereat you are ", " is in the hestion of ndhent."
    assert all(scorer.score(read(f"{ahead}{h}{behind}")) > 0.5 for h in HIDDEN)
    assert scorer.score(read(f"{ahead}ndtion{behind}")) < 0.2


def brute_decode(s, model):
    """The least cost over all ways through the lattice."""
    single, found = len(toxicity.WORDS.findall(s)) > 2, [("", 0.0)]
    for unit in toxicity.RUNS.finditer(s):
        found = [(a + b, x + y) for a, x in found for b, y in toxicity.meanings(unit[1], len(unit[0]), single)]

    def lm(t):
        c = [k for i, k in enumerate([0, 0, *map(toxicity.class_of, t), 0])]
        out, key = 0.0, 0
        for k in c:
            if k:
                out += model.cost[key << 6 | k]
                key = (key & 63) << 6 | k
            elif key:
                out += model.cost[key << 6]
                key = 0
        return out

    return min(x + lm(t) for t, x in found), {t: x + lm(t) for t, x in found}


@settings(max_examples=120, deadline=None)
@given(s=st.text("a1ts@.!* 0o", min_size=1, max_size=9))
def test_decoding_is_the_cheapest_way(model, s):
    least, cost = brute_decode(s, model)
    assert cost[toxicity.decode(s, model)] == pytest.approx(least)


def test_plain_words_stay(spark, model, docs):
    read = toxicity.Restorer(model)
    for t in ["Well-known letters, e-mail!", "a b", "The year 2024: 3.5 million.", "don't — naïve Größe", ""]:
        assert read(t) == t.lower()
    assert read(None) == ""
    out = toxicity.restore(docs.withColumn("Restored", F.lit(1)), model)
    plain = out.filter("NOT text RLIKE '[0-9@$!|+*#_~]'").filter("NOT text RLIKE '(.)\\\\1\\\\1'").filter("NOT text RLIKE '\\\\b\\\\w[ .-]{1,2}\\\\w[ .-]'")
    assert plain.count() > 50 and plain.filter("restored <> lower(text)").count() == 0


def test_toxicity_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "idiot"), (4, "idiot"), (None, "idiot"), (5, "a b c " * 20_000), (6, "x" * 100_000), (7, "Σίσυφος 日本語 İ ẞ"), (8, "1 " * 500)]
    rows += [(i, "you idiot of words" if i % 3 == 0 else "plain good words") for i in range(10, 60)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOC).withColumns({n: F.lit(1) for n in ("score", "Predicted", "toxic", "word", "n0")})
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(10, 60)] + [(10, 0), (None, 1), (4, None), (999, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in out if r.doc_id and r.doc_id >= 10)
    assert min(r.score for r in out if r.doc_id in (None, 4)) > max(r.score for r in out if r.doc_id in (1, 2, 3)) and len({r.score for r in out if r.doc_id in (None, 4)}) == 1
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    assert toxicity.score_documents(docs.filter("false"), labels).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, labels.filter("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.score_documents(docs, labels.filter("toxic = 1")).collect()} == {1.0}
    wide = toxicity.score(docs, toxicity.CharModel.of(np.zeros(64**3)), toxicity.Scorer())
    assert wide.count() == len(rows) and wide.columns.count("score") == 1
