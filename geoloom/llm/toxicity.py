"""Toxicity with a noisy channel: restore what leetspeak, spacing and repetition hide, then score the restored text.

A writer of "1d10t", "m.o.r.o.n" or "stuuupid" had a plain word in mind; the channel put stand-ins for letters, marks
between them, or repeated them. A stretch that may be such a spelling becomes a lattice: each character, or run of equal
ones, has the strings that it may stand for, each with its cost. Viterbi finds the cheapest way through it: the costs of
the channel, and those of a character language model of three letters, whose counts come from all texts that are not held
out. A stretch whose lattice has a single way is as it was; only others are decoded.

Words of restored texts are counted in the labelled texts that are not held out, once a text, and those that tell the labels
apart best make the vocabulary. A text's evidence is in the words that it has of these: the strongest for, the sum of the
five strongest, and the strongest against; each word counts with the nearer end of an interval around its log odds, so that
rare words say little. A logistic regression on these, fitted to a bounded sample, gives the score. A labelled text's own
words don't count towards its own evidence when it is fitted.

Bounded: the language model (ALPHABET**3 counts), the vocabulary (VOCABULARY words), the sample (FIT_ROWS labelled texts,
about, drawn by a hash). Counts cover all texts that are not held out.

Defined results: a null, empty or wordless text has no evidence, and the score is what the regression says of none. Without
labelled rows of both kinds the score is the share of toxic ones, 0 if there are none. Labels of an unknown document or
without an id or label don't count; of several labels of a document the greatest counts. Repeated rows each have their row;
rows without an id are not held out. Very long texts are restored and scored whole. Columns that clash with an output column are
replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm._common import slices, wider

#: Classes of characters: 0 no letter or digit, 1-26 letters without accents, 27-36 digits, 37 other letters.
ALPHABET = 64
VOCABULARY, LEAST_TEXTS, FIT_ROWS = 4000, 3, 20_000
#: Words that a task holds before it passes their counts on.
HELD_WORDS = 400_000
#: How sure the log odds of a word must be, in standard errors.
SURE = 1.64

# The letters that a character may stand for.
STAND_INS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
#: Marks that are put between letters, or in place of a vowel.
MARKS, MASKS, VOWELS = ".-_~*'", "*#", "aeiou"
#: Costs of the channel in nats: a stand-in, a masked vowel, a mark or a blank between letters that stand alone, a mark in
#: a word, a repetition that is undone, a symbol or blank that hides nothing where one would.
STOOD, MASKED, MARKED, JOINED, REPEATED, KEPT = 1.0, 2.5, 0.5, 4.0, 0.5, 4.0

WORDS = re.compile(r"[^\W_]+")
#: Something that a plain text has none of: without it there is no lattice in a text.
ANY = re.compile(r"[0-9@$!|+*#€£_~]|([^\W\d_])\1\1|(?<!\w)[^\W_](?:[ .\-']{1,2}[^\W_](?!\w)){2}")
#: Single characters with marks or blanks between them, or a word that stand-ins are part of.
STRETCH = re.compile(r"(?<![\w@$])[\w@$](?:[ .\-_~*']{1,2}[\w@$!|](?![\w@$])){2,}|(?:[\w@$]|[!|](?=\w))(?:[\w@$!|+*#.\-~'€£]*[\w@$])?")
#: What makes such a word one to decode.
HIDDEN = re.compile(r"[0-9@$!|+*#€£~]|([^\W\d_])\1\1|(?<![^\W_])[^\W_](?:[ .\-_~*']{1,2}[^\W_](?![^\W_])){2}")
LETTER = re.compile(r"[^\W\d_]")
RUNS = re.compile(r"(.)\1*", re.DOTALL)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=100_000)
def class_of(char: str) -> int:
    """The class of a lower-case character."""
    base = unicodedata.normalize("NFKD", char)[0]
    if "a" <= base <= "z":
        return ord(base) - 96
    if "0" <= base <= "9":
        return ord(base) - 21
    return 37 if char.isalpha() else 0


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, as a lower-case character."""
    return np.fromiter((class_of(chr(c).lower()[0]) for c in range(0x110000)), np.uint8, 0x110000)


@dataclass
class CharModel:
    """cost[a << 12 | b << 6 | c]: nats for class c after a and b."""

    cost: list[float]

    @classmethod
    def of(cls, counts: np.ndarray) -> CharModel:
        n = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
        part = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1)
        p = 0.7 * part(n) + 0.2 * part(n.sum(0))[None] + 0.09 * part(n.sum((0, 1)))[None, None] + 0.01 / ALPHABET
        return cls((-np.log(p)).ravel().tolist())


def count_chars(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each three classes follow each other in all texts; words are set apart by two of class 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ALPHABET**3, np.int64)
        for b in slices(batches, 64):
            cp = np.frombuffer(" ".join(["", *(t for t in b.column(text).to_pylist() if t), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            c = _classes()[cp].astype(np.int32)
            c = c[np.r_[True, (c[1:] > 0) | (c[:-1] > 0)]]
            c = np.repeat(c, np.where(c > 0, 1, 2))
            seen += np.bincount(c[:-2] << 12 | c[1:-1] << 6 | c[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["gram", "n"])

    out = np.zeros(ALPHABET**3, np.int64)
    # At most ALPHABET**3 rows.
    for gram, n in docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out


@lru_cache(maxsize=4096)
def meanings(char: str, n: int, single: bool) -> tuple[tuple[str, float], ...]:
    """(what n equal characters may stand for, its cost); single: they are between letters that stand alone."""
    same = (char * n, 0.0)
    if char in STAND_INS:
        letters = [(x, STOOD + (REPEATED if n > 1 else 0)) for x in STAND_INS[char]]
        plain = (char * n, KEPT if n == 1 and not char.isdigit() else 0.0)
        return (plain, *letters, *([(2 * x, STOOD * 2) for x, _ in letters] if n > 1 else []))
    if char == " ":
        return ((char, KEPT), ("", MARKED)) if single and n == 1 else (same,)
    if char in MARKS or char in MASKS:
        if n > 1:
            return (same, ("", JOINED))
        vowels = [(v, MASKED) for v in VOWELS] if char in MASKS else []
        return ((char, KEPT if single or vowels else 0.0), ("", MARKED if single else JOINED), *vowels)
    if n > 2 and char.isalpha():
        return (same, (char, REPEATED), (2 * char, REPEATED)) if n == 3 else ((char, REPEATED), (2 * char, REPEATED))
    return (same,)


def decode(stretch: str, model: CharModel) -> str:
    """The cheapest reading of a lower-case stretch; of equal ones the first in the order of meanings()."""
    lm, single = model.cost, len(WORDS.findall(stretch)) > 2
    ways: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last two classes: cost and what was read
    for unit in RUNS.finditer(stretch):
        new: dict[int, tuple[float, tuple | None]] = {}
        for out, extra in meanings(unit[1], len(unit[0]), single):
            classes = [class_of(c) for c in out]
            for key, (cost, read) in ways.items():
                cost += extra
                for c in classes:
                    if c:
                        cost += lm[key << 6 | c]
                        key = (key & 63) << 6 | c
                    elif key:
                        cost += lm[key << 6]
                        key = 0
                if key not in new or cost < new[key][0]:
                    new[key] = (cost, (read, out))
        ways = new
    _, read = min(((cost + (lm[key << 6] if key else 0.0), read) for key, (cost, read) in ways.items()), key=lambda w: w[0])
    parts = []
    while read:
        read, out = read
        parts.append(out)
    return "".join(reversed(parts))


class Restorer:
    """Restores texts; readings of short stretches are remembered, up to a bound."""

    def __init__(self, model: CharModel) -> None:
        self.model = model
        self.short = lru_cache(maxsize=50_000)(lambda s: decode(s, model))

    def word(self, found: re.Match) -> str:
        s = found[0]
        if not HIDDEN.search(s) or not LETTER.search(s):
            return s
        return self.short(s) if len(s) < 40 else decode(s, self.model)

    def __call__(self, text: str | None) -> str:
        text = (text or "").lower()
        return STRETCH.sub(self.word, text) if ANY.search(text) else text


def restore(docs: DataFrame, model: CharModel, text: str = "text", out: str = "restored") -> DataFrame:
    """docs with the restored lower-case text."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != out.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Restorer(model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([read(t.as_py()) for t in b.column(text)], pa.string())], [*b.schema.names, out])

    return docs.mapInArrow(run, wider(docs, (out, "string")))


def count_words(texts: DataFrame, model: CharModel) -> DataFrame:
    """(word, n0, n1): in how many restored texts of texts (text, toxic) with label 0 and 1 a word is; "" is in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen = Restorer(model), ({}, {})

        def passed() -> Iterator[pa.RecordBatch]:
            for label, own in enumerate(seen):
                words, n = pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())
                none = pa.array(np.zeros(len(own), np.int64))
                yield pa.RecordBatch.from_arrays([words, *((none, n) if label else (n, none))], ["word", "n0", "n1"])
                own.clear()

        for b in slices(batches):
            for t, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = seen[label > 0]
                for w in {"", *WORDS.findall(read(t))}:
                    own[w] = own.get(w, 0) + 1
                if len(seen[0]) + len(seen[1]) > HELD_WORDS:
                    yield from passed()
        yield from passed()

    return texts.select("text", "toxic").mapInArrow(run, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@dataclass
class Scorer:
    """words: in how many texts of label 0 and 1 each is; all: how many texts there are; weights of the regression."""

    words: dict[str, tuple[int, int]] = field(default_factory=dict)
    all: tuple[int, int] = (0, 0)
    weights: np.ndarray | None = None

    def odds(self, n0: int, n1: int, without: int | None = None) -> float:
        """The end nearer to 0 of an interval around a word's log odds; 0 if it holds 0."""
        a0, a1 = self.all
        if without is not None:
            n0, n1, a0, a1 = (n0, n1 - 1, a0, a1 - 1) if without else (n0 - 1, n1, a0 - 1, a1)
        middle = log((n1 + 0.5) / (a1 + 1)) - log((n0 + 0.5) / (a0 + 1))
        apart = SURE * (1 / (n0 + 0.5) + 1 / (n1 + 0.5)) ** 0.5
        return max(0.0, middle - apart) if middle > 0 else min(0.0, middle + apart)

    def evidence(self, restored: str, without: int | None = None) -> list[float]:
        """[1, strongest for, sum of the five strongest for, strongest against]; without: the label of a text that was counted."""
        known = sorted((self.odds(*self.words[w], without) for w in self.words.keys() & set(WORDS.findall(restored))), reverse=True)
        best = [x for x in known[:5] if x > 0]
        return [1.0, best[0] if best else 0.0, sum(best), min(0.0, known[-1]) if known else 0.0]

    def score(self, restored: str) -> float:
        if self.weights is None:
            return self.all[1] / max(1, sum(self.all))
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.evidence(restored), self.weights), -30, 30))))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column of x, of ones, bears no penalty."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, model: CharModel, vocabulary: int = VOCABULARY, rows: int = FIT_ROWS) -> Scorer:
    """A scorer from docs (doc_id, text) and labels (doc_id, toxic), both without what is held out."""
    labels = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # Labels grow with the texts, so they are never sent to all tasks, however few they are now.
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").join(labels.hint("merge"), "doc_id")
    counted = count_words(texts, model)
    both = counted.withColumn("every", F.col("n0") + F.col("n1")).filter(F.col("every") >= LEAST_TEXTS)
    # How far apart the shares are, against chance; "" comes first by itself.
    total = labels.groupBy().agg(F.avg("toxic")).first()[0]  # one row
    if total is None:
        return Scorer()
    away = (F.col("n1") - F.col("every") * total) ** 2 / (F.col("every") * max(total * (1 - total), 1e-9))
    first = both.orderBy(F.desc(F.col("word") == ""), F.desc(away), "word").limit(vocabulary + 1).collect()
    if not first or first[0].word:
        return Scorer()
    out = Scorer({r.word: (r.n0, r.n1) for r in first[1:]}, (first[0].n0, first[0].n1))
    if not all(out.all):
        return out
    share = min(1.0, rows / sum(out.all))
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Restorer(model)
        for b in slices(batches):
            labels = b.column("toxic").to_pylist()
            found = [out.evidence(read(t), y) for t, y in zip(b.column("text").to_pylist(), labels, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    fit = sample.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>").toArrow()
    y = fit.column("toxic").to_numpy()
    if 0 < y.sum() < len(y):
        out.weights = regression(np.array(fit.column("x").to_pylist()), y)
    return out


def score(docs: DataFrame, model: CharModel, scorer: Scorer, text: str = "text") -> DataFrame:
    """docs with score and predicted; the score reads the text alone."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("score", "predicted")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Restorer(model)
        for b in slices(batches):
            found = np.array([scorer.score(read(t.as_py())) for t in b.column(text)], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, wider(docs, ("score", "double"), ("predicted", "int")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of all docs, learnt from those that are not held out."""
    seen = docs.filter(~held_out()).select("doc_id", "text")
    model = CharModel.of(count_chars(seen))
    scorer = train(seen, labels.filter(~held_out()).select("doc_id", "toxic"), model)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, scorer).drop("text")
