"""BPE encoding and decoding: speculate, verify, repair.

Texts are cut into words as the tokenizer file says. A word is first tokenised by greedy longest match, which is only a
guess. A sequence of tokens is the BPE encoding if every adjacent pair of it is the encoding of its own concatenation,
so all distinct adjacent pairs of a batch of words are checked together, vectorised: merges are undone from the last
one on, and a pair fails if the two tokens at its seam would have been merged before the merge that is undone next.
Only words with a failing pair are merged exactly, lowest rank first.

The tokenizer file is a parameter (a path on each machine); each Python worker reads it once. Words repeat, so a worker
keeps the short words that it has met, up to CACHE letters of them.

Defined results: a null text counts as empty and gives no tokens and an empty decoded text. Texts of any length are
encoded whole. Repeated rows are encoded alike. Columns that clash with an output column are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm._common import slices, wider

#: Letters of the words that a worker keeps, and of the longest word that it keeps.
CACHE, KEPT = 1_000_000, 64
NEVER = np.iinfo(np.int64).max
#: Rows that are encoded together.
ROWS = 512
#: White space as the tokenizers library has it.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and numbers of Unicode 16, which Python's tables of Unicode 15.1 don't have, as first and last.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Their small letters, and those of Unicode 17, which the library changes too.
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
NEW_CAPITALS = re.compile("[\u1c89\ua7cb\ua7cc\ua7ce\ua7d2\ua7d4\ua7da\ua7dc\U00010d50-\U00010d65\U00016ea0-\U00016eb8]")

# Marks of Unicode 11 and later (and one pair of letters), which the library's normalisation leaves in place.
LATER_MARKS = re.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab\U00010eac"
    "\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839\U0001183a\U00011930\U00011935\U0001193d"
    "\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44\U00011d45\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1"
    "\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)
#: Beyond these code points the tables of regex and of the library differ.
FAR = re.compile("[^\x00-\u0557]")


@lru_cache(maxsize=2)
def class_of(kind: str) -> str:
    """The characters of a general category, L or N, as ranges for the inside of a character class."""
    more = {"L": LETTERS_16, "N": NUMBERS_16}[kind]
    own = np.fromiter((unicodedata.category(chr(c))[0] == kind for c in range(0x110000)), bool, 0x110000)
    for a, b in more:
        own[a : b + 1] = True
    edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with a mark at word ends, lower-casing and without white space."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.near_words = regex.compile(pattern.replace(r"\s", BLANKS))
        self.words = re.compile(pattern.replace(r"\p{L}", class_of("L")).replace(r"\p{N}", class_of("N")).replace(r"\s", BLANKS))
        # The same pattern for ASCII texts, which is matched faster.
        ascii_ = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r ")
        self.ascii_words = re.compile(ascii_, re.ASCII)
        self.cut = regex.compile("|".join(map(regex.escape, self.special)))
        self.letters = byte_letters()
        self.inner, self.last = ([self.vocab[x + e] for x in self.letters] for e in ("", self.end))
        n = len(self.tokens)
        #: A token is made by the merge of ``rank`` (-1: of none) from ``left`` and ``right``.
        self.rank, self.left, self.right = (np.full(n, -1, np.int64) for _ in range(3))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            ia, ib, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[ia, ib] = (r, made)
            self.rank[made], self.left[made], self.right[made] = r, ia, ib
        pairs = np.array([a * n + b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pair_codes, self.pair_ranks = pairs[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.made = np.array([m for _, m in self.merges.values()], np.int64)  # by rank
        #: The longest token that starts with these three letters.
        self.longest: dict[str, int] = {}
        for t in self.vocab:
            t = t.removesuffix(self.end)
            self.longest[t[:3]] = max(len(t), self.longest.get(t[:3], 2))
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0  # letters of known

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, in byte letters when not ASCII."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = "".join([unicodedata.normalize("NFC", part) for part in LATER_MARKS.split(text)])
        # Each character by itself, so a final sigma is like any other. White space of any kind is in no word.
        text = text.replace("Σ", "σ").lower()
        if not FAR.search(text):
            return self.near_words.findall(text)
        return self.words.findall(text.translate(SMALL) if NEW_CAPITALS.search(text) else text)

    def guess(self, word: str) -> list[int]:
        """Greedy longest match; the end mark belongs to the last letter."""
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.letters[b] for b in word.encode("utf-8")])
        out, at, n, vocab, longest = [], 0, len(word), self.vocab, self.longest
        while at < n:
            most = longest.get(word[at : at + 3], 2)
            if n - at <= most and (t := vocab.get(word[at:] + self.end)) is not None:
                out.append(t)
                break
            for end in range(min(at + most, n - 1), at, -1):
                if (t := vocab.get(word[at:end])) is not None:
                    break
            out.append(t)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays two tokens when its letters are encoded."""
        good = np.ones(len(a), bool)
        limit = np.full(len(a), NEVER)  # merges of a rank below this have been done
        live = np.arange(len(a))
        while len(live):
            crossed = self.ranks(a[live], b[live]) < limit[live]
            good[live[crossed]] = False
            live = live[~crossed]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            more = (ra >= 0) | (rb >= 0)
            live, ra, rb = live[more], ra[more], rb[more]
            # The later merge is undone first. Equal merges go from left to right, so a right token's own merge comes
            # after an equal one over the seam, and a left token's own merge before it.
            undo_a = ra > rb
            la, lb = live[undo_a], live[~undo_a]
            limit[la], limit[lb] = ra[undo_a], rb[~undo_a] + 1
            a[la], b[lb] = self.right[a[la]], self.left[b[lb]]
        return good

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging of one word, from its letters: the lowest rank first, from left to right.

        A heap of pairs over a linked list, so that a word of n letters takes n log n steps.
        """
        ids = list(ids)
        n, get, tokens = len(ids), self.merges.get, len(self.tokens)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*m, i, ids[i] * tokens + ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, made, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or ids[i] * tokens + ids[j] != pair:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (*m, x, ids[x] * tokens + ids[y]))
        return [t for t in ids if t >= 0]

    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """merge() of many words at once: each round does the next merge of every word."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, group in by_size.items():
            if size > 48 or len(group) < 8:
                for i in group:
                    out[i] = self.merge(words[i])
                continue
            who, ids = np.array(group), np.array([words[i] for i in group], np.int64)
            best = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(who):
                at = best.argmin(1) if best.shape[1] else np.zeros(len(who), np.int64)
                done = best[np.arange(len(who)), at] == NEVER if best.shape[1] else np.ones(len(who), bool)
                for i, w in zip(who[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = w
                who, ids, best, at = who[~done], ids[~done], best[~done], at[~done]
                if not len(who):
                    break
                row = np.arange(len(who))
                made = self.made[best[row, at]]
                cols = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)  # without the pair's second token
                ids[row, at] = made
                cols = cols[:-1]
                best = np.take_along_axis(best, cols + (cols >= at[:, None]), 1)
                for side in (at - 1, at):  # the two pairs that the new token is in
                    ok = np.flatnonzero((side >= 0) & (side < best.shape[1]))
                    best[ok, side[ok]] = self.ranks(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, NEVER if there is none."""
        code = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], NEVER)

    def base(self, word: str) -> list[int]:
        """The ids of a word's letters, the last one with the end mark."""
        *inner, last = word.encode("utf-8")
        out = [self.inner[b] for b in inner]
        out.append(self.last[last])
        return out

    def learn(self, words: list[str]) -> None:
        """Put the encodings of the words into ``known``."""
        guesses = [self.guess(w) for w in words]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.empty(0, np.int64)
        pairs, at = np.unique(flat[inside] * len(self.tokens) + flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs // len(self.tokens), pairs % len(self.tokens))
        failed = np.unique(owner[inside[~good[at]]]).tolist() if len(inside) else []
        for i, ids in zip(failed, self.merge_all([self.base(words[i]) for i in failed]), strict=True):
            guesses[i] = ids
        self.known.update(zip(words, map(tuple, guesses), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = []  # the words of each text; a special token is no other word's text
        for text in texts:
            parts, at = [], 0
            for m in self.cut.finditer(text or ""):
                parts += [*self.pieces(text[at : m.start()]), m[0]]
                at = m.end()
            cut.append(parts + self.pieces((text or "")[at:]))
        words = set(chain.from_iterable(cut))
        if self.held > CACHE:  # what these texts have too is kept
            self.known = {w: self.known[w] for w in words if w in self.known}
            self.held = sum(map(len, self.known))
        self.known.update({t: (i,) for t, i in self.special.items()})
        fresh = words.difference(self.known)
        if fresh:
            self.learn(list(fresh))
        get = self.known.__getitem__
        out = [np.fromiter(chain.from_iterable(map(get, parts)), np.int32) for parts in cut]
        for w in fresh:
            if len(w) > KEPT:
                del self.known[w]
            else:
                self.held += len(w)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by blanks, as the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", *, back: bool = False) -> DataFrame:
    """docs with ids (array of int), the whole text's tokens; back adds decoded, what decode() gives for them, at once."""
    new = [("ids", "array<int>"), ("decoded", "string")][: 1 + back]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in [n for n, _ in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches, ROWS):
            found = bpe.encode(b.column(text).to_pylist())
            ends = np.cumsum([0, *map(len, found)])
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            texts = [pa.array([bpe.decode(x) for x in found], pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([*b.columns, ids, *texts], [*b.schema.names, *[n for n, _ in new]])

    return docs.mapInArrow(run, wider(docs, *new))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded, the text of ids; a null list gives the empty text."""
    encoded = encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches, ROWS):
            texts = pa.array([bpe.decode(x.values.to_numpy()) if x.is_valid else "" for x in b.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, wider(encoded, ("decoded", "string")))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    both = encode(docs.select("doc_id", "text"), path, back=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
