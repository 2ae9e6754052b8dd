"""Quality rules: counting rules, then compression bands.

The counting rules reject a text of fewer than ten words and one in which more than a fifth of the words stand in
5-word windows that occur twice or more in it. The compression bands then take the zstandard ratio (compressed bytes by
bytes) of the whole text and of each fixed chunk: below a band the text repeats itself, above it the text is noise that
cannot be compressed. Short texts compress worse, so each length has its own band. A text is rejected if its whole
ratio is outside the band, or if the ratios of too large a share of its chunks are.

Defined results: a null text counts as empty (no word, so rejected). Repeated rows are judged alike, each on its own.
Very long texts are read whole. Columns that clash with an output column are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from geoloom.llm._common import slices, wider

MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: (bytes from which a band holds, lowest ratio, highest ratio) of whole texts. Under 100 bytes the frame outweighs the text.
BANDS = ((0, 0.0, 9.0), (100, 0.35, 1.3), (200, 0.30, 1.0), (400, 0.25, 0.85), (1600, 0.22, 0.74), (6400, 0.20, 0.70))
CHUNK = 2048
#: Ratios of a chunk; a last chunk under half of CHUNK is judged with the one before it.
CHUNK_BAND = (0.20, 0.80)
CHUNK_SHARE = 0.30
LEVEL = 3

OUT = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"), ("bad_chunks", "double"))


def repeated_words(words: list, width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more among the words, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    first: dict = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    code, m = ids[:n], len(first)
    for k in range(1, width):  # exact: codes are renumbered before they could overflow
        if (int(code.max()) + 1) * m >= 2**62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * m + ids[k : n + k]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[at] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def compression(data: bytes, zip_: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The whole text's ratio and the share of chunks outside their band (0 for a text of one chunk)."""
    if not data:
        return 0.0, 0.0
    whole = len(zip_.compress(data)) / len(data)
    cuts = list(range(0, len(data), CHUNK))
    if len(cuts) > 1 and len(data) - cuts[-1] < CHUNK // 2:
        cuts.pop()
    if len(cuts) < 2:
        return whole, 0.0
    bad = 0
    for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True):
        bad += not CHUNK_BAND[0] <= len(zip_.compress(data[a:b])) / (b - a) <= CHUNK_BAND[1]
    return whole, bad / len(cuts)


def judge(text: str | None, zip_: zstandard.ZstdCompressor) -> tuple:
    """One row of OUT."""
    text = text or ""
    counts = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEAT_PERCENT * counts[0]
    data = text.encode("utf-8", "surrogatepass")
    ratio, bad = compression(data, zip_)
    _, low, high = BANDS[bisect_right([b[0] for b in BANDS], len(data)) - 1]
    return (*counts, failed, not failed and low <= ratio <= high and bad <= CHUNK_SHARE, ratio, bad)


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns OUT."""
    names = [n for n, _ in OUT]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in names])
    schema = wider(docs, *OUT)
    types = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[k] for _, k in OUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        for b in slices(batches):
            rows = [judge(t.as_py(), zip_) for t in b.column(text)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in OUT]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever these are called."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[[c.lower() for c in docs.columns].index("text")]
    return quality(docs.toDF(*names), text).filter("kept").select(*names).toDF(*docs.columns)
