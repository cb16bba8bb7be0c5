"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Every shingle is hashed once; the top bits of the hash pick its bin, and a bin keeps its least hash. An empty bin takes the value of the
first occupied bin in an order of its own, the same for all documents, so two documents that borrow from the same bin agree there just
as often as their sets are alike. Of each bin only the low BITS are kept; unlike values agree there by chance, which the likeness corrects. They
are the low bits of the value mixed with the bin's number, so one borrowed value is not one chance for all its borrowers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import written

#: Bins (a power of two), low bits kept of each, words of a shingle.
BINS, BITS, WORDS = 512, 4, 5
_TOP = np.uint64(64 - BINS.bit_length() + 1)
_ORDER: list[np.ndarray] = []
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of words that a task has seen, dropped when there are so many.
_SEEN: dict[bytes, int] = {}
SEEN = 200_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _order() -> np.ndarray:
    """Row b: all bins in the order in which bin b looks for a value; the same everywhere."""
    if not _ORDER:
        h = _mixed(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * _ODD)
        _ORDER.append(h.reshape(BINS, BINS).argsort(axis=1).astype(np.int16))
    return _ORDER[0]


def _word(word: bytes) -> int:
    if len(_SEEN) >= SEEN:
        _SEEN.clear()
    h = _SEEN[word] = xxhash.xxh64_intdigest(word)
    return h


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """A hash of each shingle of words, A-Z lower-cased, from the XXH64 of its words; a text of fewer words is one shingle, one without words none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    seen = _SEEN.get
    h = np.array([seen(p) or _word(p) for p in parts], np.uint64)
    n = max(1, len(parts) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(parts))):
        out = (out + h[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return _mixed(out)


def bins(hashes: np.ndarray) -> np.ndarray:
    """The value of every bin: its least hash, or that of the occupied bin it looks to first."""
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    where = (hashes >> _TOP).astype(np.int64)
    np.minimum.at(least, where, hashes)
    full = np.zeros(BINS, bool)
    full[where] = True
    empty, at, width = np.flatnonzero(~full), 0, 16
    while empty.size and hashes.size:
        look = _order()[empty, at : at + width]
        hit = full[look]
        found = hit.any(axis=1)
        least[empty[found]] = least[look[found, hit[found].argmax(axis=1)]]
        empty, at, width = empty[~found], at + width, 4 * width
    return least


def low_bits(values: np.ndarray) -> bytes:
    """The low BITS of every bin's value mixed with its number, packed."""
    own = _mixed(values + np.arange(BINS, dtype=np.uint64) * _ODD)
    low = (own & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - BITS :]).tobytes()


def packed(text: bytes, words: int = WORDS) -> bytes:
    """The fingerprint of a text, empty without words."""
    h = shingle_hashes(text, words)
    return low_bits(bins(h)) if h.size else b""


def likeness(a: bytes, b: bytes) -> float:
    """Estimate of the Jaccard similarity of two texts' shingles from 0 to 1, corrected for bits that agree by chance; two without words are alike."""
    if not a or not b:
        return float(a == b)
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(BINS, BITS).any(axis=1)
    chance = 0.5**BITS
    return float(max(0.0, (1 - differ.mean() - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id_col, fingerprint binary): one row for each row; null texts count as empty. Nothing is shuffled; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed((t or "").encode(), words) for t in texts], pa.binary())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint binary")


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def alike(a: Column | str, b: Column | str) -> Column:
    """Likeness of two columns of fingerprints; null where either is null."""
    return _likeness(a, b)


def edited(text: str, following: str) -> str:
    """The text whose last third is the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_FIELDS = (("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()))
_SCHEMA = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(text: str, own: bytes, following: str, its: bytes) -> tuple:
    changed = edited(text, following)
    raw = changed.encode()
    new = own if changed == text else packed(raw)
    return len(text), hashlib.sha256(raw).digest(), own, new, likeness(own, new), likeness(own, its)


def _chain(kind: pa.DataType):
    """Compare each row with the one after it; a partition's first text, and its last row with its text, are told for those before and after it."""
    names = ["part", "first", "last", "doc", *(n for n, _ in _FIELDS)]
    kinds = [pa.int64(), pa.string(), pa.string(), kind, *(k for _, k in _FIELDS)]

    def run(batches):
        part, held, blank = TaskContext.get().partitionId(), None, (None,) * len(_FIELDS)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                own = packed(text.encode())
                if held is None:
                    out.append((part, text, None, None, *blank))
                else:
                    out.append((part, None, None, held[0], *_compared(*held[1:], text, own)))
                held = (doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((part, None, held[1], held[0], *blank), kinds, strict=True)], names=names)

    return run


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): every text, its edited text and the next text.

    The next document has the next smaller id, the last one's is the first; null ids come last. Rows that repeat an id are ordered by text hash, each a document; a
    single row is its own next. Null texts count as empty. Rows are ranged by id, text hash and row, so repeated rows part over tasks too; each task
    compares its own neighbours as a stream, and one row a task meets the start of the next. An empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("doc").desc_nulls_last(), F.xxhash64("text"), F.col("salt")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "text")
    arrow = ordered.select("doc").limit(0).toArrow().schema.field(0).type
    told = written(ordered.mapInArrow(_chain(arrow), f"part bigint, first string, last string, doc {kind}, {_SCHEMA}"))
    # a number for each task, however many rows there are
    parts = sorted(r[0] for r in told.where("first is not null").select("part").collect())
    spark = docs.sparkSession
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part long, after long")
    firsts = told.where("first is not null").select(F.col("part").alias("after"), "first")
    edges = told.where("last is not null").select("part", "doc", "last").join(after, "part").join(firsts, "after").select("doc", "last", "first")

    def close(batches):
        for b in batches:
            out = []
            for doc, text, following in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, its = packed(text.encode()), packed(following.encode())
                out.append((doc, *_compared(text, own, following, its)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (arrow, *(k for _, k in _FIELDS)), strict=True)], names=["doc", *(n for n, _ in _FIELDS)])

    done = told.where("n_chars is not null").select("doc", *(n for n, _ in _FIELDS))
    both = done.union(edges.mapInArrow(close, f"doc {kind}, {_SCHEMA}"))
    digits = [F.lower(F.hex(n)).alias(n) if k == pa.binary() else F.col(n) for n, k in _FIELDS]
    return both.select(F.col("doc").alias(id_col), *digits)
