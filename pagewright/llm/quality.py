"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are trigrams of character classes, so they mean the same in every language, and rates of repeated words. A
singular value decomposition of a bounded labelled sample gives the space; the labelled vectors are broadcast, and every
document votes by its exact cosines to all of them, computed in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import crc_fold, text_bytes

#: Labelled rows that make the space and vote, at most so many: 6,000 vectors of 48 numbers are under 3 MB.
SAMPLE = 6_000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Votes count by this power of the cosine.
POWER = 8
BLOCK = 512
_N = 16
_CLASS = np.full(256, 15, np.int64)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "?;:", "|", "#$%&*@~^", "\"'`", "()[]{}<>", "-_/+=\\", "!"]):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[128:] = 14
TERMS = _N**3 + 3


def terms(text: bytes) -> np.ndarray:
    """Square roots of the shares of class trigrams, with rates of words that repeat the last one, or any, and lines that do."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    c = _CLASS[np.frombuffer(b"\n" + text + b"\n", np.uint8)]
    out[: _N**3] = np.sqrt(np.bincount(c[:-2] * _N * _N + c[1:-1] * _N + c[2:], minlength=_N**3) / (len(c) - 2))
    words = text.split()
    if len(words) > 1:
        out[-3] = np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1))
        out[-2] = 0.5 * (1 - len(set(words)) / len(words)) ** 2
    lines = text.split(b"\n")
    out[-1] = 0.5 * (1 - len(set(lines)) / len(lines))
    return out


@dataclass
class Space:
    """Mean and axes of the space, labelled unit vectors in it, and their labels."""

    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        v = (x - self.mean) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of the label 1 among the nearest labelled vectors, weighted by cosine; of equally near ones the first of the sample vote."""
        n = len(self.labels)
        if not n:
            return np.full(len(x), 0.5)
        cos = self.place(x) @ self.vectors.T
        k = min(NEIGHBOURS, n)
        least = np.partition(cos, n - k, axis=1)[:, n - k, None]
        above, level = cos > least, cos == least
        chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        near = np.nonzero(chosen)[1].reshape(len(x), k)
        weight = np.clip(np.take_along_axis(cos, near, 1), 1e-3, 1).astype(np.float64) ** POWER
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space:
    """The space of at most SAMPLE labelled rows whose crc32(id) mod 5 isn't 0, those with the smallest hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = known.where(crc_fold(id_col) != 0).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)

    def run(batches):
        for b in batches:
            rows = [terms(t) for t in text_bytes(b.column(1))]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([a.astype(np.int16).tolist() for a in at], pa.list_(pa.int16())), pa.array([r[a].tolist() for r, a in zip(rows, at, strict=True)], pa.list_(pa.float32()))], names=["y", "at", "v"])

    # at most SAMPLE rows of an id and a number are broadcast, and as many sparse rows come back
    sample = docs.select(id_col, text_col).join(F.broadcast(known), id_col).select("y", text_col).mapInArrow(run, "y bigint, at array<short>, v array<float>")
    ys, x = [], []
    for r in sample.orderBy(F.xxhash64("y", "v"), "y").limit(SAMPLE).toLocalIterator():
        row = np.zeros(TERMS, np.float32)
        row[np.array(r["at"], np.int64)] = r["v"]
        x.append(row)
        ys.append(r["y"])
    if not x:
        return Space(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.array(x)
    mean = x.mean(0)
    axes = _axes(x - mean)
    space = Space(mean, axes.astype(np.float32), np.zeros((0, 1), np.float32), np.array(ys, float))
    space.vectors = space.place(x)
    return space


def _axes(x: np.ndarray) -> np.ndarray:
    """Leading right singular vectors by randomised subspace iteration."""
    k = min(DIMENSIONS + 16, *x.shape)
    q = np.linalg.qr(x.T @ (x @ np.random.default_rng(5).standard_normal((x.shape[1], k)).astype(np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :DIMENSIONS]


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts are the vector without terms and get its neighbours' vote. Repeated rows are scored each; a
    null id counts as held out; without labelled rows every score is 0.5. An empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = np.stack([terms(t) for t in text_bytes(part.column(1))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(space.score(x))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, (crc_fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
