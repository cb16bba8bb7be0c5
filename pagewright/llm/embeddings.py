"""Near-duplicate embeddings by randomised-rotation binary codes.

A vector is turned by a random orthogonal matrix and stored as the packed signs of its coordinates with correction factors,
and as the side that is compared with other codes, four bits a coordinate. From the code of one vector and the other side of a
second comes an unbiased estimate of their inner product with a bound of its error. Only codes are shuffled to the buckets;
the vectors themselves are fetched for groups in which a bound reaches the threshold, and computed exactly there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import local_roots, whole_runs, written
from pagewright.llm.components import connected_components

#: Codes of a bucket that one task compares at once; larger buckets are dealt out as pairs of chunks.
CHUNK = 1024
#: Standard deviations that the error bound of an estimate spans: a bound fails for fewer than one pair in 10^7.
SPAN = 5.5
#: Chance that a pair just at the threshold shares no bucket.
MISSED = 0.001
SEED = 20_240_501


@lru_cache(maxsize=64)
def rotation(dim: int, k: int = 0) -> np.ndarray:
    """The k-th random orthogonal matrix for vectors of ``dim`` numbers; the same in every task, made once in a process."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


#: Levels of a coordinate of the compared side: four bits.
LEVELS = 15


@dataclass
class Codes:
    """Packed signs and packed levels of turned unit vectors, with factors: the product of a vector with its own signs, the
    least level and the step between levels."""

    signs: np.ndarray
    levels: np.ndarray
    factors: np.ndarray
    dim: int

    def sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signs scaled to unit length, turned vectors as their levels say, correction factors)."""
        signs = np.unpackbits(self.signs, axis=1)[:, : self.dim].astype(np.float32) * np.float32(2) - np.float32(1)
        halves = np.stack([self.levels >> 4, self.levels & 15], axis=2).reshape(len(self.levels), -1)[:, : self.dim]
        turned = halves.astype(np.float32) * self.factors[:, 2:3] + self.factors[:, 1:2]
        return signs / np.float32(math.sqrt(self.dim)), turned, self.factors[:, 0]

    def packed(self) -> np.ndarray:
        """One row of bytes for each vector: signs, levels, factors."""
        return np.concatenate([self.signs, self.levels, np.ascontiguousarray(self.factors, "<f4").view(np.uint8)], axis=1)

    @staticmethod
    def of(rows: np.ndarray, dim: int) -> Codes:
        a, b = (dim + 7) // 8, (dim + 7) // 8 + (dim + 1) // 2
        return Codes(rows[:, :a], rows[:, a:b], np.ascontiguousarray(rows[:, b:]).view("<f4"), dim)


def codes(unit: np.ndarray) -> Codes:
    """Codes of unit vectors. Levels are rounded up or down by chance, in proportion, so that they have no bias."""
    n, dim = unit.shape
    turned = unit @ rotation(dim)
    signs = turned >= 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / LEVELS, 1e-9)
    chance = np.random.default_rng([SEED, dim, 1 << 20]).random((1, dim))
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + chance), 0, LEVELS).astype(np.uint8)
    if dim % 2:
        level = np.concatenate([level, np.zeros((n, 1), np.uint8)], axis=1)
    return Codes(np.packbits(signs, axis=1), (level[:, ::2] << 4) | level[:, 1::2], np.stack([factor, low, step], axis=1).astype(np.float32), dim)


def spreads(factors: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """How far an estimate may fall below ``threshold`` for a pair that reaches it: SPAN deviations of the code's error, which
    grows with the part of the other vector that is at right angles, and of the rounding of levels."""
    code = np.sqrt(np.maximum(1 - factors[:, 0] ** 2, 0)) / factors[:, 0] * math.sqrt(max(1 - threshold**2, 0)) / math.sqrt(max(dim - 1, 1))
    return SPAN * np.sqrt(code[:, None] ** 2 + (factors[None, :, 2] / 2 / factors[:, 0:1]) ** 2)


def may_reach(c: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all inner products (code of the row, other side of the column) and whether each may reach ``threshold``."""
    signs, turned, factor = c.sides()
    estimate = (signs @ turned.T) / factor[:, None]
    return estimate, estimate >= threshold - spreads(c.factors, c.dim, threshold)


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a bucket key, tables): buckets hold about 16 unrelated vectors each at any n."""
    same = 1 - math.acos(min(1.0, threshold)) / math.pi
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 4)
    return bits, max(1, math.ceil(math.log(MISSED) / math.log(max(1 - same**bits, 1e-12))))


def table_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each vector in each table: ``bits`` signs of further rotations."""
    dim = unit.shape[1]
    need, out, have = bits * tables, [], 0
    for k in range(1, math.ceil(need / dim) + 1):
        out.append(unit @ rotation(dim, k) >= 0)
        have += dim
    flat = np.concatenate(out, axis=1)[:, :need].reshape(len(unit), tables, bits)
    return (flat * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _by_dim(batch: pa.RecordBatch, name: str):
    sizes = np.array([len(x) for x in batch.column(name)]) if batch.num_rows else np.array([], int)
    for dim in np.unique(sizes):
        yield int(dim), batch.filter(pa.array(sizes == dim))


def _explode(bits: int, tables: int):
    """Rows (rep, code, t, key): a vector's code in the bucket of each table."""

    def run(batches):
        for batch in batches:
            for dim, part in _by_dim(batch, "vec"):
                unit = _unit(part.column("vec"))
                keys, rows = table_keys(unit, bits, tables), codes(unit).packed()
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
                code = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer(rows.tobytes())])
                for t in range(tables):
                    key = (np.int64(t) << 52) | (np.int64(dim) << 32) | keys[:, t]
                    yield pa.RecordBatch.from_arrays([part.column("rep"), code, pa.array(np.full(len(key), t, np.int32)), pa.array(np.full(len(key), dim, np.int32)), pa.array(key)], names=["rep", "code", "t", "dim", "key"])

    return run


def _candidates(threshold: float):
    """Rows (grp, rep, t, own, lo, hi): vectors of a bucket, or of a pair of its chunks, that candidate pairs connect."""

    def run(batches):
        for table in whole_runs(batches, "grp"):
            grp, rep, t, own, lo, hi, dims = (table.column(c).to_numpy() for c in ("grp", "rep", "t", "own", "lo", "hi", "dim"))
            edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
            chunk = table.column("code").combine_chunks()
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            data = np.frombuffer(chunk.buffers()[2], np.uint8)
            out: list[list[np.ndarray]] = [[], []]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e - s < 2:
                    continue
                order = s + np.argsort(rep[s:e])
                rows = data[ends[s] : ends[e]].reshape(e - s, -1)[order - s]
                _, near = may_reach(Codes.of(rows, int(dims[s])), threshold)
                # the code of the smaller id against the other side of the larger one, in every table
                near = np.triu(near, 1)
                if lo[s] != hi[s]:
                    near &= own[order][:, None] != own[order][None, :]
                i, j = np.nonzero(near)
                if i.size:
                    roots = local_roots(e - s, i, j)
                    touched = np.unique(np.r_[i, j])
                    out[0].append(order[touched])
                    out[1].append(rep[order[roots[touched]]])
            if out[0]:
                k, root = np.concatenate(out[0]), np.concatenate(out[1])
                # a group is named by its bucket and its root
                name = (grp[k].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (root.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name.view(np.int64), rep[k], t[k], own[k], lo[k], hi[k])], names=["grp", "rep", "t", "own", "lo", "hi"])

    return run


def _compare(threshold: float, bits: int, tables: int):
    """Counts and a spanning set of links of each group, exactly; a pair counts in the first table it shares."""

    def run(batches):
        for table in whole_runs(batches, "grp"):
            grp = table.column("grp").to_numpy()
            edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
            out: list[list[np.ndarray]] = [[], [], []]
            rep, weight, own, lo, hi, tables_of = (table.column(c).to_numpy() for c in ("rep", "weight", "own", "lo", "hi", "t"))
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e - s < 2:
                    continue
                order = np.argsort(rep[s:e])
                unit = _unit(table.column("vec").slice(s, e - s))[order]
                t = int(tables_of[s])
                keys = table_keys(unit, bits, tables)[:, :t]
                near = np.triu(may_reach(codes(unit), threshold)[1], 1)
                if lo[s] != hi[s]:
                    near &= own[s:e][order][:, None] != own[s:e][order][None, :]
                i, j = np.nonzero(near)
                parts = [(i[at : at + 65536], j[at : at + 65536]) for at in range(0, i.size, 65536)]
                good = [(np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold) & ~(keys[a] == keys[b]).any(axis=1) for a, b in parts]
                if not parts or not any(g.any() for g in good):
                    continue
                good = np.concatenate(good)
                i, j = i[good], j[good]
                n, w, ids = e - s, weight[s:e][order], rep[s:e][order]
                links = np.bincount(i, weights=w[j], minlength=n) + np.bincount(j, weights=w[i], minlength=n)
                roots, touched = local_roots(n, i, j), np.flatnonzero(links)
                out[0].append(ids[touched])
                out[1].append(links[touched].astype(np.int64))
                out[2].append(ids[roots[touched]])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all vectors, linked at cosine >= ``threshold``.

    Null, empty and zero vectors, those with null or non-finite components and rows without an id link with nothing:
    n_links 0, a component of their own. Vectors of different lengths aren't compared. Equal vectors are one weighted class
    before any comparison. The code of each class enters about n^0.2 tables of buckets; a bucket over CHUNK codes is dealt out as
    pairs of chunks. Groups that candidate pairs connect fetch their vectors, and what leaves a task is a count and a root for each vector,
    never the pairs. Repeated ids give repeated rows and count as vectors of their own.
    """
    doubles = F.transform(vec_col, lambda x: x.cast("double"))
    sound = F.coalesce(F.size(vec_col) > 0, F.lit(False)) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound & F.col(id_col).isNotNull(), F.col(vec_col)).alias("vec"))
    rows = rows.withColumn("cls", F.xxhash64(F.transform("vec", lambda x: x.cast("double"))))
    classes = written(rows.where("vec is not null").groupBy("cls", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).select("rep", "weight", "vec"))
    bits, tables = plan(classes.count(), threshold)
    keyed = written(classes.select("rep", "vec").mapInArrow(_explode(bits, tables), "rep bigint, code binary, t int, dim int, key bigint"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).select("rep", "code", "t", "dim", "own", "lo", "hi", F.xxhash64("key", "lo", "hi").alias("grp"))
    groups = held.repartition("grp").sortWithinPartitions("grp").mapInArrow(_candidates(threshold), "grp bigint, rep bigint, t int, own int, lo int, hi int")
    fetched = written(groups).join(classes, "rep").select("grp", "rep", "weight", "vec", "t", "own", "lo", "hi")
    found = written(fetched.repartition("grp").sortWithinPartitions("grp").mapInArrow(_compare(threshold, bits, tables), "rep bigint, links bigint, root bigint"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("vec", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = named.withColumn("cls", F.xxhash64(F.transform("vec", lambda x: x.cast("double"))))
    out = rows.join(named, ["cls", "vec"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
