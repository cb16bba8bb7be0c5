"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import local_roots, text_bytes, whole_runs, written
from pagewright.llm.components import connected_components

#: Blocks of the 64-bit fingerprint: of six, four differing bits leave two untouched at least. More blocks make longer keys,
#: of more untouched blocks, and more of them: 6 give 15 keys of 21 bits, 7 give 35 of 27, 8 give 70 of 32.
BLOCKS = 6
#: Fingerprints that buckets of the keys of so many blocks are meant for.
BLOCKS_FOR = ((6, 1 << 26), (7, 1 << 32), (8, 1 << 64))
#: Rows of a bucket that one task compares; larger buckets are split into chunks and compared by pairs of chunks.
CHUNK = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash of the word shingles; a bit is 1 if set in over half of them. No words: 0."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops, strict=True)], dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(h[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id_col, fp long): one row for each input row. Null texts count as empty and get fingerprint 0."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in text_bytes(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def near_pairs(grp: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sorted groups within ``max_bits`` of each other: all pairs of small groups, a spanning forest of large ones."""
    edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
    size = np.repeat(np.diff(edge), np.diff(edge))
    a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = size <= 64
    for d in range(1, int(size[few].max()) if few.any() else 1):
        i = np.flatnonzero((grp[:-d] == grp[d:]) & few[:-d])
        if not i.size:
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
        a_all.append(i)
        b_all.append(i + d)
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        if e - s > 64:
            for i, j in _forest(fp[s:e, None], max_bits):
                a_all.append(s + i)
                b_all.append(s + j)
    return np.concatenate(a_all), np.concatenate(b_all)


def _forest(bits: np.ndarray, max_bits: int):
    """Index pairs that connect rows of bits within ``max_bits`` of each other, each row reached once."""
    left, ahead = np.arange(1, len(bits)), [0]
    while left.size:
        if ahead:
            at = ahead.pop()
        else:
            at, left = left[0], left[1:]
        near = np.bitwise_count(bits[left] ^ bits[at]).sum(axis=1, dtype=np.int64) <= max_bits
        if near.any():
            hit, left = left[near], left[~near]
            yield np.full(hit.size, at), hit
            ahead.extend(hit.tolist())


def _links_in_runs(max_bits: int):
    """Links of each bucket of a sorted partition."""

    def run(batches):
        for table in whole_runs(batches, "grp"):
            rep = table.column("rep").to_numpy()
            i, j = near_pairs(table.column("grp").to_numpy(), table.column("fp").to_numpy().view(np.uint64), max_bits)
            if i.size:
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    return run


def links(classes: DataFrame, max_bits: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) links that connect all fingerprints of ``classes`` (rep, fp) within ``max_bits`` differing bits.

    ``max_bits`` differing bits leave all but as many of the ``blocks`` untouched, so close pairs share one of the keys made
    of that many blocks. A bucket over CHUNK rows is dealt out as pairs of chunks to many tasks; within it only
    a spanning forest leaves the task, so a bucket never emits all its pairs. No bucket is capped.
    """
    if not max_bits < blocks <= 16:
        raise ValueError("there must be more blocks than differing bits, and 16 at most")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << b - a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        key = F.lit(0).cast("long")
        for k in chosen:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(part[k])
        keys.append(F.xxhash64(F.lit(t), key) if blocks > 6 else F.shiftleft(F.lit(t).cast("long"), 40).bitwiseOR(key))
    rows = classes.select("rep", "fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = rows.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), "chunks").cast("int")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select("rep", "fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"))
    return held.repartition("grp").sortWithinPartitions("grp").select("rep", "fp", "grp").mapInArrow(_links_in_runs(max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked directly or over others.

    Identical fingerprints, however many, are one class with its smallest id before any comparison. Null and empty
    texts share fingerprint 0. Repeated ids give repeated rows; rows with a null id keep their class's component.
    An empty table gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, words))
    classes = written(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    n = classes.count()
    blocks = blocks or next(b for b, most in BLOCKS_FOR if n <= most)
    comps = connected_components(links(classes.where("rep is not null"), max_bits, blocks))
    named = classes.join(comps, classes["rep"] == comps["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


#: Least bits of a long fingerprint: their Hamming distance tells similarities 0.03 apart.
LONG = 1024
#: Chance that a pair just at the similarity shares no block.
MISSED = 0.01
#: Deviations by which the Hamming distance of a near pair may pass, in the long fingerprint, what the similarity means.
SPARE = 1.0


def differing(similarity: float) -> float:
    """Share of SimHash bits in which sets of shingles of this Jaccard similarity differ: the angle between them over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shape(n: int, similarity: float) -> tuple[int, int, int]:
    """(bits of a block, blocks, bits of a fingerprint) for ``n`` texts: a bucket holds about 8 unrelated ones at any n."""
    bits = max(12, math.ceil(math.log2(max(n, 2))) - 3)
    blocks = math.ceil(math.log(MISSED) / math.log(1 - (1 - differing(similarity)) ** bits))
    return bits, blocks, max(LONG, 64 * math.ceil(bits * blocks / 64))


def most_bits(similarity: float, size: int, spare: float) -> int:
    """Differing bits of ``size`` that a pair of this similarity has at most, with ``spare`` deviations."""
    p = differing(similarity)
    return int(size * p + spare * math.sqrt(size * p * (1 - p)))


def long_fingerprint(text: bytes, words: int = 5, size: int = LONG) -> bytes:
    """SimHash of ``size`` bits of the word shingles: every shingle's hash is mixed into as many 64-bit ones. No words: zeros."""
    parts = text.lower().split()
    total, n = np.zeros((size // 8, 256), np.int64), max(1, len(parts) - words + 1)
    if not parts:
        return bytes(size // 8)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    stops = ends[min(words, len(parts)) - 1 :] - 1
    starts = np.r_[0, ends[: n - 1]]
    digest, salt = xxhash.xxh64_intdigest, (np.arange(1, size // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    base = (np.arange(size // 8) * 256)[None, :]
    for at in range(0, n, 4096):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + 4096].tolist(), stops[at : at + 4096].tolist(), strict=True)], np.uint64)[:, None] ^ salt
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = np.ascontiguousarray(h ^ (h >> np.uint64(31)), "<u8").view(np.uint8)
        total += np.bincount((h + base).ravel(), minlength=total.size).reshape(total.shape)
    return np.packbits(2 * (total.astype(np.float32) @ _BITS.astype(np.float32)) > n, bitorder="little").tobytes()


def _groups(max_bits: int):
    """Rows (grp, rep): members of a bucket whose first 64 bits are near, directly or over others; the same members have the same grp."""

    def run(batches):
        for table in whole_runs(batches, "grp"):
            rep = table.column("rep").to_numpy()
            i, j = near_pairs(table.column("grp").to_numpy(), table.column("fp").to_numpy().view(np.uint64), max_bits)
            if i.size:
                root, k = local_roots(len(rep), i, j), np.unique(np.r_[i, j])
                h = rep[k].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                name = np.zeros(len(rep), np.uint64)
                np.add.at(name, root[k], (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
                yield pa.RecordBatch.from_arrays([pa.array(name[root[k]].view(np.int64)), pa.array(rep[k])], names=["grp", "rep"])

    return run


def _verified(max_bits: int):
    """A spanning forest (a, b) of the members of each group within ``max_bits`` of each other in their long fingerprints."""

    def run(batches):
        for table in whole_runs(batches, "grp"):
            grp, rep = table.column("grp").to_numpy(), table.column("rep").to_numpy()
            bits = np.frombuffer(b"".join(table.column("long").to_pylist()), np.uint64).reshape(len(rep), -1)
            edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
            found = [(rep[s + i], rep[s + j]) for s, e in zip(edge[:-1], edge[1:], strict=True) for i, j in _forest(bits[s:e], max_bits)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(2)], names=["a", "b"])

    return run


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(th, rep, component): each different text by hash, its class, and the class of smallest number that it is near to, directly or over others.

    64 bits can't tell a similarity of 0.8 from less, so fingerprints are longer and split into more blocks: sets of shingles of that
    similarity differ in 15 of 100 bits, and there are as many blocks as it takes for such a pair to share one but for MISSED.
    Texts that share a block and are near in their first 64 bits fetch their long fingerprints, whose Hamming distance decides.
    Equal fingerprints are one class however many; buckets over CHUNK classes are dealt out as pairs of chunks.
    """
    bits, blocks, size = shape(docs.count(), similarity)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([long_fingerprint(t, words, size) for t in text_bytes(b.column(1))], pa.binary())], names=["th", "long"])

    prints = written(docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, "th bigint, long binary").distinct())
    classes = written(prints.groupBy("long").agg(F.min("th").alias("rep")))

    def keys(batches):
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            flat = np.unpackbits(rows, axis=1)[:, : bits * blocks].reshape(b.num_rows, blocks, bits)
            key = (flat * (np.int64(1) << np.arange(bits))).sum(axis=2) | (np.arange(blocks)[None, :] << 48)
            fp = np.ascontiguousarray(rows[:, :8]).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), blocks)), pa.array(np.repeat(fp, blocks)), pa.array(key.ravel())], names=["rep", "fp", "key"])

    rows = classes.select("rep", "long").mapInArrow(keys, "rep bigint, fp bigint, key bigint")
    # only large buckets need their size; all others are whole where their key is dealt to, and shuffled once
    large = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK))
    n_large = large.count()
    large = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    small = (rows.join(large, "key", "left_anti") if n_large else rows).select("rep", "fp", F.col("key").alias("grp"))
    near = _groups(most_bits(similarity, 64, 4))
    found = small.repartition("grp").sortWithinPartitions("grp").mapInArrow(near, "grp bigint, rep bigint")
    if n_large:
        held = rows.join(large, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
        held = held.withColumn("own", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        held = held.select("rep", "fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"))
        found = found.union(held.repartition("grp").sortWithinPartitions("grp").mapInArrow(near, "grp bigint, rep bigint"))
    groups = written(found.distinct())
    fetched = groups.join(classes, "rep").repartition("grp").sortWithinPartitions("grp").select("grp", "rep", "long")
    comps = connected_components(fetched.mapInArrow(_verified(most_bits(similarity, size, SPARE)), "a bigint, b bigint").distinct())
    named = classes.join(comps, classes["rep"] == comps["id"], "left").select("long", "rep", F.coalesce("component", "rep").alias("component"))
    return prints.join(named, "long").select("th", "rep", "component")


#: Rows to keep are broadcast up to this number (24 MB); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicate texts: the smallest id, then the smallest text hash; rows without an id stay, all of them.

    Rows are told apart by id and text, so an id with two different texts is two documents; rows that repeat both are one.
    Null and empty texts are one group. Columns of any name pass through; an empty table gives an empty result.
    """
    named = docs.where(F.col(id_col).isNotNull())
    ids = named.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).groupBy("id", "th").agg(F.count("*").alias("n"))
    of_text = similar(named, id_col, text_col, words, similarity).select("th", "component")
    first = written(ids.join(of_text, "th").groupBy("component").agg(F.min(F.struct("id", "th", "n")).alias("x")).select("x.*")).alias("f")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    rows = named.alias("d").join(first, (F.col(f"d.`{id_col}`") == F.col("f.id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("f.th")))
    each = [F.col(f"d.`{c}`") for c in docs.columns]
    return rows.where("f.n = 1").select(*each).union(rows.where("f.n > 1").select(*each).dropDuplicates([id_col, text_col])).union(docs.where(F.col(id_col).isNull()))


def hex_digits(col):
    """A long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
