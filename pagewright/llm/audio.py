"""Chroma fingerprints of audio columns, and their alignment.

Each recording becomes frames of twelve pitch classes; filters over their integral image compare areas of sixteen frames and
pack into 32-bit codes, one a frame. Pairs of codes that are least in their neighbourhood are landmarks; recordings that
share one are laid on each other there, and the equal codes at that offset (its height in the histogram of offsets) and the share
of differing bits over the whole overlap decide whether they match.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import local_roots, text_bytes, whole_runs, written
from pagewright.llm.components import connected_components

#: Frames that one code looks at.
SPAN = 16
#: A landmark joins a code and the one LAG later, and is the least by hash of NEAR such pairs in a row.
LAG, NEAR = 4, 8
#: Equal codes at one offset and codes of overlap that a match has at least, and its greatest share of differing bits. An
#: overlap without any difference is as long as a landmark's neighbourhood, so it always shares one.
VOTES, ERROR, OVERLAP = 3, 0.2, NEAR + LAG
#: Recordings that one task lays on each other; landmarks of more are dealt out as pairs of chunks.
CHUNK = 1024
#: Codes compared at once.
AT_ONCE = 1 << 21
#: Ids and marks are broadcast up to this number (24 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of recordings that are heard together.
SLICE = 1 << 20
#: Steps between the four levels of a filter, of which each gives two bits.
LEVELS = (-0.25, 0.0, 0.25)


@dataclass(frozen=True)
class Sound:
    """8-bit mono samples: rate, samples of a frame and between frames."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of sixteen filters: kinds in turn over shifting areas."""
    return [(i % 4, (5 * i) % 9, 4 + 2 * (i % 3) if (5 * i) % 9 + 4 + 2 * (i % 3) <= 12 else 12 - (5 * i) % 9, (16, 8, 12, 4)[(i // 4) % 4]) for i in range(16)]


@lru_cache
def _bins(sound: Sound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies that count, their pitch classes as a matrix, and the window of a frame."""
    freq = np.fft.rfftfreq(sound.frame, 1 / sound.rate)
    low, high = max(28.0, 2 * sound.rate / sound.frame), min(3520.0, sound.rate / 2)
    use = np.flatnonzero((freq >= low) & (freq <= high))
    classes = np.zeros((len(use), 12), np.float32)
    classes[np.arange(len(use)), np.round(12 * np.log2(freq[use] / 440.0)).astype(int) % 12] = 1
    return use, classes, np.hamming(sound.frame).astype(np.float32)


def chroma(samples: np.ndarray, sound: Sound) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, summing to 1."""
    n = (len(samples) - sound.frame) // sound.hop + 1
    if n < 1:
        return np.zeros((0, 12))
    use, classes, window = _bins(sound)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32) - 128, sound.frame)[:: sound.hop]
    out = []
    for at in range(0, n, 1024):
        power = np.abs(np.fft.rfft(frames[at : at + 1024] * window, axis=1)[:, use]) ** 2
        out.append(power.astype(np.float32) @ classes)
    energy = np.concatenate(out).astype(np.float64)
    total = energy.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6, energy / np.maximum(total, 1e-6), 1 / 12)


def codes(samples: np.ndarray, sound: Sound) -> np.ndarray:
    """32-bit codes of a recording: one for each frame with SPAN - 1 after it; none for shorter recordings."""
    return codes_of([samples], sound)[0]


def codes_of(recordings: list[np.ndarray], sound: Sound) -> list[np.ndarray]:
    """Codes of each recording. Frames and sums are its own, so they don't depend on the others; only filters run over all."""
    images, starts, base = [np.zeros((0, 13))], [np.zeros(0, np.int64)], 0
    many = []
    for samples in recordings:
        c = chroma(samples, sound)
        many.append(max(0, len(c) - SPAN + 1))
        if many[-1]:
            image = np.zeros((len(c) + 1, 13))
            image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
            images.append(image)
            starts.append(base + np.arange(many[-1]))
            base += len(image)
    image, t = np.ascontiguousarray(np.concatenate(images).T), np.concatenate(starts)

    def area(t0, t1, y0, y1):
        return image[y1][t1] - image[y1][t0] - image[y0][t1] + image[y0][t0]

    packed = np.zeros(len(t), np.uint32)
    for kind, y, h, w in _filters():
        half, mid = w // 2, y + h // 2
        if kind == 0:
            a, b = area(t, t + w, y, y + h), area(t, t + w, 0, 12) * h / 12
        elif kind == 1:
            a, b = area(t, t + w, y, mid), area(t, t + w, mid, y + h)
        elif kind == 2:
            a, b = area(t, t + half, y, y + h), area(t + half, t + w, y, y + h)
        else:
            a = area(t, t + half, y, mid) + area(t + half, t + w, mid, y + h)
            b = area(t + half, t + w, y, mid) + area(t, t + half, mid, y + h)
        ratio = (a + 0.01) / (b + 0.01)
        level = sum((ratio >= edge).astype(np.uint32) for edge in np.exp(LEVELS))
        packed = (packed << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return np.split(packed.view(np.int32), np.cumsum(many)[:-1])


def fingerprints(media: DataFrame, id_col: str, audio_col: str, sound: Sound = Sound()) -> DataFrame:
    """(id, codes, fingerprint, alike) of each row of 8-bit samples: its codes, their hash, and what copies share: the hash
    of the codes, or of the samples if there are fewer codes than OVERLAP; null and empty audio have none of these."""

    def run(batches):
        for b in batches:
            at = 0
            while at < b.num_rows:
                # up to 256 recordings, of a few megabytes together unless one alone is longer
                rows, held = [], 0
                for x in text_bytes(b.column(1).slice(at, 256)):
                    if rows and held + len(x) > SLICE:
                        break
                    rows.append(x)
                    held += len(x)
                part, at = b.slice(at, len(rows)), at + len(rows)
                found = codes_of([np.frombuffer(x, np.uint8) for x in rows], sound)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                prints = [hashlib.md5(c.tobytes()).digest() if len(c) else None for c in found]
                alike = [p if len(c) >= OVERLAP else hashlib.md5(b"samples" + x).digest() if x else None for x, c, p in zip(rows, found, prints, strict=True)]
                codes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), codes, pa.array(prints, pa.binary()), pa.array(alike, pa.binary())], names=["id", "codes", "fingerprint", "alike"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, audio_col).mapInArrow(run, f"id {kind}, codes array<int>, fingerprint binary, alike binary")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def landmarks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, marks): of each NEAR pairs of codes in a row the least by hash; a mark that recurs counts where it is first."""
    c = codes.view(np.uint32).astype(np.uint64)
    if len(c) <= LAG:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mark = _mix((c[:-LAG] << np.uint64(32)) | c[LAG:])
    least = np.lib.stride_tricks.sliding_window_view(mark, min(NEAR, len(mark))).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    at = np.sort(at[np.unique(mark[at], return_index=True)[1]])
    return at, mark[at]


def _marks(batches):
    """Rows (rep, pos, mark, before): landmarks, each with a hash of the landmark before it and the distance from there."""
    for b in batches:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for rep, codes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            at, mark = landmarks(codes.values.to_numpy())
            if len(at):
                first = _mix(np.array([rep], np.int64).view(np.uint64) + np.uint64(1))
                before = np.r_[first, _mix(mark[:-1] + np.diff(at).astype(np.uint64))]
                for column, value in zip(out, (np.full(len(at), rep, np.int64), at.astype(np.int32), mark.view(np.int64), before.view(np.int64)), strict=True):
                    column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["rep", "pos", "mark", "before"])


def agreement(values: np.ndarray, start: np.ndarray, size: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(overlap, equal codes, share of differing bits) of recordings i and j laid on each other at their positions."""
    back, ahead = np.minimum(pos[i], pos[j]), np.minimum(size[i] - pos[i], size[j] - pos[j])
    n = (back + ahead).astype(np.int64)
    equal, bits = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    done = 0
    while done < len(i):
        stop = max(done + 1, int(np.searchsorted(np.cumsum(n[done:]), AT_ONCE)) + done)
        m = n[done:stop]
        edge = np.cumsum(m) - m
        inside = np.arange(int(m.sum())) - np.repeat(edge, m)
        left = np.repeat((start[i] + pos[i] - back)[done:stop], m) + inside
        right = np.repeat((start[j] + pos[j] - back)[done:stop], m) + inside
        differ = np.bitwise_count(values[left] ^ values[right]).astype(np.int64)
        bits[done:stop] = np.add.reduceat(differ, edge)
        equal[done:stop] = np.add.reduceat((differ == 0).astype(np.int64), edge)
        done = stop
    return n, equal, bits / (32.0 * n)


def _pairs(edge: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Index pairs to compare: within each group all, between two chunks only across; small groups many at once."""
    size = np.diff(edge)
    which = np.repeat(np.arange(len(size)), size)
    few = np.repeat(size <= 64, size)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(size[size <= 64].max()) if (size <= 64).any() else 1):
        k = np.flatnonzero((which[:-d] == which[d:]) & few[:-d])
        i.append(k)
        j.append(k + d)
    i, j = np.concatenate(i), np.concatenate(j)
    across = (lo[i] == hi[i]) | (own[i] != own[j])
    yield i[across], j[across]
    for g in np.flatnonzero(size > 64):
        for k in range(edge[g], edge[g + 1]):
            other = np.arange(k + 1, edge[g + 1])
            if lo[k] != hi[k]:
                other = other[own[other] != own[k]]
            yield np.full(len(other), k), other


def _lay(batches):
    """Rows (rep, root, other, off, votes, overlap, error): each recording that matches another of its group, with one it is linked to and its best match there."""
    for table in whole_runs(batches, "grp"):
        grp, rep, pos, own, lo, hi = (table.column(c).to_numpy() for c in ("grp", "rep", "pos", "own", "lo", "hi"))
        lists = table.column("codes").combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy().view(np.uint32)
        start, size, pos = ends[:-1], np.diff(ends), pos.astype(np.int64)
        edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
        found: list[tuple] = []
        for i, j in _pairs(edge, own, lo, hi):
            i, j = i[rep[i] != rep[j]], j[rep[i] != rep[j]]
            if i.size:
                n, votes, error = agreement(values, start, size, pos, i, j)
                good = (n >= OVERLAP) & (votes >= VOTES) & (error <= ERROR)
                found.append((i[good], j[good], votes[good], n[good], error[good]))
        if not found or not sum(len(f[0]) for f in found):
            continue
        i, j, votes, n, error = (np.concatenate([f[k] for f in found]) for k in range(5))
        root = local_roots(len(rep), i, j)
        a, b = np.r_[i, j], np.r_[j, i]
        votes, n, error = np.r_[votes, votes], np.r_[n, n], np.r_[error, error]
        order = np.lexsort([rep[b], -n, -votes, a])
        top = order[np.r_[True, a[order][1:] != a[order][:-1]]]
        a, b = a[top], b[top]
        columns = [rep[a], rep[root[a]], rep[b], (pos[a] - pos[b]).astype(np.int32), votes[top], n[top], error[top]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "root", "other", "off", "votes", "overlap", "error"])


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast if there are few of them, counted first; more are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def align(media: DataFrame, id_col: str = "doc_id", audio_col: str = "audio", sound: Sound = Sound()) -> DataFrame:
    """(id, n_codes, fingerprint, match_id, match_offset, votes, bit_error, component_id) of every recording; ids are integers.

    Recordings with the same codes are one class of the smallest id; so are those of fewer than OVERLAP codes with the same
    samples. Classes that share a landmark are laid on each other there and link when at least VOTES codes are equal, the overlap
    has at least OVERLAP codes and at most ERROR of its bits differ. Every pair of holders of a landmark is judged, those of
    frequent landmarks as pairs of chunks in many tasks; a landmark whose holders all have the same landmark at the
    same distance before it adds no pair and is left out. What leaves a task is a link and the best match of each recording, never
    all pairs. The match is the one of the most equal codes, then the longest overlap, then the smallest id; that of a copy is its
    class. Null and empty recordings have no match; null ids are left without a component. Repeated ids give repeated
    rows; an empty table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(media, id_col, audio_col, sound))
    classes = written(prints.where("alike is not null and id is not null").groupBy("alike").agg(F.min("id").cast("long").alias("rep")))
    reps = prints.where(F.size("codes") >= OVERLAP).select("alike", F.col("id").cast("long").alias("rep"), "codes")
    reps = reps.join(_small(classes), ["alike", "rep"], "left_semi")
    marks = reps.select("rep", "codes").mapInArrow(_marks, "rep bigint, pos int, mark bigint, before bigint")
    first = marks.groupBy("mark").agg(F.min("before").alias("least"), F.max("before").alias("most"), F.count("*").alias("n")).where("least <> most")
    shared = _small(written(first.select("mark", "n")))
    held = marks.select("rep", "pos", "mark").join(shared, "mark").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    held = written(held.select("rep", "pos", "own", "lo", "hi", F.xxhash64("mark", "lo", "hi").alias("grp")))
    asked = reps.join(_small(held.select("rep").distinct()), "rep", "left_semi").select("rep", "codes")
    laid = held.join(asked, "rep").repartition("grp").sortWithinPartitions("grp")
    found = written(laid.mapInArrow(_lay, "rep bigint, root bigint, other bigint, off int, votes bigint, overlap bigint, error double"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(found.select("rep", "other"))).withColumnRenamed("id", "rep")
    best = found.groupBy("rep").agg(F.max(F.struct("votes", "overlap", (-F.col("other")).alias("lower"), "off", "error")).alias("m"))
    named = classes.join(comps, "rep", "left").join(best, "rep", "left").select(
        "alike", "rep", F.coalesce("component", "rep").alias("component"), (-F.col("m.lower")).alias("match_id"), F.col("m.off").alias("match_offset"), F.col("m.votes").alias("votes"), F.col("m.error").alias("bit_error"))
    rows = prints.select("id", "alike", F.size("codes").cast("long").alias("n_codes"), F.lower(F.hex("fingerprint")).alias("fingerprint"))
    copy = F.col("id") > F.col("rep")
    return rows.join(named, "alike", "left").select(F.col("id").alias(id_col), "n_codes", "fingerprint",
        F.when(copy, F.col("rep")).otherwise(F.col("match_id")).alias("match_id"), F.when(copy, 0).otherwise(F.col("match_offset")).alias("match_offset"),
        F.when(copy, F.col("n_codes")).otherwise(F.col("votes")).alias("votes"), F.when(copy, 0.0).otherwise(F.col("bit_error")).alias("bit_error"), F.coalesce("component", "id").alias("component_id"))
