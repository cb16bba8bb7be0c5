"""Removal of repeated byte strings by depth-limited radix sorting of suffixes.

Every start of a 100-byte window is a suffix to be ordered through its first 100 bytes only. Equal windows contain the
same least k-gram by hash (their anchor), so suffixes are dealt to tasks by anchor: a suffix whose anchor occurs nowhere
else cannot repeat and costs one row for about forty suffixes. Suffixes around an anchor with other surroundings are
sorted by most-significant-digit passes of eight bytes that keep only groups of two or more; the groups left after the last
digit are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import text_bytes, whole_runs, written

#: Bytes of a window and of the k-grams of which the least one is its anchor.
WINDOW, GRAM = 100, 24
#: Bytes of text that a task looks at together.
SLICE = 4 << 20
#: An anchor with more different surroundings in the corpus has its windows compared one by one, dealt out by their
#: digests; one with so many in a single slice has its runs dealt out by their surroundings already in the survey.
HOT = 64
#: Ids are broadcast to pick documents up to this number (8 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_MASK = np.uint64((1 << 24) - 1)


def _words(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one number, the first the most significant; zeros after the end."""
    w = np.r_[buf, np.zeros(8, np.uint8)].astype(np.uint64)
    for k in (1, 2, 4):
        w = (w[:-k] << np.uint64(8 * k)) | w[k:]
    return w[: len(buf)]


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    w = np.r_[_words(buf), np.zeros(16, np.uint64)]
    n = len(buf)
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h + w[8 : n + 8]) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h = (h + w[16 : n + 16]) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor hash, start in the joined texts) of each run of windows with one anchor."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(buf) < WINDOW:
        return none
    h = _gram_hashes(buf)
    low = (h & ~_MASK) | np.arange(len(buf), dtype=np.uint64)
    width, have = WINDOW - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    at = np.arange(len(buf) - WINDOW + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = at[at + WINDOW <= ends[owner[: len(at)]]]
    if not at.size:
        return none
    owner = owner[at]
    spot = (low[at] & _MASK).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
    first, last, who = at[cut], at[np.r_[cut[1:], len(at)] - 1], owner[cut]
    base = (ends - sizes)[who]
    return who, first - base, last - base, h[spot[cut]], first


def _first_of(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then document and start; and which rows in it are the first with their keys."""
    order = np.lexsort([start, doc, *keys[::-1]])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new |= np.r_[True, s[1:] != s[:-1]]
    return order, new


_SURVEYED = "route bigint, h bigint, c bigint, doc bigint, s int, e int, kind int"
_RESOLVED = "doc bigint, s int, e int, h bigint, kind int"
#: What a row of the survey or of the resolved runs is: covered bytes, a run of windows, one of a hot anchor, a hot anchor's mark.
COVER, RUN, HOT_RUN, MARK = range(4)


def _slices(batch: pa.RecordBatch):
    docs, texts, held = batch.column(0).to_pylist(), [], 0
    ids: list[int] = []
    for doc, text in zip(docs, text_bytes(batch.column(1)), strict=True):
        # a text longer than a slice is looked at in parts that share a window less one byte
        for at in range(0, max(1, len(text) - WINDOW + 1), SLICE):
            part = text[at : at + SLICE + WINDOW - 1]
            if held and held + len(part) > 2 * SLICE:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append((doc, at))
            texts.append(part)
            held += len(part)
    if texts:
        yield ids, texts


def survey(batches):
    """Runs of windows by anchor. Of equal runs in a slice only the first goes on; the others are covered."""
    for batch in batches:
        for ids, texts in _slices(batch):
            who, first, last, h, at = anchors(texts)
            if not len(who):
                continue
            joined = b"".join(texts)
            digest = xxhash.xxh64_intdigest
            c = np.array([digest(joined[a:b]) for a, b in zip(at.tolist(), (at + last - first + WINDOW).tolist(), strict=True)], np.uint64).view(np.int64)
            doc = np.array([d for d, _ in ids], np.int64)[who]
            shift = np.array([a for _, a in ids], np.int64)[who]
            h, s, e = h.view(np.int64), first + shift, last + shift
            order, new = _first_of([h, c], doc, s)
            old = order[~new]
            keep = order[new]
            many = np.diff(np.flatnonzero(np.r_[True, h[keep][1:] != h[keep][:-1], True]))
            hot = np.repeat(many > HOT, many)
            route = np.where(hot, h[keep] ^ (c[keep] * np.int64(0x1E3779B97F4A7C15)), h[keep])
            marks = np.unique(h[keep][hot])
            z = np.zeros(len(marks), np.int64)
            o = np.zeros(len(old), np.int64)
            columns = [
                np.r_[doc[old], route, marks], np.r_[o, h[keep], marks], np.r_[o, c[keep], z], np.r_[doc[old], doc[keep], z],
                np.r_[s[old], s[keep], z].astype(np.int32), np.r_[e[old] + WINDOW, e[keep], z].astype(np.int32),
                np.r_[o + COVER, np.where(hot, HOT_RUN, RUN), z + MARK].astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["route", "h", "c", "doc", "s", "e", "kind"])


def settle(batches):
    """Of equal runs the first goes on if its anchor has other surroundings too; the others are covered.

    Rows come sorted by anchor, kind, surroundings, document and start, and are read as a stream: between batches only the
    last row, the number of surroundings of its anchor and a run that still waits for others are kept, however many runs
    an anchor has. An anchor with over HOT surroundings, or with a mark that it was hot in a slice, leaves a mark behind.
    """
    last, classes, marked, waiting = None, 0, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        route, h, c, doc, s, e, kind = (batch.column(k).to_numpy() for k in ("route", "h", "c", "doc", "s", "e", "kind"))
        out: list[tuple[np.ndarray, ...]] = []

        def put(rows, end, what):
            out.append((doc[rows], s[rows], end, h[rows], np.full(len(rows), what, np.int32)))

        cover = np.flatnonzero(kind == COVER)
        put(cover, e[cover], COVER)
        # runs of slices in which their anchor is hot, dealt by their surroundings: the first of equal ones goes on
        dealt = np.flatnonzero(kind == HOT_RUN)
        same = np.r_[False, (h[dealt][1:] == h[dealt][:-1]) & (c[dealt][1:] == c[dealt][:-1])] if len(dealt) else np.zeros(0, bool)
        if len(dealt) and last is not None:
            same[0] = last == (HOT_RUN, h[dealt[0]], c[dealt[0]])
        put(dealt[same], e[dealt[same]] + WINDOW, COVER)
        put(dealt[~same], e[dealt[~same]], HOT_RUN)
        # all other runs of an anchor, and its marks before them
        rest = np.flatnonzero((kind == RUN) | (kind == MARK))
        edge = np.flatnonzero(np.r_[True, h[rest][1:] != h[rest][:-1], True]) if len(rest) else np.zeros(1, np.int64)
        if len(rest):
            if last is None or last[:2] != (RUN, h[rest[0]]):
                classes, marked, waiting = 0, False, None
            new = np.r_[True, (h[rest][1:] != h[rest][:-1]) | (c[rest][1:] != c[rest][:-1]) | (kind[rest][1:] != kind[rest][:-1])] & (kind[rest] == RUN)
            if kind[rest[0]] == RUN and last == (RUN, h[rest[0]], c[rest[0]]):
                new[0] = False
            firsts = np.add.reduceat(new.astype(np.int64), edge[:-1])
            marks = np.add.reduceat((kind[rest] == MARK).astype(np.int64), edge[:-1]) > 0
            before, n = np.zeros(len(firsts), np.int64), firsts.copy()
            before[0], n[0], marks[0] = classes, classes + firsts[0], marks[0] or marked
            if waiting is not None and (n[0] > 1 or marks[0]):
                out.append(waiting)
                waiting = None
            open_ = np.repeat((n > 1) | marks, np.diff(edge))
            old = rest[~new & (kind[rest] == RUN)]
            put(old, e[old] + WINDOW, COVER)
            put(rest[new & open_], e[rest[new & open_]], RUN)
            # hot anchors say so once: when their surroundings pass HOT, or at their first mark
            hot = rest[edge[:-1][((n > HOT) & (before <= HOT)) | (marks & ~np.r_[marked, np.zeros(len(n) - 1, bool)])]]
            put(hot, np.zeros(len(hot), np.int32), MARK)
            if len(firsts) > 1:
                waiting = None
            alone = rest[new & ~open_]
            if n[-1] == 1 and firsts[-1] and not marks[-1]:
                k = alone[-1:]
                waiting = (doc[k], s[k], e[k], h[k], np.full(1, RUN, np.int32))
            classes, marked = int(n[-1]), bool(marks[-1])
        if len(rest) or len(dealt):
            k = max(rest[-1] if len(rest) else -1, dealt[-1] if len(dealt) else -1)
            last = (HOT_RUN if kind[k] == HOT_RUN else RUN, h[k], c[k])
        columns = [np.concatenate([x[k] for x in out]) for k in range(5)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(columns, (np.int64, np.int32, np.int32, np.int64, np.int32), strict=True)], names=["doc", "s", "e", "h", "kind"])


def fetch(batches):
    """Bytes of the open runs, or digests of the single windows of hot ones; rows (doc, text, runs)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out: list[list] = [[], [], [], [], []]
            single: list[tuple] = []
            part = batch.slice(at, 256)
            for doc, text, runs in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                for run in runs:
                    s, e, h, kind = run["s"], run["e"], run["h"], run["kind"]
                    if kind == RUN:
                        for column, value in zip(out, (h, 0, doc, s, text[s : e + WINDOW]), strict=True):
                            column.append(value)
                    else:
                        single += [(xxhash.xxh3_128_digest(text[p : p + WINDOW]), doc, p) for p in range(s, e + 1)]
            single.sort()
            for k, (d, doc, p) in enumerate(single):
                # of equal windows here the first goes on, the others are covered and say so by an empty digest
                again = bool(k) and single[k - 1][0] == d
                halves = (doc, 0) if again else (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))
                for column, value in zip(out, (*halves, doc, p, b"" if again else d), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["route", "rest", "doc", "s", "ctx"])


def equal_windows(starts: np.ndarray, group: np.ndarray, words: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit radix passes over the suffixes at ``starts``, each digit eight bytes of ``words``.

    Suffixes start in groups; a pass splits each group by the next digit and drops suffixes left alone. Returns the
    indexes of those left at ``depth`` bytes and their groups, which are exactly the equal windows.
    """
    live = np.arange(len(starts))
    for digit in [*range(0, depth - 8, 8), depth - 8]:
        key = words[starts[live] + digit]
        order = np.lexsort([key, group])
        live, group, key = live[order], group[order], key[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])] if len(live) else np.zeros(0, bool)
        size = np.diff(np.r_[np.flatnonzero(new), len(live)])
        more = np.repeat(size > 1, size)
        live, group = live[more], np.cumsum(new)[more]
    return live, group


def _spans(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Covered bytes (doc, s, e) of windows that start at ``at``; windows that overlap or touch are one span."""
    order = np.lexsort([at, doc])
    d, p = doc[order], at[order]
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + WINDOW)])
    end = p[np.r_[cut[1:], len(p)] - 1] + WINDOW
    return pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(p[cut].astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc", "s", "e"])


def sort_runs(table: pa.Table):
    """Covered bytes (doc, s, e) from runs of windows with their bytes, whole anchors, of at most HOT runs each."""
    route, doc, s = (table.column(k).to_numpy() for k in ("route", "doc", "s"))
    ctx = table.column("ctx").to_pylist()
    size = np.array([len(x) for x in ctx])
    edge = np.flatnonzero(np.r_[True, route[1:] != route[:-1], True])
    step = 0
    while step + 1 < len(edge):
        stop = step + 1
        while stop + 1 < len(edge) and size[edge[step] : edge[stop + 1]].sum() < SLICE:
            stop += 1
        rows = np.arange(edge[step], edge[stop])
        step = stop
        words = _words(np.frombuffer(b"".join(ctx[i] for i in rows), np.uint8))
        many = size[rows] - WINDOW + 1
        which = np.repeat(np.arange(len(rows)), many)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        starts = (np.cumsum(size[rows]) - size[rows])[which] + inside
        live, group = equal_windows(starts, route[rows][which], words)
        at_doc, at = doc[rows][which[live]], s[rows][which[live]] + inside[live]
        order, new = _first_of([group], at_doc, at)
        if not new.all():
            yield _spans(at_doc[order[~new]], at[order[~new]].astype(np.int64))


def sort_fetched(batches):
    """Covered bytes of single windows, all but the first of a digest, and of runs; sorted by route, document and start.

    A digest may be that of very many windows: they pass as a stream of which only the last row is kept. Runs wait until
    their anchor ends.
    """
    last, waiting = None, []
    for batch in batches:
        size = pc.binary_length(batch.column("ctx")).to_numpy(zero_copy_only=False)
        windows, runs = batch.filter(pa.array(size < WINDOW)), batch.filter(pa.array(size >= WINDOW))
        if windows.num_rows:
            route, rest, doc, s = (windows.column(k).to_numpy() for k in ("route", "rest", "doc", "s"))
            again = np.r_[last == (route[0], rest[0]), (route[1:] == route[:-1]) & (rest[1:] == rest[:-1])] | (size[size < WINDOW] == 0)
            last = (route[-1], rest[-1])
            if again.any():
                yield _spans(doc[again], s[again].astype(np.int64))
        if runs.num_rows:
            *done, tail = whole_runs(iter([*waiting, runs]), "route")
            waiting = tail.to_batches()
            for table in done:
                yield from sort_runs(table)
    if waiting:
        yield from sort_runs(pa.Table.from_batches(waiting))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc, text) with a doc in ``ids``; a checked number of ids is broadcast, more are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc, id, text) of all rows, and (doc, text) of each document once: rows that repeat id and text are one document.

    Ids that are unique order themselves; else documents are numbered by id, null last, and text hash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    odd = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").limit(1).count()
    if not odd and dict(rows.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint"):
        own = rows.select(F.col("id").cast("long").alias("doc"), "id", "text")
        return own, own.select("doc", "text")
    keyed = rows.withColumn("th", F.xxhash64("text"))
    # in sorted order these numbers rise, with gaps between partitions
    numbers = written(keyed.select("id", "th").distinct().orderBy(F.col("id").asc_nulls_last(), "th").withColumn("doc", F.monotonically_increasing_id()))
    k, n = keyed.alias("k"), numbers.alias("n")
    rows = written(k.join(n, F.col("k.id").eqNullSafe(F.col("n.id")) & (F.col("k.th") == F.col("n.th"))).select("n.doc", "k.id", "k.text"))
    return rows, written(rows.groupBy("doc").agg(F.min("text").alias("text")))


def covered(texts: DataFrame) -> DataFrame:
    """(doc, spans) of every document that repeats a window which starts earlier; ``texts`` (doc, text) has each document once.

    Windows around hot anchors and equal runs are settled by 64- and 128-bit digests; all others are compared byte by byte.
    """
    order = F.when(F.col("kind") == MARK, 0).otherwise(1)
    runs = texts.mapInArrow(survey, _SURVEYED).repartition("route").sortWithinPartitions("route", "h", order, "c", "doc", "s")
    settled = written(runs.mapInArrow(settle, _RESOLVED))
    hot = settled.where(F.col("kind") == MARK).select("h").distinct().withColumn("hot", F.lit(True))
    open_runs = settled.where(F.col("kind").isin(RUN, HOT_RUN)).join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot, "h", "left")
    open_runs = open_runs.withColumn("kind", F.when(F.col("hot"), HOT_RUN).otherwise(F.col("kind")))
    by_doc = open_runs.groupBy("doc").agg(F.collect_list(F.struct("s", "e", "h", "kind")).alias("runs"))
    wanted = _picked(texts, open_runs.select("doc").distinct())
    fetched = wanted.join(by_doc, "doc").select("doc", "text", "runs").mapInArrow(fetch, "route bigint, rest bigint, doc bigint, s int, ctx binary")
    fetched = fetched.repartition("route").sortWithinPartitions("route", "rest", "doc", "s")
    rest = fetched.mapInArrow(sort_fetched, "doc bigint, s int, e int")
    spans = settled.where(F.col("kind") == COVER).select("doc", "s", "e").union(rest)
    return written(spans.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): each text without its repeated bytes.

    A byte goes if a 100-byte string over it also starts earlier: in a document of smaller id, or earlier in its own.
    Matches never cross documents; strings are judged on the input. Null texts count as empty. Rows that repeat an id
    with other texts are ordered by text hash, null ids last; rows that repeat id and text are one document and get its
    result each. An empty table gives an empty result; other columns are ignored.
    """
    rows, once = _numbered(docs, id_col, text_col)
    spans = covered(once)
    ids = spans.select("doc")
    few = ids.count() <= BROADCAST_IDS
    own = rows.join(F.broadcast(ids) if few else ids, "doc", "left_anti")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = own.select(F.col("id").alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"), *([text.cast("binary").alias("kept")] if texts else []))
    kind = dict(rows.dtypes)["id"]

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for b, found in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                runs = merged([(x["s"], x["e"]) for x in found])
                kept, at = [], 0
                for s, e in runs:
                    kept.append(b[at:s])
                    at = e
                whole = b"".join([*kept, b[at:]])
                for column, value in zip(out, (len(b), len(b) - len(whole), len(runs), hashlib.sha256(whole).hexdigest(), whole), strict=True):
                    column.append(value)
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(out[: 4 + texts], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts])

    picked = rows.join(F.broadcast(ids), "doc", "left_semi") if few else rows
    hit = picked.join(spans, "doc").select("id", "text", "spans")
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts
    return plain.union(hit.mapInArrow(cut, schema))
