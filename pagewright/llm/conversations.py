"""Repair of conversations: the cheapest edits that make roles alternate, by Dial's shortest paths.

A node is (turns passed, role that stands last); keeping, changing, deleting and inserting turns are arcs of small integer cost.
Distances to the end are settled from circular buckets, one for each cost; the audit then walks from the start over tight arcs,
those on which the distance falls by just their cost, always the one of least letter.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import written

#: Costs of edits; an undeleted truncated turn adds TRUNCATED. No arc costs more than LARGEST.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LARGEST = max(DELETE, RENAME + TRUNCATED, INSERT)
#: Roles that stand last: none, system, user, assistant. The role that a new or renamed turn takes after each, and those it can follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
NEXT = (USER, USER, ASSISTANT, USER)
NEW_AFTER = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
KEPT_AFTER = ((), (START,), (START, SYSTEM, ASSISTANT), (USER,))
#: A turn's code: its role by initial (0: none of the three), CUT added if truncated; FORCED alone if it must be deleted.
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
CUT, FORCED = 4, 8
FAR = 1 << 60
#: Distance from each role to the end of a conversation.
END = (0, FAR, FAR, 0)
#: Conversations with more turns or bytes than these are worked on in segments of SEGMENT turns by many tasks.
LONG, LONG_BYTES, SEGMENT = 20_000, 64 << 20, 2_000
#: Long conversations are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_IDS = 100_000
_LAST = re.compile("[^\x20\x09-\x0d](?=[\x20\x09-\x0d]*\\Z)")


def distances(codes: list[int], ends: tuple[int, ...] = END) -> list[int]:
    """Least cost from each node 4 * (turns passed) + role to the end, where ``ends`` is what still lies ahead of each role.

    Dial's queue: as no arc costs over LARGEST, the nodes that wait fit LARGEST + 1 buckets used in turn.
    """
    n = len(codes)
    dist = [FAR] * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(LARGEST + 1)]
    seeds: dict[int, list[int]] = {}
    for role, d in enumerate(ends):
        if d < FAR:
            dist[4 * n + role] = d
            seeds.setdefault(d, []).append(4 * n + role)
    waiting, d = 0, min(ends)

    def reach(node: int, cost: int) -> None:
        nonlocal waiting
        if d + cost < dist[node]:
            dist[node] = d + cost
            buckets[(d + cost) % (LARGEST + 1)].append(node)
            waiting += 1

    while waiting or seeds:
        bucket = buckets[d % (LARGEST + 1)]
        found = seeds.pop(d, ())
        bucket.extend(found)
        waiting += len(found)
        while bucket:  # arcs that cost nothing lead back to it
            node = bucket.pop()
            waiting -= 1
            if dist[node] != d:
                continue
            role = node & 3
            for before in NEW_AFTER[role]:
                reach(node - role + before, INSERT)
            if node >= 4:
                code, at = codes[(node >> 2) - 1], node - role - 4
                extra = TRUNCATED if code & CUT else 0
                reach(at + role, DELETE)
                for before in NEW_AFTER[role]:
                    reach(at + before, RENAME + extra)
                if code & 3 == role:
                    for before in KEPT_AFTER[role]:
                        reach(at + before, extra)
        d += 1
    return dist


def walk(codes: bytes | list[int], dist: list[int], role: int, last: bool = True) -> tuple[str, int]:
    """The least audit over tight arcs and the role it ends in; only the ``last`` segment inserts turns after its own.

    ``codes`` has all turns, ``dist`` passes over forced ones: their deletion is the least letter wherever it stands and costs the same on every path.
    """
    edits, at = [], 0
    for code in codes:
        if code == FORCED:
            edits.append("D")
            continue
        extra, own = TRUNCATED if code & CUT else 0, code & 3
        while True:
            d = dist[at + role]
            if d == DELETE + dist[at + 4 + role]:
                edits.append("D")
                break
            if d == INSERT + dist[at + NEXT[role]]:
                edits.append("I")
                role = NEXT[role]
                continue
            if role in KEPT_AFTER[own] and d == extra + dist[at + 4 + own]:
                edits.append("K")
                role = own
            else:
                edits.append("R")
                role = NEXT[role]
            break
        at += 4
    while last and dist[at + role]:
        edits.append("I")
        role = NEXT[role]
    return "".join(edits), role


def fault(text: str, seen: bool) -> str:
    """The first fault of a turn: blank, duplicate, truncated or none."""
    end = _LAST.search(text)
    if not end:
        return "blank"
    return "duplicate" if seen else "" if end[0] in ".!?" else "truncated"


def code_of(role: str, what: str) -> int:
    return FORCED if what in ("blank", "duplicate") else INITIALS.get(role[:1], 0) | (CUT if what else 0)


class Ledger:
    """Counts, cost, audit and digest of one conversation whose turns pass in order; its memory doesn't grow with the texts."""

    def __init__(self) -> None:
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        self.low = self.high = self.turn = self.initial = None
        self.turns, self.role, self.audit, self.sha, self.out = 0, START, [], hashlib.sha256(), 0

    def _write(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.out else ''}{role}:{text}".encode())
        self.out += 1

    def insert(self) -> tuple[str, str]:
        self.role = NEXT[self.role]
        self.audit.append("I")
        self.count["cost"] += INSERT
        self._write(NAMES[self.role], "")
        return NAMES[self.role], ""

    def turn_passes(self, turn: int | None, role: str, text: str, code: int, edit: str) -> tuple[str, str] | None:
        """Count a turn and its edit; the role and text that are left of it."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        self.count["illegal"] += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        what = fault(text, code == FORCED)
        if what:
            self.count[what] += 1
        self.audit.append(edit)
        if edit == "D":
            self.count["cost"] += DELETE
            return None
        self.count["cost"] += (RENAME if edit == "R" else 0) + (TRUNCATED if code & CUT else 0)
        self.role = NEXT[self.role] if edit == "R" else code & 3
        role = NAMES[self.role] if edit == "R" else role
        self._write(role, text)
        return role, text

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.count.values(), "".join(self.audit), self.sha.hexdigest()


def follow(ledger: Ledger, turns: list[tuple], audit: str):
    """Pass (turn, role, text, code) with their edits to the ledger; yields (edit, turn, role, text), null role and text where deleted."""
    rows = iter(turns)
    for edit in audit:
        if edit == "I":
            yield "I", None, *ledger.insert()
        else:
            turn, role, text, code = next(rows)
            yield edit, turn, *(ledger.turn_passes(turn, role, text, code, edit) or (None, None))


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _streamed(rows, out, names: list[str], kinds: list[pa.DataType], size: int = 2_000, most: int = 8 << 20):
    """Batches of what ``out`` makes of ``rows``, cut by number and by bytes of their strings."""
    held, weight = [], 0
    for row in out(rows):
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) == size or weight > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}


def _schemas(kind: str, steps: bool) -> tuple[str, list[str], list[pa.DataType]]:
    """Spark schema, names and Arrow types of a result keyed by a conversation id of this type."""
    if kind not in _KINDS:
        raise TypeError(f"conversation ids are integers or strings, not {kind}")
    fields = [("conv_id", kind)]
    fields += [("step", "bigint"), ("edit", "string"), ("turn", "bigint"), ("role", "string"), ("text", "string")] if steps else [*((c, "bigint") for c in _COUNTS), ("audit", "string"), ("repaired_sha256", "string")]
    return ", ".join(f"{n} {k}" for n, k in fields), [n for n, _ in fields], [_KINDS[k] for _, k in fields]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copy): turns damaged by crc32 of ``conv_id:turn`` modulo 20, nulls read as one space.

    0 drops a turn, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it next to it, 4 makes its role user. Other columns are ignored.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _whole(kind: str, steps: bool):
    """Repair of conversations that each fit a task's memory, from rows sorted by conversation, turn, role and text."""
    _, names, kinds = _schemas(kind, steps)

    def mended(rows):
        for conv, group in groupby(rows, itemgetter(0)):
            seen, turns = set(), []
            for _, turn, role, text in group:
                at = (role, hashlib.md5(text.encode()).digest())
                turns.append((turn, role, text, code_of(role, fault(text, at in seen))))
                seen.add(at)
            codes = [t[3] for t in turns]
            audit, _ = walk(codes, distances([c for c in codes if c != FORCED]), START)
            ledger = Ledger()
            script = follow(ledger, turns, audit)
            if steps:
                yield from ((conv, k, *x) for k, x in enumerate(script))
            else:
                for _ in script:
                    pass
                yield conv, *ledger.row()

    return lambda batches: _streamed(_rows(batches), mended, names, kinds)


def _placed(kind: str):
    """Rows of long conversations in global order to (conv, seg, k, turn, role, text, code); segments are numbered in that order."""
    names = ["conv", "seg", "k", "turn", "role", "text", "code"]
    kinds = [_KINDS[kind], pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def placed(rows):
        seg, k, last = (TaskContext.get().partitionId() << 32) - 1, 0, ()
        for conv, turn, role, text, seen in rows:
            if (conv,) != last or k == SEGMENT:
                seg, k, last = seg + 1, 0, (conv,)
            yield conv, seg, k, turn, role, text, code_of(role, fault(text, seen))
            k += 1

    return lambda batches: _streamed(_rows(batches), placed, names, kinds)


def _segments(kind: str):
    """Codes of each segment, and the least cost from each role at its start to each role at its end."""

    def gathered(rows):
        for (conv, seg), group in groupby(rows, itemgetter(0, 1)):
            codes = [r[2] for r in group]
            free = [c for c in codes if c != FORCED]
            across = [distances(free, tuple(0 if role == end else FAR for role in range(4)))[:4] for end in range(4)]
            yield conv, seg, bytes(codes), [across[end][role] for role in range(4) for end in range(4)]

    return lambda batches: _streamed(_rows(batches), gathered, ["conv", "seg", "codes", "across"], [_KINDS[kind], pa.int64(), pa.binary(), pa.list_(pa.int64())])


def _ahead(kind: str):
    """What lies ahead of each role at the end of each segment, from the segments of a conversation, last first."""

    def added(rows):
        for conv, group in groupby(rows, itemgetter(0)):
            ends, last = list(END), True
            for _, seg, across in group:
                yield conv, seg, ends, last
                ends, last = [min(FAR, *(across[4 * role + end] + ends[end] for end in range(4))) for role in range(4)], False

    return lambda batches: _streamed(_rows(batches), added, ["conv", "seg", "ends", "last"], [_KINDS[kind], pa.int64(), pa.list_(pa.int64()), pa.bool_()])


def _walked(kind: str):
    """Audit and last role of each segment for each role that it may start from."""

    def all_ways(rows):
        for conv, seg, codes, ends, last in rows:
            dist = distances([c for c in codes if c != FORCED], tuple(ends))
            for role in range(4):
                if dist[role] < FAR:
                    yield conv, seg, role, *walk(codes, dist, role, last)

    return lambda batches: _streamed(_rows(batches), all_ways, ["conv", "seg", "entry", "audit", "exit"], [_KINDS[kind], pa.int64(), pa.int32(), pa.string(), pa.int32()])


def _chained(kind: str):
    """The role that each segment of a conversation really starts from, first segment first."""

    def chosen(rows):
        for conv, group in groupby(rows, itemgetter(0)):
            role = START
            for seg, ways in groupby(group, itemgetter(1)):
                yield conv, seg, role
                role = {w[2]: w[3] for w in ways}[role]

    return lambda batches: _streamed(_rows(batches), chosen, ["conv", "seg", "entry"], [_KINDS[kind], pa.int64(), pa.int32()])


def _told(kind: str, steps: bool):
    """Ledgers of long conversations from a stream of their audits and turns in order; one segment is held at a time."""
    _, names, kinds = _schemas(kind, steps)

    def told(rows):
        for conv, group in groupby(rows, itemgetter(0)):
            ledger, k = Ledger(), 0
            for _, part in groupby(group, itemgetter(1)):
                audit = next(part)[3]
                for x in follow(ledger, (r[4:] for r in part), audit):
                    if steps:
                        yield conv, k, *x
                    k += 1
            if not steps:
                yield conv, *ledger.row()

    return lambda batches: _streamed(_rows(batches), told, names, kinds)


def _same(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of which the conversation may be null."""
    a, b = a.alias("a"), b.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    joined = a.join(b, on, how)
    return joined.select("a.*") if how in ("left_semi", "left_anti") else joined.select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in columns])


def _long(rows: DataFrame, kind: str, steps: bool) -> DataFrame:
    """Repair of long conversations: many tasks find the distances across segments, then walk them; only totals and the final digest pass in order.

    Rows come in global order of conversation, turn, role and text, so even one conversation or one turn is dealt to many tasks. SHA-256
    has to see a text from its start, so the turns of one conversation pass one task at the end, as a stream.
    """
    salted = written(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("role", "text")).withColumn("h2", F.hash("text", "role")))
    place = F.struct(F.col("turn").isNotNull().alias("t"), F.coalesce("turn", F.lit(0)).alias("turn"), "id")
    firsts = written(salted.groupBy("conv", "h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    few = F.broadcast(firsts) if firsts.count() <= BROADCAST_IDS else firsts
    marked = _same(salted, few, ["conv", "h", "h2"], "left").withColumn("seen", F.coalesce(F.col("first.id") != F.col("id"), F.lit(False)))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ordered = marked.repartitionByRange(*order, F.substring("text", 1, 64), "id").sortWithinPartitions(*order, "text", "id")
    columns = f"conv {kind}, seg bigint"
    placed = written(ordered.select("conv", "turn", "role", "text", "seen").mapInArrow(_placed(kind), f"{columns}, k bigint, turn bigint, role string, text string, code int"))
    codes = placed.select("conv", "seg", "code", "k").repartition("seg").sortWithinPartitions("seg", "k").select("conv", "seg", "code")
    segments = written(codes.mapInArrow(_segments(kind), f"{columns}, codes binary, across array<bigint>"))
    back = segments.select("conv", "seg", "across").repartition("conv").sortWithinPartitions("conv", F.desc("seg"))
    ahead = back.mapInArrow(_ahead(kind), f"{columns}, ends array<bigint>, last boolean")
    walks = written(segments.join(ahead.drop("conv"), "seg").select("conv", "seg", "codes", "ends", "last").mapInArrow(_walked(kind), f"{columns}, entry int, audit string, exit int"))
    forth = walks.select("conv", "seg", "entry", "exit").repartition("conv").sortWithinPartitions("conv", "seg")
    entries = forth.mapInArrow(_chained(kind), f"{columns}, entry int")
    audits = walks.join(entries.drop("conv"), ["seg", "entry"]).select("conv", "seg", F.lit(-1).cast("long").alias("k"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("code", "int"))])
    turns = placed.select("conv", "seg", "k", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "code")
    return audits.union(turns).repartition("conv").sortWithinPartitions("conv", "seg", "k").mapInArrow(_told(kind, steps), _schemas(kind, steps)[0])


def _mended(conversations: DataFrame, damaged: DataFrame, steps: bool) -> DataFrame:
    kind = dict(conversations.dtypes)["conv_id"]
    schema = _schemas(kind, steps)[0]
    sizes = damaged.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    hot = written(sizes.where((F.col("n") > LONG) | (F.col("bytes") > LONG_BYTES)).select("conv"))
    n_hot = hot.count()
    few = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
    own = (_same(damaged, few, ["conv"], "left_anti") if n_hot else damaged).select("conv", "turn", "role", "text")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    done = own.repartition("conv").sortWithinPartitions(*order).mapInArrow(_whole(kind, steps), schema)
    return done.union(_long(_same(damaged, few, ["conv"], "left_semi").select("conv", "turn", "role", "text"), kind, steps)) if n_hot else done


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, step, edit, turn, role, text): the edits that repair each conversation of (conv_id, turn, role, text), in order.

    Roles and texts are those after repair, null where a turn is deleted; an inserted turn has no number. Turns go by number, nulls first, then by role
    and text, so rows that repeat are adjacent and all but the first of a role and text are duplicates. Null roles and texts are read as one
    space; a null conversation id is a conversation. A role is known by its initial. An empty table gives an empty result; other columns are ignored.
    """
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    return _mended(conversations, rows, True)


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): faults and repair of each conversation, damaged first.

    Orders, nulls and repeated rows as in ``repair``. Conversations of which damage leaves no turn have zeros, an empty audit and the digest of an empty text.
    """
    rows = damage(conversations)
    found = _mended(conversations, rows, False)
    left = conversations.select(F.col("conv_id").alias("conv")).distinct()
    gone = _same(left, rows.select("conv").distinct(), ["conv"], "left_anti")
    zeros: list[Column] = [F.lit(0).cast("long").alias(c) for c in _COUNTS]
    return found.union(gone.select(F.col("conv").alias("conv_id"), *zeros, F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256")))


ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) AS hx FROM conversations),
summed AS (
  SELECT raw.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::bigint)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM raw, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM summed, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS own FROM placed),
convs AS (SELECT DISTINCT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM conversations),
turns AS (SELECT c, j.* FROM judged j JOIN convs ON j.conv_id IS NOT DISTINCT FROM convs.conv_id),
counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pos > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY c),
follow(a, b) AS (VALUES (0, 2), (1, 2), (3, 2), (2, 3)),
fill(a, b, ins) AS (
  VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (2, 3, 'I'), (3, 2, 'I'), (0, 3, 'II'), (1, 3, 'II')),
edits AS (
  SELECT t.c, t.pos, f.a, f.ins, f.b, e.edit, e.z, 3 * length(f.ins) + e.cost AS cost,
         CASE f.ins WHEN '' THEN '' WHEN 'II' THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE CASE f.b WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10) END
         || CASE e.edit WHEN 'K' THEN role || ':' || text || chr(10) WHEN 'R' THEN CASE e.z WHEN 2 THEN 'user:' ELSE 'assistant:' END || text || chr(10) ELSE '' END AS piece
  FROM turns t, fill f, LATERAL (
    SELECT 'D' AS edit, f.b AS z, 4 AS cost
    UNION ALL SELECT 'R', follow.b, CASE t.fault WHEN 'truncated' THEN 6 ELSE 3 END FROM follow WHERE follow.a = f.b AND t.fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT 'K', t.own, CASE t.fault WHEN 'truncated' THEN 3 ELSE 0 END
      WHERE t.fault NOT IN ('blank', 'duplicate') AND ((t.own = 1 AND f.b = 0) OR (t.own = 2 AND f.b IN (0, 1, 3)) OR (t.own = 3 AND f.b = 2))) e),
paths AS (
  SELECT c, 0::bigint AS pos, 0 AS state, 0::bigint AS cost, '' AS audit, '' AS made FROM counted
  UNION ALL
  SELECT c, pos, state, best.cost, best.audit, best.made FROM (
    SELECT p.c, e.pos, e.z AS state, min({'cost': (p.cost + e.cost)::bigint, 'audit': p.audit || e.ins || e.edit, 'made': p.made || e.piece}) AS best
    FROM paths p JOIN edits e ON e.c = p.c AND e.pos = p.pos + 1 AND e.a = p.state GROUP BY p.c, e.pos, e.z)),
ended AS (
  SELECT p.c, min({'cost': p.cost + 3 * length(f.ins), 'audit': p.audit || f.ins,
         'made': p.made || CASE f.ins WHEN '' THEN '' WHEN 'II' THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE 'assistant:' || chr(10) END}) AS best
  FROM paths p JOIN counted k ON p.c = k.c AND p.pos = k.n JOIN fill f ON f.a = p.state AND f.b IN (0, 3) GROUP BY p.c)
SELECT conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
       coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(best.cost, 0)::bigint AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.made, greatest(length(best.made) - 1, 0)), '')) AS repaired_sha256
FROM convs LEFT JOIN counted USING (c) LEFT JOIN ended USING (c)
"""
