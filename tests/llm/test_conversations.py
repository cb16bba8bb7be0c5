"""Repair of conversations against a search over all edits, in memory and in segments."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from pagewright.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, seg long, k long, code int, audit string, conv long, n long, h long, id long, copy long"
BLANK = "\x20\x09-\x0d"


def table(spark, rows):
    """Turns with columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 5, 6, 7, 8, 9) for r in rows], SCHEMA)


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, "user" if kind == 4 else role, text


def brute(turns):
    """Best of all edit scripts by cost, then audit: a search over whole scripts that keeps no distances."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    faults, seen = [], set()
    for _, role, text in turns:
        end = re.search(f"[^{BLANK}](?=[{BLANK}]*\\Z)", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[0] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, at, form, made = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", form):
            break
        if (at, form[-1:]) in done:
            continue
        done.add((at, form[-1:]))
        ways = [("I", 3, at, r, "") for r in ("user", "assistant")]
        if at < len(turns):
            _, role, text = turns[at]
            ways.append(("D", 4, at + 1, None, None))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 if faults[at] else 0
                ways += [("K", extra, at + 1, role, text)] + [("R", 3 + extra, at + 1, r, text) for r in ("user", "assistant")]
        for edit, more, to, role, text in ways:
            then = form if role is None else form + role[:1] if role[:1] else form + "?"
            if re.fullmatch("s?(ua)*u?", then):
                heapq.heappush(heap, (cost + more, audit + edit, to, then, made if role is None else f"{made}\n{role}:{text}"))
    numbers = [t[0] for t in turns if t[0] is not None]
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256(made[1:].encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", "Well. \n", "é…", None, "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]
    out = [(c, rng.choice([*range(6), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Turn {rng.randint(0, 99)}.") for c in [*range(40), None] for _ in range(rng.randint(1, 9))]
    gone = next(c for c in range(500, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*out, *out[:30], (gone, 0, "user", "Dropped."), (77, 1, "user", "a" * 300_000 + "."), (77, 2, "assistant", "b" * 300_000)]


def expected(rows):
    left = {r[0]: [] for r in rows}
    for conv, *turn in damaged(rows):
        left[conv].append(turn)
    return {conv: brute(turns) for conv, turns in left.items()}


def test_report_is_the_best_of_all_scripts(spark, rows):
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.report(table(spark, rows)).collect()}
    assert got == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()
    assert conversations.report(table(spark, [])).count() == 0


@pytest.mark.parametrize("segment", [1, 3, 50])
def test_long_conversations_in_segments(spark, rows, monkeypatch, segment):
    monkeypatch.setattr(conversations, "LONG", 3)
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    assert {r.conv_id: tuple(r)[1:] for r in conversations.report(table(spark, rows)).collect()} == expected(rows)


def test_one_conversation_of_all_turns_is_dealt_to_many_tasks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, k // 2 if k % 5 else None, rng.choice(["user", "assistant"]), rng.choice(["ok", f"Turn {k}.", "Again."])) for k in range(3000)]
    monkeypatch.setattr(conversations, "LONG", 100)
    monkeypatch.setattr(conversations, "SEGMENT", 64)
    (got,) = conversations.report(table(spark, rows)).collect()
    turns = sorted(((t, r, x) for _, t, r, x in damaged(rows)), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, codes = set(), []
    for t in turns:
        codes.append(conversations.code_of(t[1], conversations.fault(t[2], t[1:] in seen)))
        seen.add(t[1:])
    audit, _ = conversations.walk(codes, conversations.distances([c for c in codes if c != conversations.FORCED]), conversations.START)
    assert got.audit == audit and len(audit) > 2000


def test_repair_gives_texts(spark, monkeypatch):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "More."), (2, 5, "assistant", "Alone.")]
    want = [(1, 0, "K", 0, "user", "Hi."), (1, 1, "D", 1, None, None), (1, 2, "R", 2, "assistant", "More."), (2, 0, "I", None, "user", ""), (2, 1, "K", 5, "assistant", "Alone.")]
    assert sorted(map(tuple, conversations.repair(table(spark, rows)).collect())) == want
    monkeypatch.setattr(conversations, "LONG", 0)
    monkeypatch.setattr(conversations, "SEGMENT", 2)
    assert sorted(map(tuple, conversations.repair(table(spark, rows)).collect())) == want


def test_oracle(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows if r[0] != 77])
    key = lambda r: (r[0] is not None, r)
    assert sorted(con.execute(conversations.ORACLE).fetchall(), key=key) == sorted(((c, *v) for c, v in expected([r for r in rows if r[0] != 77]).items()), key=key)
