"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pagewright.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, form string, side string, half string, shard long, scan long, near string"


def table(spark, rows):
    """Documents with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "x", 1, "x", "x", "x", 2, 3, "x") for i, t in rows], SCHEMA)


def vocabulary(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    """By trying all deletions."""
    less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return a in less(b) or b in less(a)


def brute(n):
    out = {}
    for w in n:
        close = [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [form, n[w], len(close), n[form] if form else None]
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def rows():
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    out = []
    for k, stem in enumerate(stems):
        many = rng.choice([2, 3, 30, 300])
        variants = [stem, stem[:3] + "x" + stem[3:], stem[:-1], "é" + stem[1:], stem + "z"]
        out += [(k * 10 + j, " ".join([v] * max(2, many // 12**j)) + " " + v.upper()) for j, v in enumerate(variants)]
    out += [(9000, "aaaaaaaa " * 2500 + "aaaaaaab " * 200 + "aaaaaabb " * 15 + "aaaaabbb " * 2), (9001, None), (9002, ""), (9003, "short 123 ×÷×÷×÷×÷"), (None, "abcdefgh abcdefgh"), (9002, "")]
    return [*out, *out[:3], (9004, "y" * 200_000 + " " + "y" * 200_000)]


@pytest.mark.parametrize("shard, hot, few", [(100_000, 10_000, 8), (50, 10_000, 0), (50, 3, 1), (100_000, 0, 8)])
def test_group(spark, monkeypatch, shard, hot, few):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling, "HOT", hot)
    data = rows()
    got = {r.word: tuple(r)[1:] for r in spelling.group(table(spark, data)).collect()}
    want = brute({w: k for w, k in vocabulary(data).items() if len(w) < 1000}) | {w: (None, w, k, 0, None) for w, k in vocabulary(data).items() if len(w) >= 1000}
    assert got == want
    assert got["aaaaabbb"][:2] == ("aaaaaabb", "aaaaaaaa") or got["aaaaaabb"][1] == "aaaaaaaa"
    assert spelling.group(table(spark, [])).count() == 0


def test_one_edit_and_where_it_meets():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == near(a, b)
        if near(a, b):
            assert spelling.shared_rest(a, b) == spelling.shared_rest(b, a)
