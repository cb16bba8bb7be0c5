"""Fingerprints against exact Jaccard similarities and their neighbours by sorting."""

import hashlib
import random
import re

import numpy as np
import pytest

from pagewright.llm import minhash

SCHEMA = "doc_id long, text string, doc long, part long, first string, last string, salt long, after long, n_chars long, fingerprint string"


def table(spark, rows):
    """Documents with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, 1, 2, "x", "x", 3, 4, 5, "x") for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(n))


def rows(n=60):
    rng = random.Random(3)
    out = [(k * 7, prose(rng, rng.choice([3, 12, 60, 400, 3000]))) for k in range(n)]
    return [*out, (1000, None), (1001, ""), (1002, " \n"), (1003, "É ß \U0001f600 x"), (1004, out[3][1].upper()), (1005, "One word"), (1006, "another pair")]


@pytest.mark.parametrize("parts", [1, 7])
def test_compare_neighbours(spark, parts):
    data = rows()
    got = {r.doc_id: r for r in minhash.compare_neighbours(table(spark, data).repartition(parts)).collect()}
    order = sorted(data, key=lambda r: -r[0])
    assert set(got) == {i for i, _ in data}
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        t, after, r = t or "", after or "", got[i]
        k = len(t) // 3
        changed = t[: len(t) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (minhash.packed(t.encode()).hex(), minhash.packed(changed.encode()).hex())
        assert abs(r.near_edited - jaccard(t, changed)) < 0.15 and abs(r.near_next - jaccard(t, after)) < 0.15
    assert minhash.compare_neighbours(table(spark, [])).count() == 0


def test_repeated_and_single_rows(spark):
    got = minhash.compare_neighbours(table(spark, [(5, "a b c")])).collect()
    assert [(r.doc_id, r.near_edited > 0.9, r.near_next) for r in got] == [(5, got[0].near_edited > 0.9, 1.0)]
    data = [(1, "same text here"), (1, "same text here"), (1, "other words of it"), (None, "no id"), (None, "no id")]
    got = minhash.compare_neighbours(table(spark, data)).collect()
    assert len(got) == 5 and sum(r.near_next == 1.0 for r in got) == 2
    hot = minhash.compare_neighbours(table(spark, [(1, "one text of all rows")] * 500 + [(2, "x y z")]).repartition(8)).collect()
    assert len(hot) == 501 and sum(r.near_next == 1.0 for r in hot) == 499


def test_estimates_are_unbiased_for_short_and_long_sets():
    """Densified bins and chance agreement of low bits are both corrected: mean error near zero, spread as the bins allow."""
    rng = np.random.default_rng(1)
    for size in (20, 100, 700, 5000):
        for share in (0.0, 0.3, 0.8):
            errors = []
            for _ in range(60):
                both = rng.integers(0, 1 << 63, int(size * share), np.uint64) * np.uint64(2) + rng.integers(0, 2, int(size * share), np.uint64)
                own = [np.r_[both, rng.integers(0, 1 << 63, size - len(both), np.uint64) * np.uint64(2)] for _ in range(2)]
                a, b = (minhash.low_bits(minhash.bins(h)) for h in own)
                errors.append(minhash.likeness(a, b) - len(both) / (2 * size - len(both)))
            assert abs(np.mean(errors)) < 0.03 and np.std(errors) < (0.12 if size == 20 else 0.06)


def test_alike_column_and_equal_texts(spark):
    fps = minhash.fingerprints(table(spark, [(1, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, ""), (5, "x y")]))
    by = {r.doc_id: bytes(r.fingerprint) for r in fps.collect()}
    assert by[1] == by[2] and by[3] == by[4] == b"" and len(by[1]) == minhash.BINS * minhash.BITS // 8
    one = fps.where("doc_id = 1").select(fps.fingerprint.alias("a"))
    got = one.crossJoin(fps).select("doc_id", minhash.alike("a", "fingerprint").alias("x")).collect()
    assert {r.doc_id: r.x == 1.0 for r in got} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert minhash.likeness(b"", b"") == 1.0 and minhash.likeness(b"", by[1]) == 0.0
