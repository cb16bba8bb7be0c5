"""Alignment of recordings against all pairs at all offsets."""

import random

import numpy as np

from pagewright.llm import audio, registry
from tests.llm.test_operators import prose, table

SOUND = audio.Sound(frame=1024, hop=256)


def tune(rng, seconds=3.0, rate=11025):
    notes = np.repeat(rng.choice([220.0, 247, 262, 294, 330, 392, 440, 523], int(seconds * 8)), rate // 8)
    return 128 + 50 * np.sin(2 * np.pi * np.cumsum(notes) / rate)


def as_bytes(x):
    return x.clip(0, 255).astype(np.uint8).tobytes()


def links(found):
    """All pairs that agree at some offset, by comparing every pair at every offset."""
    out = set()
    for i in range(len(found)):
        for j in range(i + 1, len(found)):
            a, b = found[i].view(np.uint32), found[j].view(np.uint32)
            for off in range(audio.OVERLAP - len(b), len(a) - audio.OVERLAP + 1):
                s, e = max(0, off), min(len(a), len(b) + off)
                d = np.bitwise_count(a[s:e] ^ b[s - off : e - off])
                if d.sum() <= audio.ERROR * 32 * (e - s) and (d == 0).sum() >= audio.VOTES:
                    out.add((i, j))
                    break
    return out


def planted(rng):
    """Tunes with noisy, shifted and cut copies, a jingle before many tunes, copies, and short, empty and null recordings."""
    out, jingle = [], tune(rng, 1.0)[: 256 * 40]
    for k in range(12):
        t = tune(rng)
        out += [as_bytes(t), as_bytes(t[256 * (3 + k) :] + 0.5 * rng.standard_normal(len(t) - 256 * (3 + k))), as_bytes(t[256 * 8 : 256 * 60]), as_bytes(np.r_[jingle, t[: 11025 + k]])]
    return [*out, out[0], out[1], None, b"", out[0][:900], out[0][:900], b"\x80" * 30000, b"\x80" * 20000]


def test_alignment_against_all_pairs(spark, monkeypatch):
    data = planted(np.random.default_rng(1))
    df = spark.createDataFrame([(k, x, "f", 1, 2) for k, x in enumerate(data)], "doc_id long, audio binary, fingerprint string, rep int, grp int")
    found = audio.codes_of([np.frombuffer(x or b"", np.uint8) for x in data], SOUND)
    want = list(range(len(data)))
    near = links(found)
    near |= {(i, j) for i in range(len(data)) for j in range(i + 1, len(data)) if data[i] and data[i] == data[j]}
    for _ in data:
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    got = {r.doc_id: r for r in audio.align(df, sound=SOUND).collect()}
    # no class joins what brute force keeps apart, and nearly every link of brute force is within a class
    assert all(want[got[k].component_id] == want[k] for k in range(len(data)))
    print("recall", sum(got[i].component_id == got[j].component_id for i, j in near) / len(near), len(near))
    assert sum(got[i].component_id == got[j].component_id for i, j in near) >= 0.97 * len(near) and len(near) > 60
    assert all(r.match_id is None or (min(r.match_id, k), max(r.match_id, k)) in near and r.bit_error <= audio.ERROR for k, r in got.items())
    assert got[1].match_id in (0, 2) and got[0].match_offset == 0 or got[0].match_id == 1
    assert got[48].match_id == 0 and got[48].match_offset == 0 and got[48].bit_error == 0
    assert got[50].n_codes == got[51].n_codes == 0 and got[51].match_id is None and got[53].match_id == 52
    monkeypatch.setattr(audio, "CHUNK", 4)
    monkeypatch.setattr(audio, "AT_ONCE", 500)
    assert {k: r.component_id for k, r in got.items()} == {r.doc_id: r.component_id for r in audio.align(df, sound=SOUND).collect()}


def test_a_shared_first_holder_hides_no_pair(spark):
    """Two recordings match though an unrelated one of smaller id holds all they share first."""
    rng = np.random.default_rng(3)
    shared = tune(rng, 1.5)
    data = [(1, as_bytes(np.r_[shared, tune(rng, 6.0)])), (2, as_bytes(shared)), (3, as_bytes(shared[: len(shared) - 512]))]
    got = {r.doc_id: r.component_id for r in audio.align(spark.createDataFrame(data, "doc_id long, audio binary"), sound=SOUND).collect()}
    assert got[2] == got[3]


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, b"\x01\x80" * 9000), (1, b"\x01\x80" * 9000), (None, b"\x01\x80" * 9000), (2, None)], "doc_id long, audio binary")
    got = audio.align(df, sound=SOUND).collect()
    assert len(got) == 4 and sorted(str(r.component_id) for r in got) == ["1", "1", "1", "2"]
    assert audio.align(df.limit(0), sound=SOUND).count() == 0


def test_landmarks_recur_in_shared_stretches():
    rng = np.random.default_rng(5)
    for _ in range(50):
        shared = rng.integers(0, 9, audio.OVERLAP + int(rng.integers(0, 30))).astype(np.int32) * 7919
        a, b = (np.r_[rng.integers(100, 10**6, n).astype(np.int32), shared, rng.integers(100, 10**6, n).astype(np.int32)] for n in rng.integers(0, 40, 2))
        (at, left), (_, right) = audio.landmarks(a), audio.landmarks(b)
        assert set(left.tolist()) & set(right.tolist())
        assert len(set(left.tolist())) == len(left) and (np.diff(at) > 0).all()


def test_texts_are_heard(spark, tmp_path):
    rng = random.Random(12)
    long, tiny = prose(rng, 400), prose(rng, 40)[:90]
    texts = [long, long, long[320:], tiny, prose(rng, 40)[:90], tiny, "", "", None]
    table(spark, [(k, t, "a") for k, t in enumerate(texts, 1)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op3_audio(spark, str(tmp_path)).collect()}
    assert got[1].n_codes == (len(long) - 608) // 32 + 1 and got[1].fingerprint == got[2].fingerprint is not None
    assert got[2].match_id == got[3].match_id == got[2].component_id == got[3].component_id == 1 and got[3].match_offset == -10
    assert got[6].n_codes == 0 and got[6].fingerprint is None and got[6].match_id == got[6].component_id == 4 and got[6].bit_error == 0
    assert all(got[k].component_id == k and got[k].match_id is None for k in (4, 5, 7, 8, 9))
