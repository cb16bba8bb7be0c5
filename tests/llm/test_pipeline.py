"""Each stage against a brute-force version over its own input, on given documents and on odd rows."""

import re

import pytest

import corpus_pipeline
from pagewright.llm import mixing, secrets, simhash, toxicity
from tests.llm.test_operators import prose, shingles

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def staged(spark):
    """Input and output rows of each stage over the small table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF))
        if name != "packing":
            assert after.columns == docs.columns
        out[name] = docs, after
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "packing"]


def test_toxicity_stage(spark, staged):
    """The rows kept are those that the scores, one document at a time, don't reject; hardly a clean one goes."""
    docs, after = staged["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    words, b = toxicity.Words(model.letters), model.coefficients
    kept = {i for i, t in texts(docs).items() if b[0] + sum(x * y for x, y in zip(model.evidence(words.of(t)), b[1:], strict=True)) < 0}
    assert set(texts(after)) == kept
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()} & set(texts(docs))
    assert len(clean & kept) >= 0.97 * len(clean)


def test_simhash_stage(staged):
    """Exact and near copies leave one; documents unlike all others stay."""
    docs, after = staged["simhash"]
    before, kept = texts(docs), texts(after)
    sets = {i: shingles(t) for i, t in before.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    like = {}
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j > i}:
            like[i, j] = len(s & sets[j]) / len(s | sets[j])
    near = [p for p, x in like.items() if x >= 0.8]
    assert near and sum(a in kept and b in kept for a, b in near) <= 0.02 * len(near)
    touched = {i for p, x in like.items() if x >= 0.7 for i in p} | {i for i, s in sets.items() if not s}
    assert set(before) - touched <= set(kept)
    assert kept.items() <= before.items()


def test_secrets_stage(staged):
    docs, after = staged["secrets"]
    before, clean = texts(docs), texts(after)
    assert before.keys() == clean.keys()
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for i, t in clean.items():
        plain = before[i] or ""
        found = [m.span() for m in assign.finditer(plain) if len(m[2]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", plain) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]{24,}", plain)]
        if not found and "[SECRET]" not in (t or ""):
            assert t == before[i]
        assert not [plain[s:e] for s, e in found if plain[s:e] in t]
    assert any("[SECRET]" in (t or "") for t in clean.values())
    assert all(r.n_chars == len(r.text or "") for r in after.collect() if r.text is not None and "[SECRET]" in r.text)


def test_mixing_stage(staged):
    docs, after = staged["mixing"]
    want = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(docs).where("taken > 0").collect()}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == want and texts(after).items() <= texts(docs).items()


def test_packing_stage(staged):
    docs, after = staged["packing"]
    rows = sorted(after.collect(), key=lambda r: (r.sequence_id, r.offset))
    filled = {}
    for r in rows:
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and sorted(filled) == list(range(len(filled)))
    assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(filled.values()) and sum(r.start == 0 for r in rows) == docs.count()


def test_run_is_its_stages(spark, staged):
    """The rows of run() are those of the stages one by one."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, staged["packing"][1].select(columns).collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an id with two texts, clashing names; then an empty table."""
    import random

    rng = random.Random(1)
    long = prose(rng, 30_000)
    rows = [(1, long, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "no id here", "en", "a"), (4, "plain words of a text", None, "b"), (4, "plain words of a text", None, "b"), (4, "password = hunter2hunter2", "de", None), (5, "plain words of a text", "en", "a")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, times int, cuts string, d string, th long, grp long, n long"
    docs = spark.createDataFrame([(i, t, la, s, len(t or ""), 1, 2, "c", "d", 3, 4, 5) for i, t, la, s in rows], schema)
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for some, known in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        known.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        now, counts = some, []
        for name, stage in corpus_pipeline.STAGES:
            after = corpus_pipeline.written(stage(spark, now, str(tmp_path)))
            assert name == "packing" or (after.columns == docs.columns and after.schema["text"] == docs.schema["text"])
            now = after
            counts.append(now.count())
        assert counts[:3] == [0, 0, 0] if some is not docs else counts[:3] == [8, 5, 5]
    kept = {(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()}
    assert kept == {(1, long), (2, None), (None, "no id here"), (4, "plain words of a text"), (4, "password = hunter2hunter2")}
    assert {(r.doc_id, r.text) for r in secrets.redact(docs).collect()} == {(i, "[SECRET]" if t and "hunter" in t else t) for i, t, _, _ in rows}
