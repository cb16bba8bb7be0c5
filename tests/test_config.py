"""Layered configuration: each file present, absent, empty and broken."""

import json

import pytest
from pyspark.errors import AnalysisException

from pagewright.operators import matching
from pagewright.sources import config

DEFAULTS = {"rules": {"limits": {"title": 60, "links": {"most": 3}}, "names": ["a", "b"]}, "markets": [{"market": "it", "domain": "a.it", "prefix": "/it"}], "brands": {}}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"limits": {"links": {"most": 5, "least": 1}, "title": None}, "names": ["c"], "new": {"x": 1}}))
    (tmp_path / "markets.json").write_text(json.dumps([{"market": "fr", "domain": "a.fr", "prefix": ""}, {"market": "de", "domain": "a.de"}]))
    return tmp_path


def test_files_lie_over_defaults(spark, folder):
    got = config.load(spark, str(folder), DEFAULTS)
    assert got == {"rules": {"limits": {"title": 60, "links": {"most": 5, "least": 1}}, "names": ["c"], "new": {"x": 1}}, "markets": [{"market": "fr", "domain": "a.fr", "prefix": ""}, {"market": "de", "domain": "a.de"}], "brands": {}}
    assert DEFAULTS["rules"]["limits"]["links"] == {"most": 3}


@pytest.mark.parametrize("name", list(DEFAULTS))
def test_each_file_may_be_missing(spark, folder, name):
    (folder / f"{name}.json").unlink(missing_ok=True)
    got = config.load(spark, str(folder), DEFAULTS)
    assert got[name] == DEFAULTS[name]
    with pytest.raises(AnalysisException):
        config.load(spark, str(folder), DEFAULTS, required=(name,))


def test_empty_and_broken_files(spark, folder):
    (folder / "brands.json").write_text(" ")
    assert config.load(spark, str(folder), DEFAULTS)["brands"] == {}
    (folder / "brands.json").write_text("{broken")
    with pytest.raises(ValueError, match="brands.json is not JSON"):
        config.load(spark, str(folder), DEFAULTS)
    (folder / "brands.json").write_text("[]")
    with pytest.raises(ValueError, match="brands.json holds no object"):
        config.load(spark, str(folder), DEFAULTS)


def test_operators_take_the_tables(spark, folder):
    markets = config.entries(spark, config.load(spark, str(folder), DEFAULTS)["markets"], "market string, domain string, prefix string")
    assert sorted(map(tuple, markets.fillna("").collect())) == [("de", "a.de", ""), ("fr", "a.fr", "")]
    pages = spark.createDataFrame([(1, "https://a.fr/x"), (2, "https://b.fr/x")], "page_id long, url string")
    assert {r.page_id: r.market for r in matching.longest_prefix(pages, markets.fillna("")).collect()} == {1: "fr", 2: None}
    named = config.entries(spark, {"x": {"n": 1, "at": {"k": "v"}}, "y": 2}, "name string, n long, at struct<k:string,l:string>", key="name")
    assert sorted((r.name, r.n, r.at and r.at.k) for r in named.collect()) == [("x", 1, "v"), ("y", 2, None)]
    assert config.entries(spark, [], "a string").count() == 0 and [r.a for r in config.entries(spark, ["p", "q"], "a string").collect()] == ["p", "q"]
