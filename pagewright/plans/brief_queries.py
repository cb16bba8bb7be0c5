"""Queries over briefs written out, and over documents read as briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import briefs
from pagewright.plans.inline import Rows
from pagewright.sources import table

ASSETS = ("assets.test", "/store/")
MARKETS = {"Italy": "a.it", "Spain": "a.es", "India": "a.in"}
WORK = {
    "terms": [("redirect", "redirect", 3), ("redirect", "retire", 1), ("page", "new page", 3), ("page", "publish", 1), ("local", "translation", 3)],
    "flags": [("redirect", "url_pair_rows", 4), ("removal", "removal_marks", 5), ("local", "translated_rows", 4), ("page", "sections", 4), ("page", "long_body", 2)],
    "needs": [
        ("redirect", "source", "Which addresses?", None, "site_url"), ("redirect", "destination", "Where to?", None, "rows_paired"), ("redirect", "destination", "Where to?", "redirects? to|destination", None),
        ("page", "place", "Where does it stand?", None, "content_path"), ("page", "market", "Which market?", None, "target_named"), ("local", "market", "Which market?", None, "target_named"),
    ],
    "steps": [("redirect", "old", "Open the folder"), ("redirect", "old", "Publish"), ("redirect", "new", "Add a row"), ("local", "new", "Open the language copy")],
    "migrated": (".in",), "markers": (".aspx",), "assets": ASSETS, "least": 2,
}
_LONG = "word " * 45
BRIEFS = Rows("brief_id int, text string", [
    (1, "Redirects\nhttps://a.it/x\thttps://a.it/y\nhttps://a.it/z\thttps://a.it/w.\n"),
    (2, "Please redirect https://a.it/x, thanks.\nhttps://a.in/x"),
    (3, "https://a.in/old.aspx\tx\nhttps://a.in/b\t x \thttps://A.in/b"),
    (4, "India\nField\tEnglish\tItaly\tIndia\nTitle\tLift\tÀscensore\tLíft\nBody\tDoor\tPòrta\tDóor\nCTA\tGo\tVài\tGó\nLast\tNo\tNò\tNó\n"),
    (5, "New page [1.1] in Italy\n/lifts/home/\nmore [1.2]\n" + "\n".join([_LONG] * 3)),
    (6, "Assets - see https://assets.test/a.png and https://a.it/store/b.png"),
    (7, ""), (8, None), (9, "publish"), (10, "Retire https://a.es/a (https://a.es/A) to https://a.es/b"),
    (11, "Field\tItaly\tSpain\nTitle\tUnò\tDòs\nBody\tTrè\tQuàtro\nEnd\tFìn\tFìne"),
])


def brief_structure(spark, sf_dir):
    """Structural facts of briefs written out."""
    s = briefs.structure(BRIEFS.df(spark), ASSETS)
    return s.select("brief_id", F.array_join("site", " ").alias("site"), F.array_join("assets", " ").alias("assets"), *briefs.FLAGS)


def doc_structure(spark, sf_dir):
    """Structural facts of all documents, read as briefs."""
    s = briefs.structure(table(spark, sf_dir, "documents").select("doc_id", "text"), ASSETS)
    return s.select("doc_id", F.array_join("site", " ").alias("site"), F.array_join("assets", " ").alias("assets"), *briefs.FLAGS)


def brief_analysis(spark, sf_dir):
    """Work type, platform, needs, questions and steps of briefs written out."""
    a = briefs.analyse(BRIEFS.df(spark), WORK, MARKETS)
    return a.select(*[F.array_join(c, "; ").alias(c) if c in ("have", "missing", "questions", "steps") else F.col(c) for c in a.columns])


_PROSE = "A long enough paragraph of copy that reads as prose in any case."
TYPED = Rows("brief_id int, type string, text string", [
    (1, "local", f"Country\tHeader\tBody text\tOwner\nItaly\tCiao\t{_PROSE}\tyou\n\t\t\nSpain\tHola\t{_PROSE}\tme\n"),
    (2, "local", "Top\nMeta title\tLift\tAscensore\nMeta title\tLift\tLater\nHeadline\tA\tB\nBody\tC\t\nSubheading\tC\tD\nCTA\tGo\tVai\nCTA 2\tBuy\tCompra\nCTA Link\t\t/it/a\nCTA link 2\t\ttbd\n"),
    (3, "local", f"Short line\n{_PROSE}\n"),
    (4, "keywords", "Page\tWords\nhttps://a.it/x\told\t lifts, doors \nhttps://a.it/y\tlate"),
    (5, "page", f"Market: Italy\nTitle: Home lifts\nH1: Lifts at home\nKeywords\tlift\n●\tdoor\nLinks: /it/a\nNote: ask first\n{_PROSE}\nWhy lifts [1.2]\nHero: Brand assets – front.png\nshort\n"),
    (6, "page", ""), (7, "page", None), (8, "local", None), (9, "keywords", "no address here"),
])
LABELS = {"market": "market", "title": "title", "h1": "topic", "keywords": "keywords", "links": "links", "note": "note"}
EXPECTED = Rows("brief_id int, mode string, part string, field string, text string, href string, section string, row int", [
    (1, "markets-by-field", "section", None, "Ciao", None, "Italy", 2), (1, "markets-by-field", "body", None, _PROSE, None, "Italy", 2),
    (1, "markets-by-field", "section", None, "Hola", None, "Spain", 3), (1, "markets-by-field", "body", None, _PROSE, None, "Spain", 3),
    (2, "columns", "metadata", "title", "Ascensore", None, None, 2), (2, "columns", "section", None, "B", None, "Top", 4), (2, "columns", "body", None, "D", None, "Top", 6),
    (2, "columns", "link", None, "Vai", "/it/a", "Top", 7), (2, "columns", "link", None, "Compra", None, "Top", 8),
    (3, "prose", "body", None, _PROSE, None, None, 2), (4, "columns", "metadata", "keywords", "lifts, doors", None, None, 2),
    (5, "labelled", "metadata", "market", "Italy", None, None, 1), (5, "labelled", "metadata", "title", "Home lifts", None, None, 2), (5, "labelled", "section", None, "Lifts at home", None, None, 3),
    (5, "labelled", "metadata", "keywords", "lift, door", None, None, 4), (5, "labelled", "link", None, "/it/a", "/it/a", None, 6), (5, "labelled", "front", "note", "ask first", None, None, 7),
    (5, "labelled", "body", None, _PROSE, None, None, 8), (5, "labelled", "section", None, "Why lifts", None, None, 9), (5, "labelled", "image", None, "front.png", None, None, 10),
])


def brief_expectations(spark, sf_dir):
    """What briefs written out say of their pages, by work type."""
    b = TYPED.df(spark)
    return briefs.expected(briefs.rows(b), b, LABELS, "local", "keywords")


QUERIES = {f.__name__: f for f in (brief_structure, doc_structure, brief_analysis, brief_expectations)}
_URLS = r"""list_transform(regexp_extract_all({0}, '(?i)https?://[^\s<>"'')\]]+'), lambda u: regexp_replace(u, '[.,;:]+$', ''))"""
_ASSET = "(contains(lower({0}), 'assets.test') OR contains(lower({0}), '/store/'))"
_SITE = f"list_filter({_URLS}, lambda u: NOT {_ASSET.format('u')})"


def _structure(source: str, key: str) -> str:
    return rf"""WITH t AS (SELECT {key}, coalesce(text, '') AS t FROM {source}),
l AS (SELECT {key}, line, len(list_distinct(list_transform({_SITE.format("line")}, lambda u: lower(u)))) AS n FROM (SELECT {key}, unnest(string_split_regex(t, '\r?\n')) AS line FROM t)),
c AS (SELECT {key}, count(*) FILTER (n >= 1) AS named, count(*) FILTER (n >= 2) AS paired, count(*) FILTER (n >= 1 AND regexp_matches(line, '(?i)(^|\t)\s*x\s*(\t|$)')) AS gone,
  count(*) FILTER (length(trim(line)) >= 200) AS paras, count(*) FILTER (contains(line, chr(9)) AND regexp_matches(line, '[À-ɏ]')) AS tr FROM l GROUP BY {key}),
u AS (SELECT *, {_SITE.format("t")} AS s, list_filter({_URLS.format("t")}, lambda u: {_ASSET.format("u")}) AS a FROM t JOIN c USING ({key})),
d AS (SELECT *, list_filter(s, lambda x, i: list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i) AS site FROM u)
SELECT {key}, array_to_string(site, ' ') AS site, array_to_string(a, ' ') AS assets, len(site) >= 1 AS site_url, len(site) >= 2 AS two_site_urls, named > 0 AND named = paired AS rows_paired,
  regexp_matches(t, '(?i)/content/[a-z0-9/-]+') OR regexp_matches(t, '(?im)^\s*/[a-z0-9][a-z0-9/-]*/\s*$') AS content_path, len(a) >= 1 OR regexp_matches(t, '(?i)assets\s*[-–]') AS asset, paired >= 1 AS url_pair_rows, gone >= 1 AS removal_marks,
  len(regexp_extract_all(t, '\[\d+\.\d+\]')) >= 2 AS sections, paras >= 3 AS long_body, tr >= 3 AS translated_rows, len(regexp_extract_all(t, '[À-ɏ]')) >= 8 AS not_english FROM d"""


# what the briefs above ask for, read by hand
DECIDED = Rows("brief_id int, type string, score int, matched string, confident boolean, platform string, have string, missing string, questions string, steps string, ready boolean", [
    (1, "redirect", 4, "url_pair_rows", True, "old", "source; destination", "", "", "Open the folder; Publish", True),
    (2, "redirect", 3, "redirect", True, "Mixed", "source", "destination", "Where to?", "", False),
    (3, "removal", 5, "removal_marks", True, "Mixed", "", "", "", "", False),
    (4, "local", 4, "translated_rows", True, "new", "market", "", "", "Open the language copy", True),
    (5, "page", 9, "new page, sections, long_body", True, "Unknown", "place", "market", "Which market?", "", False),
    (6, "local", 0, "", False, "Unknown", "", "market", "Which market?", "", False),
    (7, "local", 0, "", False, "Unknown", "", "market", "Which market?", "", False),
    (8, "local", 0, "", False, "Unknown", "", "market", "Which market?", "", False),
    (9, "page", 1, "publish", False, "Unknown", "", "place; market", "Where does it stand?; Which market?", "", False),
    (10, "redirect", 5, "retire, url_pair_rows", True, "old", "source; destination", "", "", "Open the folder; Publish", True),
    (11, "local", 4, "translated_rows", True, "Unknown", "", "market", "Which market?", "", False),
])
ORACLE_SQL = {"brief_structure": _structure(BRIEFS.sql(), "brief_id"), "doc_structure": _structure("documents", "doc_id"), "brief_analysis": f"SELECT * FROM {DECIDED.sql()}", "brief_expectations": f"SELECT * FROM {EXPECTED.sql()}"}
