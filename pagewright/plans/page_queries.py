"""Queries over the table of raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import crawl, head_rules, markup, matching, rules
from pagewright.sources import table

# the paths of both sides, spelled out for the other engine
_STRIP = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?://)', '')"
_PATH = f"""(SELECT page_id, url, html, lower(CASE WHEN p = '' THEN '/' ELSE p END) AS path, regexp_replace(lower(split_part({_STRIP}, '/', 1)), '^www\\.', '') AS host FROM (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STRIP}, '^[^/.]*\\.[^/]*$', '/'), '^[^/.]*\\.[^/]*/', '/'), '(?i)\\.(aspx|html?|jsp)($|\\?)', '\\2'), '(?i)/(index|default)($|\\?)', '\\2'), '/+$', '') AS p FROM pages))"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def page_host_rollup(spark, sf_dir):
    """Pages, distinct normalised paths and anchors by host."""
    rows = _pages(spark, sf_dir).select(U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"), F.regexp_count("html", F.lit(r"(?i)<a[\s>]")).alias("n"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("path").alias("paths"), F.sum("n").cast("bigint").alias("anchors"))


def page_path_collisions(spark, sf_dir):
    """Paths of more than one page, with the smallest url."""
    return _pages(spark, sf_dir).groupBy(U.path_of(F.col("url")).alias("path")).agg(F.count("*").alias("n"), F.min("url").alias("url")).where("n > 1")


def page_titles(spark, sf_dir):
    """Title lengths, stray spaces and H1 counts, from the facts of each head."""
    return head_rules.titles(_pages(spark, sf_dir))


def page_language_mismatch(spark, sf_dir):
    """Pages whose lang attribute is not the language of their path."""
    return rules.language_mismatch(_pages(spark, sf_dir))


def page_languages(spark, sf_dir):
    """Declared languages of pages by host and first path segment."""
    lang, other = rules.languages(F.col("html"))
    rows = _pages(spark, sf_dir).select(U.host_of(F.col("url")).alias("host"), F.regexp_extract(U.path_of(F.col("url")), "^/([^/?]+)", 1).alias("segment"), lang.alias("lang"), other.alias("data_lang"))
    return rows.groupBy("host", "segment", "lang", "data_lang").agg(F.count("*").alias("pages"))


def page_link_fanin(spark, sf_dir):
    """Targets by the pages that link to them and the links."""
    edges = markup.links(_pages(spark, sf_dir)).where("not placeholder")
    return edges.groupBy("href").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("links"))


def page_site_limit(spark, sf_dir):
    """The first three pages of each host by url."""
    rows = _pages(spark, sf_dir).select("page_id", "url", U.host_of(F.col("url")).alias("host"))
    return crawl.page_limit(rows, "host", "url", 3).select("host", "page_id")


def site_prefix(spark, sf_dir):
    """Each host's most frequent first path segment and its share of pages."""
    return matching.first_segments(_pages(spark, sf_dir)).select("host", "segment", "n", (F.col("n") * 100 >= F.col("total") * 60).alias("is_prefix"))


def section_bulk(spark, sf_dir):
    """Pages below each first and second section path of each host."""
    return matching.sections(matching.sections_above(matching.sitemap(_pages(spark, sf_dir))))


def market_of_page(spark, sf_dir):
    """The market of each page by longest prefix."""
    registry = spark.createDataFrame(MARKETS, "market string, domain string, prefix string")
    return matching.longest_prefix(_pages(spark, sf_dir), registry)


def robots_allowed(spark, sf_dir):
    """Whether robots rules allow each page."""
    paths = _pages(spark, sf_dir).select("page_id", U.path_of(F.col("url")).alias("path"))
    return matching.robots_allows(paths, ROBOTS).select("page_id", "allowed")


def page_suggestions(spark, sf_dir):
    """Pages of the same host whose address covers the words of each page's address best; the page itself is among them."""
    pages = _pages(spark, sf_dir)
    path = F.regexp_replace(U.path_of(F.col("url")), r"\?.*$", "")
    texts = pages.select(F.col("page_id").alias("text_id"), U.host_of(F.col("url")).alias("host"), F.translate(path, "/", " ").alias("text"), F.lit(None).cast("string").alias("exclude"))
    return matching.suggest(texts, matching.sitemap(pages)).select(F.col("text_id").alias("page_id"), "rank", "path", "score")


def page_findings(spark, sf_dir):
    """Findings of all page rules by field and note."""
    return rules.audit(_pages(spark, sf_dir)).groupBy("category", "severity", "field", "note").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def page_tally(spark, sf_dir):
    """Breaks and checks of each page, and the severity of its worst."""
    t = rules.tally(rules.audit(_pages(spark, sf_dir)), "page_id")
    return t.withColumn("worst", F.when(F.col("breaks") > 0, "break").otherwise("check"))


def page_english_score(spark, sf_dir):
    """Distinct English function words in each page's visible text."""
    return _pages(spark, sf_dir).select("page_id", T.english_score(T.strip_tags(F.col("html"))).cast("bigint").alias("score"))


MARKETS = [("com-default", "example.com", ""), ("com-en", "example.com", "/en"), ("com-fr", "example.com", "/fr"), ("net-de", "example.net", "/de"), ("org", "example.org", "")]
ROBOTS = [(False, "/en/"), (True, "/en/7"), (False, "/fr/*9$"), (True, "/de/"), (False, "/de/"), (False, "/*?page=")]

_SEGS = "list_filter(string_split(path, '/'), lambda s: s <> '')"
_ENTRIES = f"""(SELECT host, path, url, CASE WHEN lang AND segs[1] = prefix THEN segs[2:] ELSE segs END AS segs FROM (
  SELECT host, regexp_replace(path, '\\?.*$', '') AS path, min(url) AS url, {_SEGS.replace("path", "regexp_replace(path, '\\?.*$', '')")} AS segs FROM {_PATH} GROUP BY ALL) e
  LEFT JOIN (SELECT host, arg_max(prefix, n * 1000 + 0) AS prefix, bool_or(n >= 0.6 * total AND regexp_matches(prefix, '^[a-z][a-z](-[a-z][a-z])?$')) AS lang FROM (
    SELECT host, prefix, n, sum(n) OVER (PARTITION BY host) AS total FROM (SELECT host, regexp_extract(regexp_replace(path, '\\?.*$', ''), '^/([^/?]+)', 1) AS prefix, count(*) AS n FROM (SELECT DISTINCT host, regexp_replace(path, '\\?.*$', '') AS path FROM {_PATH}) GROUP BY ALL)) GROUP BY host) USING (host))"""
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(matching.STOP_WORDS))
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower({})), '[™®©]', ' ', 'g'), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains([" + _STOP + "], w))"
_STEM = "CASE WHEN regexp_matches(w, '^[0-9]+$') OR length(w) <= 3 THEN w WHEN regexp_matches(w, 'ies$') AND length(w) > 5 THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|us|is)$') THEN w ELSE regexp_replace(w, 's$', '') END"


def _tokens(text: str) -> str:
    return f"list_distinct(list_filter(list_transform({_WORDS.format(text)}, lambda w: {_STEM}), lambda w: NOT list_contains([{_STOP}], w)))"


_NAMED = ", ".join(f"'{w}'" for w in matching.EDITORIAL)
_SUGGESTIONS = f"""WITH e AS (SELECT host, path, {_tokens("coalesce(segs[-1], '')")} AS last, {_tokens("array_to_string(segs, ' ')")} AS words, len(list_intersect(segs, [{_NAMED}])) > 0 AS named, segs FROM {_ENTRIES}),
bulk AS (SELECT host, section FROM (SELECT host, array_to_string(segs[1:i], '/') AS section FROM (SELECT host, segs, unnest(range(1, len(segs))) AS i FROM e)) GROUP BY ALL HAVING count(*) >= {matching.BULK_SECTION}),
ed AS (SELECT host, path, last, words, named OR EXISTS (SELECT 1 FROM bulk b WHERE b.host = e.host AND list_contains(list_transform(range(1, len(segs)), lambda i: array_to_string(segs[1:i], '/')), b.section)) AS editorial FROM e),
t AS (SELECT page_id, host, p, {_tokens("x")} AS tt FROM (SELECT page_id, host, p, translate(p, '/', ' ') AS x FROM (SELECT *, regexp_replace(path, '\\?.*$', '') AS p FROM {_PATH}))),
s AS (SELECT page_id, path, len(list_filter(tt, lambda w: list_contains(words, w))) + len(list_filter(tt, lambda w: list_contains(last, w))) AS got, len(tt) AS n, len(last) - len(list_filter(tt, lambda w: list_contains(last, w))) AS extra FROM t JOIN ed ON t.host = ed.host
  WHERE NOT editorial OR len(list_filter(tt, lambda w: list_contains([{_NAMED}], w) OR regexp_matches(w, '^(news|stor|press|reference|blog)'))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(path), path) AS rank FROM (SELECT *, got / (2 * n) - 0.05::DOUBLE * extra AS score FROM s WHERE got > 0 AND got / (2 * n) - 0.05::DOUBLE * extra > 0.2))
SELECT page_id, CAST(rank AS INT) AS rank, path, floor(score * 100 + 0.5) / 100 AS score FROM r WHERE rank <= 3"""

QUERIES = {f.__name__: f for f in (page_host_rollup, page_path_collisions, page_titles, page_language_mismatch, page_languages, page_link_fanin, page_site_limit, site_prefix, section_bulk, market_of_page, robots_allowed, page_suggestions, page_findings, page_tally, page_english_score)}
_VALUES = ", ".join(f"('{m}', '{d}', '{p}')" for m, d, p in MARKETS)
ORACLE_SQL = {
    "page_host_rollup": f"SELECT host, count(*) AS pages, count(DISTINCT path) AS paths, CAST(sum(len(regexp_extract_all(html, '(?i)<a[\\s>]'))) AS BIGINT) AS anchors FROM {_PATH} GROUP BY host",
    "page_path_collisions": f"SELECT path, count(*) AS n, min(url) AS url FROM {_PATH} GROUP BY path HAVING count(*) > 1",
    "page_titles": r"SELECT page_id, CAST(length(t) AS BIGINT) AS title_chars, t <> trim(t) AS stray, CAST(len(regexp_extract_all(html, '(?i)<h1[\s>]')) AS BIGINT) AS h1 FROM (SELECT *, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) AS t FROM pages)",
    "page_language_mismatch": f"""SELECT * FROM (SELECT page_id, lower(substr(regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1), 1, 2)) AS lang, regexp_extract(path, '^/([a-z][a-z])(/|$)', 1) AS path_lang FROM {_PATH}) WHERE lang <> '' AND path_lang <> '' AND lang <> path_lang""",
    "page_languages": f"""SELECT host, segment, nullif(trim(regexp_extract(html, '(?is)<html\\b[^>]*\\slang="([^"]*)"', 1)), '') AS lang, nullif(regexp_extract(html, '(?is)\\sdata-lang="([^"]*)"', 1), '') AS data_lang, count(*) AS pages FROM (SELECT *, regexp_extract(path, '^/([^/?]+)', 1) AS segment FROM {_PATH}) GROUP BY ALL""",
    "page_link_fanin": r"""SELECT href, count(DISTINCT page_id) AS pages, count(*) AS links FROM (SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>')) AS a FROM pages)) WHERE href <> '' AND href NOT LIKE '#%' GROUP BY href""",
    "page_site_limit": f"SELECT host, page_id FROM (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY url) AS n FROM {_PATH}) WHERE n <= 3",
    "site_prefix": f"""WITH n AS (SELECT host, regexp_extract(path, '^/([^/?]+)', 1) AS segment, count(*) AS n FROM {_PATH} GROUP BY ALL)
SELECT host, segment, n, n * 100 >= total * 60 AS is_prefix FROM (SELECT *, sum(n) OVER (PARTITION BY host) AS total, row_number() OVER (PARTITION BY host ORDER BY n DESC, segment DESC) AS r FROM n) WHERE r = 1""",
    "section_bulk": f"""SELECT host, section, count(*) AS pages FROM (SELECT host, array_to_string(segs[1:i], '/') AS section FROM (SELECT host, segs, unnest(range(1, len(segs))) AS i FROM {{_ENTRIES}})) GROUP BY ALL""".replace("{_ENTRIES}", _ENTRIES),
    "page_suggestions": _SUGGESTIONS,
    "market_of_page": f"""WITH r(market, domain, prefix) AS (VALUES {_VALUES})
SELECT page_id, max_by(market, length(prefix) * 1000 + length(domain)) AS market FROM {_PATH} p LEFT JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND (prefix = '' OR path = prefix OR starts_with(path, prefix || '/') OR starts_with(path, prefix || '.')) GROUP BY page_id""",
    "robots_allowed": f"""WITH r(allow, n, rx) AS (VALUES (false, 4, '^/en/'), (true, 5, '^/en/7'), (false, 7, '^/fr/.*9$'), (true, 4, '^/de/'), (false, 4, '^/de/'), (false, 8, '^/.*\\?page='))
SELECT page_id, coalesce(max_by(allow, n * 2 + CAST(allow AS INT)), true) AS allowed FROM {_PATH} p LEFT JOIN r ON regexp_matches(path, rx) GROUP BY page_id""",
}
