"""Queries that apply the place, region and copy operators to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions.text import INLINE_TAGS
from pagewright.operators import copy, markup, places
from pagewright.plans.table_queries import _WORDS
from pagewright.sources import table


def page_link_places(spark, sf_dir):
    """Distinct targets of each page by the place that holds their links."""
    rows = places.link_places(table(spark, sf_dir, "pages")).select("page_id", "url", F.explode("places").alias("p"))
    return rows.groupBy("page_id", F.col("p.place").alias("place")).agg(F.count("*").alias("targets"), F.count_if("p.hidden").alias("hidden"))


def page_regions(spark, sf_dir):
    """Main region of each page, as a digest, and how it was found."""
    rows = table(spark, sf_dir, "pages").select("page_id", markup.main_region(F.col("html")).alias("r"))
    return rows.select("page_id", "r.via", F.md5("r.html").alias("region"))


def turn_copy_ledger(spark, sf_dir):
    """Turns of each conversation by whether the assistant's turns hold them, whole or by sentences."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "page_id")
    said = turns.where("role = 'assistant'").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    texts = said.select("page_id", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"))
    rows = copy.ledger(turns.select("page_id", F.col("turn").alias("ord"), F.col("role").alias("section"), "text"), texts)
    return rows.groupBy("page_id", "status").agg(F.count("*").alias("n"), F.sum("parts").alias("parts"), F.sum(F.size("absent")).alias("absent"))


QUERIES = {f.__name__: f for f in (page_link_places, page_regions, turn_copy_ledger)}

_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace({}, '&amp;', '&'), '&nbsp;', ' '), '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '[\s\x{{A0}}\x{{FEFF}}]+', ' ', 'g'))".replace('\\"', '"')
_PARTS = r"list_filter(list_transform(string_split(regexp_replace(need, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 25)"

ORACLE_SQL = {
    "page_link_places": r"""SELECT page_id, CASE WHEN nav THEN 'Navigation' WHEN foot THEN 'Footer' ELSE 'other' END AS place, count(DISTINCT dst) AS targets, CAST(0 AS BIGINT) AS hidden FROM (
  SELECT page_id, nav, foot, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(?i:https?://)[^/?#]+') || href ELSE href END AS dst FROM (
    SELECT page_id, url, true AS nav, false AS foot, regexp_extract(unnest(regexp_extract_all(regexp_extract(html, '(?is)<nav\b.*?</nav>'), '(?is)<a\b[^>]*>')), 'href="([^"#]*)', 1) AS href FROM pages
    UNION ALL SELECT page_id, url, false, false, regexp_extract(unnest(regexp_extract_all(regexp_replace(html, '(?is)<nav\b.*?</nav>', '', 'g'), '(?is)<a\b[^>]*>')), 'href="([^"#]*)', 1) FROM pages)
  WHERE starts_with(href, '/') OR starts_with(href, 'http')) GROUP BY ALL""",
    "page_english_score": rf"""SELECT page_id, CAST(len(list_intersect(list_distinct(string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ')), [{_WORDS}])) AS BIGINT) AS score FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:{'|'.join(INLINE_TAGS)})\b[^>]*>', '', 'g'), '(?i)</?[a-z][a-z0-9]*\b[^>]*>', ' ', 'g') AS t FROM pages)""",
    "page_regions": r"""SELECT page_id, CASE WHEN m <> '' THEN 'main' ELSE 'body' END AS via, md5(CASE WHEN m <> '' THEN m ELSE regexp_replace(b, '(?is)<nav\b[^>]*>.*?</nav>|<header\b[^>]*>.*?</header>|<footer\b[^>]*>.*?</footer>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g') END) AS region FROM (
  SELECT page_id, regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1) AS m, CASE WHEN regexp_matches(html, '(?is)<body\b[^>]*>.*</body>') THEN regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body>', 1) ELSE html END AS b FROM pages)""",
    "turn_copy_ledger": f"""WITH t AS (SELECT conv_id AS page_id, turn, role, {_CLEAN.format("text")} AS need FROM conversations),
page AS (SELECT page_id, string_agg(need, ' ' ORDER BY turn) AS page FROM t WHERE role = 'assistant' GROUP BY ALL),
first AS (SELECT page_id, lower(need) AS key, arg_min(need, turn) AS need FROM t WHERE need <> '' GROUP BY ALL),
met AS (SELECT page_id, key, contains(coalesce(page, ''), need) AS whole, CASE WHEN contains(coalesce(page, ''), need) THEN [] ELSE {_PARTS} END AS parts, coalesce(page, '') AS page FROM first LEFT JOIN page USING (page_id)),
part AS (SELECT *, list_filter(parts, lambda s: NOT contains(page, s)) AS absent FROM met)
SELECT page_id, CASE WHEN whole OR (len(parts) > 0 AND len(absent) = 0) THEN 'found' WHEN len(absent) < len(parts) THEN 'partial' ELSE 'missing' END AS status, count(*) AS n, CAST(sum(len(parts)) AS BIGINT) AS parts, CAST(sum(len(absent)) AS BIGINT) AS absent
FROM t JOIN part ON t.page_id = part.page_id AND lower(t.need) = part.key GROUP BY ALL""".replace("SELECT page_id, CASE WHEN whole", "SELECT t.page_id, CASE WHEN whole"),
}
