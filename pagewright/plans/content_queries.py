"""Queries that apply the link, list, brief and component operators to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import briefs, components, crawl, forms, head_rules, link_rules, list_rules, markup, matching
from pagewright.plans.page_queries import _PATH, MARKETS
from pagewright.sources import table

#: Needs of a brief: (need, question, pattern).
NEEDS = [("address", "Which page?", "https?://"), ("mail", "Whom to ask?", r"[a-z0-9._]+@[a-z0-9.]+"), ("number", "How many?", "[0-9]{3,}"), ("licence", "May it be used?", "licen[cs]e")]


def page_resources(spark, sf_dir):
    """Elements that load or link something, by tag."""
    return markup.resources(table(spark, sf_dir, "pages")).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def page_link_targets(spark, sf_dir):
    """Resolved addresses by the pages and places that lead to them."""
    return link_rules.targets(table(spark, sf_dir, "pages")).groupBy("dst").agg(F.count("*").alias("pages"), F.sum("places").alias("places"))


def page_language_prefix(spark, sf_dir):
    """The language segment that most pages of a host start with."""
    return matching.language_prefix(table(spark, sf_dir, "pages"))


def page_market_status(spark, sf_dir):
    """Pages by market and by how it was found."""
    reg = spark.createDataFrame([(m, m.split("-")[0], d, p, None) for m, d, p in MARKETS], "market string, base string, domain string, prefix string, former array<string>")
    return matching.market_status(table(spark, sf_dir, "pages"), reg).groupBy("market", "status").agg(F.count("*").alias("n"))


def page_list_items(spark, sf_dir):
    """Innermost lists of each page and their items."""
    return list_rules.lists(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("lists"), F.sum(F.size("items")).alias("items"))


def page_list_findings(spark, sf_dir):
    """Findings of the list and numbering rules, by field and note."""
    p = table(spark, sf_dir, "pages")
    return list_rules.list_findings(p).unionByName(list_rules.typed_findings(p)).groupBy("severity", "field", "note").agg(F.count("*").alias("n"))


def page_head_findings(spark, sf_dir):
    """Findings of the head, language, leakage and mixed content rules, by field and note."""
    p = table(spark, sf_dir, "pages")
    parts = [head_rules.head_findings(head_rules.facts(p)), head_rules.hreflang_findings(p), link_rules.leakage_findings(p), link_rules.mixed_content_findings(p)]
    return head_rules.union(parts).groupBy("severity", "field", "note").agg(F.count("*").alias("n"))


def page_forms(spark, sf_dir):
    """Forms by how they are embedded."""
    return forms.forms(table(spark, sf_dir, "pages")).groupBy("embed").agg(F.count("*").alias("n"))


def page_briefs(spark, sf_dir):
    """Lines of the brief generated from each page, by kind, read back."""
    b = components.brief_of(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("brief_id"), F.col("brief").alias("text"))
    return components.read_brief(b).groupBy("brief_id", "kind").agg(F.count("*").alias("lines"))


def page_components(spark, sf_dir):
    """Components of each page, rendered, and their manifest."""
    leaf = components.leaves(components.numbered(components.stream(table(spark, sf_dir, "pages"))), {"(?i)contact": "contact"})
    return components.render(components.components(leaf))


def doc_folded(spark, sf_dir):
    """Texts in lower case without accents, as digests."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


def doc_signals(spark, sf_dir):
    """Structural signs of each document."""
    return briefs.signals(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")).withColumn("tabular_rows", F.col("tabular_rows").cast("bigint")).withColumn("urls", F.col("urls").cast("bigint"))


def doc_needs(spark, sf_dir):
    """What each document meets and lacks of the needs of a brief."""
    got = briefs.needs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"), NEEDS)
    return got.select("text_id", F.array_join("have", ",").alias("have"), F.array_join("missing", ",").alias("missing"))


def turn_contexts(spark, sf_dir):
    """For each answer, the digest of the question above it."""
    kind = F.when(F.col("role") == "user", "title").when(F.col("role") == "assistant", "link").otherwise("paragraph")
    stream = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("ord"), kind.alias("kind"), "text")
    return matching.contexts(stream).select("page_id", "ord", F.md5("title").alias("title"))


def event_average_runs(spark, sf_dir):
    """Mean times of events by type as repeated fetches."""
    verdict = F.when(F.col("value") < 50, "ok").otherwise("dead")
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("url"), verdict.alias("verdict"), F.floor(F.col("value") * 100).cast("long").alias("ms"), F.floor(F.col("value") * 10).cast("long").alias("ttfb_ms"))
    return crawl.average_runs(runs)


QUERIES = {f.__name__: f for f in (page_resources, page_link_targets, page_language_prefix, page_market_status, page_list_items, page_list_findings, page_head_findings, page_forms, page_briefs, page_components, doc_folded, doc_signals, doc_needs, turn_contexts, event_average_runs)}
_REG = ", ".join(f"('{m}', '{m.split('-')[0]}', '{d}', '{p}')" for m, d, p in MARKETS)
_LIST = lambda want: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '(?i){p}') = {want} THEN '{n}' END" for n, _, p in NEEDS) + "], lambda x: x IS NOT NULL), ',')"
_BARE = "regexp_replace(regexp_replace(host, '[:?#].*$', ''), '^preview(-[a-z0-9]+)?\\.', '')"
ORACLE_SQL = {
    "page_resources": r"SELECT lower(regexp_extract(t, '^<(\w+)', 1)) AS tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|img|script|iframe|source|link|video|audio|embed)\b[^>]*>')) AS t FROM pages) WHERE regexp_matches(t, '(?i)\s(href|src)\s*=') GROUP BY tag",
    "page_link_targets": r"""SELECT dst, count(*) AS pages, CAST(sum(n) AS BIGINT) AS places FROM (SELECT page_id, dst, count(*) AS n FROM (SELECT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(?i:https?://)[^/?#]+') || href ELSE href END AS dst FROM (SELECT page_id, url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>')), 'href="([^"#]*)', 1) AS href FROM pages) WHERE starts_with(href, '/') OR starts_with(href, 'http')) GROUP BY ALL) GROUP BY dst""",
    "page_language_prefix": f"""WITH n AS (SELECT host, regexp_extract(path, '^/([^/?]+)', 1) AS prefix, count(*) AS n FROM {_PATH} GROUP BY ALL)
SELECT host, prefix FROM (SELECT *, sum(n) OVER (PARTITION BY host) AS total, row_number() OVER (PARTITION BY host ORDER BY n DESC, prefix DESC) AS r FROM n) WHERE r = 1 AND regexp_full_match(prefix, '[a-z][a-z](-[a-z][a-z])?') AND n * 10 >= total * 6""",
    "page_market_status": f"""WITH r(market, base, domain, prefix) AS (VALUES {_REG}),
j AS (SELECT page_id, count(domain) AS n, count(DISTINCT base) AS bases, arg_max(market, CASE WHEN prefix = '' OR path = prefix OR starts_with(path, prefix || '/') OR starts_with(path, prefix || '.') THEN length(prefix) END) AS market FROM {_PATH} p LEFT JOIN r ON {_BARE} = domain GROUP BY page_id)
SELECT market, CASE WHEN market IS NOT NULL THEN 'found' WHEN n > 1 AND bases = 1 THEN 'ambiguous' ELSE 'unknown' END AS status, count(*) AS n FROM j GROUP BY ALL""",
    "page_list_items": r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<[uo]l\b')) AS BIGINT) AS lists, CAST(len(regexp_extract_all(html, '(?is)<li\b[^>]*>.*?</li>')) AS BIGINT) AS items FROM pages WHERE regexp_matches(html, '(?i)<li\b')",
    "doc_folded": "SELECT doc_id, md5(lower(strip_accents(coalesce(text, '')))) AS folded FROM documents",
    "doc_signals": r"SELECT *, tabular_rows >= 3 AS has_table FROM (SELECT doc_id AS text_id, len(list_filter(l, lambda p: length(trim(p)) >= 200)) >= 3 AS long_paragraphs, len(regexp_extract_all(t, '[À-ÖØ-öø-ÿ]')) >= 8 AS accented, CAST(len(regexp_extract_all(t, 'https?://')) AS BIGINT) AS urls, CAST(len(list_filter(l, lambda p: len(string_split(p, chr(9))) >= 3)) AS BIGINT) AS tabular_rows FROM (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))",
    "doc_needs": f"SELECT doc_id AS text_id, {_LIST('true')} AS have, {_LIST('false')} AS missing FROM documents",
    "turn_contexts": "SELECT conv_id AS page_id, turn AS ord, md5(title) AS title FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS title FROM conversations) WHERE role = 'assistant'",
    "event_average_runs": "SELECT event_type AS url, CAST(floor(avg(floor(value * 100)) + 0.5) AS INT) AS ms, CAST(floor(avg(floor(value * 10)) + 0.5) AS INT) AS ttfb_ms, count(*) AS runs FROM events WHERE value < 50 GROUP BY event_type",
}
