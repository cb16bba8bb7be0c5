"""Queries that apply the column functions over texts and addresses to whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import link_rules, markup, reports
from pagewright.plans.page_queries import _PATH
from pagewright.sources import table

DOMAINS = ("example.com",)
#: (domain, language path, content root) of the markets whose editing tree is known.
ROOTS = [("therha.example.com", "en", "/content/a/en/"), ("tionble.example.com", "fr", "/content/b/fr"), ("therin.example.net", None, "/content/c"), ("blog.tionsh.example.net", "/en/", "/content/d/en")]


def page_link_functions(spark, sf_dir):
    """Each distinct target of links: what may be live, the file it names, whether it asks to sign in."""
    a = markup.anchors(table(spark, sf_dir, "pages")).where("href is not null")
    h = F.col("href")
    return a.groupBy("href").agg(F.count("*").alias("n")).select("href", "n", T.safe_href(h).alias("safe"), U.asset_identity(h).alias("file"), U.looks_like_login(h).alias("login"))


def page_url_functions(spark, sf_dir):
    """Each page's address: host, environment, why it must not be fetched, whether it is below a language path."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.bare_host(u).alias("host"), U.environment_of(U.bare_host(u), "^blog", "^m[.]").alias("environment"), U.fetchable(u, DOMAINS).alias("refused"), U.under_path(U.path_of(u), F.lit("/en")).alias("english"))


def page_author_paths(spark, sf_dir):
    """Where pages of known markets stand in the editing tree."""
    roots = spark.createDataFrame(ROOTS, "domain string, lang_path string, root string")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", U.bare_host(F.col("url")).alias("domain")).join(roots, "domain")
    return rows.select("page_id", U.author_path(F.col("url"), F.col("domain"), F.col("lang_path"), F.col("root")).alias("path")).where("path is not null")


def page_title_functions(spark, sf_dir):
    """Parts of each page's title with its first word and last segment, a part that repeats, and a slug as a label."""
    title = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    slug = F.regexp_extract(F.regexp_replace(U.path_of(F.col("url")), r"\?.*$", ""), "([^/]*)$", 1)
    word = F.substring_index(F.lower(T.normalise(title)), " ", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" | ", title, F.substring_index(title, " ", 1), slug).alias("title"), F.concat_ws("-", word, slug).alias("slug"))
    return rows.select("page_id", F.array_join(T.title_parts(F.col("title")), " / ").alias("parts"), T.duplicate_part(F.col("title")).alias("again"), T.humanise(F.col("slug")).alias("label"))


def page_first_links(spark, sf_dir):
    """The first three links of each page in order."""
    return link_rules.first_places(markup.anchors(table(spark, sf_dir, "pages")).where("href is not null"), ["page_id"], "ord").select("page_id", "href")


def doc_text_functions(spark, sf_dir):
    """Digests of each text as a CSV cell, escaped, as a label and without accents; its quotes, open items and paste damage."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.csv_cell(t)).alias("cell"), F.md5(T.escape_html(t)).alias("escaped"), F.md5(T.label_words(t)).alias("label"), F.md5(T.fold(t)).alias("folded"),
        F.size(T.quoted_spans(t)).cast("long").alias("quotes"), F.size(T.open_items(t)).cast("long").alias("open"), F.array_join(T.paste_damage(t), ", ").alias("damage"))


def page_split_urls(spark, sf_dir):
    """Addresses in a sentence that names each page's three times, in another case and with marks behind."""
    u = F.col("url")
    said = F.concat(F.lit("see "), u, F.lit(", or "), F.replace(F.upper(u), F.lit("HTTP"), F.lit("http")), F.lit("; "), u, F.lit("/x."))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(U.split_urls(said), " ").alias("urls"))


def turn_text_functions(spark, sf_dir):
    """Each turn's shared words with the turn before, its uses of a term, and its text with unbalanced quotes mended."""
    rows = table(spark, sf_dir, "conversations").withColumn("last", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    quoted = F.concat(F.when(F.col("turn") % 2 == 0, F.lit('"')).otherwise(""), F.col("text"))
    return rows.select(
        "conv_id", "turn", F.round(T.overlap(F.col("text"), F.coalesce("last", F.lit(""))), 9).alias("shared"), T.occurrences(F.col("text"), F.lit("de ")).alias("uses"),
        T.has_term(F.col("text"), "the").alias("term"), F.md5(T.unwrap_quotes(quoted)).alias("plain"), T.match_case(F.substring_index("text", " ", 1), F.lit("wort")).alias("cased"))


def order_verdicts(spark, sf_dir):
    """Order keys as answers of a server: verdicts by priority."""
    status = (F.lit(200) + F.col("o_orderkey") % 350).cast("int")
    return reports.link_tally(table(spark, sf_dir, "orders").select("o_orderpriority", U.verdict_of(status).alias("verdict")), "o_orderpriority")


QUERIES = {f.__name__: f for f in (page_link_functions, page_url_functions, page_author_paths, page_title_functions, page_first_links, doc_text_functions, page_split_urls, turn_text_functions, order_verdicts)}

_ANCHORS = r"""(SELECT page_id, ord, CASE WHEN regexp_matches(a, '(?is)\shref\s*=') THEN regexp_extract(a, '(?is)\shref\s*=\s*"([^"]*)"', 1) END AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>')) AS a, unnest(range(len(regexp_extract_all(html, '(?is)<a\b[^>]*>')))) AS ord FROM pages))"""
_BARE = r"regexp_replace(regexp_replace(host, '[:?#].*$', ''), '^preview(-[a-z0-9]+)?\.', '')"
_ROOTS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in ROOTS)


def _normal(x: str) -> str:
    for name, char in T.ENTITIES:
        quoted = char.replace("'", "''")
        x = f"regexp_replace({x}, '(?i){name}', '{quoted}', 'g')"
    quotes = """translate(%s, '‘’“”', '''''""')""" % x
    return r"trim(regexp_replace(%s, '[\s\x{a0}]+', ' ', 'g'))" % quotes


_TITLE = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)"
_SLUG = r"regexp_extract(regexp_replace(path, '\?.*$', ''), '([^/]*)$', 1)"
_LONG_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9À-ɏ]+'), lambda w: length(w) > 2)"
ORACLE_SQL = {
    "page_link_functions": rf"""SELECT href, n, CASE WHEN s = '' OR starts_with(s, '//') THEN NULL WHEN regexp_matches(s, '(?i)^https?://') OR NOT regexp_matches(s, '(?i)^[a-z][a-z0-9+.-]*:') THEN s END AS safe,
  regexp_replace(lower(regexp_replace(regexp_replace(url_decode(regexp_replace(regexp_replace(href, '[?#].*$', ''), '^.*/', '')), ':.*$', ''), '\.[A-Za-z0-9]{{2,5}}$', '')), '[^a-z0-9]', '', 'g') AS file,
  regexp_matches(href, '(?i)(^|[/.?=_-])(login|logon|signin|sign-in|sso|adfs|okta|saml|oauth2?|authorize)([/.?=_-]|$)') AS login FROM (SELECT href, trim(href) AS s, count(*) AS n FROM {_ANCHORS} WHERE href IS NOT NULL GROUP BY ALL)""",
    "page_url_functions": rf"""SELECT page_id, host, CASE WHEN host = '' THEN 'unknown' WHEN starts_with(host, 'blog') THEN 'preview' WHEN starts_with(host, 'm.') THEN 'author' ELSE 'production' END AS environment,
  CASE WHEN NOT regexp_matches(url, '(?i)^https?://') THEN 'scheme' WHEN contains(authority, '@') THEN 'credentials' WHEN port <> '' AND port NOT IN ('80', '443') THEN 'port' WHEN regexp_matches(authority, '^[0-9.]+(:|$)') THEN 'address' WHEN NOT regexp_matches(authority, '(?i)(^|\.)example\.com(:|$)') THEN 'host' END AS refused,
  path = '/en' OR starts_with(path, '/en/') OR starts_with(path, '/en.') AS english
FROM (SELECT *, regexp_extract(authority, ':(\d+)$', 1) AS port FROM (SELECT page_id, url, path, {_BARE} AS host, regexp_extract(url, '(?i)^https?://([^/?#]*)', 1) AS authority FROM {_PATH}))""",
    "page_author_paths": rf"""WITH r(domain, lang_path, root) AS (VALUES {_ROOTS}), p AS (SELECT page_id, {_BARE} AS host, regexp_replace(regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '(?i)\.html?$', ''), '/+$', '') AS path FROM {_PATH})
SELECT page_id, regexp_replace(root, '/+$', '') || path[length(lp) + 1:] AS path FROM (SELECT *, CASE WHEN coalesce(trim(lang_path, '/'), '') = '' THEN '' ELSE '/' || trim(lang_path, '/') END AS lp FROM p JOIN r ON host = domain) WHERE lp = '' OR lower(path) = lower(lp) OR starts_with(lower(path), lower(lp) || '/')""",
    "page_title_functions": rf"""WITH t AS (SELECT page_id, {_normal("concat_ws(' | ', title, split_part(title, ' ', 1), slug)")} AS whole, split_part(lower({_normal("title")}), ' ', 1) || '-' || slug AS label FROM (SELECT page_id, {_TITLE} AS title, {_SLUG} AS slug FROM {_PATH})),
p AS (SELECT page_id, label, list_filter(list_transform(regexp_split_to_array(lower(whole), '\s+[|–—-]\s+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM t)
SELECT page_id, array_to_string(parts, ' / ') AS parts, coalesce(list_filter(parts, lambda x: len(list_filter(parts, lambda y: y = x)) > 1)[1], list_filter(parts[2:], lambda x: len(list_filter(parts[2:], lambda y: x <> y AND contains(' ' || y || ' ', ' ' || x || ' '))) > 0)[1]) AS again,
  array_to_string(list_transform(list_filter(regexp_split_to_array(label, '[-_]+'), lambda w: w <> ''), lambda w, i: CASE WHEN length(w) <= 3 THEN upper(w) WHEN i = 1 THEN upper(w[1]) || lower(w[2:]) ELSE w END), ' ') AS label FROM p""",
    "page_first_links": f"SELECT page_id, href FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM {_ANCHORS} WHERE href IS NOT NULL) WHERE n <= 3",
    "doc_text_functions": r"""SELECT doc_id, md5('"' || replace(CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END, '"', '""') || '"') AS cell, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped,
  md5(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ') AS label, md5(strip_accents(lower(text))) AS folded, CAST(len(regexp_extract_all(text, '["“]([^"“”\n]{3,300})["”]')) AS BIGINT) AS quotes,
  CAST(len(regexp_extract_all(text, '(?i).{0,40}\b(?:TBD|TBC|to be (?:decided|confirmed|defined))\b.{0,40}')) AS BIGINT) AS open,
  concat_ws(', ', CASE WHEN regexp_matches(text, '(?m)^\s*[•·▪●]') THEN 'typed bullets' END, CASE WHEN regexp_matches(text, '(?i)mso-|<o:p>') THEN 'office markup' END, CASE WHEN regexp_matches(text, '[“”]') AND contains(text, '"') THEN 'mixed quotes' END) AS damage FROM documents""",
    "page_split_urls": r"""SELECT page_id, array_to_string(list_filter(u, lambda x, i: list_position(list_transform(u, lambda y: lower(y)), lower(x)) = i), ' ') AS urls FROM (
  SELECT page_id, list_transform(regexp_extract_all('see ' || url || ', or ' || replace(upper(url), 'HTTP', 'http') || '; ' || url || '/x.', 'https?://[^\s"<>]+'), lambda x: regexp_replace(x, '[.,;:]+$', '')) AS u FROM pages)""",
    "turn_text_functions": rf"""WITH t AS (SELECT conv_id, turn, text, {_LONG_WORDS.format("text")} AS a, {_LONG_WORDS.format("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS b, CASE WHEN turn % 2 = 0 THEN '"' ELSE '' END || text AS q, split_part(text, ' ', 1) AS w FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_filter(a, lambda w: list_contains(b, w))) / greatest(len(a), len(b)) ELSE 0 END, 9) AS shared, CAST((length(text) - length(replace(text, 'de ', ''))) // 3 AS BIGINT) AS uses, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') AS term,
  md5(CASE WHEN (length(q) - length(replace(q, '"', ''))) % 2 = 0 THEN q WHEN starts_with(q, '"') THEN q[2:] WHEN ends_with(q, '"') THEN q[:-2] ELSE q END) AS plain, CASE WHEN w = upper(w) THEN 'WORT' WHEN w[1] = upper(w[1]) THEN 'Wort' ELSE 'wort' END AS cased FROM t""",
    "order_verdicts": "SELECT o_orderpriority, count(*) AS checked, count(*) FILTER (s BETWEEN 200 AND 299) AS ok, count(*) FILTER (s IN (404, 410) OR s >= 500) AS dead, count(*) FILTER (s BETWEEN 300 AND 499 AND s NOT IN (404, 410)) AS unverified FROM (SELECT o_orderpriority, 200 + o_orderkey % 350 AS s FROM orders) GROUP BY ALL",
}
