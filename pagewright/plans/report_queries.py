"""Queries that apply the report operators to given tables and to small ones written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import matching, reports
from pagewright.plans.inline import Rows
from pagewright.sources import table

WANTS = Rows("page_id int, ord int, section string, row int", [(1, 1, "Proof point", 34), (1, 2, "Benefits", 51), (1, 3, "Proof point", 34), (1, 4, None, 7), (2, 1, "Intro", None), (2, 2, "", None), (3, 1, None, None)])
REPORTED = Rows("page_id int, found string", [(1, "https://a.test/x"), (1, None), (2, "https://a.test/y")])
FOUND = Rows("page_id int, found string, note string", [(1, "https://a.test/x", "leak"), (1, "https://a.test/z", "leak"), (2, "https://a.test/x", "leak"), (2, None, "other"), (1, None, "other")])
AUDIT = Rows("page_id int, ord int, kind string, text string, text_id int", [(1, 1, "link", "Doors", 1), (1, 2, "dead-cta", "Doors", 2), (1, 3, "placeholder", "Doors", 3), (2, 1, "placeholder", "Lifts", 4), (3, 1, "placeholder", "Other", 5)])
BEST = Rows("text_id int, url string, confident boolean", [(1, "/wrong", True), (2, "/doors", False), (3, "/late", True), (4, "/lifts", True)])
DEAD = Rows("page_id int, found string, note string", [(1, "Doors", "no destination"), (2, "Lifts", "no destination"), (3, "Other", "no destination")])
VERDICTS = Rows("page_id int, verdict string", [(1, "red"), (1, "green"), (1, "green"), (2, "amber"), (2, "amber"), (3, "green")])
MODULES = Rows("page_id int, module string, start int, end int", [(1, "FAQ", 10, 50), (1, "Cards", 50, 90), (2, "Intro", 0, 5)])
FIELDS = Rows("page_id int, module string, at int, field string", [(1, "FAQ", 12, "title"), (1, "FAQ", 30, "items[1]/title"), (1, "Cards", 60, "text"), (2, "Intro", 0, "text")])
OFFSETS = Rows("page_id int, offset int", [(1, 5), (1, 11), (1, 12), (1, 35), (1, 50), (1, 89), (1, 90), (2, 4), (3, 1)])
FORMS = Rows("page_id int, ord int, path string, site string, topic string, country string", [(1, 1, "/f/a", "it/it", "Sales", "IT"), (1, 2, "/f/a", "it/it", "Service", "IT"), (1, 3, "/f/a", "it/it", "Sales", None), (1, 4, "/f/b", "us/en", None, "US"), (2, 1, "/f/c", None, "Other", ""), (3, 1, "/f/d", "de/de", "Jobs", "AT")])
HOMES = Rows("page_id int, site string, country string", [(1, "it/it", "IT"), (2, "us/en", None), (3, "de/de", "DE"), (4, None, None)])
COUNTRIES = Rows("name string, domain string, lang_path string, form_id long, site_names array<string>, draft_names array<string>, site string, corporate_title boolean, root string, former array<string>", [("Belgium (French)", "A.TEST", "be-fr", 12, ["Belgium"], None, "BE/FR", None, "/content/be/fr//", ["OLD.test"]), ("Italy", None, "", None, None, None, None, False, None, None)])
SAID = Rows("page_id int, market string", [(1, "Italy"), (2, "Nowhere"), (2, "Belgium (French)"), (3, "Nowhere")])
BY_DOMAIN = Rows("page_id int, market string", [(1, "Belgium (French)"), (3, "Italy")])
MARKED = Rows("page_id int, category string, severity string, from_brief boolean", [(1, "links", "break", False), (1, "links", "check", None), (1, "metadata", "break", True), (2, "links", "check", True), (2, "images", "check", False)])
IDS = Rows("page_id int, source string, expected string, ids array<string>, state string", [(1, "embedded", "7", ["7"], "match"), (2, "", "7", [], "missing"), (3, "declared", None, ["8", "9"], "several")])
CODES = Rows("code string", [("europe",), ("EUROPE",), (" france",), ("nowhere",), ("asia",), ("china",)])


def asked_for(spark, sf_dir):
    """Where each brief asks for a text."""
    return reports.asked_for(WANTS.df(spark), "page_id")


def unreported_findings(spark, sf_dir):
    """Findings whose address the page has not reported already."""
    return reports.unreported(FOUND.df(spark), REPORTED.df(spark))


def findings_with_suggestions(spark, sf_dir):
    """Dead links with the page that their text names."""
    return reports.with_suggestions(DEAD.df(spark), AUDIT.df(spark), BEST.df(spark))


def link_audit_counts(spark, sf_dir):
    """Red, amber and green links of each page."""
    return reports.audit_counts(VERDICTS.df(spark), "page_id")


def places_of_offsets(spark, sf_dir):
    """Module and field at each offset."""
    return reports.place_of(OFFSETS.df(spark), MODULES.df(spark), FIELDS.df(spark))


def own_form_groups(spark, sf_dir):
    """Forms of pages by path."""
    g = reports.form_groups(FORMS.df(spark))
    return g.select("page_id", "path", "site", "n", "missing", F.array_join("topics", ", ").alias("topics"), F.array_join("countries", ", ").alias("countries"))


def own_form_findings(spark, sf_dir):
    """Forms that serve another market than their page's."""
    return reports.form_site_findings(reports.form_groups(FORMS.df(spark)), HOMES.df(spark))


def supplier_stems(spark, sf_dir):
    """Suppliers of each nation whose names differ by their number only."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("ord"), F.concat_ws(" ", F.lit("Card"), F.col("s_name")).alias("label"))
    return reports.stem_groups(rows, "s_nationkey").select("s_nationkey", "stem", "first", "n", F.md5(F.array_join("labels", ",")).alias("labels"))


def region_markets(spark, sf_dir):
    """Markets of asked regions and nations: the nation's suppliers, or those of a region's nations."""
    n = table(spark, sf_dir, "nation")
    areas = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("area"), F.col("n_name").alias("frontline"))
    frontlines = n.join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("frontline"), F.col("s_name").alias("market"))
    return reports.expand_regions(CODES.df(spark), areas, frontlines)


def market_registry(spark, sf_dir):
    """Registry rows with their defaults."""
    r = reports.registry_entries(COUNTRIES.df(spark))
    return r.select("name", "base", "domain", "lang_path", "form_id", "site", "corporate_title", "root", *[F.array_join(c, ",").alias(c) for c in ("site_names", "draft_names", "former")])


def markets_of_briefs(spark, sf_dir):
    """The market of each page by its brief, else by its domain."""
    pages = OFFSETS.df(spark).select("page_id").union(VERDICTS.df(spark).select("page_id")).union(HOMES.df(spark).select("page_id")).distinct()
    return reports.market_of_brief(pages, SAID.df(spark), BY_DOMAIN.df(spark), COUNTRIES.df(spark))


def page_only_tally(spark, sf_dir):
    """Findings of pages without a brief, by category."""
    return reports.page_only(MARKED.df(spark))


def form_id_states(spark, sf_dir):
    """Rows on screen for the form ids of pages."""
    return reports.form_id_rows(IDS.df(spark))


def doc_link_contexts(spark, sf_dir):
    """Lines of documents as a stream: the last lines above each line with an address, below the last short line."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text")).where("text <> ''")
    kind = F.when(F.length("text") <= 20, "title").when(F.col("text").rlike("(?i)licen|[0-9]{4}"), "link").otherwise("paragraph")
    return matching.contexts(lines.withColumn("kind", kind)).select("page_id", "ord", "title", F.md5("body").alias("body"))


QUERIES = {f.__name__: f for f in (asked_for, unreported_findings, findings_with_suggestions, link_audit_counts, places_of_offsets, own_form_groups, own_form_findings, supplier_stems, region_markets, market_registry, markets_of_briefs, page_only_tally, form_id_states, doc_link_contexts)}
_GROUPS = f"""(SELECT page_id, path, arg_min(site, CASE WHEN site IS NOT NULL THEN ord END) AS site, count(*) AS n, count(*) FILTER (coalesce(country, '') = '') AS missing,
  list_distinct(list(country ORDER BY ord) FILTER (coalesce(country, '') <> '')) AS countries FROM {FORMS.sql()} GROUP BY ALL)"""


def _in_order(column: str) -> str:
    return f"coalesce((SELECT string_agg(x, ', ' ORDER BY o) FROM (SELECT {column} AS x, min(ord) AS o FROM {FORMS.sql()} f WHERE f.page_id = g.page_id AND f.path = g.path AND coalesce({column}, '') <> '' GROUP BY {column})), '')"


_ASKED = "(SELECT DISTINCT upper(trim(code)) AS code FROM " + CODES.sql() + ")"
_OWN = "(SELECT upper(n_name) AS code, s_name AS market FROM nation JOIN supplier ON n_nationkey = s_nationkey)"
_AREA = "(SELECT upper(r_name) AS code, s_name AS market FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey)"
_STREAM = """(SELECT doc_id, ord, text, CASE WHEN length(text) <= 20 THEN 'title' WHEN regexp_matches(text, '(?i)licen|[0-9]{4}') THEN 'link' ELSE 'paragraph' END AS kind FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS ord FROM documents) WHERE text <> '')"""
ORACLE_SQL = {
    "asked_for": f"""SELECT page_id, string_agg(place, '; ' ORDER BY o) AS places FROM (SELECT page_id, place, min(ord) AS o FROM (SELECT *, CASE WHEN coalesce(section, '') <> '' AND "row" IS NOT NULL THEN section || ', row ' || "row" WHEN "row" IS NOT NULL THEN 'row ' || "row" ELSE coalesce(section, '') END AS place FROM {WANTS.sql()}) WHERE place <> '' GROUP BY ALL) GROUP BY page_id""",
    "unreported_findings": f"SELECT * FROM {FOUND.sql()} f WHERE NOT EXISTS (SELECT 1 FROM {REPORTED.sql()} r WHERE r.page_id = f.page_id AND r.found = f.found)",
    "findings_with_suggestions": f"""WITH x AS (SELECT page_id, text AS found, arg_min(url || CASE WHEN confident THEN '' ELSE ' (closest match — check it)' END, ord) AS suggest FROM {AUDIT.sql()} JOIN {BEST.sql()} USING (text_id) WHERE kind IN ('dead-cta', 'placeholder') GROUP BY ALL) SELECT d.*, suggest FROM {DEAD.sql()} d LEFT JOIN x USING (page_id, found)""",
    "link_audit_counts": f"SELECT page_id, count(*) FILTER (verdict = 'red') AS red, count(*) FILTER (verdict = 'amber') AS amber, count(*) FILTER (verdict = 'green') AS green FROM {VERDICTS.sql()} GROUP BY page_id",
    "places_of_offsets": f"""SELECT o.page_id, o."offset", m.module, (SELECT arg_max(field, "at") FROM {FIELDS.sql()} f WHERE f.page_id = o.page_id AND f.module = m.module AND f."at" <= o."offset") AS field FROM {OFFSETS.sql()} o LEFT JOIN {MODULES.sql()} m ON m.page_id = o.page_id AND o."offset" >= m."start" AND o."offset" < m."end" """,
    "own_form_groups": f"SELECT page_id, path, site, n, missing, {_in_order('topic')} AS topics, {_in_order('country')} AS countries FROM {_GROUPS} g",
    "own_form_findings": f"""WITH g AS (SELECT g.*, h.site AS want, h.country AS home FROM {_GROUPS} g LEFT JOIN {HOMES.sql()} h USING (page_id))
SELECT page_id, 'break' AS severity, string_agg(DISTINCT site, ', ' ORDER BY site) AS found, NULL AS expected FROM g WHERE site IS NOT NULL GROUP BY page_id HAVING count(DISTINCT site) > 1
UNION ALL SELECT page_id, 'check', path, NULL FROM g WHERE want IS NOT NULL AND site IS NULL UNION ALL SELECT page_id, 'break', site, want FROM g WHERE site <> want
UNION ALL SELECT page_id, 'break', c, home FROM (SELECT *, unnest(countries) AS c FROM g WHERE want IS NOT NULL) WHERE c <> home UNION ALL SELECT page_id, 'check', path, NULL FROM g WHERE want IS NOT NULL AND missing > 0""",
    "supplier_stems": r"SELECT s_nationkey, regexp_replace(lower('Card ' || s_name), '\s*\d+\s*$', '') AS stem, min(s_suppkey) AS first, count(*) AS n, md5(string_agg('Card ' || s_name, ',' ORDER BY s_suppkey)) AS labels FROM supplier GROUP BY ALL",
    "region_markets": f"""SELECT code, 'frontline' AS kind, market FROM {_ASKED} JOIN {_OWN} USING (code) UNION ALL SELECT DISTINCT code, 'area', market FROM {_ASKED} JOIN {_AREA} USING (code) WHERE code NOT IN (SELECT code FROM {_OWN})
UNION ALL SELECT code, 'invalid', NULL FROM {_ASKED} WHERE code NOT IN (SELECT code FROM {_OWN}) AND code NOT IN (SELECT code FROM {_AREA})""",
    "market_registry": rf"""SELECT name, regexp_replace(name, '\s*\([^)]*\)\s*$', '') AS base, lower(coalesce(domain, '')) AS domain, nullif(lang_path, '') AS lang_path, CAST(form_id AS VARCHAR) AS form_id, lower(site) AS site, coalesce(corporate_title, true) AS corporate_title, rtrim(root, '/') AS root,
  coalesce(array_to_string(site_names, ','), '') AS site_names, coalesce(array_to_string(draft_names, ','), '') AS draft_names, coalesce(lower(array_to_string(former, ',')), '') AS former FROM {COUNTRIES.sql()}""",
    "markets_of_briefs": f"""WITH p AS (SELECT page_id FROM {OFFSETS.sql()} UNION SELECT page_id FROM {VERDICTS.sql()} UNION SELECT page_id FROM {HOMES.sql()}), s AS (SELECT page_id, min(market) AS named FROM {SAID.sql()} WHERE market IN (SELECT name FROM {COUNTRIES.sql()}) GROUP BY page_id)
SELECT page_id, coalesce(named, market) AS market, CASE WHEN named IS NOT NULL THEN 'brief' WHEN market IS NOT NULL THEN 'domain' ELSE 'none' END AS basis FROM p LEFT JOIN s USING (page_id) LEFT JOIN {BY_DOMAIN.sql()} d USING (page_id)""",
    "page_only_tally": f"SELECT page_id, category, count(*) FILTER (severity <> 'check') AS breaks, count(*) FILTER (severity = 'check') AS checks FROM {MARKED.sql()} WHERE NOT coalesce(from_brief, false) GROUP BY ALL",
    "form_id_states": f"SELECT page_id, 'Form id' AS field, nullif(source, '') AS source, nullif(expected, '') AS expected, nullif(array_to_string(ids, ', '), '') AS found, state FROM {IDS.sql()}",
    "doc_link_contexts": f"""WITH s AS (SELECT *, last_value(CASE WHEN kind = 'title' THEN text END IGNORE NULLS) OVER w AS title, count(*) FILTER (kind = 'title') OVER w AS part FROM {_STREAM} WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT doc_id, part, list(struct_pack(o := ord, x := text) ORDER BY ord) AS paragraphs FROM s WHERE kind = 'paragraph' GROUP BY ALL)
SELECT doc_id AS page_id, ord, title, md5(array_to_string(list_transform(coalesce(list_filter(paragraphs, lambda p: p.o < ord AND p.x <> text), [])[CASE WHEN title IS NULL THEN -2 ELSE -4 END:], lambda p: p.x), ' ')) AS body FROM s LEFT JOIN g USING (doc_id, part) WHERE kind = 'link'""",
}
