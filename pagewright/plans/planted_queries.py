"""Queries over pages whose markup is written from each row's number, so that the SQL knows what the rules must find.

Every page of the table gets a head, headings, links and a shared header that are right or wrong by the remainders of its
number. The SQL counts by the remainders alone and reads no markup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.operators import head_rules, link_rules, markup, rules
from pagewright.sources import table

LONG_TITLE = "Lifts and doors for every house and every street of the whole wide town"


def _pick(k: int, *cases: str) -> Column:
    """The case of each row's number modulo ``k``; the last case for all others."""
    by = F.col("page_id") % k
    return reduce(lambda out, c: F.when(by == c[0], c[1]).otherwise(out), reversed(list(enumerate(cases[:-1]))), F.lit(cases[-1]))


def planted(spark, sf_dir):
    """(page_id, url, html) with planted markup; the exchange keeps it from being written anew in every expression that reads it."""
    n = F.col("page_id").cast("string")
    at = F.concat(F.when(F.col("page_id") % 11 == 0, "https://preview.a.test/p").otherwise(F.concat(F.lit("https://a.test/p/"), n)), _pick(4, ".aspx", ""))
    meta = lambda name, value: F.concat(F.lit(f'<meta name="{name}" content="'), value, F.lit('">'))
    alternate = lambda code, href: F.concat(F.lit(f'<link rel="alternate" hreflang="{code}" href="'), href, F.lit('">'))
    by5 = F.col("page_id") % 5
    head = [
        F.concat(F.lit("<title>"), _pick(10, "", " Lifts and doors ", LONG_TITLE, "Lifts - Doors - Lifts", "Lifts and doors"), F.lit("</title>")),
        meta("keywords", _pick(4, "", "lifts")), F.when(F.col("page_id") % 4 != 1, meta("description", _pick(4, "x" * 100, "", "short", "x" * 100))).otherwise(""),
        F.concat(F.lit('<link rel="canonical" href="'), at, F.lit('">')), meta("robots", _pick(3, "noindex, follow", "index")),
        meta("og:url", F.concat(at, _pick(5, "x", "/"))), meta("twitter:card", _pick(2, "summary", "summary_large_image")), meta("og:image", F.lit("i.png")), meta("twitter:image", _pick(7, "j.png", "i.png")),
        F.when(by5 == 0, alternate("en", at)).when(by5 == 2, alternate("english", at)).when(by5 == 3, F.concat(alternate("en", at), alternate("en", at))).when(by5 == 4, alternate("de", F.lit("https://b.test/q"))).otherwise(""),
    ]
    body = [
        _pick(6, "", "<h1>Lifts</h1><h1>Doors</h1>", "<h1>Lifts<br>doors</h1>", "<h1>Nothing alike</h1>", "<h1>Lifts</h1>"), _pick(5, "<h2>Same</h2><h2>same</h2>", "<h2>Other</h2>"),
        _pick(7, '<a href="#">Elevators</a>', '<a href="/x"></a>', '<a href="/y">Read more</a>', '<a href="/y">Leggi di più →</a>', '<a href="/z">Doors</a>'),
        F.lit('<div data-search-country="'), _pick(3, "FR", "IT"), F.lit('" data-search-language="it"></div><a class="x header__logo-link" href="'), _pick(4, "/fr", "/it/"), F.lit('">Home</a><span class="y language-button__label">'), _pick(5, "FR-FR", "IT - IT"), F.lit("</span>"),
    ]
    lang = F.concat(F.lit('<html lang="en"'), _pick(9, ' data-lang="fr"', ""), F.lit(">"))
    html = F.concat(lang, F.lit("<head>"), *head, F.lit("</head><body>"), *body, F.lit("</body></html>"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://a.test/p/"), n).alias("url"), html.alias("html")).repartition("page_id")


def _counted(found):
    return found.groupBy("severity", "field", "note").agg(F.count("*").alias("n"))


def planted_findings(spark, sf_dir):
    """What the page rules find in planted pages."""
    return _counted(rules.audit(planted(spark, sf_dir)))


def planted_tally(spark, sf_dir):
    """Breaks and checks of each planted page."""
    return rules.tally(rules.audit(planted(spark, sf_dir)), "page_id")


def planted_head_findings(spark, sf_dir):
    """What the head rules find in planted pages."""
    return _counted(head_rules.head_findings(head_rules.facts(planted(spark, sf_dir))))


def planted_facts(spark, sf_dir):
    """What the heads of planted pages say."""
    return head_rules.facts(planted(spark, sf_dir)).select("page_id", "title", "canonical", "og_url", "card", "robots", "environment")


def planted_hreflang_findings(spark, sf_dir):
    """What the rules of language versions find in planted pages."""
    return _counted(head_rules.hreflang_findings(planted(spark, sf_dir)))


def planted_chrome_findings(spark, sf_dir):
    """Headers of planted pages that name another market."""
    pages = planted(spark, sf_dir)
    return _counted(head_rules.chrome_findings(pages, pages.select("page_id", F.lit("it").alias("country"), F.lit("it").alias("language"), F.lit("it").alias("lang_path"))))


def planted_headings(spark, sf_dir):
    """Headings of planted pages by level and text."""
    return markup.headings(planted(spark, sf_dir)).groupBy("level", "text").agg(F.count("*").alias("n"))


def planted_alternates(spark, sf_dir):
    """Language versions that planted pages name."""
    return markup.alternates(planted(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def planted_link_targets(spark, sf_dir):
    """Where the links of planted pages lead."""
    return link_rules.targets(planted(spark, sf_dir)).groupBy("dst").agg(F.count("*").alias("pages"), F.sum("places").alias("places"))


def planted_title_formats(spark, sf_dir):
    """Titles by the naming rule, with and without a known market."""
    rows = table(spark, sf_dir, "pages").select("page_id", _pick(12, "", "Lifts", "Lifts - Brand", "Lifts - Other", "Lifts - Brand France - Brand Italy", "Lifts - Brand Corporation", "Lifts - Brand Italy", "Lifts - Brand France", "Lifts - Brand Spain", "Lifts – Brand Italy", "Lifts - Brand Italia", "Lifts | Doors | Lifts").alias("title"), F.when(F.col("page_id") % 2 == 0, F.array(F.lit("Italy"))).alias("own"))
    f = head_rules.title_format(F.col("title"), F.col("own"), F.lit(None).cast("string"), True, ["Italy", "France"], "Brand", drafts=F.when(F.col("own").isNotNull(), F.array(F.lit("Italia"))), shared=F.col("page_id") % 5 == 0)
    return rows.select(f.alias("f")).groupBy("f.state", "f.reason").agg(F.count("*").alias("n"))


def order_fetches(spark, sf_dir):
    """Orders as fetched pages: what the rules of live answers find."""
    k = F.col("o_orderkey")
    url = F.concat(F.when(k % 9 == 0, "http://a.test/o/").otherwise("https://a.test/o/"), k)
    hop = F.struct(F.lit("https://a.test/hop").alias("to"))
    tls = F.struct((k % 8 != 0).alias("valid"), F.when(k % 8 == 0, "expired").alias("error"), (k % 60).cast("int").alias("days_left"))
    rows = table(spark, sf_dir, "orders").select(k.alias("page_id"), url.alias("url"), F.when(k % 5 == 0, F.concat(url, F.lit("/x"))).alias("final_url"), (F.lit(200) + F.when(k % 7 == 0, 204).otherwise(0)).cast("int").alias("status"), F.array_repeat(hop, (k % 6).cast("int")).alias("redirects"), (k % 4000).cast("int").alias("ms"), (k % 1000).cast("int").alias("ttfb_ms"), tls.alias("tls"), F.concat(F.lit("https://a.test/o/"), k).alias("canonical"))
    return _counted(head_rules.live_findings(rows))


QUERIES = {f.__name__: f for f in (planted_findings, planted_tally, planted_head_findings, planted_facts, planted_hreflang_findings, planted_chrome_findings, planted_headings, planted_alternates, planted_link_targets, planted_title_formats, order_fetches)}


def _count(cases: list[tuple[str, str, str, str]], rows: str = "pages") -> str:
    """(severity, field, note, n) of the cases (condition, severity, field, note) that occur."""
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS severity, '{f}' AS field, '{n.replace(chr(39), chr(39) * 2)}' AS note, count(*) AS n FROM {rows} WHERE {c}" for c, s, f, n in cases) + ") WHERE n > 0"


_PAGE_RULES = [
    ("page_id % 10 = 0", "break", "Title", "no title"), ("page_id % 10 = 1", "check", "Title", "leading or trailing spaces"), ("page_id % 10 = 2", "check", "Title", "over 60 characters"), ("page_id % 10 = 3", "check", "Title", "a part repeats"),
    ("page_id % 6 = 0", "break", "H1", "no H1"), ("page_id % 6 = 1", "break", "H1", "more than one H1"), ("page_id % 5 = 0", "break", "Heading", "heading repeats"),
    ("page_id % 7 = 0", "break", "Link", "placeholder link"), ("page_id % 7 = 1", "break", "Link text", "link without a name"), ("page_id % 7 IN (2, 3)", "check", "Link text", "link text says nothing about its target"),
    ("page_id % 9 = 0", "break", "Page language", "lang and data-lang disagree"), ("page_id % 4 = 0", "check", "Keywords", "keywords are empty"), ("page_id % 4 = 1", "check", "Description", "no description"), ("page_id % 4 = 2", "check", "Description", "not 70 to 160 characters"),
]
_sum = lambda s: " + ".join(f"CAST({c} AS INT)" for c, sev, _, _ in _PAGE_RULES if sev == s)
_AT = "CASE WHEN page_id % 11 = 0 THEN 'https://preview.a.test/p' ELSE 'https://a.test/p/' || page_id END || CASE WHEN page_id % 4 = 0 THEN '.aspx' ELSE '' END"
_TITLES = f"CASE page_id % 10 WHEN 0 THEN '' WHEN 2 THEN '{LONG_TITLE}' WHEN 3 THEN 'Lifts - Doors - Lifts' ELSE 'Lifts and doors' END"
_FETCHED = "(SELECT o_orderkey AS k FROM orders)"
ORACLE_SQL = {
    "planted_findings": _count(_PAGE_RULES),
    "planted_tally": f"SELECT * FROM (SELECT page_id, CAST({_sum('break')} AS BIGINT) AS breaks, CAST({_sum('check')} AS BIGINT) AS checks FROM pages) WHERE breaks + checks > 0",
    "planted_head_findings": _count([
        ("page_id % 3 = 0 AND page_id % 11 <> 0", "check", "Robots", "production page is kept from search"), ("page_id % 10 = 3", "check", "Page title", "site name doubled or repeated in part"), ("page_id % 4 = 0", "check", "Canonical", "old page ending"),
        ("page_id % 5 = 0", "check", "og:url", "differs from the canonical"), ("page_id % 2 = 0", "check", "twitter:card", "share image shown small"), ("page_id % 7 = 0", "check", "twitter:image", "two share images"),
        ("page_id % 6 = 2", "check", "H1", "broken over lines"), ("page_id % 6 = 3 AND page_id % 10 <> 0", "check", "H1", "shares no keyword with the title"),
    ]),
    "planted_facts": f"SELECT page_id, {_TITLES} AS title, {_AT} AS canonical, {_AT} || CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '/' END AS og_url, CASE WHEN page_id % 2 = 0 THEN 'summary' ELSE 'summary_large_image' END AS card, CASE WHEN page_id % 3 = 0 THEN 'noindex, follow' ELSE 'index' END AS robots, CASE WHEN page_id % 11 = 0 THEN 'preview' ELSE 'production' END AS environment FROM pages",
    "planted_hreflang_findings": _count([("page_id % 5 = 1", "check", "hreflang", "no alternates"), ("page_id % 5 = 2", "break", "hreflang", "no valid code"), ("page_id % 5 = 3", "break", "hreflang", "declared more than once"), ("page_id % 5 = 4", "check", "hreflang", "no alternate names the page itself")]),
    "planted_chrome_findings": _count([("page_id % 3 = 0", "break", "Header/footer market", "search is set up for another market"), ("page_id % 4 = 0", "break", "Header/footer market", "logo links to another site"), ("page_id % 5 = 0", "break", "Header/footer market", "language button of another market")]),
    "planted_headings": "SELECT level, text, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{lv}' AS level, '{t}' AS text FROM pages WHERE {c}" for lv, t, c in [("h1", "Lifts", "page_id % 6 IN (1, 4, 5)"), ("h1", "Doors", "page_id % 6 = 1"), ("h1", "Lifts doors", "page_id % 6 = 2"), ("h1", "Nothing alike", "page_id % 6 = 3"), ("h2", "Same", "page_id % 5 = 0"), ("h2", "same", "page_id % 5 = 0"), ("h2", "Other", "page_id % 5 <> 0")]) + ") GROUP BY ALL",
    "planted_alternates": "SELECT code, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(CASE page_id % 5 WHEN 0 THEN ['en'] WHEN 2 THEN ['english'] WHEN 3 THEN ['en', 'en'] WHEN 4 THEN ['de'] ELSE [] END) AS code FROM pages) GROUP BY code",
    "planted_link_targets": "SELECT 'https://a.test' || p AS dst, count(*) AS pages, CAST(count(*) AS BIGINT) AS places FROM (SELECT unnest([CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '/x' WHEN 2 THEN '/y' WHEN 3 THEN '/y' ELSE '/z' END, CASE WHEN page_id % 4 = 0 THEN '/fr' ELSE '/it/' END]) AS p FROM pages) WHERE p IS NOT NULL GROUP BY p",
    "planted_title_formats": """SELECT s[1] AS state, s[2] AS reason, count(*) AS n FROM (SELECT CASE page_id % 12 WHEN 0 THEN ['red', 'no title'] WHEN 1 THEN CASE WHEN page_id % 5 = 0 THEN ['green', 'page name alone'] ELSE ['amber', 'no site name'] END WHEN 2 THEN ['amber', 'no country after the brand'] WHEN 3 THEN ['amber', 'the ending is no site name']
  WHEN 4 THEN ['amber', 'two site names'] WHEN 5 THEN ['green', 'corporate name'] WHEN 6 THEN CASE WHEN own THEN ['green', 'confirmed name of the market'] ELSE ['amber', 'market unknown'] END WHEN 7 THEN CASE WHEN own THEN ['red', 'another market''s name'] ELSE ['amber', 'market unknown'] END
  WHEN 8 THEN CASE WHEN own THEN ['amber', 'not a confirmed name'] ELSE ['amber', 'market unknown'] END WHEN 9 THEN ['amber', 'a long dash before the site name'] WHEN 10 THEN CASE WHEN own THEN ['amber', 'draft name of the market'] ELSE ['amber', 'market unknown'] END ELSE ['red', 'site name doubled'] END AS s FROM (SELECT page_id, page_id % 2 = 0 AS own FROM pages)) GROUP BY ALL""",
    "order_fetches": _count([
        ("k % 9 = 0", "break", "HTTPS", "served over plain http"), ("k % 8 = 0", "break", "Certificate", "certificate is not valid"), ("k % 8 <> 0 AND k % 60 < 30", "check", "Certificate", "certificate runs out soon"), ("k % 6 > 3", "break", "Redirect chain", "too many redirects"), ("k % 6 BETWEEN 2 AND 3", "check", "Redirect chain", "reached through redirects"),
        ("k % 7 = 0", "break", "Final status", "not 200"), ("k % 4000 > 3000", "check", "Load time", "slow"), ("k % 1000 > 800", "check", "First byte", "slow first byte"), ("k % 5 = 0", "check", "Canonical", "served at another address than its canonical"),
    ], _FETCHED),
}
