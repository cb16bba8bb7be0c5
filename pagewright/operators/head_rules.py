"""Checks of a page's head, address and chrome; findings as in ``rules``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import markup
from pagewright.operators.rules import checks, finding, union

# fixed values: words of titles that are no keywords
TITLE_STOP_WORDS = ("the", "a", "an", "and", "or", "of", "for", "to", "in", "on", "at", "by", "with", "from", "your", "you", "our", "us", "we", "this", "that", "all", "is", "are", "be", "it", "its", "as", "into", "corporation")
HREFLANG = r"(?i)^(x-default|[a-z]{2,3}(-([a-z]{2}|[a-z]{4}|\d{3}))?)$"
#: A certificate that runs out in fewer days needs a look.
CERTIFICATE_DAYS = 30


def facts(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, canonical, robots, environment and share tags): what the head says, null where it says nothing."""
    html = F.col("html")
    head = F.when(html.rlike(r"(?is)<head\b[^>]*>.*?</head>"), F.regexp_extract(html, r"(?is)<head\b[^>]*>(.*?)</head>", 1)).otherwise(html)
    rows = pages.select("page_id", "url", "html", head.alias("head"))
    link = F.regexp_extract("head", r"(?is)(<link\b[^>]*rel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    either = lambda name: F.coalesce(markup.meta(F.col("head"), name), markup.meta(F.col("head"), name, "property"))
    names = {"og_title": "og:title", "og_url": "og:url", "og_image": "og:image", "card": "twitter:card", "card_image": "twitter:image", "robots": "robots"}
    title = F.when(F.col("head").rlike(r"(?is)<title\b[^>]*>"), T.normalise(F.regexp_extract("head", r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
    h1 = F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return rows.select(
        "page_id", "url", "html", title.alias("title"), F.when(link != "", T.attr(link, "href")).alias("canonical"), h1.alias("h1"),
        *[either(v).alias(k) for k, v in names.items()], U.environment_of(U.host_of(F.coalesce(F.when(link != "", T.attr(link, "href")), F.col("url")))).alias("environment"),
    )


def title_format(title, own_names, separator, corporate: bool, other_names: list[str], brand: str, drafts=None, shared=False):
    """(state, reason) of a title by the naming rule "page - brand name": green if confirmed, red if wrong, else amber.

    ``own_names`` is the column of confirmed names of the page's market (null: unknown market), ``separator`` that of
    the only mark the market takes (null: any), ``other_names`` all confirmed names, ``drafts`` the column of names the market
    has not confirmed yet. Where ``shared``, another title of the page carries the brand, and the page's name alone will do.
    """
    t = T.normalise(title)
    sep = F.regexp_extract(t, r"^.*\s([|-])\s", 1)
    suffix = F.trim(F.regexp_extract(t, r"^.*\s[|-]\s(.*)$", 1))
    name = F.lower(F.trim(F.regexp_extract(suffix, rf"^{brand}\s+(.+)$", 1)))
    own = F.transform(F.coalesce(own_names, F.array().cast("array<string>")), lambda x: F.lower(x))
    known = [n.lower() for n in other_names]
    previous = F.lower(F.regexp_extract(t, rf"^.*\s[|-]\s{brand}\s+(.+?)\s[|-]\s[^|]*$", 1))
    state = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", state("red", "no title"))
        .when(T.duplicate_part(t).isNotNull(), state("red", "site name doubled"))
        .when((sep == "") & t.rlike(rf"(?i)\s[–—]\s*{brand}\b"), state("amber", "a long dash before the site name"))
        .when((sep == "") & F.lit(shared) & ~t.rlike(rf"\b{brand}\b"), state("green", "page name alone"))
        .when(sep == "", state("amber", "no site name"))
        .when(suffix == brand, state("amber", "no country after the brand"))
        .when(name == "", state("amber", "the ending is no site name"))
        .when(previous.isin("corporation", *known), state("amber", "two site names"))
        .when(name == "corporation", state("green", "corporate name") if corporate else state("red", "corporate name on a market's page"))
        .when(separator.isNotNull() & (sep != separator) & F.array_contains(own, name), state("amber", "another separator than the market's"))
        .when(F.array_contains(own, name), state("green", "confirmed name of the market"))
        .when(name.isin(*known) & own_names.isNotNull(), state("red", "another market's name"))
        .when(own_names.isNull(), state("amber", "market unknown"))
        .when(F.array_contains(F.transform(F.coalesce(drafts if drafts is not None else F.lit(None), F.array().cast("array<string>")), lambda x: F.lower(x)), name), state("amber", "draft name of the market"))
        .otherwise(state("amber", "not a confirmed name"))
    )


def head_findings(f: DataFrame) -> DataFrame:
    """Robots on production, share tags that disagree, an old page ending in the canonical, an H1 unlike the title."""
    https = lambda c: F.regexp_replace(c, "/+$", "")
    titled, named = T.keywords_of(F.col("title"), TITLE_STOP_WORDS), T.keywords_of(T.strip_tags(F.col("h1")), TITLE_STOP_WORDS)
    part = f.withColumn("part", T.duplicate_part(F.col("title")))
    apart = (F.size(titled) > 0) & (F.size(named) > 0) & ~F.arrays_overlap(titled, named)
    return checks(part, [
        ((F.col("environment") == "production") & F.lower("robots").contains("noindex"), "metadata", "check", "Robots", F.col("robots"), "production page is kept from search"),
        ("part is not null", "metadata", "check", "Page title", F.col("part"), "site name doubled or repeated in part"),
        (F.col("canonical").rlike(r"(?i)\.aspx(?=$|[?#])"), "metadata", "check", "Canonical", F.col("canonical"), "old page ending"),
        (https(F.col("og_url")) != https(F.col("canonical")), "metadata", "check", "og:url", F.col("og_url"), "differs from the canonical"),
        ("card = 'summary' and og_image <> ''", "metadata", "check", "twitter:card", F.col("card"), "share image shown small"),
        ("card_image <> '' and og_image <> '' and card_image <> og_image", "metadata", "check", "twitter:image", F.col("card_image"), "two share images"),
        (F.col("h1").rlike(r"(?i)<br\s*/?>"), "metadata", "check", "H1", T.strip_tags(F.col("h1")), "broken over lines"),
        (apart, "metadata", "check", "H1", T.strip_tags(F.col("h1")), "shares no keyword with the title"),
    ])


def hreflang_findings(pages: DataFrame) -> DataFrame:
    """No alternates, codes that are none, codes that repeat, no alternate that names the page itself."""
    f = facts(pages).select("page_id", "canonical")
    alt = markup.alternates(pages).withColumn("code", F.trim("code"))
    own = F.concat(U.host_of(F.col("canonical")), U.path_of(F.col("canonical")))
    there = F.concat(U.host_of(F.col("href")), U.path_of(F.col("href")))
    joined = f.join(alt, "page_id", "left").groupBy("page_id").agg(F.count("code").alias("n"), F.bool_or(own == there).alias("self"), F.any_value("canonical").alias("canonical"))
    return union([
        finding(joined.where("n = 0"), "metadata", "check", "hreflang", None, "no alternates"),
        finding(alt.where(~F.col("code").rlike(HREFLANG)), "metadata", "break", "hreflang", F.col("code"), "no valid code"),
        finding(alt.groupBy("page_id", "code").agg(F.count("*").alias("n")).where("n > 1"), "metadata", "break", "hreflang", F.col("code"), "declared more than once"),
        finding(joined.where("n > 0 and canonical is not null and not coalesce(self, false)"), "metadata", "check", "hreflang", F.col("n"), "no alternate names the page itself"),
    ])


def live_findings(fetches: DataFrame, slow_ms: int = 3000, slow_ttfb_ms: int = 800, max_redirects: int = 3) -> DataFrame:
    """Plain http, certificates, redirects, statuses, slow pages and another canonical, from rows of ``fetch``
    (page_id, url, final_url, status, redirects, ms, ttfb_ms, tls, canonical)."""
    hops, final = F.coalesce(F.size("redirects"), F.lit(0)), F.coalesce("final_url", "url")
    rows = fetches.withColumn("hops", hops).withColumn("final", final)
    place = lambda c: F.concat(U.host_of(c), U.path_of(c))
    chain = F.concat_ws(" -> ", "url", F.array_join(F.transform("redirects", lambda r: r["to"]), " -> "))
    return checks(rows, [
        (F.col("final").rlike("^(?i)http://"), "structure", "break", "HTTPS", F.col("final"), "served over plain http"),
        ("not tls.valid", "structure", "break", "Certificate", F.col("tls.error"), "certificate is not valid"),
        (f"tls.valid and tls.days_left < {CERTIFICATE_DAYS}", "structure", "check", "Certificate", F.col("tls.days_left"), "certificate runs out soon"),
        (F.col("hops") > max_redirects, "links", "break", "Redirect chain", chain, "too many redirects"),
        (F.col("hops").between(2, max_redirects), "links", "check", "Redirect chain", chain, "reached through redirects"),
        ("status <> 200 and status <> 0", "structure", "break", "Final status", F.col("status"), "not 200"),
        (F.col("ms") > slow_ms, "structure", "check", "Load time", F.format_string("%.1f s", F.col("ms") / 1000), "slow"),
        (F.col("ttfb_ms") > slow_ttfb_ms, "structure", "check", "First byte", F.format_string("%.1f s", F.col("ttfb_ms") / 1000), "slow first byte"),
        (F.col("canonical").isNotNull() & (place(F.col("final")) != place(F.col("canonical"))) & ~F.regexp_replace(F.lower("final"), "^https?://(www\\.)?", "").rlike(r"^preview(-[a-z]+)?\."), "metadata", "check", "Canonical", F.col("canonical"), "served at another address than its canonical"),
    ])


def chrome_findings(pages: DataFrame, market: DataFrame) -> DataFrame:
    """Search country, logo and language button that name another market; ``market`` is (page_id, country, language, lang_path).

    The classes and attributes are those of the shared header: data-search-country and -language, a class that ends in
    ``header__logo-link`` and one that ends in ``language-button__label``.
    """
    src = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1>", " ")
    rows = pages.select("page_id", src.alias("src")).join(market, "page_id")
    search = F.regexp_extract("src", r"(?is)(<[a-z][^>]*\sdata-search-country\s*=[^>]*>)", 1)
    logo = F.regexp_extract("src", r"(?is)(<a\b[^>]*\bclass\s*=\s*[\"'][^\"']*header__logo-link\b[^>]*>)", 1)
    labels = F.regexp_extract_all("src", F.lit(r"(?is)<span\b[^>]*\bclass\s*=\s*[\"'][^\"']*language-button__label\b[^>]*>(.*?)</span>"), F.lit(1))
    rows = rows.select("page_id", "country", "language", "lang_path", T.attr(search, "data-search-country").alias("sc"), T.attr(search, "data-search-language").alias("sl"), U.path_of(T.attr(logo, "href")).alias("lp"), (logo != "").alias("has_logo"), labels.alias("labels"))
    other = (F.lower("sc") != F.col("country")) | (F.lower("sl") != F.col("language"))
    want = F.concat(F.lit("/"), F.lower("lang_path"))
    away = F.col("has_logo") & (F.col("lang_path") != "") & ~((F.col("lp") == want) | F.col("lp").startswith(F.concat(want, F.lit("/"))))
    shown = rows.select("page_id", "country", "language", F.explode("labels").alias("raw")).withColumn("label", T.strip_tags(F.col("raw")))
    wrong = F.upper(F.regexp_replace("label", r"\s+", "")) != F.upper(F.concat_ws("-", "country", "language"))
    return union([
        finding(rows.where(other), "structure", "break", "Header/footer market", F.concat_ws("/", "sc", "sl"), "search is set up for another market"),
        finding(rows.where(away), "structure", "break", "Header/footer market", F.col("lp"), "logo links to another site"),
        finding(shown.where((F.col("label") != "") & wrong), "structure", "break", "Header/footer market", F.col("label"), "language button of another market"),
    ])


def metadata_compare(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, field, expected, found, state): five fields of a brief against a page's head; wants that are null are no rows.

    ``wanted`` is (page_id, title, name, description, keywords, url). Titles that match the share title only are soft.
    """
    f = facts(pages).withColumn("description", markup.meta(F.col("html"), "description")).withColumn("keywords", markup.meta(F.col("html"), "keywords"))
    w = wanted.select("page_id", *[F.col(c).alias(f"w_{c}") for c in ("title", "name", "description", "keywords", "url")])
    row = lambda field, want, have, same, soft=F.lit(False): F.struct(F.lit(field).alias("field"), want.alias("expected"), have.alias("found"), F.when(F.coalesce(same, F.lit(False)), "matches").when(F.coalesce(soft, F.lit(False)), "soft").otherwise("differs").alias("state"))
    c, eq = F.col, lambda a, b: T.normalise(a) == T.normalise(b)
    items = F.array(
        row("title", c("w_title"), F.coalesce("og_title", "title"), eq(c("w_title"), F.coalesce("og_title", "title")), eq(c("w_title"), c("title"))),
        row("name", c("w_name"), c("title"), eq(c("w_name"), c("title"))),
        row("description", c("w_description"), c("description"), eq(c("w_description"), c("description"))),
        row("keywords", c("w_keywords"), c("keywords"), T.same_list(c("w_keywords"), c("keywords")) & c("keywords").isNotNull()),
        row("url", c("w_url"), c("canonical"), U.path_of(c("w_url")) == U.path_of(c("canonical"))),
    )
    return w.join(f, "page_id").select("page_id", F.explode(items).alias("x")).select("page_id", "x.*").where("expected is not null")


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, title_chars, stray, h1): length of the raw title, whether spaces stand around it, and H1 tags."""
    title = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", F.length(title).cast("bigint").alias("title_chars"), (title != F.trim(title)).alias("stray"), F.regexp_count("html", F.lit(r"(?i)<h1[\s>]")).cast("bigint").alias("h1"))
