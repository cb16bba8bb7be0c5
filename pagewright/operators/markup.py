"""Flat extraction from raw HTML with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T


# fixed values: attributes and labels of anchors to # that work as they are
SAFE_ATTRIBUTES = r"(?i)\b(aria-expanded|aria-controls|data-toggle|data-bs-toggle|role\s*=\s*[\"']?(button|tab))"
SAFE_LABELS = "back to top|top of page|skip to|scroll to top"


def first_text(html: Column, tag: str) -> Column:
    """Visible text of the first ``tag``, null where there is none."""
    at = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
    return F.when(html.rlike(at), T.strip_tags(F.regexp_extract(html, at, 1)))


def headings(pages: DataFrame, levels: str = "1-3") -> DataFrame:
    """(page_id, ord, level, text, hidden) of the headings."""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)(<h[{levels}]\b[^>]*>.*?</h[{levels}]>)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "tag"))
    open_tag = F.regexp_extract("tag", r"(?s)^(<[^>]*>)", 1)
    return rows.select("page_id", "ord", F.lower(F.substring("tag", 2, 2)).alias("level"), T.strip_tags(F.col("tag")).alias("text"), open_tag.rlike(r"(?i)display\s*:\s*none").alias("hidden"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, ord, tag, text) of p and li."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:p|li)\b[^>]*>.*?(?=</?(?:p|li|ul|ol|div|article|section|footer|body)\b))"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    return rows.select("page_id", "ord", F.lower(F.regexp_extract("raw", r"^<(\w+)", 1)).alias("tag"), T.strip_tags(F.col("raw")).alias("text")).where("text <> ''")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, ord, tag, href, text, alt) of every a; href is null where the tag has none, alt is that of the first image inside."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "raw")).withColumn("tag", F.regexp_extract("raw", r"(?s)^(<a\b[^>]*>)", 1))
    return rows.select("page_id", "ord", "tag", T.attr(F.col("tag"), "href").alias("href"), T.strip_tags(F.col("raw")).alias("text"), T.attr(F.regexp_extract("raw", r"(?is)(<img\b[^>]*>)", 1), "alt").alias("alt"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, href, text, placeholder): in-page anchors are left out; a # that toggles or scrolls is no placeholder."""
    rows = anchors(pages)
    empty = (F.coalesce("href", F.lit("")) == "") | (F.col("href") == "#")
    safe = F.col("tag").rlike(SAFE_ATTRIBUTES) | F.lower("text").rlike(SAFE_LABELS)
    rows = rows.where(~(empty & safe) & (empty | ~F.coalesce("href", F.lit("")).startswith("#")))
    return rows.select("page_id", "ord", "href", "text", empty.alias("placeholder"))


def images(pages: DataFrame) -> DataFrame:
    """(page_id, ord, src, alt) of every img; a lazy source stands in for a placeholder."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))).alias("ord", "tag"))
    src, lazy = T.attr(F.col("tag"), "src"), F.coalesce(T.attr(F.col("tag"), "data-src"), T.attr(F.col("tag"), "data-lazy-src"))
    return rows.select("page_id", "ord", F.when(lazy.isNotNull() & (F.coalesce(src, F.lit("")).rlike("^$|^data:")), lazy).otherwise(src).alias("src"), T.attr(F.col("tag"), "alt").alias("alt"))


def resources(pages: DataFrame) -> DataFrame:
    """(page_id, ord, tag, url, rel) of elements that load or link something."""
    names = "a|img|script|iframe|source|link|video|audio|embed"
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(rf"(?i)(<(?:{names})\b[^>]*>)"), F.lit(1))).alias("ord", "raw"))
    url = F.coalesce(T.attr(F.col("raw"), "src"), T.attr(F.col("raw"), "href"))
    return rows.select("page_id", "ord", F.lower(F.regexp_extract("raw", r"^<(\w+)", 1)).alias("tag"), url.alias("url"), T.attr(F.col("raw"), "rel").alias("rel")).where("url is not null")


def alternates(pages: DataFrame) -> DataFrame:
    """(page_id, code, href) of hreflang links."""
    raw = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)(<link\b[^>]*hreflang[^>]*>)"), F.lit(1))).alias("raw"))
    return raw.select("page_id", F.lower(T.attr(F.col("raw"), "hreflang")).alias("code"), T.attr(F.col("raw"), "href").alias("href"))


def meta(html: Column, name: str, key: str = "name") -> Column:
    """Content of a meta tag: null without the tag, empty with an empty content."""
    tag = F.regexp_extract(html, rf"(?is)(<meta\b[^>]*\s{key}\s*=\s*[\"']?{name}[\"'\s/>][^>]*>)", 1)
    return F.when(tag != "", F.coalesce(T.attr(tag, "content"), F.lit("")))


def main_region(html: Column, marked: tuple[str, ...] = ()) -> Column:
    """(html, via): the first part with visible text of main, role=main and elements of the classes ``marked``; else the body without chrome."""
    ways = [("main", r"(?is)<main\b[^>]*>(.*?)</main>", 1), ("[role=main]", r"(?is)<([a-z]+)\b[^>]*role\s*=\s*[\"']main[\"'][^>]*>(.*?)</\1>", 2)]
    ways += [(f".{c}", rf"(?is)<([a-z]+)\b[^>]*class\s*=\s*[\"'][^\"']*(?<![\w-]){c}(?![\w-])[^\"']*[\"'][^>]*>(.*?)</\1>", 2) for c in marked]
    parts = [(via, F.regexp_extract(html, at, group)) for via, at, group in ways]
    body = F.when(html.rlike(r"(?is)<body\b[^>]*>.*?</body>"), F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)</body>", 1)).otherwise(F.coalesce(html, F.lit("")))
    rest = F.regexp_replace(body, r"(?is)<(nav|header|footer|script|style|noscript|svg)\b[^>]*>.*?</\1>", " ")
    return F.coalesce(*[F.when(T.strip_tags(part) != "", F.struct(part.alias("html"), F.lit(via).alias("via"))) for via, part in parts], F.struct(rest.alias("html"), F.lit("body").alias("via")))


def by_class(pages: DataFrame, tags: str, marked: str) -> DataFrame:
    """(page_id, ord, inner, text) of elements of ``tags`` with a class of ``marked`` (alternatives), up to their first closing tag."""
    at = rf"(?is)(<({tags})\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?<![\w-])(?:{marked})(?![\w-])[^\"']*[\"'][^>]*>(.*?)</\2>)"
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(at), F.lit(3))).alias("ord", "inner"))
    return rows.withColumn("text", T.strip_tags(F.col("inner"))).where("text <> ''")


def dead_ctas(pages: DataFrame, marked: str = "actions|cta|ctalink") -> DataFrame:
    """(page_id, ord, text): containers of a call to action that hold text but no link, and no blocks of their own."""
    rows = by_class(pages, "div|p|span", marked)
    return rows.where(~F.col("inner").rlike(r"(?i)<(?:a|div|p|section|article|ul|ol|h[1-6])\b")).select("page_id", "ord", "text")


def triggers(pages: DataFrame, marked: str = "accordion-trigger") -> DataFrame:
    """(page_id, ord, text): labels that open a fold, which read as headings."""
    return by_class(pages, "button|a|div|span", marked).select("page_id", "ord", "text")


def details(pages: DataFrame) -> DataFrame:
    """(page_id, ord, summary, text) of details elements."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<details\b[^>]*>(.*?)</details>"), F.lit(1))).alias("ord", "inner"))
    at = r"(?is)<summary\b[^>]*>(.*?)</summary>"
    return rows.select("page_id", "ord", T.strip_tags(F.regexp_extract("inner", at, 1)).alias("summary"), T.strip_tags(F.regexp_replace("inner", at, " ")).alias("text"))


def page_data(html: Column, names: tuple[str, ...], variable: str = "digitalData") -> Column:
    """Struct of the values that the script declaring ``variable`` gives ``names``, quoted or bare; null where no script does."""
    body = F.regexp_extract(html, rf"(?is)<script\b[^>]*>((?:(?!</script>).)*?var\s+{variable}\s*=.*?)</script>", 1)
    bare = lambda n: F.coalesce(F.nullif(F.regexp_extract(body, rf"(?i){n}[\"']?\s*:\s*[\"']([^\"']*)[\"']", 1), F.lit("")), F.nullif(F.regexp_extract(body, rf"(?i){n}[\"']?\s*:\s*([\w.-]+)", 1), F.lit("")))
    return F.when(body != "", F.struct(*[bare(n).alias(n) for n in names]))
