"""Checks that emit one table of findings: (page_id, category, severity, field, found, note)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import markup

# fixed values: link texts that say nothing about where a link goes, in six languages
GENERIC_LINK_TEXT = (
    "click here", "here", "read more", "more", "learn more", "find out more", "this link", "link",
    "clicca qui", "qui", "leggi di più", "scopri di più", "scopri",
    "haga clic aquí", "aquí", "leer más", "más información",
    "clique aqui", "aqui", "saiba mais", "leia mais",
    "hier klicken", "hier", "mehr", "weiterlesen", "mehr erfahren",
    "cliquez ici", "ici", "en savoir plus", "lire la suite",
)


def finding(rows: DataFrame, category: str, severity: str, field: str, found: Column | None, note: str) -> DataFrame:
    return rows.select("page_id", F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), (F.lit(None) if found is None else found).cast("string").alias("found"), F.lit(note).alias("note"))


def checks(rows: DataFrame, items: list[tuple]) -> DataFrame:
    """Findings of several checks (condition, category, severity, field, found, note) in one pass over ``rows``; a null condition is no finding."""
    one = [F.when(F.expr(c) if isinstance(c, str) else c, F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"), F.lit(field).alias("field"), (F.lit(None) if found is None else found).cast("string").alias("found"), F.lit(note).alias("note"))) for c, cat, sev, field, found, note in items]
    return rows.select("page_id", F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("x")).select("page_id", "x.*")


def title_findings(pages: DataFrame) -> DataFrame:
    """No title; stray spaces; over 60 characters; a segment that repeats."""
    raw = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    rows = pages.select("page_id", "html").withColumn("has", F.col("html").rlike(r"(?is)<title\b[^>]*>.*?</title>")).withColumn("raw", T.decode_entities(raw)).withColumn("title", T.normalise(raw)).drop("html")
    parts = F.transform(F.split(F.lower("title"), r"\s+[-–|]\s+"), lambda x: F.trim(x))
    return checks(rows, [
        (~F.col("has") | (F.col("title") == ""), "metadata", "break", "Title", None, "no title"),
        (F.col("has") & (F.col("raw") != F.trim("raw")), "metadata", "check", "Title", F.col("raw"), "leading or trailing spaces"),
        (F.length("title") > 60, "metadata", "check", "Title", F.col("title"), "over 60 characters"),
        ((F.col("title") != "") & (F.size(F.array_distinct(parts)) < F.size(parts)), "metadata", "check", "Title", F.col("title"), "a part repeats"),
    ])


def heading_findings(pages: DataFrame) -> DataFrame:
    """H1 missing or more than one; a visible heading again, reported once, at its second place."""
    heads = markup.headings(pages).where("not hidden")
    ones = pages.select("page_id").join(heads.where("level = 'h1'").groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left")
    keyed = heads.withColumn("key", F.lower("text")).where("key <> ''")
    again = keyed.withColumn("nth", F.row_number().over(W.partitionBy("page_id", "key").orderBy("ord"))).where("nth = 2")
    return union([
        finding(ones.where("n is null"), "headings", "break", "H1", None, "no H1"),
        finding(ones.where("n > 1"), "headings", "break", "H1", F.col("n"), "more than one H1"),
        finding(again, "headings", "break", "Heading", F.col("text"), "heading repeats"),
    ])


def link_findings(pages: DataFrame, generic: tuple[str, ...] = GENERIC_LINK_TEXT) -> DataFrame:
    """Placeholders; links without a name in text, label, title or image; generic link texts, each once for a text and target."""
    rows = markup.anchors(pages).where(F.col("href").isNotNull() & ~F.trim("href").isin("", "#"))
    rows = rows.withColumn("name", F.trim(F.regexp_replace("text", r"[\s→›»>.…]+$", "")))
    label = F.concat(*[F.coalesce(c, F.lit("")) for c in (T.attr(F.col("tag"), "aria-label"), T.attr(F.col("tag"), "title"), F.col("alt"))])
    vague = rows.withColumn("key", F.lower("name")).where(F.col("key").isin(*generic)).groupBy("page_id", "key", "href").agg(F.min(F.struct("ord", "name")).alias("x"))
    return union([
        finding(markup.links(pages).where("placeholder"), "links", "break", "Link", F.col("text"), "placeholder link"),
        finding(rows.where((F.col("name") == "") & (F.trim(label) == "")), "links", "break", "Link text", F.col("href"), "link without a name"),
        finding(vague, "links", "check", "Link text", F.concat_ws(" -> ", "x.name", "href"), "link text says nothing about its target"),
    ])


def languages(html: Column) -> tuple[Column, Column]:
    """(lang of the page, first data-lang of its markup), null where it has none."""
    page = F.regexp_extract(html, r"(?is)(<html\b[^>]*>)", 1)
    tag = F.regexp_extract(html, r"(?is)(<[a-z][a-z0-9]*\b[^>]*\sdata-lang\s*=[^>]*>)", 1)
    return F.nullif(F.trim(T.attr(page, "lang")), F.lit("")), F.nullif(F.trim(T.attr(tag, "data-lang")), F.lit(""))


def language_mismatch(pages: DataFrame) -> DataFrame:
    """(page_id, lang, path_lang): pages whose language is not that of the first segment of their path."""
    lang = F.lower(F.substring(languages(F.col("html"))[0], 1, 2))
    rows = pages.select("page_id", lang.alias("lang"), F.regexp_extract(U.path_of(F.col("url")), r"^/([a-z]{2})(?:/|$)", 1).alias("path_lang"))
    return rows.where("lang is not null and path_lang <> '' and lang <> path_lang")


def metadata_findings(pages: DataFrame) -> DataFrame:
    """Empty keywords; description missing or outside 70 to 160 characters; two languages declared."""
    lang, other = languages(F.col("html"))
    rows = pages.select("page_id", markup.meta(F.col("html"), "keywords").alias("keywords"), markup.meta(F.col("html"), "description").alias("description"), lang.alias("lang"), other.alias("other"))
    return checks(rows, [
        (F.substring(F.lower("lang"), 1, 2) != F.substring(F.lower("other"), 1, 2), "metadata", "break", "Page language", F.col("other"), "lang and data-lang disagree"),
        ("keywords = ''", "metadata", "check", "Keywords", None, "keywords are empty"),
        ("description is null or description = ''", "metadata", "check", "Description", None, "no description"),
        ("description <> '' and length(description) not between 70 and 160", "metadata", "check", "Description", F.length("description"), "not 70 to 160 characters"),
    ])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit(pages: DataFrame) -> DataFrame:
    """All findings of all rules over ``pages`` (page_id, url, html)."""
    return union([title_findings(pages), heading_findings(pages), link_findings(pages), metadata_findings(pages)])


def tally(findings: DataFrame, *by: str) -> DataFrame:
    """Breaks and checks: every severity but ``check`` is a break."""
    return findings.groupBy(*by).agg(F.count_if(F.col("severity") != "check").alias("breaks"), F.count_if(F.col("severity") == "check").alias("checks"))
