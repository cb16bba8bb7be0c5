"""Tables, sitemaps, robots files, URL lists and uploads as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sitemap_urls(texts: DataFrame) -> DataFrame:
    """(site, url, ord) of sitemap texts: every loc; without one, words that don't start with #. Only http(s), first of equals."""
    loc = F.regexp_extract_all("text", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    lines = F.filter(F.split("text", r"\n"), lambda x: ~F.trim(x).startswith("#"))
    found = F.when(F.size(loc) > 0, loc).otherwise(F.split(F.array_join(lines, " "), r"\s+"))
    urls = F.array_distinct(F.filter(F.transform(found, lambda u: F.replace(F.trim(u), F.lit("&amp;"), F.lit("&"))), lambda u: u.rlike(r"(?i)^https?://")))
    return texts.select("site", F.posexplode(urls).alias("ord", "url")).select("site", "url", "ord")


def sitemap_files(texts: DataFrame) -> DataFrame:
    """(file, url, is_index) of sitemap texts (file, text): their addresses, and whether the file lists further sitemaps; what ``crawl.sitemap_walk`` reads."""
    flags = texts.select("file", F.col("text").rlike(r"(?i)<(?:\w+:)?sitemapindex\b").alias("is_index"))
    urls = sitemap_urls(texts.select(F.col("file").alias("site"), "text")).select(F.col("site").alias("file"), "url")
    return urls.join(flags, "file").select("file", "url", "is_index")


def robots_sitemaps(texts: DataFrame) -> DataFrame:
    """(host, url, ord) of the Sitemap lines of robots files (host, text), whichever group they stand in; first of equals."""
    rows = texts.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line"))
    url = F.trim(F.regexp_extract(F.regexp_replace("line", r"\s#.*$", ""), r"(?i)^\s*sitemap\s*:\s*(\S+)", 1))
    return rows.select("host", url.alias("url"), "ord").where("url <> ''").groupBy("host", "url").agg(F.min("ord").alias("ord"))


def robots_rules(texts: DataFrame) -> DataFrame:
    """(host, allow, path, ord) of the groups that name every agent; an agent line after a rule opens a new group."""
    line = F.trim(F.regexp_replace("line", r"#.*$", ""))
    rows = texts.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line")).select("host", "ord", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"), F.trim(F.regexp_replace(line, r"^[^:]*:?", "")).alias("value"))
    rows = rows.where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy("host").orderBy("ord")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("group", F.sum(opens.cast("int")).over(w))
    every = F.bool_or((F.col("field") == "user-agent") & (F.col("value") == "*")).over(W.partitionBy("host", "group"))
    return rows.withColumn("every", every).where("every and field <> 'user-agent' and value <> ''").select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"), "ord")


def url_list(lines: DataFrame) -> DataFrame:
    """(line_no, url, form_id) of a crawl list: an address, then perhaps an id after a comma, semicolon or tab; first of equals."""
    parts = F.split(F.trim("line"), r"\s*[,;\t]\s*")
    rows = lines.select("line_no", parts[0].alias("url"), F.nullif(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), F.lit("")).alias("form_id")).where("url <> '' and lower(url) <> 'url'")
    return rows.groupBy("url").agg(F.min(F.struct("line_no", "form_id")).alias("x")).select("x.line_no", "url", "x.form_id")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(content: bytes) -> str:
    """Loose paragraphs, then tables as tab-separated rows."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    line = lambda p: "".join("\t" if e.tag == f"{_W}tab" else e.text or "" for e in p.iter() if e.tag in (f"{_W}t", f"{_W}tab"))
    loose = [line(p) for p in body.findall(f"{_W}p")]
    tables = ["\t".join(" ".join(line(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")) for t in body.iter(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return "\n".join([*loose, *tables])


def xlsx_text(content: bytes) -> str:
    """The first worksheet by name, as tab-separated rows; gaps are empty cells, cells with tabs, breaks or quotes are quoted."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    out = []
    for row in ElementTree.fromstring(z.read(names[0])).iter(f"{_S}row"):
        cells: list[str] = []
        for c in row.findall(f"{_S}c"):
            at = 0
            for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                at = at * 26 + ord(ch) - 64
            value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if (v := c.find(f"{_S}v")) is not None else ""
            cells += [""] * (at - 1 - len(cells))
            cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
        out.append("\t".join('"' + c.replace('"', '""') + '"' if re.search(r'[\t\n"]', c) else c for c in cells))
    return "\n".join(out)


def uploads(files: DataFrame) -> DataFrame:
    """(path, text, error) of a binaryFile table: docx and xlsx are read, csv cells parted at every comma and joined by tabs, other texts kept.

    Old binary doc and xls give an error instead of a text; other endings give neither.
    """

    @F.pandas_udf("string")
    def read(path: pd.Series, content: pd.Series) -> pd.Series:
        def one(p, c):
            low = p.lower()
            if low.endswith(".docx"):
                return docx_text(c)
            if low.endswith(".xlsx"):
                return xlsx_text(c)
            return c.decode("utf-8", "replace") if low.endswith((".txt", ".md", ".csv", ".tsv", ".html", ".xml")) else None

        return pd.Series([one(p, bytes(c)) for p, c in zip(path, content, strict=True)])

    cells = lambda line: F.array_join(F.transform(F.split(line, ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', ""))), "\t")
    rows = files.select("path", read("path", "content").alias("text"))
    table_text = F.array_join(F.transform(F.split("text", "\r?\n"), cells), "\n")
    old = F.lower("path").rlike(r"\.(doc|xls)$")
    return rows.select("path", F.when(F.lower("path").endswith(".csv"), table_text).otherwise(F.col("text")).alias("text"), F.when(old, "old binary format; save it as docx or xlsx").alias("error"))
