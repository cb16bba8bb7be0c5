"""Briefs as tables: cells, sections, markets and columns."""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def cells_of(text: str | None) -> list[list[str]]:
    """Rows of tab-separated cells; a quote opens a cell only at its start; rows of blank cells are left out."""
    out, row, cell, quoted, text, i = [], [], [], False, (text or "").replace("\r\n", "\n").replace("\r", "\n"), 0
    while i < len(text):
        c = text[i]
        if quoted and c == '"':
            if text[i + 1 : i + 2] == '"':
                cell.append(c)
                i += 1
            else:
                quoted = False
        elif not quoted and c == '"' and not cell:
            quoted = True
        elif not quoted and c in "\t\n":
            row.append("".join(cell))
            cell = []
            if c == "\n":
                out.append(row)
                row = []
        else:
            cell.append(c)
        i += 1
    out.append([*row, "".join(cell)])
    return [r for r in out if any(x.strip() for x in r)]


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def split_cells(texts: pd.Series) -> pd.Series:
    return texts.map(cells_of)


def rows(briefs: DataFrame) -> DataFrame:
    """(brief_id, row, cells, section): rows from 1; a row of one short cell names the section from it on."""
    r = briefs.select("brief_id", F.posexplode(split_cells("text")).alias("row", "cells")).withColumn("row", F.col("row") + 1)
    filled = F.filter(F.transform("cells", lambda x: F.trim(x)), lambda c: c != "")
    name = F.when((F.size(filled) == 1) & (F.length(filled[0]) <= 60), filled[0])
    return r.withColumn("section", F.last(name, True).over(W.partitionBy("brief_id").orderBy("row").rowsBetween(W.unboundedPreceding, 0)))


def header_rows(brief_rows: DataFrame, markets: list[str]) -> DataFrame:
    """(brief_id, row, columns): the first row with two cells or more that are market names, and where they stand."""
    names = [m.strip().lower() for m in markets]
    cols = F.filter(F.transform("cells", lambda c, i: F.struct(F.lower(F.trim(c)).alias("market"), i.alias("column"))), lambda x: x["market"].isin(*names))
    hits = brief_rows.select("brief_id", "row", cols.alias("columns")).where(F.size("columns") >= 2)
    return hits.groupBy("brief_id").agg(F.min(F.struct("row", "columns")).alias("x")).select("brief_id", "x.row", "x.columns")


def market_values(brief_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(brief_id, row, section, label, market, value, untranslated): the table below the header, a row for each market."""
    below = brief_rows.join(headers.select("brief_id", F.col("row").alias("head"), "columns"), "brief_id").where("row > head")
    first = F.array_min(F.transform("columns", lambda c: c["column"]))
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("cells", i + 1), F.lit("")))
    r = below.withColumn("label", cell(F.lit(0))).withColumn("english", F.when(first > 1, cell(F.lit(1)))).withColumn("c", F.explode("columns"))
    r = r.select("brief_id", "row", "section", "label", F.col("c.market").alias("market"), cell(F.col("c.column")).alias("value"), "english")
    return r.where("label <> '' and value <> ''").withColumn("untranslated", F.coalesce(F.col("value") == F.col("english"), F.lit(False))).drop("english")


def row_quality(values: DataFrame) -> DataFrame:
    """(brief_id, row, kind): rows that lack a market, leave one untranslated, or differ in their numbers."""
    from pagewright.functions.text import numbers_in

    per = values.groupBy("brief_id", "row").agg(F.count("*").alias("n"), F.bool_or("untranslated").alias("u"), F.count_distinct(F.array_join(numbers_in(F.col("value")), " ")).alias("numbers"))
    most = values.groupBy("brief_id").agg(F.count_distinct("market").alias("markets"))
    r = per.join(most, "brief_id").where("markets >= 2")
    kinds = F.filter(F.array(F.when(F.col("n") < F.col("markets"), "ragged"), F.when(F.col("u"), "untranslated"), F.when(F.col("numbers") > 1, "number-mismatch")), lambda k: k.isNotNull())
    return r.select("brief_id", "row", F.explode(kinds).alias("kind"))


# fixed values: labels that name a content field, and words of headers that name a column of copy
FIELD_LABELS = ("headline", "subheading", "title", "body", "meta title", "meta description", "meta keywords", "page name", "url path")
HEADER_WORDS = "(?i)header|title|headline|\\btext\\b|paragraph|description|content|copy"


def is_identifier(cell):
    """A short label: up to 30 characters and four words, no end of a sentence."""
    return (cell != "") & (F.length(cell) <= 30) & (F.size(F.split(cell, r"\s+")) <= 4) & ~cell.rlike(r"[.!?](\s|$)")


def master_column(headers: DataFrame, brief_rows: DataFrame) -> DataFrame:
    """(brief_id, master): the column of the English text: one that says so, else the first named one no market claims; null without."""
    h = brief_rows.join(headers.select("brief_id", "row", "columns"), ["brief_id", "row"])
    claimed = F.transform("columns", lambda c: c["column"])
    free = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), F.trim(c).alias("c"))), lambda x: (x["i"] > 0) & ~F.array_contains(claimed, x["i"]))
    said = F.filter(free, lambda x: x["c"].rlike("(?i)english|master"))
    named = F.filter(free, lambda x: x["c"] != "")
    return h.select("brief_id", F.coalesce(F.try_element_at(said, F.lit(1))["i"], F.try_element_at(named, F.lit(1))["i"]).alias("master"))


def target_market(brief_rows: DataFrame, headers: DataFrame, markets: list[str]) -> DataFrame:
    """(brief_id, market): the first market named above the header row, or anywhere in briefs without one."""
    named = brief_rows.join(headers.select("brief_id", F.col("row").alias("head")), "brief_id", "left").where("head is null or row < head")
    hits = named.select("brief_id", "row", F.posexplode(F.transform("cells", lambda c: F.lower(F.trim(c)))).alias("col", "market")).where(F.col("market").isin(*[m.lower() for m in markets]))
    return hits.groupBy("brief_id").agg(F.min_by("market", F.struct("row", "col")).alias("market"))


def orientation(brief_rows: DataFrame) -> DataFrame:
    """(brief_id, orientation, header): fields-by-market, markets-by-field with its header row, or unknown.

    The first takes two rows of three cells or more that open with a field label. The second takes, below the row with
    most header words, four of five rows that open with a distinct short label and a column of prose on three of five.
    """
    t = brief_rows.where(F.size("cells") >= 3).withColumn("first", F.trim(F.col("cells")[0]))
    label = F.regexp_replace(F.regexp_replace(F.lower("first"), r"\s*\d+\s*$", ""), r"\s*/.*$", "")
    words = F.size(F.filter(F.slice("cells", 2, 1 << 20), lambda c: c.rlike(HEADER_WORDS)))
    t = t.withColumn("label", label.isin(*FIELD_LABELS) | F.col("first").rlike(r"(?i)^cta\b")).withColumn("words", words)
    per = t.groupBy("brief_id").agg(F.count("*").alias("tabular"), F.count_if("label").alias("labels"), F.max_by(F.struct("row", F.size("cells").alias("width")), F.struct("words", -F.col("row"))).alias("h"))
    data = t.join(per.select("brief_id", "h"), "brief_id").where((F.col("row") > F.col("h.row")) & (F.size("cells") >= F.col("h.width")))
    stats = data.groupBy("brief_id").agg(F.count("*").alias("n"), F.count_if(is_identifier(F.col("first"))).alias("ids"), F.count_distinct(F.when(is_identifier(F.col("first")), F.lower("first"))).alias("distinct"))
    prose = data.select("brief_id", F.posexplode(F.slice("cells", F.lit(2), F.col("h.width") - 1)).alias("col", "cell")).groupBy("brief_id", "col").agg((F.count_if(F.length(F.trim("cell")) >= 40) >= F.ceil(F.count("*") * 0.6)).alias("prose"))
    prose = prose.groupBy("brief_id").agg(F.bool_or("prose").alias("prose"))
    fits = (F.col("n") >= 2) & (F.col("ids") >= 0.8 * F.col("n")) & (F.col("distinct") >= 0.8 * F.col("n")) & F.col("prose")
    kind = F.when(F.coalesce("tabular", F.lit(0)) < 2, "unknown").when(F.col("labels") >= 2, "fields-by-market").when(F.coalesce(fits, F.lit(False)), "markets-by-field").otherwise("unknown")
    every = brief_rows.select("brief_id").distinct().join(per, "brief_id", "left").join(stats, "brief_id", "left").join(prose, "brief_id", "left")
    out = every.select("brief_id", kind.alias("orientation"), "h")
    return out.select("brief_id", "orientation", F.when(F.col("orientation") == "markets-by-field", F.col("h.row")).alias("header"))


def unpivot(brief_rows: DataFrame, shapes: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(brief_id, market, role, header, part, text): markets-by-field sheets as rows, cells cut at blank lines.

    ``roles`` maps patterns of headers to section or body; columns that match none have a null role and stay listed.
    """
    sheet = shapes.where("header is not null").select("brief_id", "header")
    heads = brief_rows.join(sheet, "brief_id").where("row = header").select("brief_id", "header", F.col("cells").alias("names"))
    data = brief_rows.join(heads, "brief_id").where("row > header and size(cells) >= size(names)")
    cells = data.select("brief_id", "row", F.trim(F.col("cells")[0]).alias("market"), F.posexplode(F.arrays_zip(F.slice("names", 2, 1 << 20).alias("name"), F.slice("cells", 2, 1 << 20).alias("cell"))).alias("col", "x")).where("x.name is not null")
    role = F.coalesce(*[F.when(F.col("x.name").rlike(rx), F.lit(r)) for rx, r in roles.items()], F.lit(None).cast("string"))
    parts = cells.select("brief_id", "row", "market", F.col("x.name").alias("header"), role.alias("role"), F.posexplode(F.split("x.cell", r"\n\s*\n")).alias("part", "text"))
    return parts.select("brief_id", "row", "market", "role", "header", "part", F.trim("text").alias("text")).where("text <> ''")


def front_matter(brief_rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(brief_id, field, ord, value): the leading run of label rows, by tab or colon; rows of a bullet continue the last label.

    ``fields`` maps labels in lower case to field names, halves of a slashed label count after the whole. Copy ends it: the
    first row that neither opens with a label nor continues one.
    """
    r = _fronted(brief_rows, fields).where("past = 0 and field is not null and value <> ''")
    return r.select("brief_id", "field", "row", "value").withColumn("ord", F.row_number().over(W.partitionBy("brief_id", "field").orderBy("row"))).drop("row")


def _fronted(brief_rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows with their ``line``, the ``field`` and ``value`` of front matter, and ``past``, which is 1 from the first row of copy on."""
    one = F.array_join(F.filter("cells", lambda c: F.trim(c) != ""), "\t")
    r = brief_rows.withColumn("line", one)
    cut = F.regexp_extract("line", r"(?s)^([^\t:]{1,40})[\t:]\s*(.*)$", 1)
    label = F.lower(F.trim(F.coalesce(F.nullif(cut, F.lit("")), "line")))
    names = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.lit(v))])
    half = lambda i: F.try_element_at(names, F.coalesce(F.trim(F.try_element_at(F.split("label", "/"), F.lit(i))), F.lit("")))
    r = r.withColumn("label", label).withColumn("field", F.coalesce(F.try_element_at(names, F.col("label")), half(1), half(2)))
    bullet = F.col("line").rlike(r"^\s*[●•·*-]\s*\t?")
    w = W.partitionBy("brief_id").orderBy("row")
    r = r.withColumn("copy", (F.col("field").isNull() & ~bullet) | F.col("line").rlike(r"\[\d+\.\d+\]"))
    r = r.withColumn("past", F.max(F.col("copy").cast("int")).over(w)).withColumn("field", F.last("field", True).over(w))
    return r.withColumn("value", F.trim(F.regexp_replace(F.regexp_replace("line", r"(?s)^[^\t:●•]{1,40}[\t:]\s*", ""), r"^[●•·*-]\s*\t?", "")))


def paired(brief_values: DataFrame, label_field: str = "cta", link_field: str = "cta link") -> DataFrame:
    """(brief_id, n, label, href): the n-th label with the n-th link; a link that is no address is null."""
    w = W.partitionBy("brief_id").orderBy("row")
    side = lambda f, name: brief_values.where(F.lower("label") == f).select("brief_id", F.row_number().over(w).alias("n"), F.col("value").alias(name))
    both = side(label_field, "text").join(side(link_field, "href"), ["brief_id", "n"], "left")
    return both.select("brief_id", "n", F.col("text").alias("label"), F.when(F.col("href").rlike(r"^(?i)(https?://|/)"), F.col("href")).alias("href"))


#: Least share of words for a closest row; code points by which a text is looked for inside others, of which fewer serve shorter ones.
CLOSE, GRAMS = 0.4, (9, 3, 1)
#: Rows of a brief up to which a query meets all of them.
FEW = 32


def row_candidates(needles: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, brief_id, row): pairs of (query_id, brief_id, needle) and (brief_id, row, english) that may be equal, contained or close, each once; every such pair is among them.

    Contained texts meet by their first GRAMS code points, equi-joined with all windows of that length of the longer text. Close ones meet by a word of the row's prefix: of n words, repeats
    counted, a close text has CLOSE * n at least, so one of any n - ceil(CLOSE * n) + 1 is among its words; the rarest of the brief are taken. Rows of a brief that share neither never meet.
    In briefs of up to FEW rows every query meets every row, which costs less than the windows of their texts.
    """
    from pagewright.functions import text as T

    # a table's size says nothing of its windows and words, so no side may be broadcast by it: all joins sort both sides, and spill
    join = lambda a, b, on, how="inner": a.join(b.hint("merge"), on, how)
    held = rows.groupBy("brief_id").agg(F.count("*").alias("n"))
    few, many = held.where(F.col("n") <= FEW).select("brief_id"), held.where(F.col("n") > FEW).select("brief_id")
    every = join(join(needles, few, "brief_id", "left_semi").select("query_id", "brief_id"), rows.select("brief_id", "row"), "brief_id")
    needles, rows = join(needles, many, "brief_id", "left_semi"), join(rows, many, "brief_id", "left_semi")

    size = lambda c: F.when(F.length(c) >= GRAMS[0], GRAMS[0]).when(F.length(c) >= GRAMS[1], GRAMS[1]).otherwise(GRAMS[2])
    # a window is a string that starts with its length, as lists of strings are made distinct by hashing
    start = lambda c: F.concat(size(c).cast("string"), F.substr(c, F.lit(1), size(c)))

    def windows(c: Column, sizes: tuple[int, ...]) -> Column:
        of = lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - g + 1, F.lit(1))), lambda i: F.concat(F.lit(str(g)), F.substr(c, i, F.lit(g))))
        return F.explode(F.array_distinct(F.concat(*[of(g) for g in sizes])))

    long = rows.where("length(english) > 8")
    asked = needles.select("query_id", "brief_id", start(F.col("needle")).alias("k"))
    inside = join(asked, long.select("brief_id", "row", windows(F.col("english"), GRAMS).alias("k")), ["brief_id", "k"])
    around = join(needles.select("query_id", "brief_id", windows(F.col("needle"), GRAMS[:1]).alias("k")), long.select("brief_id", "row", start(F.col("english")).alias("k")), ["brief_id", "k"])
    equal = join(needles.withColumnRenamed("needle", "english"), rows, ["brief_id", "english"])

    words = lambda c: F.filter(F.split(F.lower(T.normalise(c)), "[^a-z0-9À-ɏ]+"), lambda w: F.length(w) > 2)
    split = rows.select("brief_id", "row", words(F.col("english")).alias("x")).where("size(x) > 0")
    each = split.select("brief_id", "row", F.size("x").alias("n"), F.explode("x").alias("word")).groupBy("brief_id", "row", "n", "word").agg(F.count("*").alias("times"))
    held = each.groupBy("brief_id", "word").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("times").over(W.partitionBy("brief_id", "row").orderBy("rows", "word").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    prefix = join(each, held, ["brief_id", "word"]).withColumn("before", before).where(F.col("before") < F.col("n") - F.ceil(CLOSE * F.col("n") - 1e-9) + 1)
    own = needles.select("query_id", "brief_id", words(F.col("needle")).alias("y")).select("query_id", "brief_id", F.size("y").alias("m"), F.explode(F.array_distinct("y")).alias("word"))
    close = join(own, prefix.select("brief_id", "row", "n", "word"), ["brief_id", "word"]).where(F.col("n") >= CLOSE * F.col("m") - 1e-9)
    pair = ["query_id", "brief_id", "row"]
    return every.select(*pair).unionByName(equal.select(*pair)).unionByName(inside.select(*pair)).unionByName(around.select(*pair)).unionByName(close.select(*pair)).distinct()


def find_row(queries: DataFrame, values: DataFrame) -> DataFrame:
    """(query_id, how, row, confidence, others): the row whose English text is a query's.

    Exact if one is equal, ambiguous if several are; else the longest that contains it or lies in it; else the closest by
    shared words from 0.4 on, with the next three; else none. ``queries`` is (query_id, brief_id, text), ``values``
    (brief_id, row, english); a query meets the rows of its brief that ``row_candidates`` gives, and those are judged exactly.
    """
    from pagewright.functions import text as T

    q = queries.withColumn("needle", T.strip_tags(F.col("text"))).where("needle <> ''")
    rows = values.where("english <> ''").select("brief_id", "row", T.normalise(F.col("english")).alias("english"))
    needles = q.select("query_id", "brief_id", "needle")
    pairs = row_candidates(needles, rows).join(needles.hint("merge"), ["query_id", "brief_id"]).join(rows.hint("merge"), ["brief_id", "row"])
    exact = F.col("english") == F.col("needle")
    within = (F.length("english") > 8) & (F.col("english").contains(F.col("needle")) | F.col("needle").contains(F.col("english")))
    tier = F.when(exact, 3).when(within, 2).otherwise(1)
    score = F.when(exact, F.lit(1.0)).when(within, F.lit(0.9)).otherwise(T.overlap(F.col("english"), F.col("needle")))
    pairs = pairs.withColumn("tier", tier).withColumn("score", score).where((F.col("tier") > 1) | (F.col("score") >= CLOSE))
    w = W.partitionBy("query_id").orderBy(F.desc("tier"), F.when(F.col("tier") == 2, -F.length("english")).otherwise(0), F.desc("score"), "row")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= 4) | (F.col("tier") == 3))
    per = ranked.groupBy("query_id").agg(F.max("tier").alias("tier"), F.count_if(F.col("tier") == 3).alias("exact"), F.min_by("row", "rank").alias("row"), F.max_by("score", -F.col("rank")).alias("score"), F.array_sort(F.collect_list(F.when((F.col("rank") > 1) & (F.col("tier") == 1), F.struct("rank", "row")))).alias("rest"))
    how = F.when(F.col("tier").isNull(), "none").when(F.col("exact") > 1, "ambiguous").when(F.col("tier") == 3, "exact").when(F.col("tier") == 2, "contained").otherwise("closest")
    out = queries.select("query_id").join(per, "query_id", "left").withColumn("how", how)
    others = F.when(F.col("how") == "closest", F.transform("rest", lambda x: x["row"])).otherwise(F.array().cast("array<int>"))
    return out.select("query_id", "how", F.when(F.col("how") != "ambiguous", F.col("row")).alias("row"), F.col("score").alias("confidence"), others.alias("others"))


@F.pandas_udf(StructType([StructField("html", StringType()), StructField("restored", IntegerType()), StructField("unplaced", IntegerType())]))
def carry_markup(english: pd.Series, localised: pd.Series) -> pd.DataFrame:
    """Inline tags of the English markup around the same words of a localised text, each once, the rest escaped.

    A link to anything but http, https or an address without a scheme stays text.
    """

    def one(source: str | None, text: str | None) -> tuple[str, int, int]:
        pieces: list[tuple[str, str | None, str]] = [(text or "", None, "")]
        placed = missed = 0
        for m in re.finditer(r"(?is)<(a|strong|b|em|i)\b([^>]*)>(.*?)</\1>", source or ""):
            words = " ".join(re.sub(r"<[^>]*>", "", html.unescape(m[3])).split())
            if not words:
                continue
            tag = {"b": "strong", "i": "em"}.get(m[1].lower(), m[1].lower())
            href = re.search(r"(?i)href\s*=\s*[\"']?([^\"'\s>]*)", m[2]) if tag == "a" else None
            k = next((k for k, (p, t, _) in enumerate(pieces) if t is None and words in p), None)
            if k is None:
                missed += 1
                continue
            before, after = pieces[k][0].split(words, 1)
            to = html.unescape(href[1]).strip() if href else ""
            if tag == "a" and (to.startswith("//") or re.match(r"(?i)(?!https?://)[a-z][a-z0-9+.\-]*:", to)):
                tag = None
            pieces[k : k + 1] = [(before, None, ""), (words, tag, to), (after, None, "")]
            placed += 1
        esc = lambda s: html.escape(s).replace("&#x27;", "'")
        out = "".join(esc(p) if t is None else f'<a href="{esc(h)}">{esc(p)}</a>' if t == "a" else f"<{t}>{esc(p)}</{t}>" for p, t, h in pieces)
        return out, placed, missed

    return pd.DataFrame([one(a, b) for a, b in zip(english, localised, strict=True)], columns=["html", "restored", "unplaced"])


def platform_of(url: Column, migrated: tuple[str, ...], markers: tuple[str, ...], old: str = "old", new: str = "new") -> Column:
    """The platform of one address, as ``platform_vote`` judges it."""
    from pagewright.functions import urls as U

    host = U.host_of(url)
    moved = reduce(lambda a, b: a | b, [host.endswith(m.lower()) for m in migrated], F.lit(False))
    return F.when(U.is_asset(url, markers), old).when(moved, new).otherwise(old)


def platform_vote(urls: DataFrame, migrated: tuple[str, ...], markers: tuple[str, ...], old: str = "old", new: str = "new") -> DataFrame:
    """(brief_id, platform): the platform all hosts of a brief agree on, Mixed where they don't; briefs without urls have no row.

    An address with a marker is on the old platform; a host that ends in a migrated one is on the new; others on the old.
    """
    votes = urls.select("brief_id", platform_of(F.col("url"), migrated, markers, old, new).alias("v"))
    return votes.groupBy("brief_id").agg(F.when(F.count_distinct("v") > 1, "Mixed").otherwise(F.min("v")).alias("platform"))


def needs(texts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(text_id, have, missing): needs of a text, each met by any of its patterns, in the order of ``rules`` (need, question, pattern)."""
    met: dict[str, list[str]] = {}
    for need, _, pattern in rules:
        met.setdefault(need, []).append(pattern)
    flags = F.array(*[F.struct(F.lit(n).alias("need"), F.coalesce("text", F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)).alias("met")) for n, ps in met.items()])
    pick = lambda want: F.transform(F.filter("flags", lambda x: x["met"] == F.lit(want)), lambda x: x["need"])
    return texts.select("text_id", flags.alias("flags")).select("text_id", pick(True).alias("have"), pick(False).alias("missing"))


def signals(texts: DataFrame) -> DataFrame:
    """(text_id, long_paragraphs, accented, urls, tabular_rows, has_table): structural signs of a brief."""
    c, t = F.col, F.coalesce("text", F.lit(""))
    paras = F.filter(F.split(t, r"\n"), lambda p: F.length(F.trim(p)) >= 200)
    tab = F.filter(F.split(t, r"\n"), lambda p: F.size(F.split(p, "\t")) >= 3)
    return texts.select("text_id", (F.size(paras) >= 3).alias("long_paragraphs"), (F.regexp_count(t, F.lit("[À-ÖØ-öø-ÿ]")) >= 8).alias("accented"), F.regexp_count(t, F.lit(r"https?://")).alias("urls"), F.size(tab).alias("tabular_rows")).withColumn("has_table", c("tabular_rows") >= 3)


# the structural facts that ``structure`` finds
FLAGS = ("site_url", "two_site_urls", "rows_paired", "content_path", "asset", "url_pair_rows", "removal_marks", "sections", "long_body", "translated_rows", "not_english")


def structure(texts: DataFrame, asset_marks: tuple[str, ...], asset_label: str = r"assets\s*[-–]") -> DataFrame:
    """``texts`` with ``site`` and ``assets`` (their addresses) and the boolean columns of ``FLAGS``; null texts count as empty.

    An address with one of ``asset_marks`` is an asset; site addresses that differ in case only count once. A row pairs if a
    line with a site address has two; it marks a removal if a cell is a lone x beside an address.
    """
    from pagewright.functions import urls as U

    t = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(t, r"\r?\n"), lambda x: F.struct(x.alias("line"), F.size(F.array_distinct(F.transform(F.filter(U.urls_in(x), lambda u: ~U.is_asset(u, asset_marks)), lambda u: F.lower(u)))).alias("n")))
    r = texts.withColumn("site", F.filter(U.split_urls(t), lambda u: ~U.is_asset(u, asset_marks))).withColumn("assets", F.filter(U.urls_in(t), lambda u: U.is_asset(u, asset_marks))).withColumn("__lines", lines)
    count = lambda test: F.size(F.filter("__lines", test))
    paired, named = count(lambda x: x["n"] >= 2), count(lambda x: x["n"] >= 1)
    flags = (
        F.size("site") >= 1, F.size("site") >= 2, (named > 0) & (named == paired), t.rlike(r"(?i)/content/[a-z0-9/-]+|(?m)^\s*/[a-z0-9][a-z0-9/-]*/\s*$"),
        (F.size("assets") >= 1) | t.rlike(f"(?i){asset_label}"), paired >= 1, count(lambda x: x["line"].rlike(r"(?i)(^|\t)\s*x\s*(\t|$)") & (x["n"] >= 1)) >= 1,
        F.regexp_count(t, F.lit(r"\[\d+\.\d+\]")) >= 2, count(lambda x: F.length(F.trim(x["line"])) >= 200) >= 3,
        count(lambda x: F.contains(x["line"], F.lit("\t")) & x["line"].rlike("[À-ɏ]")) >= 3, F.regexp_count(t, F.lit("[À-ɏ]")) >= 8,
    )
    return r.select(*texts.columns, "site", "assets", *[f.alias(n) for n, f in zip(FLAGS, flags, strict=True)])


def analyse(briefs: DataFrame, work: dict, markets: dict[str, str]) -> DataFrame:
    """(brief_id, type, score, matched, confident, platform, have, missing, questions, steps, ready): what each brief asks for.

    ``briefs`` is (brief_id, text), ``markets`` names with their domains. ``work`` is configuration: ``terms`` and ``flags``
    (type, term or flag, weight), ``needs`` (type, need, question, pattern, flag; either may be None, rows of one need are
    alternatives), ``steps`` (type, platform, step), ``migrated``, ``markers``, ``assets`` and ``least``. The platform is
    what all site addresses agree on; without any, that of the target market of a brief with a header of markets, else
    Unknown. A brief is ready if it lacks nothing and its platform is certain. Null texts count as empty.
    """
    from pagewright.operators.classify import heaviest, type_scores

    r = rows(briefs)
    heads = header_rows(r, list(markets))
    place = F.create_map(*[F.lit(x) for k, v in markets.items() for x in (k.strip().lower(), v)])
    target = target_market(r, heads, list(markets)).join(heads.select("brief_id", F.lit(True).alias("head")), "brief_id", "left")
    target = target.select("brief_id", F.lit(True).alias("target_named"), F.when(F.col("head"), F.concat(F.lit("https://"), F.try_element_at(place, F.col("market")))).alias("at"))
    s = structure(briefs.withColumn("text", F.coalesce("text", F.lit(""))), work["assets"]).join(target, "brief_id", "left").withColumn("target_named", F.coalesce("target_named", F.lit(False)))
    judge = lambda u: platform_of(u, work["migrated"], work["markers"])
    votes = F.array_distinct(F.transform("site", judge))
    s = s.withColumn("platform", F.when(F.size(votes) > 1, "Mixed").when(F.size(votes) == 1, votes[0]).when(F.col("at").isNotNull(), judge(F.col("at"))).otherwise("Unknown"))
    s = s.withColumn("t", heaviest(type_scores(F.col("text"), work["terms"], work["flags"]), work["least"]))

    def needs_of(kind: str) -> Column:
        met: dict[tuple[str, str], list[Column]] = {}
        for t, need, question, pattern, flag in work["needs"]:
            if t == kind:
                met.setdefault((need, question), []).append(F.col(flag) if flag else F.col("text").rlike(f"(?i){pattern}"))
        one = [F.struct(F.lit(n).alias("need"), F.lit(q).alias("question"), reduce(lambda a, b: a | b, c).alias("met")) for (n, q), c in met.items()]
        return F.array(*one) if one else F.lit(None)

    kinds = list(dict.fromkeys(t for t, *_ in [*work["terms"], *work["flags"]]))
    none = F.array().cast("array<string>")
    steps: dict[tuple[str, str], list[str]] = {}
    for kind, platform, step in work["steps"]:
        steps.setdefault((kind, platform), []).append(step)
    s = s.withColumn("needs", F.coalesce(*[F.when(F.col("t.type") == k, needs_of(k)) for k in kinds]))
    s = s.withColumn("steps", F.coalesce(*[F.when((F.col("t.type") == k) & (F.col("platform") == p), F.array(*map(F.lit, v))) for (k, p), v in steps.items()], none))
    pick = lambda met, field: F.coalesce(F.transform(F.filter("needs", lambda x: x["met"] == F.lit(met)), lambda x: x[field]), none)
    s = s.select("brief_id", "t.*", "platform", pick(True, "need").alias("have"), pick(False, "need").alias("missing"), pick(False, "question").alias("questions"), "steps")
    return s.withColumn("ready", (F.size("missing") == 0) & ~F.col("platform").isin("Unknown", "Mixed"))


# fixed values: labels of rows that hold a page's metadata, its sections and its copy
COLUMN_METADATA = {"meta title": "title", "page name": "pageName", "meta description": "description", "meta keywords": "keywords"}
COLUMN_SECTIONS, COLUMN_BODY = ("headline", "title"), ("subheading", "body")
SHEET_ROLES = {"(?i)header|title|headline": "section", r"(?i)\bbody\b|text|paragraph|description|content|copy": "body"}
FRONT_METADATA = ("title", "pageName", "description", "canonical", "keywords", "market")
ADDRESS = r"^(https?://|/)"


def expected(brief_rows: DataFrame, types: DataFrame, fields: dict[str, str], localised: str, keywords: str, asset_label: str = r"assets\s*[-–]") -> DataFrame:
    """(brief_id, mode, part, field, text, href, section, row): what a brief says its page must carry, read by its work type.

    ``types`` is (brief_id, type). Briefs of type ``localised`` are sheets with a row for each market, sheets with a row for each
    field (the last cell counts, the n-th call to action has the n-th address), or prose, of which lines of 40 characters or more
    are copy. Those of type ``keywords`` name keywords in the last cell of the first row that opens with an address. All others are
    front matter, labelled by ``fields``, then lines: a number in brackets at the end marks a section, ``asset_label`` an image.
    """
    from pagewright.functions import text as T

    r = brief_rows.join(types.select("brief_id", "type"), "brief_id")
    null = F.lit(None).cast("string")

    def say(d: DataFrame, mode: str, part, text, field=null, href=null, section=null) -> DataFrame:
        part = F.lit(part) if isinstance(part, str) else part
        return d.select("brief_id", F.lit(mode).alias("mode"), part.alias("part"), field.alias("field"), text.alias("text"), href.alias("href"), section.alias("section"), F.col("row").cast("int").alias("row"))

    local = r.where(F.col("type") == localised)
    shape = orientation(local.select("brief_id", "row", "cells"))
    sheets = unpivot(local.select("brief_id", "row", "cells"), shape, SHEET_ROLES).where("role is not null")
    size = local.groupBy("brief_id").agg(F.count_if(F.size("cells") >= 3).alias("tabular")).join(shape.where("orientation = 'markets-by-field'"), "brief_id", "left_anti")
    rest = local.join(size, "brief_id")
    line = F.trim(F.array_join("cells", " "))
    prose = rest.where((F.col("tabular") < 2) & (F.length(line) >= 40))

    c = rest.where("tabular >= 2 and size(cells) >= 3").withColumn("key", F.lower(T.normalise(F.col("cells")[0]))).withColumn("last", F.trim(F.element_at("cells", -1))).where("last <> ''")
    names = F.create_map(*[F.lit(x) for kv in COLUMN_METADATA.items() for x in kv])
    meta = c.where(F.col("key").isin(*COLUMN_METADATA)).groupBy("brief_id", names[F.col("key")].alias("name")).agg(F.min_by("last", "row").alias("last"), F.min("row").alias("row"))
    copy = c.where(F.col("key").isin(*COLUMN_SECTIONS, *COLUMN_BODY))
    cta = c.where(F.col("key").rlike(r"^cta\b")).withColumn("is_link", F.contains("key", F.lit("link"))).withColumn("n", F.row_number().over(W.partitionBy("brief_id", "is_link").orderBy("row")))
    to = cta.where("is_link").select("brief_id", "n", F.col("last").alias("to"))
    cta = cta.where("not is_link").join(to, ["brief_id", "n"], "left")

    k = r.where((F.col("type") == keywords) & (F.size("cells") >= 2) & F.trim(F.col("cells")[0]).rlike("(?i)^https?://"))
    k = k.groupBy("brief_id").agg(F.min_by(F.trim(F.element_at("cells", -1)), "row").alias("last"), F.min("row").alias("row"))

    f = _fronted(r.where(~F.col("type").isin(localised, keywords)).select("brief_id", "row", "cells"), fields)
    front = f.where("past = 0 and field is not null and value <> ''")
    inside = front.where(F.col("field").isin(*FRONT_METADATA)).groupBy("brief_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]), ", ").alias("text"), F.min("row").alias("row"))
    own = front.where(~F.col("field").isin(*FRONT_METADATA))
    kind = F.when(F.col("field") == "topic", "section").when(F.col("field") == "image", "image").when(F.col("field") == "links", "link").otherwise("front")
    body = f.where("past = 1").withColumn("line", F.trim(F.array_join("cells", "\t")))
    head, image = F.regexp_extract("line", r"^(.+?)\s*\[\d+\.\d+\]$", 1), F.regexp_extract("line", rf"(?i)^(?:hero\s*:\s*)?(?:\w+ )?{asset_label}\s*(.+)$", 1)
    what = F.when(head != "", F.struct(F.lit("section").alias("part"), head.alias("text"))).when(image != "", F.struct(F.lit("image").alias("part"), image.alias("text"))).when(F.length("line") >= 40, F.struct(F.lit("body").alias("part"), F.col("line").alias("text")))
    body = body.withColumn("x", what).where("x is not null")
    return reduce(DataFrame.union, [
        say(sheets, "markets-by-field", F.col("role"), F.col("text"), section=F.col("market")),
        say(prose, "prose", "body", line),
        say(meta, "columns", "metadata", F.col("last"), F.col("name")),
        say(copy, "columns", F.when(F.col("key").isin(*COLUMN_SECTIONS), "section").otherwise("body"), F.col("last"), section=F.col("section")),
        say(cta, "columns", "link", F.col("last"), href=F.when(F.col("to").rlike(ADDRESS), F.col("to")), section=F.col("section")),
        say(k, "columns", "metadata", F.col("last"), F.lit("keywords")),
        say(inside, "labelled", "metadata", F.col("text"), F.col("field")),
        say(own, "labelled", kind, F.col("value"), F.when(kind == "front", F.col("field")), F.when((kind == "link") & F.col("value").rlike(ADDRESS), F.col("value"))),
        say(body, "labelled", F.col("x.part"), F.col("x.text")),
    ])
