"""Localised copy for English markup: rows of a brief, the row a text stands for, and its markup carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.operators import briefs


def plain_rows(brief_rows: DataFrame) -> DataFrame:
    """(brief_id, row, section, label, english, localised) of briefs without market columns: the last cell is localised, of three or more the one before it English."""
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit("")))
    rows = brief_rows.where(F.size("cells") >= 2)
    return rows.select("brief_id", "row", "section", cell(1).alias("label"), F.when(F.size("cells") >= 3, cell(-2)).otherwise("").alias("english"), cell(-1).alias("localised")).where("label <> '' and localised <> ''")


def localised_row(brief_rows: DataFrame, label: str) -> DataFrame:
    """(brief_id, value): last cell of the first row of three cells or more that opens with ``label`` and ends in copy."""
    last = F.trim(F.try_element_at("cells", F.lit(-1)))
    hits = brief_rows.where((F.size("cells") >= 3) & (F.lower(F.trim(F.get("cells", 0))) == label.strip().lower()) & (last != ""))
    return hits.groupBy("brief_id").agg(F.min_by(last, "row").alias("value"))


def market_gaps(brief_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(brief_id, row, section, label, market): rows with an English text but none for a market; briefs without an English column have none."""
    master = briefs.master_column(headers, brief_rows).where("master is not null")
    rows = brief_rows.join(headers.select("brief_id", F.col("row").alias("head"), "columns"), "brief_id").join(master, "brief_id").where("row <> head")
    cell = lambda i: F.trim(F.coalesce(F.get("cells", i), F.lit("")))
    rows = rows.where((cell(F.lit(0)) != "") & (cell(F.col("master")) != "")).withColumn("c", F.explode("columns"))
    return rows.where(cell(F.col("c.column")) == "").select("brief_id", "row", "section", cell(F.lit(0)).alias("label"), F.col("c.market").alias("market"))


def fill(queries: DataFrame, values: DataFrame) -> DataFrame:
    """(query_id, how, confidence, row, others, html, restored, unplaced): each English text in its localised form.

    ``queries`` is (query_id, brief_id, text) with inline markup in the text, ``values`` (brief_id, row, english,
    localised). The row is that of ``briefs.find_row``; without one nothing is carried.
    """
    found = briefs.find_row(queries, values).join(queries.select("query_id", "brief_id", "text"), "query_id")
    rows = found.join(values.select("brief_id", "row", "localised").dropDuplicates(["brief_id", "row"]), ["brief_id", "row"], "left")
    rows = rows.withColumn("x", briefs.carry_markup("text", "localised"))
    has = F.col("row").isNotNull()
    return rows.select("query_id", "how", "confidence", "row", "others", *[F.when(has, F.col(f"x.{c}")).alias(c) for c in ("html", "restored", "unplaced")])


def suggest_form(markets: DataFrame, registry: DataFrame) -> DataFrame:
    """(brief_id, market, form_id): the form that a brief's market carries; none where the market has several entries or no form.

    A market's own name comes first; a name without its parenthesis fits only where one entry goes by it.
    """
    base = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", "")))
    reg = registry.select(F.lower(F.trim("market")).alias("name"), base(F.col("market")).alias("base"), F.col("market").alias("entry"), "form_id")
    own = reg.withColumn("n", F.count("*").over(W.partitionBy("name"))).where("n = 1").select("name", F.struct("entry", "form_id").alias("own"))
    sole = reg.groupBy("base").agg(F.count("*").alias("n"), F.max(F.struct("entry", "form_id")).alias("sole")).where("n = 1").select("base", "sole")
    asked = markets.select("brief_id", F.lower(F.trim("market")).alias("name"), base(F.col("market")).alias("base"))
    hit = asked.join(own, "name", "left").join(sole, "base", "left").select("brief_id", F.coalesce("own", "sole").alias("x"))
    return hit.where("x.form_id is not null").select("brief_id", F.col("x.entry").alias("market"), F.col("x.form_id").alias("form_id"))
