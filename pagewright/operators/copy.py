"""Copy that briefs want against the text of their pages, with a fallback to sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import diff
from pagewright.operators.rules import finding


def ledger(wants: DataFrame, texts: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(page_id, ord, section, text, status, found, page_count, parts, absent, place): every wanted row of copy in brief order.

    ``wants`` is (page_id, ord, section, text), ``texts`` (page_id, text) and ``modules`` (page_id, ord, name, nth, body).
    A row is found where the page's text holds it, whole or as all its sentences; partial where some sentences are
    there, else missing. ``place`` is the first component that holds the row or its first found sentence. Rows equal
    but for case share the verdict of the first. An odd quotation mark is dropped. Both sides meet by page only.
    """
    rows = wants.select("page_id", "ord", "section", T.normalise(T.unwrap_quotes(F.col("text"))).alias("text")).where("text <> ''").withColumn("key", F.lower("text"))
    groups = rows.groupBy("page_id", "key").agg(F.min_by("text", "ord").alias("need"))
    page = texts.select("page_id", T.normalise(F.col("text")).alias("page"))
    met = groups.join(page, "page_id", "left").withColumn("page", F.coalesce("page", F.lit(""))).withColumn("n", T.occurrences(F.col("page"), F.col("need")))
    met = met.withColumn("parts", F.when(F.col("n") == 0, T.sentences(F.col("need"))).otherwise(F.array().cast("array<string>")))
    met = met.withColumn("absent", F.filter("parts", lambda s: ~F.contains(F.col("page"), T.normalise(s))))
    parts, absent = F.size("parts"), F.size("absent")
    status = F.when(F.col("n") > 0, "found").when((parts > 0) & (absent == 0), "found").when(absent < parts, "partial").otherwise("missing")
    count = F.when(F.col("n") > 0, F.col("n")).when((parts > 0) & (absent == 0), 1).otherwise(0)
    there = F.get(F.array_except("parts", "absent"), 0)
    needle = F.when(F.col("n") > 0, F.col("need")).when(there.isNotNull(), T.normalise(there))
    out = met.select("page_id", "key", status.alias("status"), count.cast("long").alias("page_count"), "parts", "absent", needle.alias("needle"))
    if modules is None:
        out = out.withColumn("place", F.lit(None).cast("string"))
    else:
        held = modules.select("page_id", F.col("ord").alias("m"), F.concat_ws(" #", "name", "nth").alias("label"), T.strip_tags(F.col("body")).alias("held"))
        hit = out.where("needle is not null").join(held, "page_id").where(F.contains("held", "needle")).groupBy("page_id", "key").agg(F.min_by("label", "m").alias("place"))
        out = out.join(hit, ["page_id", "key"], "left")
    return rows.join(out, ["page_id", "key"]).select("page_id", "ord", "section", "text", "status", "page_count", F.size("parts").alias("parts"), "absent", "place")


def bracketed(rows: DataFrame) -> DataFrame:
    """``rows`` of a ledger with the places before and after each missing one; null for the others."""
    near = diff.bracket(rows, "page_id", "ord", "place")
    gone = F.col("status") == "missing"
    return near.withColumn("before", F.when(gone, F.col("before"))).withColumn("after", F.when(gone, F.col("after")))


def copy_findings(rows: DataFrame) -> DataFrame:
    """One finding for each missing row, and for each sentence that a partial row lacks."""
    lost = rows.where("status = 'missing'")
    some = rows.where("status = 'partial'").select("page_id", F.explode("absent").alias("text"))
    return finding(lost, "body", "break", "Copy", F.col("text"), "copy isn't on the page").unionByName(finding(some, "body", "break", "Copy", F.col("text"), "sentence isn't on the page"))


def suspect(coverage: DataFrame, least: int = 8, share: float = 0.9) -> DataFrame:
    """``coverage`` (.., total, found) with ``suspect``: so much is missing that the brief was likely read wrongly."""
    return coverage.withColumn("suspect", (F.col("total") >= least) & ((F.col("total") - F.col("found")) / F.col("total") >= share))
