"""Expected against found content, as bags, ledgers and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_wants(wants: DataFrame, *by: str) -> DataFrame:
    """(by..., key, text, wanted): wants that differ in case only are one; the first stands for them."""
    return wants.withColumn("key", F.lower("text")).groupBy(*by, "key").agg(F.min_by("text", "ord").alias("text"), F.count("*").alias("wanted"))


def bag_difference(wants: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """(by..., key, wanted, found, missing, severity): fewer than wanted is a break, more a check, as many none."""
    a = wants.groupBy(*by, F.lower("text").alias("key")).agg(F.count("*").alias("wanted"))
    b = found.groupBy(*by, F.lower("text").alias("key")).agg(F.count("*").alias("found"))
    both = a.join(b, [*by, "key"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    severity = F.when(F.col("found") < F.col("wanted"), "break").when(F.col("found") > F.col("wanted"), "check")
    return both.withColumn("missing", F.greatest(F.col("wanted") - F.col("found"), F.lit(0))).withColumn("severity", severity)


def coverage(diff: DataFrame, *by: str) -> DataFrame:
    """(by..., total, found, missing, complete)."""
    sums = diff.groupBy(*by).agg(F.sum("wanted").alias("total"), F.sum("missing").alias("missing"))
    return sums.withColumn("found", F.greatest(F.col("total") - F.col("missing"), F.lit(0))).withColumn("complete", F.col("missing") == 0)


def bracket(ledger: DataFrame, by: str, ord_col: str, located: str) -> DataFrame:
    """``ledger`` with the nearest located rows before and after each row."""
    before, after = (W.partitionBy(by).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (ord_col, F.desc(ord_col)))
    return ledger.withColumn("before", F.last(located, True).over(before)).withColumn("after", F.last(located, True).over(after))


def out_of_order(rows: DataFrame, by: str, ord_col: str, pos: str) -> DataFrame:
    """Rows whose position is before that of an earlier one; absent positions don't count."""
    w = W.partitionBy(by).orderBy(ord_col).rowsBetween(W.unboundedPreceding, -1)
    return rows.where(F.col(pos).isNotNull()).withColumn("reached", F.max(pos).over(w)).where(F.col(pos) < F.col("reached"))


def forward_fill(rows: DataFrame, by: str, ord_col: str, value) -> DataFrame:
    """``rows`` with the last non-null ``value`` up to each as ``section``."""
    w = W.partitionBy(by).orderBy(ord_col).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(value, True).over(w))


def runs(rows: DataFrame, by: str, ord_col: str, kind: str) -> DataFrame:
    """(by, kind, first, last, n): maximal runs of neighbouring rows of one kind."""
    w, k = W.partitionBy(by).orderBy(ord_col), W.partitionBy(by, kind).orderBy(ord_col)
    marked = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(k))
    return marked.groupBy(by, kind, "island").agg(F.min(ord_col).alias("first"), F.max(ord_col).alias("last"), F.count("*").alias("n")).drop("island")
