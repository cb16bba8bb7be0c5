"""Mixing sources to target weights by Efraimidis-Spirakis keys. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import written

#: Words are runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that one bucket of keys is expected to hold at most, or ten times the root of their number if that is
#: more, so that neither a bucket nor the list of buckets grows in proportion; only the bucket of a source's cut is sorted.
BUCKET_ROWS = 4_000
#: Least weight of a document.
LEAST = 0.25


def text_quality(text: Column) -> Column:
    """Weight from LEAST to 1, of column functions: the product of how little of the text is markers of junk, how much of it is
    letters and space, and how many of its lines are no repeats. Pass the scores of a classifier as ``quality`` to use those."""
    size = F.greatest(F.length(text), F.lit(1))
    marks = F.regexp_count(text, F.lit(r"[#$%&*|!]")) / size
    prose = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / size
    lines = F.split(text, "\n")
    fresh = F.size(F.array_distinct(lines)) / F.size(lines)
    return F.coalesce(F.greatest(F.lit(LEAST), (1 - 4 * marks) * F.least(F.lit(1.0), prose + 0.1) * fresh), F.lit(LEAST))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Add ``target`` to one row a source (skey, source, source_size): its share of all words, capped at ``max_epochs`` times its size.

    Sources by code point, null last, take ``weights`` in turn. Filling by order of size over weight finds the level at
    which no more sources are capped. One row a source goes through this window, however many documents there are.
    """
    every, order = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("nth", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.partitionBy(F.lit(0)).orderBy("ratio", "nth").rowsBetween(W.unboundedPreceding, -1)
    capped, gone = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(every) - capped) / (F.sum("weight").over(every) - gone))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))).over(every)["level"]
    return s.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).drop("nth", "cap", "ratio", "level")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, quality: Column | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words that the mix takes of each document, repeats counted.

    A source is taken whole as often as its target allows; the rest goes to documents by their exponential key
    -ln(u) / weight, least first, until the words are spent, the last one in part. That is the order of u^(1/weight). u is a
    hash of the id (of the text where it is null), so reruns agree. ``quality`` is a weight from above 0 to 1; weights below LEAST
    or null count as LEAST, those over 1 as 1. Keys fall in buckets of equal width: as an exponential key is nowhere denser than its weight,
    no bucket is expected to hold over BUCKET_ROWS documents (or ten times the root of their number), whatever the weights. Whole buckets are taken or left by
    their sums, and only the bucket of the cut is sorted, so a source with a third of all rows costs no large sort. Null texts and texts of white space have size 0 and give 0 words; a null
    source is a source of its own, the last. Repeated rows count each. An empty table gives an empty result.
    """
    text = F.col(text_col)
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\n"), F.xxhash64(text).cast("string")))
    u = (F.xxhash64(named, F.lit(seed)).bitwiseAND((1 << 52) - 1) + F.lit(0.5)) / float(1 << 52)
    weight = F.least(F.lit(1.0), F.greatest(F.lit(LEAST), F.coalesce(text_quality(text) if quality is None else F.nanvl(quality.cast("double"), F.lit(LEAST)), F.lit(LEAST))))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("skey"), size.alias("size"),
        (-F.log(u) / weight).alias("r"), F.xxhash64(text).alias("tie"),
    )
    base = written(base)
    sums = base.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = written(targets(sums.withColumn("source", F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30))), weights, max_epochs).drop("source"))
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))
    sources = sources.withColumn("buckets", F.ceil(F.col("n") / F.greatest(F.lit(BUCKET_ROWS), 10 * F.sqrt("n"))))
    rows = base.join(sources.select("skey", "source_size", "target", "epochs", "rest", "buckets"), "skey")
    rows = rows.withColumn("bucket", F.floor(F.col("r") * F.col("buckets")))
    by = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("in_bucket"))
    above = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("before", F.coalesce(F.sum("in_bucket").over(above), F.lit(0)))
    rows = rows.join(by, ["skey", "bucket"]).withColumn("left", F.col("rest") - F.col("before"))
    cut = (F.col("left") > 0) & (F.col("left") < F.col("in_bucket"))
    earlier = W.partitionBy("skey", "bucket").orderBy("r", "id", "tie").rowsBetween(W.unboundedPreceding, -1)
    part = rows.where(cut).withColumn("left", F.col("left") - F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    part = part.withColumn("extra", F.greatest(F.lit(0), F.least("left", "size")))
    whole = rows.where(~cut).withColumn("extra", F.when(F.col("left") > 0, F.col("size")).otherwise(0))
    done = whole.select(part.columns).union(part)
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Rows of ``docs`` once for each time the mix takes words of them; the row of a source's cut is taken whole.

    Rows that repeat an id are taken as often as the one of them that is taken most. Columns of any name pass through.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).where("taken > 0")
    times = taken.groupBy(F.col(id_col).alias("id")).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times")).alias("t")
    rows = docs.alias("d").join(times, F.col(f"d.`{id_col}`").eqNullSafe(F.col("t.id")))
    each = rows.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"), F.explode(F.sequence(F.lit(1), F.col("t.times"))).alias("nth"))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns])
