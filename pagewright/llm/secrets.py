"""Secret scans with corpus-wide ownership counts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import written

#: Kinds in the order that breaks ties; (pattern, group that holds the value, least length of the value).
KINDS = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "token": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: A value in the hands of so many owners is a copied example, or of two owners in so many repositories; others look live.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 4


SPAN = "struct<s:int,k:int,e:int,v:bigint>"


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind number, gap, length, value hash, keep) of the matches of one kind, leftmost first; null without any.

    A gap is the length of the text between a match and the one before it, so that a running sum gives the offsets.
    """
    pattern, group, least = KINDS[kind]
    # \G ties each match to the end of the last one, so the text before a match is a group and the tail is read once
    step = rf"(?s)\G(.*?)({pattern})"
    value_group = 2 if group == 0 else 2 + group
    gaps, hits = F.regexp_extract_all(text, F.lit(step), F.lit(1)), F.regexp_extract_all(text, F.lit(step), F.lit(2))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(step), F.lit(value_group))
    sizes = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))

    def one(x, v):
        keep = F.length(v) >= least
        if kind == "token":
            keep = keep & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
        return F.struct(F.lit(list(KINDS).index(kind)).alias("k"), x["g"].alias("g"), x["h"].alias("h"), F.xxhash64(v).alias("v"), keep.alias("keep"))

    return F.when(text.rlike(pattern), F.zip_with(sizes, values, one))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, id, owner, repo), and their spans (uid, owner, repo, s, k, e, v) by regular expressions.

    Only matches leave the scan. Offsets are running sums over the matches of a row and kind, so a text with very many
    matches costs time in proportion to them. Long tokens that overlap a span of another kind are left out: in order of
    start, none of those before may end behind a token's start, and the next one may not start before its end.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(owner_col, F.lit(""))).alias("owner"), F.xxhash64(*repo_cols).alias("repo"),
        *[_matches(text, k).alias(f"m_{k}") for k in KINDS],
    ))
    none = F.array().cast(rows.schema["m_assign"].dataType.simpleString())
    hit = rows.where(" or ".join(f"m_{k} is not null" for k in KINDS))
    one = hit.select("uid", "owner", "repo", F.posexplode(F.concat(*[F.coalesce(F.col(f"m_{k}"), none) for k in KINDS])).alias("nth", "x"))
    along = W.partitionBy("uid", "x.k").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    spans = one.withColumn("e", F.sum(F.col("x.g") + F.col("x.h")).over(along).cast("int")).where("x.keep")
    spans = spans.select("uid", "owner", "repo", (F.col("e") - F.col("x.h")).alias("s"), "x.k", "e", "x.v")
    base_s, base_e = (F.when(F.col("k") < len(BASE), F.col(c)) for c in "se")
    # both frames grow from the start of their order; a frame that shrinks to the end would be summed anew for every row
    ahead, back = (W.partitionBy("uid").orderBy(*by).rowsBetween(W.unboundedPreceding, -1) for by in (("s", "k", "e"), (F.desc("s"), F.desc("k"), F.desc("e"))))
    spans = spans.withColumn("reach", F.max(base_e).over(ahead)).withColumn("next", F.last(base_s, True).over(back))
    clear = (F.col("k") < len(BASE)) | (~F.coalesce(F.col("reach") > F.col("s"), F.lit(False)) & ~F.coalesce(F.col("next") < F.col("e"), F.lit(False)))
    return rows.select("uid", "id", "owner", "repo"), written(spans.where(clear).drop("reach", "next"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(uid, id, base, added, n_live, n_example): base spans and those that ownership adds, for each row of ``docs``.

    Candidate values are hashed and counted over the whole corpus by distinct repositories and owners, in three
    aggregations that combine before each shuffle. A value of EXAMPLE_OWNERS owners, or of two owners in EXAMPLE_REPOS
    repositories, is a copied example; others look live, and long mixed tokens that look live are added to the spans. Null
    texts count as empty; a null owner is an owner. Repeated rows each give a row. An empty table gives an empty result.
    """
    rows, spans = candidates(docs, id_col, text_col, owner_col, repo_cols)
    owned = spans.groupBy("v", "owner", "repo").agg(F.count("*").alias("n")).groupBy("v", "owner").agg(F.count("*").alias("repos"))
    owned = owned.groupBy("v").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") >= 2) & (F.col("repos") >= EXAMPLE_REPOS))
    x = F.struct("s", "k", "e", "v")
    # a value of very many rows is one key of this join, which adaptive execution splits, as the grouping after it shuffles anyway
    judged = spans.join(owned.select("v", example.alias("example")), "v").groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when(F.col("k") < len(BASE), x))).alias("base"), F.array_sort(F.collect_list(F.when(~F.col("example") & (F.col("k") >= len(BASE)), x))).alias("added"),
        F.count_if(~F.col("example")).alias("n_live"), F.count_if("example").alias("n_example"))
    none = F.array().cast(f"array<{SPAN}>")
    return rows.join(judged, "uid", "left").select("uid", "id", *[F.coalesce(c, none).alias(c) for c in ("base", "added")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example")])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, **names) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans and all spans of each document."""
    found = scan(docs, **names)
    many = lambda k: F.size(F.filter("base", lambda x: x["k"] == list(KINDS).index(k))).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias(names.get("id_col", "doc_id")), *map(many, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_example")


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` with every base span and every added span of a text replaced by ``mark``; other rows stay as they are.

    Spans belong to a text by its 64-bit hash, so rows that repeat an id each get those of their own text, and rows of one text
    those found for any of them. Overlapping spans become one mark. Null texts stay null; other columns of any name pass through.
    """
    found = scan(docs.select(F.xxhash64(text_col).alias("th"), text_col, *{names.get("owner_col", "source"), *names.get("repo_cols", ("source", "lang"))} - {text_col}), id_col="th", text_col=text_col, **names)
    spans = found.where("size(base) + size(added) > 0").select(F.col("id").alias("th"), F.explode(F.concat("base", "added")).alias("x")).select("th", "x.s", "x.e").distinct()
    order = W.partitionBy("th").orderBy("s", "e")
    spans = spans.withColumn("reach", F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.count_if(F.coalesce(F.col("reach") <= F.col("s"), F.lit(True))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("th", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    cuts = spans.groupBy("th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("cuts"))
    t = F.col(f"d.`{text_col}`")

    def kept(points):
        """The texts between the cuts, of a text as four bytes a code point, so that a piece is found without reading up to it."""
        starts = F.concat(F.array(F.lit(0)), F.transform("c.cuts", lambda x: x["e"]))
        ends = F.concat(F.transform("c.cuts", lambda x: x["s"]), F.array((F.length(points) / 4).cast("int")))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: F.decode(F.substr(points, 4 * a + 1, 4 * (b - a)), "UTF-32")), mark)

    clean = F.when(F.col("c.cuts").isNull(), t).otherwise(F.transform(F.array(F.encode(t, "UTF-32")), kept)[0])
    rows = docs.alias("d").join(cuts.alias("c"), F.xxhash64(t) == F.col("c.th"), "left")
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
