"""Roll-ups, filters and link checks over crawl results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T

#: Load and first-byte times over which a page is slow, and hops over which it redirects too often.
SLOW_MS, SLOW_TTFB_MS, MAX_REDIRECTS = 3000, 800, 3


def filters() -> dict[str, Column]:
    """The nine views of a crawl table; a missing value is in none of them."""
    c = F.col
    views = {
        "all": F.lit(True), "dead": c("verdict") == "dead", "unverified": c("verdict").isin("unverified", "refused"), "breaks": c("breaks") > 0,
        "title": c("title_format").isin("red", "amber"), "form": c("form_id").isin("differs", "missing") | (c("form_market") == "fix"),
        "redirects": c("loop") | (c("redirects") > MAX_REDIRECTS), "slow": (c("load_ms") > SLOW_MS) | (c("ttfb_ms") > SLOW_TTFB_MS), "links": c("broken_links") > 0,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in views.items()}


def filter_counts(rows: DataFrame) -> DataFrame:
    """One row: how many rows each view holds."""
    return rows.agg(*[F.count_if(v).alias(k) for k, v in filters().items()])


def rollup(rows: DataFrame, by: str = "site") -> DataFrame:
    """Pages, verdicts and findings of each site; every verdict but ok and dead counts as unverified."""
    v = F.coalesce("verdict", F.lit(""))
    return rows.groupBy(by).agg(F.count("*").alias("pages"), F.count_if(v == "ok").alias("ok"), F.count_if(v == "dead").alias("dead"), F.count_if(~v.isin("ok", "dead")).alias("unverified"), F.sum("breaks").alias("breaks"), F.sum("checks").alias("checks"))


def page_limit(pages: DataFrame, site: str, ord_col: str, limit: int) -> DataFrame:
    """The first ``limit`` pages of each site; 0 keeps all."""
    if not limit:
        return pages
    ranked = pages.select(F.struct(*pages.columns).alias("row"), F.row_number().over(W.partitionBy(site).orderBy(ord_col)).alias("n"))
    return ranked.where(F.col("n") <= limit).select("row.*")


def redirect_verdicts(fetches: DataFrame) -> DataFrame:
    """(url, hops, loop, severity): a loop or over three hops breaks, two or three need a look. ``redirects`` is an array of (url, to)."""
    hops = F.size("redirects")
    seen = F.transform("redirects", lambda r, i: F.array_contains(F.transform(F.slice("redirects", 1, i + 1), lambda x: x["url"]), r["to"]))
    rows = fetches.select("url", hops.alias("hops"), F.exists(seen, lambda x: x).alias("loop"))
    return rows.withColumn("severity", F.when(F.col("loop") | (F.col("hops") > MAX_REDIRECTS), "break").when(F.col("hops") >= 2, "check"))


def broken_links(edges: DataFrame, statuses: DataFrame, shown: int = 3) -> DataFrame:
    """(dst, verdict, pages, examples): targets that don't answer and the first pages that link to them."""
    bad = edges.join(statuses.where("verdict <> 'ok'"), "dst")
    firsts = bad.select("dst", "verdict", "page_id").distinct().withColumn("n", F.row_number().over(W.partitionBy("dst").orderBy("page_id")))
    return firsts.groupBy("dst", "verdict").agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.col("page_id")))), ",").alias("examples"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """(value) lines of CSV: every cell quoted, formulas defused, a carriage return before each line's end."""
    return rows.select(F.concat(F.concat_ws(",", *[T.csv_cell(F.col(f"`{c}`")) for c in rows.columns]), F.lit("\r")).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV parts of ``csv_lines``, each with a byte order mark and the header, written by the tasks that hold the rows."""
    head = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns) + "\r"

    def headed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    csv_lines(rows).mapInArrow(headed, "value string").write.text(path)


def sitemap_walk(files: DataFrame, roots: list[str], depth: int = 2, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """((url, level), (partial)): pages reached from ``roots`` over ``files`` (file, url, is_index), an index at most ``depth`` deep.

    Each level is one equi-join on the files named so far; a page counts at its first level. Over ``most`` pages the
    walk keeps the first by level and address, and says that it is partial.
    """
    spark = files.sparkSession
    now = spark.createDataFrame([(r,) for r in roots], "file string").distinct()
    seen, pages = now, None
    for level in range(depth + 1):
        listed = files.join(now, "file")
        found = listed.where("not is_index").select("url", F.lit(level).alias("level"))
        pages = found if pages is None else pages.union(found)
        now = listed.where("is_index").select(F.col("url").alias("file")).distinct().join(seen, "file", "left_anti")
        seen = seen.union(now)
    once = pages.groupBy("url").agg(F.min("level").alias("level"))
    return once.orderBy("level", "url").limit(most), once.agg((F.count("*") > most).alias("partial"))


#: A site's walk: files asked for together, and the files and addresses after which no more are asked for.
BATCH, MOST_FILES, MOST_URLS = 4, 50, 20_000


def _batches(queue: pd.DataFrame) -> pd.DataFrame:
    """The batch of each place of a site's queue: up to BATCH that stand in it when the batch begins, and what they list comes after."""
    queue = queue.sort_values("place")
    batch, left, there, coming, out = -1, 0, int((queue["depth"] == 0).sum()), 0, []
    for at, kids in enumerate(queue["kids"]):
        if not left:
            there, coming, batch = there + coming, 0, batch + 1
            left = min(BATCH, there - at)
        out.append(batch)
        left, coming = left - 1, coming + kids
    return queue[["site", "place"]].assign(batch=out)


def budget_walk(files: DataFrame, roots: DataFrame, depth: int = 2, most_files: int = MOST_FILES, most_urls: int = MOST_URLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((site, url, ord), (site, file, state), (site, read, failed, urls, partial)): a walk of each site's sitemaps in breadth-first order within a budget.

    ``files`` is (file, ok, is_index, urls), one row for a file that was asked for, ``roots`` (site, ord, file). Files queue by depth, then in the order of those that list them; a file that comes again is not
    read again. Files are taken BATCH at a time, fewer where fewer wait, until a batch begins with ``most_files`` read or failed, or ``most_urls`` addresses found; a site whose queue isn't empty then is partial. Files that are
    not there or not ok have failed. Every level is one equi-join for all sites; what is left is windows by site, whose queues hold what its files list.
    """
    asked = files.select("file", "ok", "is_index", "urls")
    level = roots.select("site", F.lit(0).alias("depth"), F.array(F.col("ord").cast("int")).alias("o"), "file")
    items = None
    for d in range(depth + 1):
        items = level if items is None else items.unionByName(level)
        if d < depth:
            once = items.withColumn("again", F.row_number().over(W.partitionBy("site", "file").orderBy("depth", "o"))).where((F.col("again") == 1) & (F.col("depth") == d))
            inside = once.join(asked.where("ok and is_index"), "file").select("site", "o", F.posexplode("urls").alias("k", "file"))
            level = inside.select("site", F.lit(d + 1).alias("depth"), F.concat("o", F.array("k")).alias("o"), "file")
    queue = W.partitionBy("site").orderBy("depth", "o")
    rows = items.withColumn("place", F.row_number().over(queue)).withColumn("fresh", F.row_number().over(W.partitionBy("site", "file").orderBy("depth", "o")) == 1)
    rows = rows.join(asked, "file", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    kids = F.when(F.col("fresh") & F.col("ok") & F.col("is_index") & (F.col("depth") < depth), F.size("urls")).otherwise(0)
    kind = dict(rows.dtypes)["site"]
    dealt = rows.select("site", "place", "depth", kids.cast("int").alias("kids")).groupBy("site").applyInPandas(_batches, f"site {kind}, place int, batch long")
    rows = rows.join(dealt, ["site", "place"])
    listed = rows.where("fresh and ok and not is_index").select("site", "place", "batch", F.posexplode("urls").alias("k", "url"))
    found = listed.groupBy("site", "url").agg(F.min(F.struct("place", "k", "batch")).alias("x")).select("site", "url", "x.*").withColumn("ord", F.row_number().over(W.partitionBy("site").orderBy("place", "k")))
    per = rows.groupBy("site", "batch").agg(F.count_if("fresh").alias("files")).join(found.groupBy("site", "batch").agg(F.count("*").alias("new")), ["site", "batch"], "left")
    before = W.partitionBy("site").orderBy("batch").rowsBetween(W.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    taken = per.withColumn("taken", (spent("files") < most_files) & (spent(F.coalesce("new", F.lit(0))) < most_urls)).select("site", "batch", "taken")
    pages = found.join(taken.where("taken"), ["site", "batch"]).where(F.col("ord") <= most_urls).select("site", "url", F.col("ord").cast("long").alias("ord"))
    judged = rows.join(taken, ["site", "batch"])
    states = judged.where("taken and fresh").select("site", "file", F.when(F.col("ok"), "read").otherwise("failed").alias("state"))
    counts = judged.groupBy("site").agg(F.count_if(F.col("taken") & F.col("fresh") & F.col("ok")).alias("read"), F.count_if(F.col("taken") & F.col("fresh") & ~F.col("ok")).alias("failed"), F.bool_or(~F.col("taken")).alias("partial"))
    counts = counts.join(pages.groupBy("site").agg(F.count("*").alias("urls")), "site", "left").select("site", "read", "failed", F.coalesce("urls", F.lit(0)).alias("urls"), "partial")
    return pages, states, counts


def discover(urls: DataFrame, host: str, prefix: str, allowed: DataFrame) -> DataFrame:
    """(url, reason): why a listed address is left out: host, path or robots; null where it is crawled. ``allowed`` is (url, allowed)."""
    from pagewright.functions import urls as U

    r = urls.select("url").distinct().join(allowed, "url", "left")
    path = F.regexp_replace(U.path_of(F.col("url")), r"\?.*$", "")
    under = F.lit(True) if not prefix else U.under_path(path, F.lit(prefix))
    return r.select("url", F.when(U.host_of(F.col("url")) != host, "host").when(~under, "path").when(~F.coalesce("allowed", F.lit(True)), "robots").alias("reason"))


def work(listed: DataFrame, sites: DataFrame, limit: int = 50) -> DataFrame:
    """(site, url, via): addresses of a list first, then each site's pages up to ``limit``, none that the list has."""
    named = listed.select("site", "url", F.lit("list").alias("via"))
    rest = page_limit(sites.join(listed.select("url"), "url", "left_anti"), "site", "ord", limit)
    return named.union(rest.select("site", "url", F.lit("sitemap").alias("via")))


def average_runs(runs: DataFrame) -> DataFrame:
    """(url, ms, ttfb_ms, runs) of repeated fetches: means over those that answered, rounded."""
    mean = lambda c: F.floor(F.avg(c) + 0.5).cast("int").alias(c)
    return runs.where("verdict = 'ok'").groupBy("url").agg(mean("ms"), mean("ttfb_ms"), F.count("*").alias("runs"))


def rows_of(findings: DataFrame, fetches: DataFrame, titles: DataFrame) -> DataFrame:
    """One wide row a page: verdict, times, breaks and checks, the worst state of its titles, and the fields that broke."""
    per = findings.groupBy("page_id").agg(F.count_if(F.col("severity") != "check").alias("breaks"), F.count_if(F.col("severity") == "check").alias("checks"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("severity") != "check", F.col("field")))), " | ").alias("fields"))
    order = F.when(F.col("state") == "red", 3).when(F.col("state") == "amber", 2).otherwise(1)
    worst = titles.groupBy("page_id").agg(F.max_by("state", order).alias("title_format"))
    out = fetches.join(per, "page_id", "left").join(worst, "page_id", "left")
    return out.na.fill(0, ["breaks", "checks"]).na.fill("", ["fields"])


def fetch_error(code):
    """Verdict of a fetch that got no answer: refused where the address is a private one, else unverified."""
    return F.when(code == "EPRIVATE", "refused").otherwise("unverified")


def summary_text(pages: DataFrame, findings: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(page_id, text): a page's findings as copyable lines, by category in the order given, breaks first; a category without any says so.

    ``findings`` is (page_id, category, severity, field, found, note).
    """
    line = F.concat(F.lit("- ["), F.when(F.col("severity") == "check", "Check").otherwise("Fix"), F.lit("] "), "field", F.coalesce(F.concat(F.lit(": "), "found"), F.lit("")), F.lit("\n    "), "note")
    one = F.struct((F.col("severity") == "check").alias("late"), "field", line.alias("line"))
    per = findings.where(F.col("category").isin(*categories)).groupBy("page_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("category") == c, one))).alias(f"c{k}") for k, c in enumerate(categories)])
    rows = pages.select("page_id", "url").join(per, "page_id", "left")
    part = lambda k, c: F.concat(F.lit(f"{c.upper()} ("), F.coalesce(F.size(f"c{k}"), F.lit(0)).cast("string"), F.lit(")\n"), F.when(F.coalesce(F.size(f"c{k}"), F.lit(0)) == 0, "  nothing found").otherwise(F.array_join(F.transform(f"c{k}", lambda x: x["line"]), "\n")))
    return rows.select("page_id", F.concat_ws("\n\n", F.concat(F.lit("QA summary - "), F.coalesce("url", F.lit("pasted page"))), *[part(k, c) for k, c in enumerate(categories)]).alias("text"))


def json_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as one JSON object, nulls kept, for a service to hand out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))
