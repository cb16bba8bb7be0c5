"""Checks of lists, numbering and spelling; findings as in ``rules``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import markup
from pagewright.operators.proofing import distance
from pagewright.operators.rules import checks, finding, union

#: A list written as paragraphs: items of at most so many characters, so many of them.
ITEM_CHARS, LEAST_ITEMS = 80, 2


def lists(pages: DataFrame) -> DataFrame:
    """(page_id, ord, tag, attributes, items): innermost ul and ol with the texts of their items; breadcrumbs are left out."""
    src = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1>", " ")
    # cut before every list tag: an opening piece right before a closing one is an innermost list
    pieces = F.filter(F.split(src, r"(?i)(?=</?(?:ul|ol)\b)"), lambda x: x.rlike(r"(?i)^</?(ul|ol)\b"))
    inner = F.filter(F.transform(pieces, lambda x, i: F.when(x.rlike("^<[^/]") & F.coalesce(F.get(pieces, i + 1), F.lit("")).startswith("</"), x)), lambda x: x.isNotNull())
    rows = pages.select("page_id", F.posexplode(inner).alias("ord", "raw")).withColumn("attributes", F.regexp_extract("raw", r"(?s)^<\w+([^>]*)>", 1))
    items = F.transform(F.regexp_extract_all("raw", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), T.strip_tags)
    return rows.select("page_id", "ord", F.lower(F.substring("raw", 2, 2)).alias("tag"), "attributes", items.alias("items")).where("size(items) > 0 and not attributes rlike 'breadcrumb'")


def list_findings(pages: DataFrame) -> DataFrame:
    """Items that should be sub-lists, mixed full stops, numbers typed into numbered lists, empty and single items."""
    rows = lists(pages)
    colon = F.filter("items", lambda t, i: t.rlike(":$") & (i < F.size("items") - 1))
    body = F.filter("items", lambda t: (t != "") & ~t.rlike(":$"))
    stops = F.size(F.filter(body, lambda t: t.rlike(r"[.!?]$")))
    rows = rows.withColumn("colon", colon).withColumn("body", F.size(body)).withColumn("stops", stops)
    return checks(rows, [
        ("size(colon) > 0", "lists", "check", "Flattened list", F.array_join("colon", " / "), "points belong below these items"),
        ("stops > 0 and stops < body and body >= 3", "lists", "check", "Mixed punctuation", F.concat_ws(" of ", "stops", "body"), "items end in a full stop, others don't"),
        ((F.col("tag") == "ol") & F.exists("items", lambda t: t.rlike(r"^\d+[.)]\s")), "lists", "break", "Double numbering", F.col("items")[0], "typed numbers in a numbered list"),
        (F.exists("items", lambda t: t == ""), "lists", "check", "Empty list item", None, "empty item"),
        ((F.size("items") == 1) & ~F.col("attributes").rlike("accordion"), "lists", "check", "Single-item list", F.col("items")[0], "one item"),
    ])


def typed_findings(pages: DataFrame) -> DataFrame:
    """Numbers typed into headings, a break where they skip or repeat; bullets typed as characters; lists written as paragraphs."""
    heads = markup.headings(pages, "1-6").where(F.col("text").rlike(r"^\d+[.)]\s")).withColumn("n", F.regexp_extract("text", r"^(\d+)", 1).cast("long"))
    before = F.lag("n").over(W.partitionBy("page_id").orderBy("ord"))
    per = heads.withColumn("gap", F.col("n") != before + 1).groupBy("page_id").agg(F.count("*").alias("many"), F.coalesce(F.bool_or("gap"), F.lit(False)).alias("gap"))
    paras = markup.paragraphs(pages)
    bullets = paras.where(F.col("text").rlike(r"^[•·▪●◦‣]\s*|^[-–—]\s+")).groupBy("page_id").agg(F.count("*").alias("many"))
    return union([
        finding(per.where("gap"), "lists", "break", "Typed numbering", F.col("many"), "typed numbers skip or repeat"),
        finding(per.where("not gap"), "lists", "check", "Typed numbering", F.col("many"), "numbers typed into headings"),
        finding(bullets, "lists", "check", "Typed bullets", F.col("many"), "paragraphs start with a typed bullet"),
        finding(paragraph_lists(paras), "lists", "check", "List as paragraphs", F.col("text"), "items written as paragraphs"),
    ])


def paragraph_lists(paragraphs: DataFrame) -> DataFrame:
    """(page_id, ord, text, items): paragraphs that end in a colon, with two short unpunctuated ones or more right after."""
    w = W.partitionBy("page_id").orderBy("ord")
    item = (F.col("tag") == "p") & (F.length("text") <= ITEM_CHARS) & ~F.col("text").rlike(r"[.!?:]$")
    rows = paragraphs.withColumn("item", item).withColumn("island", F.sum((~F.col("item")).cast("int")).over(w))
    size = F.count_if(F.col("item")).over(W.partitionBy("page_id", "island"))
    return rows.withColumn("items", size).where((~F.col("item")) & F.col("text").rlike(":$") & (F.col("items") >= LEAST_ITEMS)).select("page_id", "ord", "text", "items")


def name_findings(words: DataFrame, names: list[str]) -> DataFrame:
    """Names written wrong or in the wrong case, from (page_id, ord, word): the words of a page as written, in order.

    A name of several words meets as many neighbouring words, by their number and first letter. It is written wrong by one edit, or two from
    eight letters on, with its first letter and about its length; what has a plural on the page is left alone. Right but for its case, it is told
    if the name has a capital after its first letter and isn't all in lower case. Each form is told once for a page. Names are configuration and become a table of their own few rows.
    """
    spark = words.sparkSession
    known = spark.createDataFrame([(" ".join(n.split()), n.lower(), len(n.split())) for n in names if n.strip()] or [("", "", 0)], "name string, ln string, size int").withColumn("initial", F.substring("ln", 1, 1))
    sizes = sorted({len(n.split()) for n in names if n.strip()})
    w = W.partitionBy("page_id").orderBy("ord")
    ahead = lambda k: F.when(F.lead("word", k - 1).over(w).isNotNull(), F.struct(F.lit(k).alias("size"), F.concat_ws(" ", *[F.lead("word", j).over(w) for j in range(k)]).alias("text")))
    runs = words.select("page_id", F.array(*[ahead(k) for k in sizes] or [F.lit(None).cast("struct<size:int,text:string>")]).alias("x"))
    runs = runs.select("page_id", F.explode(F.array_compact("x")).alias("x")).select("page_id", "x.size", "x.text").distinct().withColumn("low", F.lower("text")).withColumn("initial", F.substring("low", 1, 1))
    met = runs.join(known, ["size", "initial"]).where((F.length("text") >= 5) & (F.abs(F.length("low") - F.length("ln")) <= 1) & (F.col("text") != F.col("name")))
    case = met.where((F.col("low") == F.col("ln")) & F.expr("substr(name, 2)").rlike("[A-Z]") & (F.col("text") != F.col("low")))
    edits = F.when(F.length("ln") >= 8, 2).otherwise(1)
    close = met.where((F.col("low") != F.col("ln")) & F.levenshtein("low", "ln", 4).between(0, 2 * edits)).join(known.select(F.col("ln").alias("low")), "low", "left_anti")
    plural = runs.where(F.col("low").endswith("s")).select("page_id", F.regexp_replace("low", "s$", "").alias("low")).distinct()
    close = close.where(distance("low", "ln") <= edits).join(plural, ["page_id", "low"], "left_anti")
    told = F.concat_ws(" -> ", "text", "name")
    return union([finding(case, "spelling", "check", "Product name", told, "the name is written in another case"), finding(close, "spelling", "break", "Product name", told, "not how the name is spelt")])


def spelling_findings(counts: DataFrame, misspelt: dict[str, str], brands: list[str], us_uk: list[tuple[str, str]]) -> DataFrame:
    """Listed misspellings, brand names written wrong, both spellings on one page, from (page_id, word, n) of word counts.

    The lists are configuration and become expressions or tables of their own few rows. Brands of one word are looked for
    as in ``name_findings``, which also takes names of several words and tells wrong case.
    """
    spark = counts.sparkSession
    wrong = spark.createDataFrame(list(misspelt.items()) or [("", "")], "word string, fix string")
    listed = counts.join(wrong, "word")
    names = spark.createDataFrame([(b, b.lower()) for b in brands if " " not in b] or [("", "")], "brand string, lb string")
    names, counts = names.withColumn("initial", F.substring("lb", 1, 1)), counts.withColumn("initial", F.substring("word", 1, 1))
    near = (F.abs(F.length("word") - F.length("lb")) <= 1) & (F.length("word") >= 5) & (F.col("word") != F.col("lb")) & ~F.col("word").isin(*[b.lower() for b in brands])
    edits = F.when(F.length("lb") >= 8, 2).otherwise(1)
    # a swap is two plain edits at most, so the plain distance leaves only near pairs to the exact one
    close = counts.join(names, "initial").where(near & F.levenshtein("word", "lb", 4).between(0, 2 * edits)).where(distance("word", "lb") <= edits)
    plural = counts.where(F.col("word").endswith("s")).select("page_id", F.regexp_replace("word", "s$", "").alias("word"))
    close = close.join(plural, ["page_id", "word"], "left_anti")
    us, uk = [a for a, _ in us_uk], [b for _, b in us_uk]
    mixed = counts.groupBy("page_id").agg(F.array_sort(F.collect_set(F.when(F.col("word").isin(*us), F.col("word")))).alias("us"), F.array_sort(F.collect_set(F.when(F.col("word").isin(*uk), F.col("word")))).alias("uk"))
    return union([
        finding(listed, "spelling", "break", "Misspelling", F.concat_ws(" -> ", "word", "fix"), "listed misspelling"),
        finding(close, "spelling", "break", "Product name", F.concat_ws(" -> ", "word", "brand"), "not how the name is spelt"),
        finding(mixed.where("size(us) > 0 and size(uk) > 0"), "spelling", "check", "Mixed spelling", F.array_join(F.concat("us", "uk"), ", "), "two conventions on one page"),
    ])
