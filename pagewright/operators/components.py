"""Pages and briefs as components: sections, modules, fields, and what is generated from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import markup
from pagewright.operators.head_rules import facts

#: A run of so many alike leaves is one component with items.
RUN = 2


def stream(pages: DataFrame) -> DataFrame:
    """(page_id, ord, kind, level, text): visible headings, paragraphs, items and named images in the order of the page."""
    piece = r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]>|<img\b[^>]*>|<summary\b[^>]*>.*?</summary>|<(?:p|li)\b[^>]*>.*?(?=</?(?:p|li|ul|ol|div|article|section|footer|body|h[1-6])\b))"
    src = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|nav|header|footer)\b[^>]*>.*?</\1>", " ")
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(src, F.lit(piece), F.lit(1))).alias("ord", "raw"))
    name = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    tag = F.regexp_extract("raw", r"(?s)^(<[^>]*>)", 1)
    rows = rows.withColumn("name", name).where(~tag.rlike(r"(?i)display\s*:\s*none|\shidden[\s>=]"))
    picture = F.regexp_replace(F.regexp_replace(F.coalesce(T.attr(F.col("raw"), "data-src"), T.attr(F.col("raw"), "src")), r"[?#].*$", ""), r"^.*/", "")
    picture = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(picture, F.lit("+"), F.lit("%2B"))), picture), ":.*$", ""), r"(?i)\.(jpe?g|png|webp|gif|svg|avif)$", "")
    kind = F.when(F.col("name").rlike("^h[1-6]$"), "heading").when(F.col("name") == "img", "image").when(F.col("name") == "summary", "question").otherwise("copy")
    text = F.when(F.col("name") == "img", F.trim(picture)).otherwise(T.strip_tags(F.col("raw")))
    return rows.select("page_id", "ord", kind.alias("kind"), F.when(kind == "heading", F.substring("name", 2, 1).cast("int")).alias("level"), text.alias("text")).where("text <> ''")


def numbered(rows: DataFrame) -> DataFrame:
    """``stream`` with major and minor numbers: a heading above the third level opens a section, a third-level one a part of it."""
    w = W.partitionBy("page_id").orderBy("ord")
    r = rows.withColumn("major", F.sum(F.when((F.col("kind") == "heading") & (F.col("level") != 3), 1).otherwise(0)).over(w))
    minor = F.sum(F.when(F.col("level") == 3, 1).otherwise(0)).over(W.partitionBy("page_id", "major").orderBy("ord"))
    return r.withColumn("minor", minor + F.when(F.col("major") > 0, 1).otherwise(0))


def brief_of(pages: DataFrame) -> DataFrame:
    """(page_id, brief): a page as a brief: its head as labels, own links as bullets, then headings with numbers, copy and assets."""
    f = facts(pages)
    label = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(name + "\t"), F.trim(c)))
    head = F.array(label("Page Title/Title Tag", F.coalesce("og_title", "title")), label("Page Name", F.col("title")), label("Meta Description/Meta Tag", markup.meta(F.col("html"), "description")), label("Meta Keywords", markup.meta(F.col("html"), "keywords")), label("URL Path", F.col("canonical")))
    heads = f.select("page_id", F.array_compact(head).alias("head"))
    own = f.select("page_id", U.host_of(F.col("canonical")).alias("host"))
    a = markup.anchors(pages).join(own, "page_id").where((F.col("href").rlike("(?i)^https?://") & (U.host_of(F.col("href")) == F.col("host"))) | F.col("href").startswith("/"))
    a = a.where(~F.col("href").rlike(r"(?i)^https?://[^/]*author|/content/")).groupBy("page_id", U.path_of(F.col("href")).alias("path")).agg(F.min(F.struct("ord", "href")).alias("x"))
    links = a.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x, i: F.concat(F.when(i == 0, "Internal Links\t").otherwise(""), F.lit("●\t"), x["href"])).alias("links"))
    line = F.when(F.col("kind") == "heading", F.concat("text", F.lit("["), "major", F.lit("."), "minor", F.lit("]"))).when(F.col("kind") == "image", F.concat(F.lit("Asset - "), "text")).otherwise(F.col("text"))
    body = numbered(stream(pages)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x")).select("page_id", F.transform("x", lambda x: x["line"]).alias("body"))
    none = F.array().cast("array<string>")
    out = heads.join(links, "page_id", "left").join(body, "page_id", "left")
    return out.select("page_id", F.array_join(F.concat("head", F.coalesce("links", none), F.coalesce(F.concat(F.array(F.lit("")), "body"), none)), "\n").alias("brief"))


def read_brief(briefs: DataFrame) -> DataFrame:
    """(brief_id, ord, kind, major, minor, text): lines of a generated brief; what ``brief_of`` writes comes back."""
    rows = briefs.select("brief_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).where("line <> ''")
    mark = r"^(.*)\[(\d+)\.(\d+)\]$"
    kind = F.when(F.col("line").rlike(mark), "heading").when(F.col("line").startswith("Asset - "), "image").when(F.col("line").contains("\t"), "label").otherwise("copy")
    text = F.when(kind == "heading", F.regexp_extract("line", mark, 1)).when(kind == "image", F.regexp_replace("line", "^Asset - ", "")).otherwise(F.col("line"))
    number = lambda k: F.when(kind == "heading", F.regexp_extract("line", mark, k).cast("int"))
    return rows.select("brief_id", "ord", kind.alias("kind"), number(2).alias("major"), number(3).alias("minor"), text.alias("text"))


def modules(pages: DataFrame, names: str = r"module-[\w-]+|hero-banner") -> DataFrame:
    """(page_id, ord, name, nth, of, body): sections whose class names a module, counted by name; sections inside one belong to it.

    A running count of opened less closed sections gives the depth, so a module ends where its own section does.
    """
    src = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1>", " ")
    pieces = F.split(src, r"(?i)(?=</?section\b)")
    rows = pages.select("page_id", F.posexplode(pieces).alias("ord", "piece"))
    w = W.partitionBy("page_id").orderBy("ord")
    opened, closed = F.col("piece").rlike(r"(?i)^<section\b"), F.col("piece").rlike(r"(?i)^</section\b")
    rows = rows.withColumn("depth", F.sum(F.when(opened, 1).when(closed, -1).otherwise(0)).over(w))
    name = F.regexp_extract("piece", rf"(?is)^<section\b[^>]*\bclass\s*=\s*[\"'][^\"']*?\b({names})\b", 1)
    rows = rows.withColumn("name", F.when(opened & (name != ""), name))
    # a module is outermost unless an earlier one, opened at a lower depth, is still open
    first = rows.withColumn("at", F.when(F.col("name").isNotNull(), F.col("depth")))
    span = first.withColumn("low", F.last(F.when(F.col("name").isNotNull(), F.struct("ord", "depth")), True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    since = span.withColumn("floor", F.min("depth").over(W.partitionBy("page_id", F.col("low.ord")).orderBy("ord")))
    top = since.withColumn("outer", F.col("name").isNotNull() & (F.col("low").isNull() | (F.col("floor") < F.col("low.depth"))))
    grouped = top.withColumn("module", F.last(F.when(F.col("outer"), F.struct("ord", "depth", "name")), True).over(w)).where("module is not null")
    inside = grouped.withColumn("least", F.min("depth").over(W.partitionBy("page_id", F.col("module.ord")).orderBy("ord"))).where("least >= module.depth")
    out = inside.groupBy("page_id", F.col("module.ord").alias("ord"), F.col("module.name").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("body"))
    return out.withColumn("nth", F.row_number().over(W.partitionBy("page_id", "name").orderBy("ord"))).withColumn("of", F.count("*").over(W.partitionBy("page_id", "name"))).select("page_id", "ord", "name", "nth", "of", "body")


def component_of(classes: DataFrame, vocabulary: list[tuple[str, list[str]]]) -> DataFrame:
    """(element_id, component): the component all of whose classes an element (element_id, classes) has, the most classes first,
    then the order of the vocabulary. The vocabulary is configuration and becomes one expression."""
    best = sorted(vocabulary, key=lambda v: -len(v[1]))
    fits = [F.when(F.size(F.array_except(F.array(*map(F.lit, need)), "classes")) == 0, F.lit(name)) for name, need in best if need]
    return classes.select("element_id", F.coalesce(*fits, F.lit(None).cast("string")).alias("component"))


def leaves(rows: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
    """(page_id, ord, title, type, body, images): a component for each heading of ``numbered`` rows.

    The type is the first name of ``vocabulary`` (pattern to type) its heading fits; else by shape: questions, an image
    with copy as a card, copy alone as text; a heading without anything is bare.
    """
    heads = rows.withColumn("head", F.last(F.when(F.col("kind") == "heading", F.struct("ord", "text", "level")), True).over(W.partitionBy("page_id").orderBy("ord"))).where("head is not null")
    text = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "text")))), lambda x: x["text"])
    per = heads.groupBy("page_id", F.col("head.ord").alias("ord"), F.col("head.text").alias("title"), F.col("head.level").alias("level")).agg(text("copy").alias("body"), text("image").alias("images"), F.count_if(F.col("kind") == "question").alias("questions"))
    named = [F.when(F.lower("title").rlike(p), F.lit(t)) for p, t in vocabulary.items()]
    asks = F.col("title").rlike(r"[?？]\s*$") & (F.size("body") > 0)
    shape = F.when((F.col("questions") > 0) | asks, "question").when((F.size("images") > 0) & (F.size("body") > 0), "card").when(F.size("body") > 0, "text").when(F.size("images") > 0, "image").otherwise("bare")
    return per.select("page_id", "ord", "level", "title", F.coalesce(*named, shape).alias("type"), "body", "images")


def components(leaf: DataFrame) -> DataFrame:
    """(page_id, ord, type, title, items): neighbouring question or card leaves fold into one faq or card list, a bare heading
    right before them is its title; every other leaf is a component of its own."""
    w = W.partitionBy("page_id").orderBy("ord")
    folds = F.col("type").isin("question", "card")
    r = leaf.withColumn("change", (~folds) | (F.lag("type").over(w) != F.col("type")) | F.lag("type").over(w).isNull()).withColumn("run", F.sum(F.col("change").cast("int")).over(w))
    item = F.struct("ord", "title", "body", "images")
    g = r.groupBy("page_id", "run").agg(F.min("ord").alias("ord"), F.first("type").alias("leaf"), F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n"))
    many = F.col("leaf").isin("question", "card") & (F.col("n") >= RUN)
    g = g.withColumn("type", F.when(many & (F.col("leaf") == "question"), "faq").when(many, "cards").otherwise(F.col("leaf"))).withColumn("many", many)
    o = W.partitionBy("page_id").orderBy("ord")
    g = g.withColumn("intro", F.when(F.lag("leaf").over(o) == "bare", F.lag("items").over(o)[0]["title"])).withColumn("swallowed", (F.col("leaf") == "bare") & F.coalesce(F.lead("many").over(o), F.lit(False)))
    title = F.when(F.col("many"), F.col("intro")).otherwise(F.col("items")[0]["title"])
    return g.where("not swallowed").select("page_id", "ord", "type", title.alias("title"), "items")


def render(parts: DataFrame) -> DataFrame:
    """(page_id, html, manifest): components as plain markup, all text escaped, and as JSON."""
    para = lambda xs: F.array_join(F.transform(xs, lambda t: F.concat(F.lit("<p>"), T.escape_html(t), F.lit("</p>"))), "")
    pics = lambda xs: F.array_join(F.transform(xs, lambda t: F.concat(F.lit('<img alt="'), T.escape_html(t), F.lit('">'))), "")
    title = F.coalesce(F.concat(F.lit("<h2>"), T.escape_html(F.col("title")), F.lit("</h2>")), F.lit(""))
    fold = F.array_join(F.transform("items", lambda x: F.concat(F.lit("<details><summary>"), T.escape_html(x["title"]), F.lit("</summary>"), para(x["body"]), F.lit("</details>"))), "")
    cards = F.array_join(F.transform("items", lambda x: F.concat(F.lit("<article><h3>"), T.escape_html(x["title"]), F.lit("</h3>"), pics(x["images"]), para(x["body"]), F.lit("</article>"))), "")
    plain = F.array_join(F.transform("items", lambda x: F.concat(pics(x["images"]), para(x["body"]))), "")
    body = F.when(F.col("type") == "faq", fold).when(F.col("type") == "cards", cards).otherwise(plain)
    one = F.concat(F.lit('<section class="'), "type", F.lit('">'), title, body, F.lit("</section>"))
    rows = parts.select("page_id", "ord", one.alias("html"), F.struct("type", "title", F.size("items").alias("items")).alias("m"))
    g = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "html", "m"))).alias("x"))
    return g.select("page_id", F.array_join(F.transform("x", lambda x: x["html"]), "\n").alias("html"), F.to_json(F.transform("x", lambda x: x["m"])).alias("manifest"))


def template(parts: DataFrame, templates: list[tuple[str, list[str]]]) -> DataFrame:
    """(page_id, template): the template all of whose types a page has, the most types first; null where none fits."""
    types = parts.groupBy("page_id").agg(F.collect_set("type").alias("classes")).withColumnRenamed("page_id", "element_id")
    return component_of(types, templates).select(F.col("element_id").alias("page_id"), F.col("component").alias("template"))


def slots(parts: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(page_id, ord, slot, text, left): paragraphs of a component in the slots of its type in order; ``left`` counts those without one."""
    names = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    r = parts.select("page_id", "ord", F.flatten(F.transform("items", lambda x: x["body"])).alias("body"), F.coalesce(F.try_element_at(names, F.col("type")), F.array().cast("array<string>")).alias("names"))
    left = F.greatest(F.size("body") - F.size("names"), F.lit(0))
    return r.select("page_id", "ord", left.alias("left"), F.posexplode("names").alias("k", "slot"), "body").select("page_id", "ord", "slot", F.get("body", F.col("k")).alias("text"), "left")
