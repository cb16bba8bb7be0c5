"""Where things sit on a page: the component, block, landmark and heading around links, forms and editor fields.

Only the nesting of tags needs a pass in order; one Arrow function reads it and leaves every marked element with the
elements around it. All judgement is joins, windows and column functions over those rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators.rules import checks, finding

# fixed values: classes of the repeated blocks of a component and what a block is called
ITEM_NOUNS = {"content-block": "block", "teaser": "teaser", "content-river__item": "item", "accordion-listitem": "question", "news-item": "card", "proofpoints-turningcard": "card", "card": "card"}
# fixed values: elements that name a part of the page
LANDMARKS = {"header": "Header", "nav": "Navigation", "footer": "Footer", "aside": "Sidebar"}
# fixed values: elements without content
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: fields that hold an address, not copy
ASSET_FIELDS = r"(?i)image|url|dam|src|asset"
#: Characters of a title that a place shows.
TITLE = 70
#: Characters of pages after which what was found on them is handed on.
PART = 1 << 19

_ELEMENT = S.StructType([S.StructField("at", S.IntegerType()), S.StructField("stop", S.IntegerType()), S.StructField("tag", S.StringType())])
_MARKED = S.ArrayType(S.StructType([S.StructField("kind", S.StringType()), S.StructField("at", S.IntegerType()), S.StructField("tag", S.StringType()), S.StructField("body", S.StringType()), S.StructField("chain", S.ArrayType(_ELEMENT))]))
_TOKEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<(/?)([a-z][a-z0-9-]*)\b[^>]*>", re.I | re.S)
_FIELD = re.compile(r"<!--\s*Start Component Field:", re.I)
_ITEM = re.compile("|".join(rf"(?<![\w-]){re.escape(c)}(?![\w-])" for c in ITEM_NOUNS))
_TITLE = re.compile(r"<h[1-6]\b|<(?:button|a|div|span)\b[^>]*\baccordion-trigger\b", re.I)


def _kinds(name: str, tag: str) -> list[str]:
    out = {"a": ["link"], "form": ["form"], "section": ["section"]}.get(name, []).copy()
    if name == "article" or _ITEM.search(tag):
        out.append("item")
    return out + ["title"] if _TITLE.match(tag) else out


def in_parts(batches: Iterator[pd.Series], one: Callable[[str | None], list]) -> Iterator[pd.Series]:
    """``one`` of each page, handed on whenever PART characters are read: what is found outgrows the pages many times, so no batch of it is ever whole in memory."""
    for batch in batches:
        done, read = [], 0
        for page in batch:
            done.append(one(page))
            read += len(page or "")
            if read >= PART:
                yield pd.Series(done, dtype=object)
                done, read = [], 0
        if done:
            yield pd.Series(done, dtype=object)


@F.pandas_udf(_MARKED)
def marked_elements(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Links, forms, repeated blocks, titles and editor fields of a page, each with the elements open around it."""

    def one(page: str | None):
        page, found, stack, fields = page or "", [], [], []

        def shut(depth: int, at: int) -> None:
            for element, _, title in stack[depth:]:
                element["stop"] = at
                if title:
                    title["body"] = page[title["at"] : at]
            del stack[depth:]
            while fields and fields[-1][1] > depth:
                x, _, start = fields.pop()
                x["body"] = page[start:at]

        for m in _TOKEN.finditer(page):
            at, tag = m.start(), m.group()
            chain = [element for element, _, _ in stack]
            if m.group(3) is None:
                if _FIELD.match(tag):
                    before = page[page.rfind(">", 0, at) + 1 : at]
                    found.append({"kind": "field", "at": at, "tag": tag + before, "body": None, "chain": chain})
                    fields.append((found[-1], len(stack), m.end()))
                continue
            name = m.group(3).lower()
            if m.group(2):
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == name), None)
                if depth is not None:
                    shut(depth, at)
                continue
            new = [{"kind": k, "at": at, "tag": tag, "body": None, "chain": chain} for k in _kinds(name, tag)]
            found += new
            if name not in VOID and not tag.endswith("/>"):
                stack.append(({"at": at, "stop": len(page), "tag": tag}, name, new[-1] if new and new[-1]["kind"] == "title" else None))
        shut(0, len(page))
        for x, _, start in fields:
            x["body"] = page[start:]
        return found

    return in_parts(batches, one)


def hidden(tag: Column) -> Column:
    bare = F.regexp_replace(tag, "\"[^\"]*\"|'[^']*'", '""')
    style = tag.rlike(r"(?i)\sstyle\s*=\s*[\"'][^\"']*(display\s*:\s*none|visibility\s*:\s*hidden)")
    return style | bare.rlike(r"(?i)\shidden(?=[\s>/=])") | F.arrays_overlap(classes(tag), F.array(*map(F.lit, ("hidden", "d-none", "hide"))))


def classes(tag: Column) -> Column:
    return F.split(F.trim(F.coalesce(T.attr(tag, "class"), F.lit(""))), r"\s+")


def landmark(tag: Column) -> Column:
    """Header, Navigation, Footer or Sidebar by element or by a whole part of a class; null for other elements."""
    name = F.lower(F.regexp_extract(tag, r"^<([a-zA-Z0-9-]+)", 1))
    has = lambda part: F.exists(classes(tag), lambda c: c.rlike(rf"(^|[-_]){part}($|[-_])"))
    by_class = F.when(has("footer"), "Footer").when(has("header"), "Header").when(has("nav(igation)?"), "Navigation")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LANDMARKS.items() for x in p]), name), by_class)


def noun(tag: Column) -> Column:
    """What a repeated block is called; null for other elements."""
    names = F.create_map(*[F.lit(x) for p in ITEM_NOUNS.items() for x in p])
    known = F.filter(F.transform(classes(tag), lambda c: F.try_element_at(names, c)), lambda x: x.isNotNull())
    return F.coalesce(F.get(known, 0), F.when(tag.rlike("(?i)^<article\\b"), "block"))


def _module(tag: Column, names: str) -> Column:
    """Class that makes a section a component, null where none does."""
    return F.nullif(F.regexp_extract(tag, rf"(?is)^<section\b[^>]*\bclass\s*=\s*[\"'][^\"']*?(?<![\w-])({names})(?![\w-])", 1), F.lit(""))


def places(pages: DataFrame, kind: str = "link", names: str = r"module-[\w-]+|hero-banner", keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, keep..., at, tag, body, chain, place, hidden, anchor, module_at): where every link, form or field of a page sits.

    ``place`` reads "component #n › block k — "title" (hidden)". The component is the outermost section whose class names
    one, else the outermost landmark, else Page body. Blocks count by their own kind within a component, outermost
    only. The title is the last visible heading in the block or component before the element, else the first in it;
    outside both, the last heading above. ``anchor`` is the component's own id as a fragment.
    """
    module = lambda e: F.get(F.filter(e["chain"], lambda c: _module(c["tag"], names).isNotNull()), 0)
    blocks = lambda e: F.filter(e["chain"], lambda c: (c["at"] > module(e)["at"]) & noun(c["tag"]).isNotNull())
    # all of a page is in its row, so nothing is shuffled
    rows = pages.select("page_id", *keep, marked_elements("html").alias("all")).select(
        "page_id", *keep, F.filter("all", lambda e: e["kind"] == kind).alias("own"),
        F.filter(F.transform(F.filter("all", lambda e: (e["kind"] == "title") & ~e["tag"].rlike(r"(?i)display\s*:\s*none")), lambda e: F.struct(e["at"].alias("at"), T.strip_tags(F.coalesce(e["body"], F.lit(""))).alias("title"))), lambda t: t["title"] != "").alias("titles"),
        F.transform(F.filter("all", lambda e: (e["kind"] == "section") & _module(e["tag"], names).isNotNull() & module(e).isNull()), lambda e: F.struct(e["at"].alias("at"), _module(e["tag"], names).alias("name"))).alias("modules"),
        F.transform(F.filter("all", lambda e: (e["kind"] == "item") & noun(e["tag"]).isNotNull() & module(e).isNotNull() & (F.size(blocks(e)) == 0)), lambda e: F.struct(e["at"].alias("at"), module(e)["at"].alias("module"), noun(e["tag"]).alias("name"))).alias("items"),
    )
    # an outer explode, since the filter that Spark infers from a plain one would read every page twice
    one = rows.select("page_id", *keep, "titles", "modules", "items", F.explode_outer("own").alias("e")).where("e is not null").select("*", module(F.col("e")).alias("module"), F.get(blocks(F.col("e")), 0).alias("item"), "e.at", "e.tag", "e.body", "e.chain")
    one = one.withColumn("land", F.get(F.filter("chain", lambda c: landmark(c["tag"]).isNotNull()), 0))
    one = one.withColumn("component", _module(F.col("module.tag"), names)).withColumn("noun", noun(F.col("item.tag")))
    one = one.withColumn("n", F.size(F.filter("modules", lambda m: (m["name"] == F.col("component")) & (m["at"] <= F.col("module.at")))))
    one = one.withColumn("nth", F.size(F.filter("items", lambda i: (i["module"] == F.col("module.at")) & (i["name"] == F.col("noun")) & (i["at"] <= F.col("item.at")))))
    one = one.withColumn("module_at", F.col("module.at"))
    box = F.coalesce("item", "module", "land")
    within = F.filter("titles", lambda t: F.coalesce((t["at"] >= box["at"]) & (t["at"] < box["stop"]), t["at"] < F.col("at")))
    before = F.filter(within, lambda t: t["at"] < F.col("at"))
    title = F.coalesce(F.try_element_at(before, F.lit(-1)), F.get(within, 0))["title"]
    clipped = F.when(F.length(title) > TITLE, F.concat(F.regexp_replace(F.substring(title, 1, TITLE - 3), r"\s+\S*$", ""), F.lit("…"))).otherwise(title)
    hid = F.coalesce(hidden(F.col("tag")), F.lit(False)) | F.exists("chain", lambda e: hidden(e["tag"]))
    base = F.coalesce(F.concat("component", F.lit(" #"), "n"), landmark(F.col("land.tag")), F.lit("Page body"))
    place = F.concat(base, F.coalesce(F.concat(F.lit(" › "), "noun", F.lit(" "), "nth"), F.lit("")), F.coalesce(F.concat(F.lit(' — "'), clipped, F.lit('"')), F.lit("")), F.when(hid, " (hidden)").otherwise(""))
    anchor = F.concat(F.lit("#"), F.nullif(T.attr(F.col("module.tag"), "id"), F.lit("")))
    return one.select("page_id", *keep, "at", "tag", "body", "chain", place.alias("place"), hid.alias("hidden"), anchor.alias("anchor"), "module_at")


def link_places(pages: DataFrame) -> DataFrame:
    """(page_id, url, places): the distinct places of each absolute target of a page, in order."""
    rows = places(pages, keep=("url",)).withColumn("dst", U.absolute(T.attr(F.col("tag"), "href"), F.col("url"))).where("dst is not null")
    first = rows.groupBy("page_id", "dst", "place").agg(F.min(F.struct("at", "hidden", "anchor")).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("x.at").alias("at"), "place", F.col("x.hidden").alias("hidden"), F.col("x.anchor").alias("anchor"))))
    return first.groupBy("page_id", F.col("dst").alias("url")).agg(listed.alias("places"))


def form_places(pages: DataFrame) -> DataFrame:
    """(page_id, at, place, hidden, anchor, near, panel): where forms sit.

    ``near`` is the id of the nearest element around a form that has one; ``panel`` the id of the nearest tab, accordion
    or topic panel around it.
    """
    rows = places(pages, "form")
    ids = lambda keep: F.try_element_at(F.filter(F.transform(F.filter("chain", keep), lambda e: T.attr(e["tag"], "id")), lambda x: x != ""), F.lit(-1))
    panel = lambda e: e["tag"].rlike(r"(?i)\brole\s*=\s*[\"']tabpanel|class\s*=\s*[\"'][^\"']*(panel|topic)")
    return rows.select("page_id", "at", "place", "hidden", "anchor", ids(lambda e: F.lit(True)).alias("near"), ids(panel).alias("panel"))


def fields(pages: DataFrame) -> DataFrame:
    """(page_id, at, path, value, place): editor fields that comments of a page name.

    A value runs from its comment to the end of the element around it; where that is empty, it is the text between the
    comment and the tag before it. Prefixes of the path's parts that name a schema are dropped.
    """
    rows = places(pages, "field")
    raw = F.regexp_extract("tag", r"\"XPath\"\s*:\s*\"([^\"]+)\"", 1)
    path = F.regexp_replace(F.regexp_replace(raw, "(?i)^tcm:Content/", ""), "(?i)(^|/)custom:", "$1")
    before = F.regexp_extract("tag", r"(?s)-->(.*)$", 1)
    after = T.strip_tags(F.col("body"))
    return rows.where(raw != "").select("page_id", "at", path.alias("path"), F.coalesce(F.nullif(after, F.lit("")), T.normalise(before)).alias("value"), "place", F.col("module_at"))


def field_findings(found: DataFrame, localised: DataFrame) -> DataFrame:
    """Fields without a value, but for those of assets; English values on pages of ``localised`` (page_id).

    Only fields inside a component count.
    """
    loc = localised.select("page_id").distinct().withColumn("loc", F.lit(True))
    rows = found.where("module_at is not null").join(loc, "page_id", "left")
    where = F.concat_ws(" › ", "place", "path")
    return checks(rows, [
        ((F.col("value") == "") & ~F.col("path").rlike(ASSET_FIELDS), "components", "break", "Field", where, "field is empty on the page"),
        (F.col("loc") & (T.english_score(F.col("value")) >= 3), "components", "break", "Field", F.col("value"), "field reads as English on a localised page"),
    ])


def image_findings(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """Images without source or alternative text; wanted assets, (page_id, want, src) of ``matching.assets``, that no image resolves to."""
    on_page = checks(images, [
        (F.coalesce("src", F.lit("")) == "", "images", "break", "Image", F.coalesce(F.nullif("alt", F.lit("")), F.lit("(no alt)")), "image without a source"),
        ((F.coalesce("src", F.lit("")) != "") & (F.coalesce("alt", F.lit("")) == ""), "images", "break", "Image", F.col("src"), "image without alternative text"),
    ])
    lost = wanted.where(F.col("src").isNull() & (U.asset_identity(F.col("want")) != ""))
    return on_page.unionByName(finding(lost, "images", "check", "Image", F.col("want"), "no image resolves to this asset"))
