"""Pages and briefs as one model: a stream of blocks, leaves under headings, typed components, and the manifest of them.

A type is decided in tiers: the text or the markup names it; a slot word in the heading; fields or headings that repeat; the shape of the leaf; else it is generic
and left to review. Every component tells its tier, how sure it is and why. Vocabularies are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pagewright.functions import text as T
from pagewright.operators import places

# fixed values: words of a heading that name a slot, and headings that count steps
SLOT_WORDS = (("hero", r"(?i)\bhero\b"), ("accordion", r"(?i)\baccordion\b|\bfaq\b"), ("cta", r"(?i)\bcta\b"), ("image", r"(?i)\bimage\b|\bhero image\b|\bcover image\b"))
ORDINAL = r"(?i)^\s*(?:\d{1,2}\s*[.):]|step\s+\d+|passo\s+\d+|paso\s+\d+)"
# fixed values: names of editor fields and the role of their values, the first that fits
ROLES = (("question", "(?i)question"), ("answer", "(?i)answer"), ("heading", "(?i)heading|title|h1"), ("subtitle", "(?i)subtitle"), ("body", r"(?i)\bbody\b|bodytext|description|intro|leadtext"), ("cta", "(?i)actiontext|^cta$|button"), ("href", "(?i)actionurl|href"), ("image", "(?i)^image$|alttext|caption"))
#: Characters of a body that a card may have, of a block of loose text, and of a heading quoted as evidence.
CARD, LOOSE, QUOTED = 320, 200, 70
#: Words and characters of a line of a brief that reads as a heading.
HEADING_WORDS, HEADING_CHARS = 12, 90


@dataclass(frozen=True)
class Vocabulary:
    """What names a component: names of components, phrases that signal a type, phrases of page chrome, slots of a type, templates."""

    names: dict[str, str] = field(default_factory=dict)
    signals: tuple[tuple[str, tuple[str, ...]], ...] = ()
    chrome: tuple[str, ...] = ()
    slots: dict[str, tuple[str, ...]] = field(default_factory=dict)
    templates: tuple[tuple[str, tuple[str, ...]], ...] = ()


def label_key(text: Column) -> Column:
    """Letters and digits of a label in lower case, words parted by one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _plain(phrase: str) -> str:
    return re.sub("[^a-z0-9]+", " ", phrase.lower()).strip()


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key) if pairs else F.lit(None).cast("string")


def type_named(text: Column, words: Vocabulary) -> Column:
    """The type that a text names: the name of a component as a whole, or a phrase that signals one as whole words; null where it names none."""
    names = {_plain(n).replace(" ", ""): t for n, t in words.names.items()}

    def of(padded: Column) -> Column:
        signals = [F.when(F.greatest(F.lit(False), *[F.contains(padded, F.lit(f" {_plain(p)} ")) for p in phrases if _plain(p)]), F.lit(t)) for t, phrases in words.signals]
        return F.coalesce(_lookup(names, F.replace(padded, F.lit(" "), F.lit(""))), *signals, F.lit(None).cast("string"))

    # bound as a variable, so the key is made once for all phrases
    return F.get(F.transform(F.array(F.concat(F.lit(" "), label_key(text), F.lit(" "))), of), 0)


def first_named(texts: Column, words: Vocabulary) -> Column:
    """(type, text) of the first of several texts that names a type; null where none does."""
    found = F.filter(F.transform(texts, lambda t: F.struct(type_named(t, words).alias("type"), t.alias("text"))), lambda x: x["type"].isNotNull())
    return F.get(found, 0)


def is_chrome(text: Column, words: Vocabulary) -> Column:
    return F.get(F.transform(F.array(label_key(text)), lambda k: F.greatest(F.lit(False), F.lit(False), *[F.contains(k, F.lit(_plain(c))) for c in words.chrome]) & (k != "")), 0)


def quoted(text: Column) -> Column:
    return F.when(F.length(text) > QUOTED, F.concat(F.substring(text, 1, QUOTED - 3), F.lit("…"))).otherwise(text)


def _verdict(kind: Column | str, tier: str, sure: str, why: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("type"), F.lit(tier).alias("tier"), F.lit(sure).alias("confidence"), lit(why).alias("why"))


GENERIC = ("generic", "generic", "low", "nothing names a component here; review before publishing")


def by_shape(heading: Column, body: Column, image: Column, links: Column) -> Column:
    """Type by what a leaf consists of; null where its shape says nothing."""
    has, some, pic, goes = F.coalesce(heading, F.lit("")) != "", F.size(body) > 0, image.isNotNull(), F.size(links) > 0
    return (
        F.when(has & pic & (F.size(body) <= 1), _verdict("hero", "shape", "medium", "a heading, an image and a short text at most"))
        .when(has & some, _verdict("content", "shape", "medium", "a heading with copy below it"))
        .when(goes & ~has & ~some & ~pic, _verdict("cta", "shape", "medium", "links without copy around them"))
        .when(pic & ~has & ~some & ~goes, _verdict("image", "shape", "medium", "an image alone"))
    )


_BLOCK = S.ArrayType(S.StructType([S.StructField("at", S.IntegerType()), S.StructField("kind", S.StringType()), S.StructField("level", S.IntegerType()), S.StructField("raw", S.StringType())]))
_TAG = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<(/?)([a-z][a-z0-9]*)\b[^>]*>", re.I | re.S)
_ENDS = frozenset("p li ul ol div article section footer body details summary h1 h2 h3 h4 h5 h6 table form".split())
_NOT_LOOSE = frozenset("p li h1 h2 h3 h4 h5 h6 label input select textarea button details summary".split())


@F.pandas_udf(_BLOCK)
def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Headings, paragraphs, list items, images, folds, links with their tag, and innermost divs of a page by offset, with their inner markup.

    Copy inside a fold belongs to the fold. A div counts if no other div and no block of copy, heading or form control is inside it.
    """

    def one(page: str | None):
        page, found, divs, run, head, fold, link = page or "", [], [], None, None, None, None

        def add(at: int, kind: str, level: int | None, raw: str) -> None:
            found.append({"at": at, "kind": kind, "level": level, "raw": raw})

        for m in _TAG.finditer(page):
            if m.group(3) is None:
                continue
            name, shuts, at = m.group(3).lower(), bool(m.group(2)), m.start()
            if run and name in _ENDS:
                add(run[0], "copy", None, page[run[1] : at])
                run = None
            if not shuts and name in _NOT_LOOSE:
                for d in divs:
                    d[2] = False
            if name == "details":
                if not shuts and fold is None:
                    fold = (at, m.end())
                elif shuts and fold:
                    add(fold[0], "fold", None, page[fold[1] : at])
                    fold = None
            elif name == "div":
                if not shuts:
                    for d in divs:
                        d[2] = False
                    divs.append([at, m.end(), True])
                elif divs:
                    start, inner, alone = divs.pop()
                    if alone and not fold:
                        add(start, "loose", None, page[inner:at])
            elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
                if not shuts:
                    head = (at, m.end(), name, m.group())
                elif head and head[2] == name:
                    if not places_hidden(head[3]):
                        add(head[0], "heading", int(name[1]), page[head[1] : at])
                    head = None
            elif name in ("p", "li") and not shuts and not fold:
                run = (at, m.end())
            elif name == "img" and not shuts:
                add(at, "image", None, m.group())
            elif name == "a":
                if shuts and link is not None:
                    add(link, "link", None, page[link:at])
                link = None if shuts else at if link is None else link
        if run:
            add(run[0], "copy", None, page[run[1] :])
        return sorted(found, key=lambda x: x["at"])

    return places.in_parts(batches, one)


def places_hidden(tag: str) -> bool:
    return bool(re.search(r"display\s*:\s*none", tag, re.I))


def page_stream(pages: DataFrame) -> DataFrame:
    """(page_id, at, kind, level, text, answer): the blocks of each page in order; ``answer`` is the copy of a fold, an image's text its alternative or file name.

    Empty blocks are left out, and loose text of over LOOSE characters. A page is one row, so nothing is shuffled.
    """
    rows = pages.select("page_id", F.explode_outer(blocks("html")).alias("b")).where("b is not null").select("page_id", "b.*")
    summary = r"(?is)<summary\b[^>]*>(.*?)</summary>"
    file = F.regexp_replace(F.regexp_replace(F.coalesce(T.attr(F.col("raw"), "src"), F.lit("")), r"[?#].*$", ""), "^.*/", "")
    picture = F.coalesce(F.nullif(T.attr(F.col("raw"), "alt"), F.lit("")), F.nullif(F.coalesce(F.try_url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), file), F.lit("")), F.lit("image"))
    text = F.when(F.col("kind") == "image", picture).when(F.col("kind") == "fold", T.strip_tags(F.regexp_extract("raw", summary, 1))).otherwise(T.strip_tags(F.col("raw")))
    answer = F.when(F.col("kind") == "fold", F.nullif(T.strip_tags(F.regexp_replace("raw", r"(?is)^.*?</summary>", "")), F.lit("")))
    out = rows.select("page_id", "at", "kind", "level", text.alias("text"), answer.alias("answer"))
    return out.where((F.col("kind") != "link") & (F.col("text") != "") & ((F.col("kind") != "loose") | (F.length("text") <= LOOSE)))


def landmarks(stream: DataFrame) -> DataFrame:
    """(page_id, at, kind, text, landmark, nth): every block but headings with the heading last above it, null before the first, and its number below that."""
    w = W.partitionBy("page_id").orderBy("at")
    rows = stream.withColumn("mark", F.last(F.when(F.col("kind") == "heading", F.struct("at", "text")), True).over(w)).where("kind <> 'heading'")
    nth = F.row_number().over(W.partitionBy("page_id", "mark.at").orderBy("at"))
    return rows.select("page_id", "at", "kind", "text", F.col("mark.text").alias("landmark"), nth.alias("nth"))


def brief_stream(briefs: DataFrame) -> DataFrame:
    """(page_id, at, kind, text, href): lines of labelled briefs (brief_id, text) as blocks; numbers of lines start at 1.

    Lines with a tab or a bullet before the copy are labels, of which the internal links count; copy starts at the first other line. A line with a number mark is a
    heading, one that names an asset an image, a short one that doesn't end as a sentence a heading too.
    """
    rows = briefs.select(F.col("brief_id").alias("page_id"), F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw")).select("page_id", (F.col("n") + 1).alias("at"), "raw").where("trim(raw) <> ''")
    # all that a line says by itself is read before the windows, so it is read once whatever reads the stream
    bullet = F.col("raw").rlike(r"^\s*●")
    mark, asset = r"^(.*?)\s*\[\d+\.\d+\]\s*$", r"(?i)Assets?\s*[-–]\s*(.+)$"
    rows = rows.select("page_id", "at", "raw", (F.contains("raw", F.lit("\t")) | bullet).alias("label"), F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("line"))
    rows = rows.select("*", F.trim(F.regexp_extract("line", mark, 1)).alias("mark"), F.regexp_extract("line", asset, 1).alias("asset"), F.when(F.col("label"), F.split("raw", r"\t")).alias("cells"))
    short = (F.length("line") <= HEADING_CHARS) & (F.size(F.split("line", " ")) <= HEADING_WORDS) & ~F.col("line").rlike(r"[.!]$")
    kind = F.when(F.col("mark") != "", "heading").when(F.col("asset") != "", "image").when(short, "heading").otherwise("copy")
    text = F.when(F.col("mark") != "", F.col("mark")).when(F.col("asset") != "", F.trim("asset")).otherwise(F.col("line"))
    href = F.trim(F.element_at("cells", -1))
    rows = rows.select("page_id", "at", "label", kind.alias("kind"), text.alias("text"), F.when(~bullet, F.lower(F.trim(F.col("cells")[0]))).alias("name"), F.when(href.rlike("(?i)^(https?://|/)"), href).alias("href"))
    w = W.partitionBy("page_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("copy", F.max(~F.col("label")).over(w))
    field = F.last(F.when(~F.col("copy"), F.col("name")), True).over(w)
    linked = ~F.col("copy") & (field == "internal links") & F.col("href").isNotNull()
    rows = rows.withColumn("linked", F.coalesce(linked, F.lit(False)))
    return rows.select("page_id", "at", F.when(F.col("linked"), "link").when(F.col("copy"), F.col("kind")).alias("kind"), F.when(F.col("linked"), F.col("href")).otherwise(F.col("text")).alias("text"), F.when(F.col("linked"), F.col("href")).alias("href")).where("kind is not null")


def _in_order(kind: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", value.alias("v"))))), lambda x: x["v"])


def leaves(stream: DataFrame) -> DataFrame:
    """(page_id, at, heading, body, image, links, rows): what stands below each heading; what stands before the first has a null heading.

    The first image below a heading is its own, later ones are left out.
    """
    href = F.col("href") if "href" in stream.columns else F.lit(None).cast("string")
    w = W.partitionBy("page_id").orderBy("at")
    rows = stream.withColumn("href", href).withColumn("head", F.last(F.when(F.col("kind") == "heading", F.struct("at", "text")), True).over(w))
    text = F.col("text")
    g = rows.groupBy("page_id", F.col("head.at").alias("head_at"), F.col("head.text").alias("heading"))
    return g.agg(_in_order("copy", text).alias("body"), F.get(_in_order("image", text), 0).alias("image"), F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "link", F.struct("at", F.col("text").alias("label"), "href")))), lambda x: F.struct(x["label"].alias("label"), x["href"].alias("href"))).alias("links"), F.array_sort(F.collect_list("at")).alias("rows")).select("page_id", F.coalesce("head_at", F.lit(0)).alias("at"), "heading", "body", "image", "links", "rows")


_COLUMNS = ("page_id", "at", "type", "tier", "confidence", "why", "heading", "subtitle", "body", "items", "image", "links", "rows")


def _unresolved(rows: DataFrame, text: Column, why: Column | str) -> DataFrame:
    return rows.select("page_id", "at", text.alias("text"), (F.lit(why) if isinstance(why, str) else why).alias("why"), "rows")


def fold(leaf: DataFrame, words: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Components of ``leaves``, and (page_id, at, text, why, rows) of what belongs to none: copy before the first heading, and headings of page chrome.

    Two or more neighbouring questions fold into an accordion, as many short titled texts into cards, or steps if all count. A bare heading right before such a run, or first in one
    of three and more, is the run's own title: one look back and one ahead over the runs. Links before the first heading are a call to action.
    """
    has = F.coalesce("heading", F.lit("")) != ""
    ahead = F.col("heading").isNull()
    only_links = ahead & (F.size("links") > 0) & (F.size("body") == 0) & F.col("image").isNull()
    chrome = has & is_chrome(F.col("heading"), words)
    lost = leaf.where((ahead & ~only_links) | chrome)
    text = F.when(ahead, F.substring(F.array_join(F.concat("body", F.array_compact(F.array("image"))), " / "), 1, 200)).otherwise(F.col("heading"))
    lost = _unresolved(lost, text, F.when(ahead, "stands before any heading").otherwise("names a part of the page's frame"))
    plain = F.col("image").isNull() & (F.size("links") == 0)
    question = has & F.col("heading").rlike(r"\?\s*$") & (F.size("body") == 1) & plain
    card = has & (F.size("body") <= 1) & plain & (F.coalesce(F.length(F.get("body", F.lit(0))), F.lit(0)) <= CARD)
    kept = leaf.where(only_links | (~ahead & ~chrome)).withColumn("cls", F.when(question, "q").when(card, "c").otherwise("n"))
    w = W.partitionBy("page_id").orderBy("at")
    kept = kept.withColumn("run", F.sum(((F.col("cls") == "n") | ~F.lag("cls").over(w).eqNullSafe(F.col("cls"))).cast("int")).over(w))
    one = F.struct("at", "heading", "body", "image", "links", "rows")
    runs = kept.groupBy("page_id", "run", "cls").agg(F.array_sort(F.collect_list(one)).alias("all")).withColumn("many", (F.col("cls") != "n") & (F.size("all") > 1))
    bare = lambda x: (F.coalesce(x["heading"], F.lit("")) != "") & (F.size(x["body"]) == 0) & x["image"].isNull() & (F.size(x["links"]) == 0)
    o = W.partitionBy("page_id").orderBy("run")
    first = F.get("all", 0)
    runs = runs.withColumn("bare", ~F.col("many") & bare(first)).withColumn("before", F.when(F.lag("bare").over(o), F.get(F.lag("all").over(o), 0))).withColumn("taken", F.col("bare") & F.coalesce(F.lead("many").over(o), F.lit(False))).where("not taken")
    inner = F.col("many") & F.col("before").isNull() & (F.size("all") >= 3) & bare(first)
    runs = runs.withColumn("lead", F.when(F.col("many"), F.coalesce("before", F.when(inner, first)))).withColumn("leaf", F.when(inner, F.slice("all", 2, 1 << 20)).otherwise(F.col("all")))
    item = lambda x: F.struct(x["heading"].alias("title"), F.get(x["body"], 0).alias("body"))
    one = F.get("leaf", 0)
    runs = runs.select("page_id", "cls", "many", "lead", "leaf", F.coalesce("lead.at", one["at"]).alias("at"), F.when(F.col("many"), F.col("lead.heading")).otherwise(one["heading"]).alias("heading"), F.when(F.col("many"), F.array().cast("array<string>")).otherwise(one["body"]).alias("body"), F.when(F.col("many"), F.transform("leaf", item)).otherwise(F.array().cast("array<struct<title:string,body:string>>")).alias("items"), F.when(~F.col("many"), one["image"]).alias("image"), F.when(F.col("many"), F.array().cast("array<struct<label:string,href:string>>")).otherwise(one["links"]).alias("links"), F.array_sort(F.array_distinct(F.concat(F.coalesce("lead.rows", F.array().cast("array<int>")), F.flatten(F.transform("leaf", lambda x: x["rows"]))))).alias("rows"))
    n = F.size("leaf").cast("string")
    under = F.coalesce(F.concat(F.lit(' under "'), "heading", F.lit('"')), F.lit(""))
    run_name = type_named(F.col("heading"), words)
    steps = F.forall("leaf", lambda x: x["heading"].rlike(ORDINAL))
    of_run = (
        F.when(F.col("cls") == "q", _verdict("accordion", "repeats", "medium", F.concat(n, F.lit(" questions in a row"), under)))
        .when(run_name.isNotNull(), _verdict(run_name, "named", "high", F.concat(F.lit("the text names it: "), quoted(F.col("heading")))))
        .when(steps, _verdict("steps", "repeats", "medium", F.concat(n, F.lit(" numbered titles in a row"), under))).otherwise(_verdict("cards", "repeats", "medium", F.concat(n, F.lit(" titled texts in a row"), under)))
    )
    named = first_named(F.array_compact(F.concat(F.array("heading"), F.transform("links", lambda x: x["label"]))), words)
    told = first_named(F.col("body"), words)
    slot = F.coalesce(*[F.when(F.col("heading").rlike(p), F.lit(t)) for t, p in SLOT_WORDS])
    runs = runs.withColumn("named", named).withColumn("told", told)
    of_leaf = (
        F.when(F.col("named").isNotNull(), _verdict(F.col("named.type"), "named", "high", F.concat(F.lit("the text names it: "), quoted(F.col("named.text")))))
        .when(F.col("told").isNotNull(), _verdict(F.col("told.type"), "named", "high", F.concat(F.lit("its copy names it: "), quoted(F.col("told.text")))))
        .when(slot.isNotNull(), _verdict(slot, "slot", "high", F.concat(F.lit("a heading with the word of a slot: "), quoted(F.col("heading")))))
        .otherwise(F.coalesce(by_shape(F.col("heading"), F.col("body"), F.col("image"), F.col("links")), _verdict(*GENERIC)))
    )
    done = runs.withColumn("v", F.when(F.col("many"), of_run).otherwise(of_leaf)).select("*", "v.*").withColumn("subtitle", F.lit(None).cast("string"))
    return done.select(*_COLUMNS), lost


def sections(stream: DataFrame, words: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Components of pages without modules, from the levels of their headings, and what belongs to none.

    The highest level opens sections; where it occurs once on a page and there is a lower one, the next level does too. Deeper headings are items of the
    section, each with the first copy below it; folds are items with question and answer. The last image of a section is its own; loose text is left to ``slots``.
    """
    page = W.partitionBy("page_id")
    w = page.orderBy("at")
    heading = F.col("kind") == "heading"
    rows = stream.withColumn("top", F.min(F.when(heading, F.col("level"))).over(page))
    rows = rows.withColumn("once", F.count_if(heading & (F.col("level") == F.col("top"))).over(page) == 1).withColumn("second", F.min(F.when(heading & (F.col("level") > F.col("top")), F.col("level"))).over(page))
    opens = heading & ((F.col("level") == F.col("top")) | (F.col("once") & (F.col("level") == F.col("second"))))
    # what comes first opens a section in any case, if it is a heading or a fold
    rows = rows.withColumn("entry", F.count_if(F.col("kind").isin("heading", "fold")).over(w)).withColumn("opens", opens | (F.col("kind").isin("heading", "fold") & (F.col("entry") == 1)))
    rows = rows.withColumn("section", F.last(F.when(F.col("opens"), F.struct("at", "kind", "text")), True).over(w))
    lost = rows.where("section is null").groupBy("page_id").agg(F.min("at").alias("at"), F.array_sort(F.collect_list("at")).alias("rows"), _in_order("copy", F.col("text")).alias("body"))
    lost = _unresolved(lost, F.substring(F.array_join("body", " / "), 1, 200), "stands before any heading")
    s = W.partitionBy("page_id", "section.at").orderBy("at")
    is_item = (F.col("kind") == "fold") | (heading & ~F.col("opens"))
    inside = rows.where("section is not null").withColumn("item", F.last(F.when(is_item, F.struct("at", "kind")), True).over(s))
    nth = F.row_number().over(W.partitionBy("page_id", "section.at", "item.at", "kind").orderBy("at"))
    inside = inside.withColumn("own", (F.col("kind") == "copy") & F.coalesce(F.col("item.kind") == "heading", F.lit(False)) & (nth == 1))
    below = F.first(F.when(F.col("own"), F.col("text")), True).over(W.partitionBy("page_id", "section.at", "item.at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    inside = inside.withColumn("below", below).withColumn("is_item", is_item)
    ordered = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("at", value.alias("v"))))), lambda x: x["v"])
    item = F.struct(F.col("text").alias("title"), F.when(F.col("kind") == "fold", F.col("answer")).otherwise(F.col("below")).alias("body"), (F.col("kind") == "fold").alias("asks"))
    g = inside.groupBy("page_id", F.col("section.at").alias("at"), F.when(F.col("section.kind") == "heading", F.col("section.text")).alias("heading"))
    g = g.agg(ordered(F.col("is_item"), item).alias("all"), ordered((F.col("kind") == "copy") & ~F.col("own"), F.col("text")).alias("body"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), ordered(F.col("kind") == "image", F.col("text"))), -1).alias("image"), F.array_sort(F.collect_list("at")).alias("rows"))
    chrome = F.col("heading").isNotNull() & is_chrome(F.col("heading"), words)
    lost = lost.unionByName(_unresolved(g.where(chrome), F.col("heading"), "names a part of the page's frame"))
    single = F.array(F.array_join(F.array_compact(F.array(F.get("all", 0)["title"], F.get("all", 0)["body"])), ": "))
    name = type_named(F.col("heading"), words)
    kept = g.where(~F.coalesce(chrome, F.lit(False))).withColumn("name", name)
    alone = F.col("name").isNull() & (F.size("all") == 1)
    kept = kept.withColumn("body", F.when(alone, F.concat("body", single)).otherwise(F.col("body"))).withColumn("items", F.when(alone, F.slice("all", 1, 0)).otherwise(F.col("all")))
    n, links = F.size("items").cast("string"), F.array().cast("array<struct<label:string,href:string>>")
    verdict = (
        F.when(F.col("name").isNotNull(), _verdict(F.col("name"), "named", "high", F.concat(F.lit("the text names it: "), quoted(F.col("heading")))))
        .when((F.size("items") >= 2) & F.exists("items", lambda x: x["asks"]), _verdict("accordion", "repeats", "medium", F.concat(n, F.lit(" questions with answers"))))
        .when((F.size("items") >= 2) & F.forall("items", lambda x: x["title"].rlike(ORDINAL)), _verdict("steps", "repeats", "medium", F.concat(n, F.lit(" numbered headings"))))
        .when(F.size("items") >= 2, _verdict("cards", "repeats", "medium", F.concat(n, F.lit(" headings below one"))))
        .otherwise(F.coalesce(by_shape(F.col("heading"), F.col("body"), F.col("image"), links), _verdict(*GENERIC)))
    )
    items = F.transform("items", lambda x: F.struct(x["title"].alias("title"), x["body"].alias("body")))
    done = kept.withColumn("v", verdict).withColumn("items", items).withColumn("links", links).withColumn("subtitle", F.lit(None).cast("string")).select("*", "v.*")
    return done.select(*_COLUMNS), lost


def field_roles(found: DataFrame) -> DataFrame:
    """Editor fields (page_id, module_at, at, path, value) with ``index``, the number in the part of their path that repeats, ``leaf``, the name behind it or the last, and ``role``."""
    part = r"(?:^|/)\w+\[(\d+)\](?=/|$)"
    index = F.regexp_extract("path", part, 1)
    last = F.regexp_extract("path", r"([^/]*)$", 1)
    behind = F.regexp_extract("path", r"^(?:[^/]*[^\]/]/)*?\w+\[\d+\]/(.+)$", 1)
    leaf = F.when(index == "", last).when(behind != "", behind).otherwise(F.regexp_extract("path", r"(?:^|/)(\w+\[\d+\])$", 1))
    rows = found.withColumn("index", F.nullif(index, F.lit("")).cast("int")).withColumn("leaf", leaf)
    return rows.withColumn("role", F.coalesce(*[F.when(F.col("leaf").rlike(p), F.lit(r)) for r, p in ROLES], F.lit(None).cast("string")))


def module_fields(found: DataFrame) -> DataFrame:
    """(page_id, module_at, heading, subtitle, body, cta, href, image, items, asks): the fields of each module by role.

    Fields whose path has an index are regrouped into items by it, in the order in which indexes first appear; the last value of a role within an item counts. Of fields that don't repeat the first
    heading, subtitle, image and call to action count, the last address, and all copy. An item needs a title, question, answer or copy.
    """
    rows = field_roles(found).withColumn("v", F.nullif(F.col("value"), F.lit("")))
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("v")), F.when(F.col("role") == role, F.col("at")))
    first = lambda role: F.min_by("v", F.when((F.col("role") == role) & F.col("v").isNotNull(), F.col("at")))
    items = rows.where("index is not null").groupBy("page_id", "module_at", "index").agg(F.min("at").alias("at"), last("question").alias("q"), last("answer").alias("a"), last("heading").alias("h"), last("body").alias("b"))
    items = items.where("q is not null or a is not null or h is not null or b is not null")
    item = lambda x: F.struct(F.when(F.col("asks"), F.coalesce(x["q"], x["h"])).otherwise(F.coalesce(x["h"], x["q"])).alias("title"), F.when(F.col("asks"), F.coalesce(x["a"], x["b"])).otherwise(F.coalesce(x["b"], x["a"])).alias("body"))
    items = items.groupBy("page_id", "module_at").agg(F.bool_or(F.col("q").isNotNull() | F.col("a").isNotNull()).alias("asks"), F.array_sort(F.collect_list(F.struct("at", "q", "a", "h", "b"))).alias("all")).select("page_id", "module_at", "asks", F.transform("all", item).alias("items"))
    body = F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "body") & F.col("v").isNotNull(), F.struct("at", "v")))), lambda x: x["v"])
    plain = rows.where("index is null").groupBy("page_id", "module_at").agg(first("heading").alias("heading"), first("subtitle").alias("subtitle"), body.alias("body"), first("cta").alias("cta"), last("href").alias("href"), first("image").alias("image"))
    return plain.join(items, ["page_id", "module_at"], "full")


def modules(pages: DataFrame, prefix: str = "module-", extra: tuple[str, ...] = ("hero-banner",), components: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """(page_id, at, name, label, nth, of, anchor, component, heading, text): outermost sections whose class names a module.

    The label is the name without its prefix, short words in capitals. ``components`` are (component, classes) as in ``components.component_of``: all its classes, the most first.
    """
    names = "|".join([rf"{re.escape(prefix)}[\w-]+", *map(re.escape, extra)])
    rows = pages.select("page_id", "html", places.marked_elements("html").alias("all")).select("page_id", "html", F.explode_outer(F.filter("all", lambda e: e["kind"] == "section")).alias("e")).where("e is not null")
    own = places._module(F.col("e.tag"), names)
    outer = ~F.exists("e.chain", lambda c: places._module(c["tag"], names).isNotNull())
    rows = rows.where(own.isNotNull() & outer).select("page_id", F.col("e.at").alias("at"), F.col("e.tag").alias("tag"), own.alias("name"), "html")
    inner = F.regexp_extract(F.col("html").substr(F.col("at") + 1, F.length("html")), r"(?is)^(<section\b(?:(?!</?section\b).)*+(?:<section\b(?:(?!</?section\b).)*+</section>(?:(?!</?section\b).)*+)*+</section>)", 1)
    words = F.split(F.when(F.col("name").startswith(prefix), F.substr("name", F.lit(len(prefix) + 1))).otherwise(F.col("name")), "-")
    label = F.array_join(F.transform(F.filter(words, lambda x: x != ""), lambda x, i: F.when(F.length(x) <= 3, F.upper(x)).when(i == 0, F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))).otherwise(x)), " ")
    best = sorted(components, key=lambda c: -len(c[1]))
    component = F.coalesce(*[F.when(F.size(F.array_except(F.array(*map(F.lit, need)), places.classes(F.col("tag")))) == 0, F.lit(n)) for n, need in best], F.lit(None).cast("string"))
    rows = rows.withColumn("inner", inner).withColumn("component", component)
    head = T.strip_tags(F.regexp_extract("inner", r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>", 1))
    w = W.partitionBy("page_id", "name")
    return rows.select("page_id", "at", "name", label.alias("label"), F.row_number().over(w.orderBy("at")).alias("nth"), F.count("*").over(w).alias("of"), T.attr(F.col("tag"), "id").alias("anchor"), "component", F.nullif(head, F.lit("")).alias("heading"), T.strip_tags(F.col("inner")).alias("text"))


def of_modules(found: DataFrame, fields: DataFrame, words: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Components of ``modules`` and their editor fields, and modules of page chrome, which are none.

    A module is typed by its component, else by a name in its label or heading, else by two or more items, else by shape. A module without any field is its heading, or its text.
    """
    label = F.concat("label", F.when(F.col("of") > 1, F.concat(F.lit(" #"), F.col("nth").cast("string"))).otherwise(""))
    by_field = module_fields(fields.where("module_at is not null")).withColumn("marked", F.lit(True))
    rows = found.withColumnRenamed("heading", "own").join(by_field.withColumnRenamed("module_at", "at"), ["page_id", "at"], "left").withColumn("title", label)
    chrome = is_chrome(F.coalesce(F.nullif("label", F.lit("")), "name"), words)
    lost = rows.where(chrome).withColumn("rows", F.array("at"))
    lost = _unresolved(lost, F.col("title"), "names a part of the page's frame")
    none = F.array().cast("array<string>")
    no_link = F.array().cast("array<struct<label:string,href:string>>")
    rows = rows.where(~chrome).withColumn("heading", F.coalesce("heading", "own")).withColumn("items", F.coalesce("items", F.array().cast("array<struct<title:string,body:string>>"))).withColumn("links", F.when(F.col("cta").isNotNull(), F.array(F.struct(F.col("cta").alias("label"), "href"))).otherwise(no_link)).withColumn("body", F.coalesce("body", none))
    empty = (F.size("items") == 0) & (F.size("body") == 0) & F.col("heading").isNull() & F.col("image").isNull() & (F.size("links") == 0)
    rows = rows.withColumn("body", F.when(empty & (F.coalesce("text", F.lit("")) != ""), F.array("text")).otherwise(F.col("body")))
    known = _lookup({_plain(n).replace(" ", ""): t for n, t in words.names.items()}, F.replace(label_key(F.col("component")), F.lit(" "), F.lit("")))
    named = F.coalesce(type_named(F.col("label"), words), type_named(F.col("heading"), words))
    asks, n = F.coalesce("asks", F.lit(False)), F.size("items").cast("string")
    verdict = (
        F.when(known.isNotNull(), _verdict(known, "named", "high", F.concat(F.when(F.col("marked"), "editor fields say ").otherwise("classes say "), "component")))
        .when(named.isNotNull(), _verdict(named, "named", "high", F.concat(F.lit("the page names it: "), F.coalesce(F.nullif("label", F.lit("")), "heading"))))
        .when((F.size("items") >= 2) & asks, _verdict("accordion", "repeats", "high", F.concat(n, F.lit(" questions in fields that repeat")))).when(F.size("items") >= 2, _verdict("cards", "repeats", "high", F.concat(n, F.lit(" fields that repeat"))))
        .otherwise(F.coalesce(by_shape(F.col("heading"), F.col("body"), F.col("image"), F.col("links")), _verdict(*GENERIC)))
    )
    done = rows.withColumn("v", verdict).withColumn("rows", F.array("at")).select("*", "v.*")
    return done.select(*_COLUMNS), lost


def slots(parts: DataFrame, words: Vocabulary) -> DataFrame:
    """``parts`` with ``slots``, (slot, text) in the order of the type's slots, and ``unmapped``, copy that no slot is left for.

    Introduction, body and description take one paragraph each in the order of the slots.
    """
    names = F.create_map(*[x for t, s in words.slots.items() for x in (F.lit(t), F.array(*map(F.lit, s)))]) if words.slots else None
    own = F.coalesce(F.try_element_at(names, F.col("type")), F.array().cast("array<string>")) if words.slots else F.array().cast("array<string>")
    prose = lambda s: s.isin("intro", "body", "description")
    rows = parts.withColumn("own", own).withColumn("copy", F.filter("own", prose))
    value = lambda s: F.when(s == "heading", F.col("heading")).when(s == "subtitle", F.col("subtitle")).when(s == "cta", F.coalesce(F.get("links", 0)["label"], F.get("links", 0)["href"])).when(s == "media", F.col("image")).when(prose(s), F.get("body", F.array_position("copy", s).cast("int") - 1))
    filled = F.filter(F.transform("own", lambda s: F.struct(s.alias("slot"), value(s).alias("text"))), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    return rows.withColumn("slots", filled).withColumn("unmapped", F.slice("body", F.size("copy") + 1, 1 << 20)).drop("own", "copy")


def build(parts: DataFrame, lost: DataFrame, ids: DataFrame, origin: str, words: Vocabulary) -> DataFrame:
    """(page_id, origin, template, confidence, components, unresolved, open_items, manifest): one model for each of ``ids`` (page_id), the same from a brief and from a page.

    The template is the one with most types of which all occur; it is medium sure if the page has more components than the template types. Open items are texts that say
    they are to be confirmed. The manifest is JSON of the components in order.
    """
    texts = F.array_compact(F.concat(F.array("heading", "subtitle"), "body", F.transform("items", lambda x: x["title"]), F.transform("items", lambda x: x["body"])))
    rows = slots(parts, words).withColumn("open", F.size(F.filter(texts, lambda t: t.rlike(r"(?i)\b(TBD|TBC|to be confirmed|to confirm)\b|\[\s*placeholder\s*\]|\[\s*\]"))))
    one = F.struct("at", "type", "tier", "confidence", "why", "heading", "subtitle", "body", "items", "image", "links", "rows", "slots", "unmapped")
    per = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("all"), F.sum("open").alias("open_items"))
    gone = lost.groupBy("page_id").agg(F.count("*").alias("unresolved"))
    best = sorted(words.templates, key=lambda t: -len(t[1]))
    types = F.transform("all", lambda x: x["type"])
    fits = [F.when(F.size(F.array_except(F.array(*map(F.lit, need)), types)) == 0, F.struct(F.lit(n).alias("name"), F.when(F.size("all") > len(need), "medium").otherwise("low").alias("sure"))) for n, need in best]
    template = F.coalesce(*fits, F.struct(F.lit("unknown").alias("name"), F.lit("low").alias("sure")))
    out = ids.select("page_id").distinct().join(per, "page_id", "left").join(gone, "page_id", "left").withColumn("all", F.coalesce("all", F.slice("all", 1, 0))).withColumn("t", template)
    n = F.coalesce(F.size("all"), F.lit(0))
    return out.select("page_id", F.lit(origin).alias("origin"), F.col("t.name").alias("template"), F.col("t.sure").alias("confidence"), F.when(n > 0, n).otherwise(0).cast("long").alias("components"), F.coalesce("unresolved", F.lit(0)).cast("long").alias("unresolved"), F.coalesce("open_items", F.lit(0)).cast("long").alias("open_items"), F.coalesce(F.to_json("all"), F.lit("[]")).alias("manifest"))


def from_briefs(briefs: DataFrame, words: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Components and unresolved rows of labelled briefs (brief_id, text)."""
    return fold(leaves(brief_stream(briefs)), words)


def from_pages(pages: DataFrame, words: Vocabulary, components: list[tuple[str, list[str]]] = ()) -> tuple[DataFrame, DataFrame]:
    """Components and unresolved rows of pages: by their modules where a page has some, else by the levels of its headings."""
    found = modules(pages, components=components)
    parts, lost = of_modules(found, places.fields(pages), words)
    plain, gone = sections(page_stream(pages.join(found.select("page_id").distinct(), "page_id", "left_anti")), words)
    return parts.unionByName(plain), lost.unionByName(gone)
