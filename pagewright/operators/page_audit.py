"""All rules of a page over one record of it: the markup is scanned once, every rule reads the record, and nothing is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import head_rules, link_rules, list_rules, markup, rules


#: The note of an internal address.
LEAK = "internal host"


def _each(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all("html", F.lit(pattern), F.lit(group))


def _tag(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)^(<[^>]*>)", 1)


def record(pages: DataFrame) -> DataFrame:
    """One row for each page (page_id, url, html) with all that its rules read: head, languages, headings, anchors, paragraphs, images, resources, alternates and lists, each in order.

    Lists hold what the functions of ``markup`` and ``list_rules`` give as rows. Null markup gives an empty record.
    """
    rows = head_rules.facts(pages.withColumn("html", F.coalesce("html", F.lit(""))))
    page, other = rules.languages(F.col("html"))
    names = "a|img|script|iframe|source|link|video|audio|embed"
    lazy = lambda t: F.coalesce(T.attr(t, "data-src"), T.attr(t, "data-lazy-src"))
    src = lambda t: F.when(lazy(t).isNotNull() & F.coalesce(T.attr(t, "src"), F.lit("")).rlike("^$|^data:"), lazy(t)).otherwise(T.attr(t, "src"))
    flat = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1>", " ")
    pieces = F.filter(F.split(flat, r"(?i)(?=</?(?:ul|ol)\b)"), lambda x: x.rlike(r"(?i)^</?(ul|ol)\b"))
    rows = rows.select(
        "*", page.alias("lang"), other.alias("data_lang"), F.col("html").rlike(r"(?is)<title\b[^>]*>.*?</title>").alias("has_title"), F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1).alias("title_tag"),
        markup.meta(F.col("html"), "keywords").alias("keywords"), markup.meta(F.col("html"), "description").alias("description"),
        _each(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]>)").alias("h"), _each(r"(?is)(<a\b[^>]*>.*?</a>)").alias("a"), _each(r"(?i)(<img\b[^>]*>)").alias("i"), _each(rf"(?i)(<(?:{names})\b[^>]*>)").alias("r"), _each(r"(?i)(<link\b[^>]*hreflang[^>]*>)").alias("l"),
        _each(r"(?is)(<(?:p|li)\b[^>]*>.*?(?=</?(?:p|li|ul|ol|div|article|section|footer|body)\b))").alias("p"), pieces.alias("u"),
    ).drop("html")
    inner = F.filter(F.transform("u", lambda x, i: F.when(x.rlike("^<[^/]") & F.coalesce(F.get("u", i + 1), F.lit("")).startswith("</"), x)), lambda x: x.isNotNull())
    items = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), T.strip_tags)
    return rows.select(
        "page_id", "url", "title", "canonical", "h1", "og_url", "og_image", "card", "card_image", "robots", "environment", "lang", "data_lang", "has_title", T.decode_entities(F.col("title_tag")).alias("title_raw"), T.normalise(F.col("title_tag")).alias("title_text"), "keywords", "description",
        F.transform("h", lambda x: F.struct(F.substring(x, 3, 1).cast("int").alias("level"), T.strip_tags(x).alias("text"), _tag(x).rlike(r"(?i)display\s*:\s*none").alias("hidden"))).alias("headings"),
        F.transform("a", lambda x: F.struct(_tag(x).alias("tag"), T.attr(_tag(x), "href").alias("href"), T.strip_tags(x).alias("text"), T.attr(F.regexp_extract(x, r"(?is)(<img\b[^>]*>)", 1), "alt").alias("alt"))).alias("anchors"),
        F.filter(F.transform("p", lambda x: F.struct(F.lower(F.regexp_extract(x, r"^<(\w+)", 1)).alias("tag"), T.strip_tags(x).alias("text"))), lambda x: x["text"] != "").alias("paragraphs"),
        F.transform("i", lambda x: F.struct(src(x).alias("src"), T.attr(x, "alt").alias("alt"))).alias("images"),
        F.filter(F.transform("r", lambda x: F.struct(F.lower(F.regexp_extract(x, r"^<(\w+)", 1)).alias("tag"), F.coalesce(T.attr(x, "src"), T.attr(x, "href")).alias("url"), T.attr(x, "rel").alias("rel"))), lambda x: x["url"].isNotNull()).alias("resources"),
        F.transform("l", lambda x: F.struct(F.trim(F.lower(T.attr(x, "hreflang"))).alias("code"), T.attr(x, "href").alias("href"))).alias("alternates"),
        F.filter(F.transform(inner, lambda x: F.struct(F.lower(F.substring(x, 2, 2)).alias("tag"), F.regexp_extract(x, r"(?s)^<\w+([^>]*)>", 1).alias("attributes"), items(x).alias("items"))), lambda x: (F.size(x["items"]) > 0) & ~x["attributes"].rlike("breadcrumb")).alias("lists"),
    )


def _found(category: str | Column, severity: str | Column, field: str, found: Column | None, note: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(category).alias("category"), lit(severity).alias("severity"), F.lit(field).alias("field"), (F.lit(None) if found is None else found).cast("string").alias("found"), lit(note).alias("note"))


def _when(*items: tuple) -> Column:
    """Findings of conditions (condition, category, severity, field, found, note) on one record or list entry; a null condition is none."""
    return F.filter(F.array(*[F.when(c, _found(*rest)) for c, *rest in items]), lambda x: x.isNotNull())


def _first(entries: Column, key) -> Column:
    """Entries of which none before has the same key."""
    return F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda y: key(y).eqNullSafe(key(x))))


def _titles() -> Column:
    c = F.col
    parts = F.transform(F.split(F.lower("title_text"), r"\s+[-–|]\s+"), lambda x: F.trim(x))
    plain = lambda x: F.regexp_replace(x, "/+$", "")
    titled, named = T.keywords_of(c("title"), head_rules.TITLE_STOP_WORDS), T.keywords_of(T.strip_tags(c("h1")), head_rules.TITLE_STOP_WORDS)
    apart = (F.size(titled) > 0) & (F.size(named) > 0) & ~F.arrays_overlap(titled, named)
    part = T.duplicate_part(c("title"))
    m = ("metadata", "check")
    return _when(
        (~c("has_title") | (c("title_text") == ""), "metadata", "break", "Title", None, "no title"), (c("has_title") & (c("title_raw") != F.trim("title_raw")), *m, "Title", c("title_raw"), "leading or trailing spaces"),
        (F.length("title_text") > 60, *m, "Title", c("title_text"), "over 60 characters"), ((c("title_text") != "") & (F.size(F.array_distinct(parts)) < F.size(parts)), *m, "Title", c("title_text"), "a part repeats"),
        (F.substring(F.lower("lang"), 1, 2) != F.substring(F.lower("data_lang"), 1, 2), "metadata", "break", "Page language", c("data_lang"), "lang and data-lang disagree"), (c("keywords") == "", *m, "Keywords", None, "keywords are empty"),
        (c("description").isNull() | (c("description") == ""), *m, "Description", None, "no description"), ((c("description") != "") & ~F.length("description").between(70, 160), *m, "Description", F.length("description"), "not 70 to 160 characters"),
        ((c("environment") == "production") & F.lower("robots").contains("noindex"), *m, "Robots", c("robots"), "production page is kept from search"), (part.isNotNull(), *m, "Page title", part, "site name doubled or repeated in part"),
        (c("canonical").rlike(r"(?i)\.aspx(?=$|[?#])"), *m, "Canonical", c("canonical"), "old page ending"), (plain(c("og_url")) != plain(c("canonical")), *m, "og:url", c("og_url"), "differs from the canonical"),
        ((c("card") == "summary") & (c("og_image") != ""), *m, "twitter:card", c("card"), "share image shown small"), ((c("card_image") != "") & (c("og_image") != "") & (c("card_image") != c("og_image")), *m, "twitter:image", c("card_image"), "two share images"),
        (c("h1").rlike(r"(?i)<br\s*/?>"), *m, "H1", T.strip_tags(c("h1")), "broken over lines"), (apart, *m, "H1", T.strip_tags(c("h1")), "shares no keyword with the title"),
    )


def _headings() -> Column:
    shown = F.filter("headings", lambda x: ~x["hidden"] & (x["level"] <= 3))
    ones = F.size(F.filter(shown, lambda x: x["level"] == 1))
    key = lambda x: F.lower(x["text"])
    named = F.filter(shown, lambda x: x["text"] != "")
    again = F.filter(named, lambda x, i: F.size(F.filter(F.slice(named, F.lit(1), i), lambda y: key(y) == key(x))) == 1)
    return F.concat(_when((ones == 0, "headings", "break", "H1", None, "no H1"), (ones > 1, "headings", "break", "H1", ones, "more than one H1")), F.transform(again, lambda x: _found("headings", "break", "Heading", x["text"], "heading repeats")))


def _anchors(generic: tuple[str, ...]) -> Column:
    href = lambda x: F.coalesce(x["href"], F.lit(""))
    safe = lambda x: x["tag"].rlike(markup.SAFE_ATTRIBUTES) | F.lower(x["text"]).rlike(markup.SAFE_LABELS)
    idle = F.filter("anchors", lambda x: href(x).isin("", "#") & ~safe(x))
    real = F.filter("anchors", lambda x: x["href"].isNotNull() & ~F.trim(x["href"]).isin("", "#"))
    name = lambda x: F.trim(F.regexp_replace(x["text"], r"[\s→›»>.…]+$", ""))
    label = lambda x: F.concat(*[F.coalesce(c, F.lit("")) for c in (T.attr(x["tag"], "aria-label"), T.attr(x["tag"], "title"), x["alt"])])
    words = F.split(F.lit("\n".join(generic)), "\n")
    vague = F.filter(F.transform(real, lambda x: F.struct(F.lower(name(x)).alias("key"), x["href"].alias("href"), name(x).alias("name"))), lambda x: F.array_contains(words, x["key"]))
    return F.concat(
        F.transform(idle, lambda x: _found("links", "break", "Link", x["text"], "placeholder link")), F.transform(F.filter(real, lambda x: (name(x) == "") & (F.trim(label(x)) == "")), lambda x: _found("links", "break", "Link text", x["href"], "link without a name")),
        F.transform(_first(vague, lambda x: F.struct(x["key"], x["href"])), lambda x: _found("links", "check", "Link text", F.concat_ws(" -> ", x["name"], x["href"]), "link text says nothing about its target")),
    )


def _resources(internal: tuple[str, ...]) -> Column:
    category = lambda x: F.when(x["tag"] == "a", "links").when(x["tag"].isin(*link_rules.PASSIVE), "images").otherwise("structure")
    used = lambda x: (x["tag"] != "link") | F.coalesce(F.lower(x["rel"]).rlike("stylesheet|icon|preload|manifest"), F.lit(False))
    plain = F.when(F.col("canonical").rlike("(?i)^https://"), F.filter("resources", lambda x: (x["tag"] != "a") & x["url"].rlike("(?i)^http://") & used(x)))
    active = lambda x: x["tag"].isin(*link_rules.ACTIVE)
    none = F.array().cast("array<struct<category:string,severity:string,field:string,found:string,note:string>>")
    mixed = F.transform(_first(plain, lambda x: x["url"]), lambda x: _found(category(x), F.when(active(x), "break").otherwise("check"), "Mixed content", x["url"], F.when(active(x), "browsers block it").otherwise("browsers warn of it")))
    host = lambda x: U.host_of(x["url"])
    inside = F.filter("resources", lambda x: x["url"].rlike(r"(?i)^(https?:)?//") & ~x["url"].eqNullSafe(F.col("canonical")) & reduce(lambda a, b: a | b, [host(x).contains(h) for h in internal]))
    once = _first(inside, lambda x: x["url"])
    built = F.col("environment").isin("preview", "author")
    severity = F.when(F.col("environment") == "production", "break").otherwise("check")
    told = lambda x: F.struct(category(x).alias("category"), severity.alias("severity"), F.concat(F.lit("<"), x["tag"], F.lit(">")).alias("field"), x["url"].alias("found"), F.lit(LEAK).alias("note"))
    leaks = F.when(~built, F.transform(once, told)).when(F.size(once) > 0, F.array(_found("links", "check", "Internal hosts", F.size(once), "internal links, expected on this build")))
    return F.concat(F.coalesce(mixed, none), F.coalesce(leaks, none))


def _alternates() -> Column:
    own = F.concat(U.host_of(F.col("canonical")), U.path_of(F.col("canonical")))
    mine = F.exists("alternates", lambda x: F.concat(U.host_of(x["href"]), U.path_of(x["href"])) == own)
    codes = F.filter(F.transform("alternates", lambda x: x["code"]), lambda x: x.isNotNull())
    twice = F.filter(F.array_distinct(codes), lambda x: F.size(F.filter(codes, lambda y: y == x)) > 1)
    n = F.size(codes)
    return F.concat(
        _when((n == 0, "metadata", "check", "hreflang", None, "no alternates"), ((n > 0) & F.col("canonical").isNotNull() & ~F.coalesce(mine, F.lit(False)), "metadata", "check", "hreflang", n, "no alternate names the page itself")),
        F.transform(F.filter(codes, lambda x: ~x.rlike(head_rules.HREFLANG)), lambda x: _found("metadata", "break", "hreflang", x, "no valid code")), F.transform(twice, lambda x: _found("metadata", "break", "hreflang", x, "declared more than once")),
    )


def _lists() -> Column:
    def of(x: Column) -> Column:
        items = x["items"]
        colon = F.filter(items, lambda t, i: t.rlike(":$") & (i < F.size(items) - 1))
        body = F.filter(items, lambda t: (t != "") & ~t.rlike(":$"))
        stops, n = F.size(F.filter(body, lambda t: t.rlike(r"[.!?]$"))), F.size(body)
        return _when(
            (F.size(colon) > 0, "lists", "check", "Flattened list", F.array_join(colon, " / "), "points belong below these items"), ((stops > 0) & (stops < n) & (n >= 3), "lists", "check", "Mixed punctuation", F.concat_ws(" of ", stops.cast("string"), n.cast("string")), "items end in a full stop, others don't"),
            ((x["tag"] == "ol") & F.exists(items, lambda t: t.rlike(r"^\d+[.)]\s")), "lists", "break", "Double numbering", items[0], "typed numbers in a numbered list"), (F.exists(items, lambda t: t == ""), "lists", "check", "Empty list item", None, "empty item"),
            ((F.size(items) == 1) & ~x["attributes"].rlike("accordion"), "lists", "check", "Single-item list", items[0], "one item"),
        )

    numbers = F.transform(F.filter("headings", lambda x: x["text"].rlike(r"^\d+[.)]\s")), lambda x: F.regexp_extract(x["text"], r"^(\d+)", 1).cast("long"))
    gap = F.exists(F.transform(numbers, lambda x, i: (i > 0) & (x != F.get(numbers, i - 1) + 1)), lambda x: x)
    bullets = F.size(F.filter("paragraphs", lambda x: x["text"].rlike(r"^[•·▪●◦‣]\s*|^[-–—]\s+")))
    item = lambda x: (x["tag"] == "p") & (F.length(x["text"]) <= list_rules.ITEM_CHARS) & ~x["text"].rlike(r"[.!?:]$")
    after = lambda k: F.coalesce(item(F.get("paragraphs", k)), F.lit(False))
    written = F.filter("paragraphs", lambda x, i: ~item(x) & x["text"].rlike(":$") & reduce(lambda a, b: a & b, [after(i + k) for k in range(1, list_rules.LEAST_ITEMS + 1)]))
    return F.concat(
        F.flatten(F.transform("lists", of)), _when((gap, "lists", "break", "Typed numbering", F.size(numbers), "typed numbers skip or repeat"), (~gap & (F.size(numbers) > 0), "lists", "check", "Typed numbering", F.size(numbers), "numbers typed into headings"), (bullets > 0, "lists", "check", "Typed bullets", bullets, "paragraphs start with a typed bullet")),
        F.transform(written, lambda x: _found("lists", "check", "List as paragraphs", x["text"], "items written as paragraphs")),
    )


def _images() -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.flatten(F.transform("images", lambda x: _when((blank(x["src"]), "images", "break", "Image", F.coalesce(F.nullif(x["alt"], F.lit("")), F.lit("(no alt)")), "image without a source"), (~blank(x["src"]) & blank(x["alt"]), "images", "break", "Image", x["src"], "image without alternative text"))))


def audit(records: DataFrame, generic: tuple[str, ...] = rules.GENERIC_LINK_TEXT, internal: tuple[str, ...] = link_rules.INTERNAL_HOSTS, suppress: bool = True) -> DataFrame:
    """(page_id, category, severity, field, found, note): findings of all page rules over ``record`` rows.

    With ``suppress``, an internal address that another finding of the page names already is not told again. All rules are expressions over a page's own row: one scan, no shuffle.
    """
    parts = {"head": _titles(), "heads": _headings(), "links": _anchors(generic), "alts": _alternates(), "lists_": _lists(), "pics": _images(), "own": _resources(internal)}
    rows = records.select("page_id", *[c.alias(k) for k, c in parts.items()])
    told = F.concat(*[k for k in parts if k != "own"])
    mixed = F.filter("own", lambda x: x["note"] != LEAK)
    leaks = F.filter("own", lambda x: x["note"] == LEAK)
    if suppress:
        known = F.transform(F.concat(F.col("told"), mixed), lambda x: x["found"])
        leaks = F.filter(leaks, lambda x: ~F.coalesce(F.array_contains(F.col("known"), x["found"]), F.lit(False)))
        rows = rows.withColumn("told", told).withColumn("known", F.filter(known, lambda x: x.isNotNull()))
    else:
        rows = rows.withColumn("told", told)
    return rows.select("page_id", F.explode_outer(F.concat(F.col("told"), mixed, leaks)).alias("x")).where("x is not null").select("page_id", "x.*")
