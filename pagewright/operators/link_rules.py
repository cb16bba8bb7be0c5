"""Checks of where a page's links and resources lead; findings as in ``rules``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import markup, matching, model
from pagewright.operators.head_rules import facts
from pagewright.operators.rules import finding, union

# fixed values: parts of host names that no visitor can reach
INTERNAL_HOSTS = ("preview.", "preview-training.", "staging", "-dev.", "localhost", "127.0.0.1")
# fixed values: elements whose plain http is blocked, and those that browsers only warn of
ACTIVE, PASSIVE = ("script", "iframe", "embed", "link"), ("img", "source", "video", "audio")


def _category():
    return F.when(F.col("tag") == "a", "links").when(F.col("tag").isin(*PASSIVE), "images").otherwise("structure")


def leakage_findings(pages: DataFrame, internal: tuple[str, ...] = INTERNAL_HOSTS) -> DataFrame:
    """Links to internal hosts: each address once, a break on production pages; on preview and author builds one note a page."""
    rows = markup.resources(pages).withColumn("host", U.host_of(F.col("url"))).join(facts(pages).select("page_id", "canonical", "environment"), "page_id")
    rows = rows.where(F.col("url").rlike(r"(?i)^(https?:)?//") & ~F.col("url").eqNullSafe(F.col("canonical")))
    inside = rows.where(reduce(lambda a, b: a | b, [F.col("host").contains(h) for h in internal]))
    once = inside.groupBy("page_id", "url", "environment").agg(F.min(F.struct("ord", "tag")).alias("x")).withColumn("tag", F.col("x.tag"))
    built = once.where(F.col("environment").isin("preview", "author")).groupBy("page_id").agg(F.count("*").alias("n"))
    out = once.where(~F.col("environment").isin("preview", "author"))
    found = out.select("page_id", _category().alias("category"), F.when(F.col("environment") == "production", "break").otherwise("check").alias("severity"), F.concat(F.lit("<"), "tag", F.lit(">")).alias("field"), F.col("url").alias("found"), F.lit("internal host").alias("note"))
    return union([found, finding(built, "links", "check", "Internal hosts", F.col("n"), "internal links, expected on this build")])


def mixed_content_findings(pages: DataFrame) -> DataFrame:
    """Plain http on pages whose canonical is https, each address once: a break where browsers block it."""
    secure = facts(pages).where(F.col("canonical").rlike("(?i)^https://")).select("page_id")
    used = (F.col("tag") != "link") | F.coalesce(F.lower("rel").rlike("stylesheet|icon|preload|manifest"), F.lit(False))
    rows = markup.resources(pages).where((F.col("tag") != "a") & F.col("url").rlike("(?i)^http://") & used).join(secure, "page_id")
    once = rows.groupBy("page_id", "url").agg(F.min(F.struct("ord", "tag")).alias("x")).withColumn("tag", F.col("x.tag"))
    active = F.col("tag").isin(*ACTIVE)
    return once.select("page_id", _category().alias("category"), F.when(active, "break").otherwise("check").alias("severity"), F.lit("Mixed content").alias("field"), F.col("url").alias("found"), F.when(active, "browsers block it").otherwise("browsers warn of it").alias("note"))


def targets(pages: DataFrame) -> DataFrame:
    """(page_id, dst, places): the distinct http(s) addresses that a page's anchors lead to, and how many do."""
    rows = markup.anchors(pages).join(pages.select("page_id", "url"), "page_id")
    return rows.select("page_id", U.absolute("href", "url").alias("dst")).where("dst is not null").groupBy("page_id", "dst").agg(F.count("*").alias("places"))


def status_findings(links: DataFrame, statuses: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """Links (page_id, dst) that are dead or could not be verified, own and external ones apart; ``statuses`` is (dst, verdict, status, reason).

    Every distinct address is judged once and joined back, so a link that all pages carry is one row of ``statuses``.
    """
    host = U.host_of(F.col("dst"))
    own = reduce(lambda a, b: a | b, [(host == d) | host.endswith(f".{d}") for d in domains], F.lit(False))
    rows = links.join(statuses, "dst").withColumn("kind", F.when(own, "own").otherwise("external"))
    dead = F.col("verdict") == "dead"
    bad = rows.where(dead | F.col("verdict").isin("unverified", "refused"))
    return bad.select("page_id", F.lit("links").alias("category"), F.when(dead, "break").otherwise("check").alias("severity"), F.concat(F.when(dead, "Broken link (").otherwise("Link not verified ("), "kind", F.lit(")")).alias("field"), F.col("dst").alias("found"), F.coalesce("reason", F.concat(F.lit("answered "), F.col("status").cast("string")), F.lit("no answer")).alias("note"))


def cross_market_findings(pages: DataFrame, market: DataFrame, registry: DataFrame) -> DataFrame:
    """Links that leave a page's market but not its domain, one finding for each other place with the number of links.

    ``market`` is (page_id, market, base, domain, prefix); ``registry`` (market, base, domain, prefix) is configuration of
    tens of rows. Pages of whole-domain markets, and domains that hold languages of one market only, are left alone.
    """
    shared = registry.groupBy("domain").agg(F.count_distinct("base").alias("bases")).where("bases > 1").select("domain")
    mine = market.where("prefix <> ''").join(shared, "domain")
    to = targets(pages).withColumn("host", U.bare_host(F.col("dst"))).withColumn("path", F.regexp_replace(U.path_of(F.col("dst")), r"\?.*$", ""))
    out = mine.join(to, "page_id").where((F.col("host") == F.col("domain")) & ~U.under_path(F.col("path"), F.col("prefix")) & ~F.col("path").rlike(r"^/(content/dam|etc\.clientlibs)/"))
    r = registry.select(F.col("domain").alias("d"), F.col("prefix").alias("p"), F.col("market").alias("other")).where("p <> ''")
    near = out.join(r, (F.col("domain") == F.col("d")) & U.under_path(F.col("path"), F.col("p")), "left")
    named = near.groupBy("page_id", "dst", "path", "places").agg(F.max_by("p", F.length("p")).alias("p"), F.max_by("other", F.length("p")).alias("other"))
    key = F.coalesce("p", F.concat(F.lit("/"), F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(2)), F.lit(""))))
    per = named.groupBy("page_id", key.alias("to"), "other").agg(F.sum("places").alias("n"))
    return finding(per, "links", "check", "Cross-market link", F.concat_ws(" ", "n", F.lit("to"), "to", "other"), "leads out of the page's market")


def rulings_of(links: DataFrame, rulings: list[tuple[str | None, str, str, str]]) -> DataFrame:
    """(page_id, text, href, verdict): the first ruling (site, pattern of texts, target, verdict) that fits each link.

    The list is configuration; it becomes one expression, so no join is needed.
    """
    host, path = U.host_of(F.col("href")), U.path_of(F.col("href"))
    fits = [F.when(F.col("text").rlike(f"(?i){rx}") & (path == to.lower()) & (F.lit(site is None) | (host == (site or ""))), F.lit(verdict)) for site, rx, to, verdict in rulings]
    return links.select("page_id", "text", "href", F.coalesce(*fits, F.lit(None).cast("string")).alias("verdict"))


def _judged(verdict: str, reason: str, suggested=None, sure=None):
    none = F.array().cast("array<string>")
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"), (none if suggested is None else F.coalesce(suggested, none)).alias("suggested"), F.coalesce(F.lit(False) if sure is None else sure, F.lit(False)).alias("confident"))


def _by_text(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, key, paths, best, score, sure): suggestions for each different bag of words of a host's links; a text that all pages carry is looked up once."""
    texts = rows.where("size(tt) > 0").groupBy("host", "key").agg(F.min("text").alias("text")).select(F.struct("host", "key").alias("text_id"), "host", "text", F.lit(None).cast("string").alias("exclude"))
    found = matching.suggest(texts, entries)
    paths = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "score"))), lambda x: F.struct(x["path"].alias("path"), x["score"].alias("score")))
    rows = found.groupBy("text_id").agg(paths.alias("all"))
    top, second = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    sure = (top["score"] >= 0.5) & (second.isNull() | (top["score"] - second["score"] >= 0.1) | second["path"].startswith(F.concat(top["path"], F.lit("/"))))
    return rows.select("text_id.host", "text_id.key", F.transform("all", lambda x: x["path"]).alias("paths"), top["path"].alias("best"), top["score"].alias("score"), F.coalesce(sure, F.lit(False)).alias("sure"))


def _by_title(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, title, named): pages (path, words) that each different title above a link without words names in full."""
    titles = rows.where("title is not null").select("host", "title").distinct().select(F.struct("host", "title").alias("text_id"), "host", F.col("title").alias("text"))
    found = matching.context_suggest(titles, entries, 4)
    named = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "words"))), lambda x: F.struct(x["path"].alias("path"), x["words"].alias("words")))
    return found.groupBy("text_id").agg(named.alias("named")).select("text_id.host", "text_id.title", "named")


def own_links(pages: DataFrame, most: int = 4, untitled: int = 2) -> DataFrame:
    """(page_id, host, own, at, tag, href, text, tt, title, near): links of each page with the words ``tt`` of their text.

    Links without words get the title above them and the words ``near`` them: of that title and the last ``most`` paragraphs in between, ``untitled`` where there is no title, their own text left out.
    A page is one row until its links part, so nothing is shuffled.
    """
    of = lambda cond: F.filter("b", cond)
    shown = lambda x: F.when(x["kind"] == "fold", F.regexp_extract(x["raw"], r"(?is)<summary\b[^>]*>(.*?)</summary>", 1)).otherwise(x["raw"])
    texts = lambda xs: F.filter(F.transform(xs, lambda x: F.struct(x["at"].alias("at"), T.strip_tags(shown(x)).alias("text"))), lambda x: x["text"] != "")
    rows = pages.select("page_id", U.host_of(F.col("url")).alias("host"), F.regexp_replace(U.path_of(F.col("url")), r"\?.*$", "").alias("own"), model.blocks("html").alias("b")).select(
        "page_id", "host", "own", texts(of(lambda x: ((x["kind"] == "heading") & (x["level"] <= 3)) | (x["kind"] == "fold"))).alias("titles"), texts(of(lambda x: x["kind"] == "copy")).alias("copy"),
        F.transform(of(lambda x: x["kind"] == "link"), lambda x: F.struct(x["at"].alias("at"), F.regexp_extract(x["raw"], r"(?s)^(<[^>]*>)", 1).alias("tag"), T.strip_tags(x["raw"]).alias("text"))).alias("links"),
    )
    one = rows.select("page_id", "host", "own", "titles", "copy", F.explode_outer("links").alias("l")).where("l is not null").select("page_id", "host", "own", "l.*", matching.tokens(F.col("l.text")).alias("tt"), "titles", "copy")
    title = F.when(F.size("tt") == 0, F.try_element_at(F.filter("titles", lambda t: t["at"] < F.col("at")), F.lit(-1)))
    one = one.withColumn("over", title)
    between = F.filter("copy", lambda p: (p["at"] < F.col("at")) & (F.col("over").isNull() | (p["at"] > F.col("over.at"))) & (p["text"] != F.col("text")))
    one = one.withColumn("between", F.when(F.size("tt") == 0, between)).withColumn("keep", F.when(F.col("over").isNull(), untitled).otherwise(most))
    body = F.transform(F.slice("between", F.greatest(F.size("between") - F.col("keep") + 1, F.lit(1)), F.col("keep")), lambda p: p["text"])
    near = F.when(F.size("tt") == 0, F.array_union(matching.tokens(F.coalesce("over.text", F.lit(""))), matching.tokens(F.coalesce(F.array_join(body, " "), F.lit("")))))
    return one.select("page_id", "host", "own", "at", "tag", F.trim(F.coalesce(T.attr(F.col("tag"), "href"), F.lit(""))).alias("href"), "text", "tt", F.col("over.text").alias("title"), near.alias("near"))


def audit(pages: DataFrame, entries: DataFrame, prefixes: DataFrame, rulings: list[tuple[str | None, str, str, str]] = (), cta: str = "actions|cta|ctalink") -> DataFrame:
    """(page_id, kind, text, href, target, verdict, reason, suggested, confident, ruled, n): every own link of a page judged against the sitemap of its host.

    ``entries`` is ``matching.sitemap``, ``prefixes`` (host, prefix) the language segment that most of a host's pages carry, ``rulings`` as in ``rulings_of``. Red: links without a destination, bare calls to
    action, scripts, editor paths, and paths that exist only with the language segment. Amber: paths the sitemap doesn't list; a listing where a page below it is named; texts that name another page
    better, or not the one they lead to. Green: the page itself, and the page the text names. A text of no words of its own is judged by the title and paragraphs around it, and left out if they say nothing.
    Links to other sites, within the page and home are not judged. Rows of one kind, text and address are one, as the first of them was judged.
    """
    return judge(own_links(pages), bare_ctas(pages, cta), entries, prefixes, rulings)


def bare_ctas(pages: DataFrame, marked: str = "actions|cta|ctalink") -> DataFrame:
    """(page_id, host, own, at, text, tt): calls to action written as bare text, before all links by their place."""
    own = pages.select("page_id", U.host_of(F.col("url")).alias("host"), F.regexp_replace(U.path_of(F.col("url")), r"\?.*$", "").alias("own"))
    rows = markup.dead_ctas(pages, marked).select("page_id", (F.lit(-1) - F.col("ord")).alias("at"), "text").join(own, "page_id")
    return rows.select("page_id", "host", "own", "at", "text", matching.tokens(F.col("text")).alias("tt"))


def judge(links: DataFrame, ctas: DataFrame, entries: DataFrame, prefixes: DataFrame, rulings: list[tuple[str | None, str, str, str]] = ()) -> DataFrame:
    """``audit`` of ``own_links`` and ``bare_ctas``; these are read three times, so write them to a table first where pages are many."""
    empty, script = F.col("href").isin("", "#"), F.col("href").rlike("(?i)^(javascript:|~/)")
    safe = F.col("tag").rlike(markup.SAFE_ATTRIBUTES) | F.lower("text").rlike(markup.SAFE_LABELS)
    rows = links.where(~(empty & safe) & (empty | ~F.col("href").startswith("#")) & ~F.col("href").rlike("(?i)^(mailto|tel):")).withColumn("kind", F.when(empty | script, "placeholder").otherwise("link")).drop("tag")
    rows = rows.unionByName(ctas.withColumn("kind", F.lit("dead-cta")), allowMissingColumns=True)
    there = F.when(F.col("href").rlike(r"^(?i:https?:)?//"), U.host_of(F.regexp_replace("href", "^//", ""))).otherwise(F.col("host"))
    rows = rows.where((F.col("kind") != "link") | (there == F.col("host"))).withColumn("target", F.when(F.col("kind") == "link", F.regexp_replace(U.path_of(F.col("href")), r"\?.*$", ""))).withColumn("key", F.array_join(F.array_sort("tt"), " "))
    rows = rows.join(prefixes.select("host", "prefix"), "host", "left")
    lacks = F.coalesce(F.col("prefix") != "", F.lit(False)) & (F.coalesce(F.try_element_at(F.split("target", "/"), F.lit(2)), F.lit("")) != F.col("prefix"))
    rows = rows.withColumn("fixed", F.when(lacks, F.concat(F.lit("/"), "prefix", F.when(F.col("target") == "/", "").otherwise(F.col("target")))))
    sites = entries.select("host").distinct().withColumn("site", F.lit(True))
    known = entries.select("host", F.col("path").alias("target"), F.col("last"), F.col("words").alias("all"), F.lit(True).alias("known"))
    rows = rows.join(known, ["host", "target"], "left").join(entries.select("host", F.col("path").alias("fixed"), F.lit(True).alias("fixed_known")), ["host", "fixed"], "left").join(sites, "host", "left")
    rows = rows.join(_by_text(rows, entries), ["host", "key"], "left").join(_by_title(rows, entries), ["host", "title"], "left")

    is_self = F.col("target") == F.col("own")
    home = (F.col("target") == "/") | F.coalesce(F.col("target") == F.concat(F.lit("/"), "prefix"), F.lit(False))
    missing = F.coalesce("fixed_known", F.lit(False)) | F.coalesce(F.col("fixed") == F.col("own"), F.lit(False))
    listed = F.coalesce("known", F.lit(False))
    generic = F.size("tt") == 0
    others = lambda but: F.slice(F.filter("named", lambda x: ~x["path"].eqNullSafe(but)), 1, 3)
    paths = lambda xs: F.transform(xs, lambda x: x["path"])
    firm = lambda xs: F.get(xs, 0)["words"] >= 2
    got = F.size(F.array_intersect("tt", "all")) + F.size(F.array_intersect("tt", "last"))
    mine = got / (2 * F.size("tt")) - 0.05 * F.size(F.array_except("last", "tt"))
    rows = rows.withColumn("mine", F.when(listed & ~generic, mine)).withColumn("lead", others(F.col("own"))).withColumn("alt", others(F.col("target")))
    suggested = F.when(generic, paths(F.col("lead"))).otherwise(F.col("paths"))
    sure = F.when(generic, firm(F.col("lead"))).otherwise(F.col("sure"))
    rest = F.filter("paths", lambda p: p != F.col("target"))
    better = F.coalesce((F.col("best") != F.col("target")) & (F.col("score") > F.col("mine") + 0.05) & (F.col("score") >= 0.5), F.lit(False))
    named = (F.size("last") > 0) & (F.size(F.array_except("last", "tt")) == 0)
    around = F.size(F.array_except("last", F.coalesce("near", F.array().cast("array<string>")))) == 0
    of_generic = F.when(~listed & ~is_self, _judged("amber", "the sitemap does not list this path", suggested, sure)).when(~is_self & (F.size("last") > 0), F.when(around, _judged("green", "what stands around it is about the page", sure=F.lit(True))).when(firm(F.col("alt")), _judged("amber", "what stands around it is about another page", paths(F.col("alt")), F.lit(True))))
    of_text = (
        F.when(~listed & ~is_self, _judged("amber", "the sitemap does not list this path", F.col("paths"), F.col("sure"))).when(is_self, _judged("green", "leads to this page itself", sure=F.col("sure")))
        .when(better & F.col("best").startswith(F.concat("target", F.lit("/"))), _judged("amber", "leads to a listing; a page below it is named", rest, F.col("sure")))
        .when(named | ((F.col("mine") >= 0.6) & ~better), _judged("green", "leads to the page its text names", sure=F.col("sure"))).when(better, _judged("amber", "the text names another page better", rest, F.col("sure")))
        .otherwise(_judged("amber", "the text does not name the page it leads to", rest, F.col("sure")))
    )
    judged = (
        F.when(F.col("kind") == "dead-cta", _judged("red", "a call to action without a link", suggested, sure)).when(F.col("href").isin("", "#"), _judged("red", "no destination", suggested, sure))
        .when(F.col("href").startswith("~"), _judged("red", "editor path", suggested, sure)).when(F.col("kind") == "placeholder", _judged("red", "runs a script", suggested, sure))
        .when(missing, _judged("red", "language segment missing", F.array("fixed"), F.lit(True))).when(home | F.col("site").isNull(), F.lit(None)).when(generic, of_generic).otherwise(of_text)
    )
    rows = rows.withColumn("j", judged).where("j is not null")
    ruling = F.lit(None).cast("string")
    for site, rx, to, verdict in reversed(rulings):
        ruling = F.when(F.col("text").rlike(f"(?i){rx}") & (F.col("target") == to.lower()) & (F.lit(site is None) | (F.col("host") == (site or ""))), F.lit(verdict)).otherwise(ruling)
    rows = rows.withColumn("ruling", F.when((F.col("kind") == "link") & ~missing, ruling))
    one = F.struct("at", "target", F.coalesce("ruling", "j.verdict").alias("verdict"), F.when(F.col("ruling").isNotNull(), "ruled").otherwise(F.col("j.reason")).alias("reason"), "j.suggested", "j.confident", F.col("ruling").isNotNull().alias("ruled"))
    per = rows.groupBy("page_id", "kind", F.when(F.col("text") == "", "(no label)").otherwise(F.col("text")).alias("text"), "href").agg(F.min_by(one, "at").alias("x"), F.count("*").alias("n"))
    return per.select("page_id", "kind", "text", "href", "x.target", "x.verdict", "x.reason", "x.suggested", "x.confident", "x.ruled", "n")


def first_places(rows: DataFrame, by: list[str], ord_col: str, shown: int = 3) -> DataFrame:
    """The first ``shown`` rows of each group in order."""
    ranked = rows.select(F.struct(*rows.columns).alias("row"), F.row_number().over(W.partitionBy(*by).orderBy(ord_col)).alias("n"))
    return ranked.where(F.col("n") <= shown).select("row.*")
