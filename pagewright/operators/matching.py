"""Joins that match texts, links and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U

# fixed values: words of link texts that name no page, in six languages
STOP_WORDS = tuple((
    "learn more about read find out discover explore see view get go to visit click here now touch "
    "option options start started begin continue browse try today "
    "opzioni inizia opciones comenzar empezar opcoes comecar optionen starten beginnen commencer "
    "the a an and or of for to in on at by with from your you our us we this that all its it is are "
    "corporation page link more info information details "
    "scopri di piu leggi qui maggiori informazioni il la le lo gli i un una del della dei delle per con su "
    "saiba mais leia aqui o os as um uma do da dos das para com em "
    "leer mas aqui haga clic el los las un una del para con en sobre nuestro nuestra "
    "mehr erfahren hier klicken der die das ein eine und fur mit zu uber unsere "
    "en savoir plus lire la suite ici le les un une des du pour avec sur notre nos").split())
# fixed values: sections whose pages are articles about a thing, not the thing
EDITORIAL = ("news", "news-insights", "press-releases", "press", "stories", "references", "blogs", "blog", "articles", "notizie", "noticias", "noticias-y-referencias", "aktuelles", "actualites", "case-studies")
#: A section with so many pages is editorial too.
BULK_SECTION = 40


def tokens(col, brand: tuple[str, ...] = ()):
    """Distinct stemmed words of a text, without accents, that could name a page."""
    # one literal that folds to a list, not a node for each word in every expression that asks for tokens
    stop = F.split(F.lit(" ".join((*STOP_WORDS, *brand))), " ")
    words = F.filter(F.split(F.regexp_replace(T.fold(col), "[™®©]", " "), "[^a-z0-9]+"), lambda w: (w != "") & ~F.array_contains(stop, w))
    stem = lambda w: F.when(w.rlike("^[0-9]+$") | (F.length(w) <= 3), w).when(w.rlike("ies$") & (F.length(w) > 5), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(ss|us|is)$"), w).otherwise(F.regexp_replace(w, "s$", ""))
    return F.array_distinct(F.filter(F.transform(words, stem), lambda w: ~F.array_contains(stop, w)))


def sitemap(pages: DataFrame) -> DataFrame:
    """(host, path, url, segs, last, words, editorial): one entry for a path of a host, that of the smallest url.

    ``segs`` leave out the language segment of the host (``language_prefix``); ``last`` and ``words`` are tokens of the last and of all.
    """
    rows = pages.select(U.host_of(F.col("url")).alias("host"), F.regexp_replace(U.path_of(F.col("url")), r"\?.*$", "").alias("path"), "url").groupBy("host", "path").agg(F.min("url").alias("url"))
    rows = rows.join(language_prefix(rows), "host", "left")
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumn("segs", F.when(F.try_element_at(segs, F.lit(1)) == F.col("prefix"), F.slice(segs, 2, 1 << 20)).otherwise(segs)).drop("prefix")
    return editorial(rows.withColumn("last", tokens(F.coalesce(F.try_element_at("segs", F.lit(-1)), F.lit("")))).withColumn("words", tokens(F.array_join("segs", " "))))


def suggest(texts: DataFrame, entries: DataFrame, top: int = 3) -> DataFrame:
    """(text_id, rank, path, url, score): entries of the text's host that cover its words best.

    ``texts`` is (text_id, host, text, exclude), ``exclude`` a path that is not suggested or null. Words of the last segment count
    two, others one; each further word of it costs 0.05; scores over 0.2 stay, the highest first, shorter paths first on a tie.
    Editorial entries count only for texts that ask for them. Texts meet entries by an equi-join on host and word, never all by
    all, and the pairs carry numbers only.
    """
    tt = texts.select("text_id", "host", "exclude", F.array_distinct(tokens(F.col("text"))).alias("tt")).where("size(tt) > 0")
    asks = F.exists("tt", lambda t: t.isin(*EDITORIAL) | t.rlike("^(news|stor|press|reference|blog)"))
    words = tt.select("text_id", "host", "exclude", asks.alias("asks"), F.size("tt").alias("n"), F.explode("tt").alias("word"))
    index = entries.select("host", "path", "url", "editorial", F.size("last").alias("long"), F.col("last").alias("l"), F.explode("words").alias("word"))
    index = index.select("host", "path", "url", "editorial", "long", "word", F.array_contains("l", F.col("word")).alias("own"))
    hits = words.join(index, ["host", "word"]).where((F.col("asks") | ~F.col("editorial")) & ~F.coalesce(F.col("exclude") == F.col("path"), F.lit(False)))
    got = hits.groupBy("text_id", "path", "url").agg(F.sum(F.when(F.col("own"), 2).otherwise(1)).alias("got"), F.max("n").alias("n"), (F.max("long") - F.count_if("own")).alias("extra"))
    scored = got.withColumn("score", F.col("got") / (2 * F.col("n")) - 0.05 * F.col("extra")).where("score > 0.2")
    best = W.partitionBy("text_id").orderBy(F.desc("score"), F.length("path"), "path")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("text_id", "rank", "path", "url", (F.floor(F.col("score") * 100 + 0.5) / 100).alias("score"))


def longest_prefix(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """(page_id, market): the entry of the page's domain with the longest path prefix; a whole-domain entry has an empty prefix.

    A page meets the registry by an equi-join on the endings of its host.
    """
    rows = pages.select("page_id", U.bare_host(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"))
    labels = F.size(F.split("host", r"\."))
    ends = rows.select("page_id", "path", F.explode(F.transform(F.sequence(F.lit(1), labels), lambda k: F.array_join(F.slice(F.split("host", r"\."), labels - k + 1, k), "."))).alias("domain"))
    under = (F.col("prefix") == "") | U.under_path(F.col("path"), F.col("prefix"))
    found = ends.join(registry, "domain").where(under).groupBy("page_id").agg(F.max_by("market", F.struct(F.length("prefix"), F.length("domain"))).alias("market"))
    return rows.select("page_id").join(found, "page_id", "left")


def robots_allows(paths: DataFrame, rules: list[tuple[bool, str]]) -> DataFrame:
    """(page_id, path, allowed): the longest rule that matches decides, Allow on a tie; no rule allows."""
    import re

    fixed = [(allow, path, "^" + re.sub(r"\\\*", ".*", re.escape(path[:-1] if path.endswith("$") else path)) + ("$" if path.endswith("$") else "")) for allow, path in rules if path]
    tries = F.array(*[F.when(F.col("path").rlike(rx), F.struct(F.lit(len(p)).alias("n"), F.lit(a).alias("allow"))) for a, p, rx in fixed])
    return paths.withColumn("allowed", F.coalesce(F.array_max(F.filter(tries, lambda x: x.isNotNull()))["allow"], F.lit(True)))


#: Passages of fewer than three words share no whole word with a text for sure; so many are compared with every text.
SHORT_PASSAGES = 1_000


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, docs, hits): documents that hold a passage, and how often, by a word that both must share.

    Items and documents meet on each item's longest inner word, so the join is an equi-join on words; only ids go through it,
    and the texts of the pairs it finds are fetched. Shorter passages, counted first, are looked for in every text.
    """
    words = lambda c: F.array_distinct(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "))
    parts = items.select("item_id", F.col("text").alias("passage"), F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w")).where("length(passage) > 0")
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    keyed = parts.where("size(w) > 2").withColumn("word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    pairs = docs.select("doc_id", F.explode(words(F.col("text"))).alias("word")).join(keyed.select("item_id", "word"), "word").select("doc_id", "item_id").distinct()
    texts = docs.select("doc_id", "text")
    found = pairs.join(keyed.select("item_id", "passage"), "item_id").join(texts, "doc_id")
    short = parts.where("size(w) <= 2").select("item_id", "passage")
    n = short.count()
    if n > SHORT_PASSAGES:
        raise ValueError(f"{n} passages of one or two words; at most {SHORT_PASSAGES} can be looked for in every text")
    if n:
        found = found.select("item_id", "doc_id", "passage", "text").union(texts.join(F.broadcast(short), F.contains("text", "passage")).select("item_id", "doc_id", "passage", "text"))
    hits = found.select("item_id", T.occurrences(F.col("text"), F.col("passage")).alias("n")).where("n > 0")
    return hits.groupBy("item_id").agg(F.count("*").alias("docs"), F.sum("n").alias("hits"))


def first_segments(pages: DataFrame) -> DataFrame:
    """(host, segment, n, total): the first path segment that most pages of a host start with, the later one of equals, and all its pages."""
    rows = pages.select(U.host_of(F.col("url")).alias("host"), F.regexp_extract(U.path_of(F.col("url")), "^/([^/?]+)", 1).alias("segment"))
    n = rows.groupBy("host", "segment").agg(F.count("*").alias("n"))
    return n.groupBy("host").agg(F.max(F.struct("n", "segment")).alias("x"), F.sum("n").alias("total")).select("host", "x.segment", "x.n", "total")


def language_prefix(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """(host, prefix): the language segment that three of five pages of a host start with; hosts without one have no row."""
    most = first_segments(pages).where(F.col("segment").rlike("^[a-z]{2}(-[a-z]{2})?$") & (F.col("n") >= share * F.col("total")))
    return most.select("host", F.col("segment").alias("prefix"))


def editorial(entries: DataFrame, bulk: int = BULK_SECTION) -> DataFrame:
    """``entries`` (host, path, segs, ...) with ``editorial``: in a section of articles by name, or in one of ``bulk`` pages of its host."""
    rows = sections_above(entries)
    counts = sections(rows).where(F.col("pages") >= bulk).select("host", "section")
    crowded = rows.join(counts, ["host", "section"]).select("host", "path").distinct().withColumn("crowded", F.lit(True))
    named = F.arrays_overlap("segs", F.array(*map(F.lit, EDITORIAL)))
    return entries.join(crowded, ["host", "path"], "left").withColumn("editorial", named | F.coalesce("crowded", F.lit(False))).drop("crowded")


def sections_above(entries: DataFrame) -> DataFrame:
    """(host, path, section): each section path above an entry."""
    above = F.transform(F.sequence(F.lit(1), F.size("segs") - 1), lambda i: F.array_join(F.slice("segs", F.lit(1), i), "/"))
    return entries.where("size(segs) > 1").select("host", "path", F.explode(above).alias("section"))


def sections(rows: DataFrame) -> DataFrame:
    """(host, section, pages) from one row for each page and section above it."""
    return rows.groupBy("host", "section").agg(F.count("*").alias("pages"))


def confident(suggestions: DataFrame) -> DataFrame:
    """(text_id, path, score, confident): the first suggestion; sure from 0.5 on if alone, 0.1 ahead, or the second's parent."""
    top = suggestions.where("rank = 1").select("text_id", "path", "score")
    second = suggestions.where("rank = 2").select("text_id", F.col("path").alias("p2"), F.col("score").alias("s2"))
    sure = (F.col("score") >= 0.5) & (F.col("s2").isNull() | (F.col("score") - F.col("s2") >= 0.1) | F.col("p2").startswith(F.concat("path", F.lit("/"))))
    return top.join(second, "text_id", "left").select("text_id", "path", "score", F.coalesce(sure, F.lit(False)).alias("confident"))


def context_suggest(titles: DataFrame, entries: DataFrame, top: int = 3) -> DataFrame:
    """(text_id, rank, path, words): pages whose last segment's words are all in a title, the most words first, then the shorter path.

    Titles (text_id, host, text) meet pages of their host by an equi-join on the page's last word in name order, and the rest is checked on the pair.
    """
    have = titles.select("text_id", "host", tokens(F.col("text")).alias("have"))
    keyed = entries.where("size(last) > 0 and not editorial").select("host", "path", "last", F.array_max("last").alias("word"))
    pairs = have.select("text_id", "host", "have", F.explode("have").alias("word")).join(keyed, ["host", "word"]).where(F.size(F.array_except("last", "have")) == 0)
    w = W.partitionBy("text_id").orderBy(F.desc(F.size("last")), F.length("path"), "path")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("text_id", "rank", "path", F.size("last").alias("words"))


def contexts(stream: DataFrame, most: int = 4, untitled: int = 2) -> DataFrame:
    """(page_id, ord, text, title, body): each link of a stream (page_id, ord, kind, text) with the title above it and the
    last paragraphs in between, ``most`` of them, ``untitled`` where there is no title; its own text is left out."""
    w = W.partitionBy("page_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    rows = stream.withColumn("title", F.last(F.when(F.col("kind") == "title", F.col("text")), True).over(w)).withColumn("section", F.count_if(F.col("kind") == "title").over(w))
    # a section of a page is gathered once; each of its links takes what stands before it
    one = F.array_sort(F.collect_list(F.struct("ord", "kind", "text", "title")))
    part = rows.where("kind <> 'title'").groupBy("page_id", "section").agg(one.alias("all"))

    def body(link):
        others = F.filter("paragraphs", lambda x: (x["ord"] < link["ord"]) & (x["text"] != link["text"]))
        keep = F.when(link["title"].isNull(), untitled).otherwise(most)
        near = F.slice(others, F.greatest(F.size(others) - keep + 1, F.lit(1)), keep)
        return F.struct(link["ord"].alias("ord"), link["text"].alias("text"), link["title"].alias("title"), F.array_join(F.transform(near, lambda x: x["text"]), " ").alias("body"))

    of_kind = lambda kind: F.filter("all", lambda x: x["kind"] == kind)
    part = part.select("page_id", of_kind("link").alias("links"), of_kind("paragraph").alias("paragraphs"))
    return part.select("page_id", F.explode(F.transform("links", body)).alias("x")).select("page_id", "x.*")


def market_status(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """(page_id, market, status): found, ambiguous, former or unknown.

    ``registry`` (market, base, domain, prefix, former) is configuration. The longest prefix on the page's domain wins; a
    domain whose entries are all languages of one base, none of which fits, is ambiguous; a former domain is followed.
    """
    rows = pages.select("page_id", U.bare_host(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"))
    reg = registry.select("market", "base", "domain", F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("former", F.array().cast("array<string>")).alias("former"))
    at = rows.join(reg, F.col("host") == F.col("domain"), "left")
    under = (F.col("prefix") == "") | U.under_path(F.col("path"), F.col("prefix"))
    per = at.groupBy("page_id", "host").agg(F.max_by(F.when(under, F.col("market")), F.when(under, F.length("prefix"))).alias("market"), F.count("domain").alias("n"), F.count_distinct("base").alias("bases"))
    old = reg.select(F.explode("former").alias("f"), "market").groupBy("f").agg(F.min("market").alias("moved"))
    out = per.join(old, F.col("host") == F.col("f"), "left")
    status = F.when(F.col("market").isNotNull(), "found").when((F.col("n") > 1) & (F.col("bases") == 1), "ambiguous").when(F.col("moved").isNotNull(), "former").otherwise("unknown")
    return out.select("page_id", F.coalesce("market", "moved").alias("market"), status.alias("status"))


def claim(wants: DataFrame, links: DataFrame, fold_case: bool = False) -> DataFrame:
    """(page_id, ord, want, link, href, state): each want of a brief in its order takes the page's first link that is left and fits, none twice.

    ``wants`` is (page_id, ord, label, href), ``links`` (page_id, ord, text, href) and perhaps placeholder. A want whose label is its address, or that has only an address for a label, fits a link to
    that path; any other fits a link of that label. Labels and addresses take from the same links, so what one takes the other lacks. A claimed link to another path than wanted is a wrong target;
    a want that only a placeholder carries is one. The walk is a fold over the page's row: one page meets one page's wants, and nothing but the two gatherings by page is shuffled.
    """
    norm = lambda c: F.lower(T.normalise(c)) if fold_case else T.normalise(c)
    label, to = norm(F.col("label")), norm(F.coalesce("href", F.lit("")))
    bare = F.when(F.col("href").isNotNull(), label == to).otherwise(F.col("label").rlike("(?i)^(https?://|/)"))
    w = wants.select("page_id", F.struct("ord", "label", "href", label.alias("key"), U.path_of(F.coalesce("href", "label")).alias("path"), F.coalesce(bare, F.lit(False)).alias("bare")).alias("w"))
    idle = F.col("placeholder") if "placeholder" in links.columns else F.lit(False)
    have = links.select("page_id", F.struct("ord", "href", norm(F.col("text")).alias("key"), U.path_of(F.col("href")).alias("path"), F.coalesce(idle, F.lit(False)).alias("idle")).alias("l"))
    per = w.groupBy("page_id").agg(F.array_sort(F.collect_list("w")).alias("wants")).join(have.groupBy("page_id").agg(F.array_sort(F.collect_list("l")).alias("links")), "page_id", "left")
    kinds = dict(have.select("l.*").dtypes) | {"want": dict(wants.dtypes)["ord"]}
    none = F.from_json(F.lit("[]"), f"array<struct<ord:{kinds['want']},want:string,link:{kinds['ord']},href:string,state:string>>")
    start = F.struct(F.array().cast(f"array<{kinds['ord']}>").alias("taken"), none.alias("out"))

    def step(done, want):
        fits = lambda x: ~x["idle"] & ~F.array_contains(done["taken"], x["ord"]) & F.when(want["bare"], x["path"] == want["path"]).otherwise((x["key"] == want["key"]) & (want["key"] != ""))
        held = F.exists("links", lambda x: x["idle"] & (x["key"] == want["key"]))

        def put(hit):
            wrong = want["href"].isNotNull() & ~want["bare"] & (hit["path"] != want["path"])
            state = F.when(hit.isNull(), F.when(F.coalesce(held, F.lit(False)), "placeholder").otherwise("missing")).when(wrong, "wrong target").otherwise("found")
            row = F.struct(want["ord"].alias("ord"), want["label"].alias("want"), hit["ord"].alias("link"), hit["href"].alias("href"), state.alias("state"))
            return F.struct(F.when(hit.isNull(), done["taken"]).otherwise(F.array_append(done["taken"], hit["ord"])).alias("taken"), F.array_append(done["out"], row).alias("out"))

        return F.get(F.transform(F.array(F.get(F.filter("links", fits), 0)), put), 0)

    return per.select("page_id", F.explode(F.aggregate("wants", start, step)["out"]).alias("x")).select("page_id", "x.*")


def assets(wants: DataFrame, images: DataFrame) -> DataFrame:
    """(page_id, want, src): images of a page whose file name is, holds or lies in a wanted asset's name; null where none does."""
    w = wants.select("page_id", F.col("asset").alias("want"), U.asset_identity(F.col("asset")).alias("wk"))
    have = images.select("page_id", "src", U.asset_identity(F.col("src")).alias("hk")).where("hk <> ''")
    fits = (F.col("wk") == F.col("hk")) | F.contains("wk", "hk") | F.contains("hk", "wk")
    pairs = w.join(have, "page_id", "left")
    return pairs.groupBy("page_id", "want").agg(F.min(F.when(fits & (F.col("wk") != ""), F.col("src"))).alias("src"))


def pick(pages: DataFrame, briefs: DataFrame, coverage: DataFrame) -> DataFrame:
    """(page_id, brief_id, how): the brief a page belongs to: the only one that declares its address, else the one it covers best.

    ``briefs`` is (brief_id, url), ``coverage`` (page_id, brief_id, found, total). Two equally good briefs are ambiguous.
    """
    p = pages.select("page_id", U.host_of(F.col("url")).alias("h"), U.path_of(F.col("url")).alias("p"))
    b = briefs.where("url is not null").select("brief_id", U.host_of(F.col("url")).alias("h"), U.path_of(F.col("url")).alias("p"))
    said = p.join(b, ["h", "p"]).groupBy("page_id").agg(F.count("*").alias("n"), F.min("brief_id").alias("said")).where("n = 1").select("page_id", "said")
    rank = F.rank().over(W.partitionBy("page_id").orderBy(F.desc(F.col("found") / F.col("total")), F.desc("found")))
    best = coverage.where("total > 0 and found > 0").withColumn("r", rank).where("r = 1").groupBy("page_id").agg(F.count("*").alias("ties"), F.min("brief_id").alias("best"))
    out = p.select("page_id").join(said, "page_id", "left").join(best, "page_id", "left")
    how = F.when(F.col("said").isNotNull(), "declared").when(F.col("ties") > 1, "ambiguous").when(F.col("ties") == 1, "coverage").otherwise("none")
    return out.select("page_id", F.when(how != "ambiguous", F.coalesce("said", "best")).alias("brief_id"), how.alias("how"))
