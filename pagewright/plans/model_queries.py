"""Queries that apply the model, claim and link audit operators to the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.functions.text import INLINE_TAGS
from pagewright.operators import briefs, head_rules, link_rules, markup, matching, model, page_audit, places, rules
from pagewright.plans.page_queries import _ENTRIES, _NAMED, _PATH, _tokens
from pagewright.plans.place_queries import _CLEAN
from pagewright.sources import table

WORDS = model.Vocabulary(
    names={"Accordion": "accordion", "Hero Banner": "hero", "The": "quote"},
    signals=(("form", ("the of", "die")), ("value-highlights", ("que", "la de"))),
    chrome=("breadcrumb", "erth"),
    slots={"hero": ("heading", "intro", "cta"), "content": ("heading", "body")},
    templates=(("article", ("content",)), ("listing", ("cards",)), ("mixed", ("content", "cards"))),
)


def brief_texts(docs):
    """(brief_id, text): a labelled brief of each document: every line under a heading of its first words; a question by its length, a line in four without its copy."""
    line = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    head = lambda x: F.regexp_replace(F.array_join(F.slice(F.split(line(x), " "), 1, 3), " "), r"[.!?]+$", "")

    def lines(x, i):
        title = lambda h: F.concat(h, F.when(F.length(x) % 3 == 0, "?").otherwise(""), F.lit("[1."), (i + 1).cast("string"), F.lit("]"))
        of = lambda h: F.when(h == "", F.array().cast("array<string>")).when(F.length(x) % 4 != 0, F.array(title(h), x)).otherwise(F.array(title(h)))
        # the head is bound as a variable, so it is made once
        return F.get(F.transform(F.array(head(x)), of), 0)

    return docs.where("text is not null").select(F.col("doc_id").alias("brief_id"), F.array_join(F.flatten(F.transform(F.split("text", "\n"), lines)), "\n").alias("text"))


def doc_brief_components(spark, sf_dir):
    """Components of the brief of each document with their tier and the lines they come from; what belongs to none is unresolved."""
    parts, lost = model.from_briefs(brief_texts(table(spark, sf_dir, "documents")), WORDS)
    rows = parts.select("page_id", "at", "type", "tier", "confidence", F.md5(F.coalesce("heading", F.lit(""))).alias("heading"), F.size("items").cast("long").alias("items"), F.size("body").cast("long").alias("body"), F.array_join("rows", ",").alias("rows"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    gone = lost.select("page_id", "at", F.lit("unresolved").alias("type"), none("tier", "string"), none("confidence", "string"), F.md5("text").alias("heading"), none("items", "long"), none("body", "long"), F.array_join("rows", ",").alias("rows"))
    return rows.unionByName(gone).withColumn("line", F.col("at").cast("long")).drop("at").withColumnRenamed("page_id", "doc_id")


def doc_brief_models(spark, sf_dir):
    """The model of each document's brief: template, components and what is unresolved."""
    b = brief_texts(table(spark, sf_dir, "documents"))
    return model.build(*model.from_briefs(b, WORDS), b.select(F.col("brief_id").alias("page_id")), "brief", WORDS).select(F.col("page_id").alias("doc_id"), "template", "confidence", "components", "unresolved")


def page_sections(spark, sf_dir):
    """Components of each page by its headings, as digests of heading and copy."""
    parts, lost = model.from_pages(table(spark, sf_dir, "pages"), WORDS)
    rows = parts.select("page_id", "type", "tier", F.md5("heading").alias("heading"), F.size("body").cast("long").alias("body"), F.md5(F.array_join("body", "\n")).alias("copy"))
    return rows.unionByName(lost.select("page_id", F.lit("unresolved").alias("type"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("heading"), F.size("rows").cast("long").alias("body"), F.md5("text").alias("copy")))


def page_run_places(spark, sf_dir):
    """Blocks of each page by the heading last above them, counted and measured."""
    rows = model.landmarks(model.page_stream(table(spark, sf_dir, "pages")))
    return rows.groupBy("page_id", F.md5("landmark").alias("landmark"), "kind").agg(F.count("*").alias("runs"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("nth").cast("long").alias("last"))


def page_module_components(spark, sf_dir):
    """Components of modules written from each page's own links: fields that repeat by an index, a banner, and a frame that is none."""
    p = table(spark, sf_dir, "pages")
    links = markup.anchors(p).where("text <> ''").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text", "href"))), lambda x: F.struct(T.escape_html(x["text"]).alias("t"), x["href"].alias("h"))).alias("links"))
    field = lambda path, value: F.concat(F.lit('<div><!-- Start Component Field: {"XPath":"tcm:Content/custom:'), path, F.lit('"} -->'), F.coalesce(value, F.lit("")), F.lit("</div>"))
    by = F.col("page_id") % 3
    kind = F.when(by == 0, "faq").when(by == 1, "list").otherwise("breadcrumbs")
    names = [F.when(by == 0, a).otherwise(b) for a, b in (("question", "title"), ("answer", "body"))]
    item = lambda x, i: F.concat(*[field(F.concat(F.lit("List/custom:items["), (i + 1).cast("string"), F.lit("]/custom:"), n), v) for n, v in zip(names, (x["t"], x["h"]), strict=True)])
    some = F.slice("links", 1, (F.col("page_id") % 4).cast("int"))
    html = F.concat(F.lit('<section class="module module-'), kind, F.lit('" id="m'), F.col("page_id").cast("string"), F.lit('"><h2>'), F.get("links", F.lit(0))["t"], F.lit("</h2>"), F.array_join(F.transform(some, item), ""), F.lit('</section><section class="x hero-banner">'), *[field(F.lit(f"Hero/custom:{n}"), v) for n, v in (("heading", F.get("links", F.lit(0))["t"]), ("intro", F.get("links", F.lit(1))["t"]), ("actionText", F.get("links", F.lit(2))["t"]), ("actionUrl", F.get("links", F.lit(2))["h"]))], F.lit("</section>"))
    planted = links.select("page_id", html.alias("html"))
    parts, lost = model.of_modules(model.modules(planted, components=[("Accordion", ["module", "module-faq"])]), places.fields(planted), WORDS)
    pairs = F.array_join(F.transform("items", lambda x: F.concat_ws("=", x["title"], x["body"])), "|")
    rows = parts.select("page_id", "type", "tier", "confidence", F.md5("heading").alias("heading"), F.size("items").cast("long").alias("items"), F.md5(pairs).alias("pairs"), F.array_join("body", "|").alias("body"), F.get("links", F.lit(0))["href"].alias("href"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return rows.unionByName(lost.select("page_id", F.lit("unresolved").alias("type"), none("tier"), none("confidence"), F.md5("text").alias("heading"), F.lit(None).cast("long").alias("items"), none("pairs"), none("body"), none("href")))


def page_claims(spark, sf_dir):
    """Wants made of each page's links, by address and by label in turns, and the links that they take."""
    links = markup.anchors(table(spark, sf_dir, "pages")).where("href is not null").select("page_id", F.col("ord").cast("long").alias("ord"), "text", "href")
    k = F.col("ord")
    want = F.array(F.struct((2 * k + k % 2).alias("ord"), F.col("href").alias("label"), "href"), F.struct((2 * k + 1 - k % 2).alias("ord"), F.col("text").alias("label"), F.when(k % 5 == 1, F.concat("href", F.lit("x"))).otherwise(F.col("href")).alias("href")))
    wants = links.where("text <> ''").select("page_id", F.explode(want).alias("w")).select("page_id", "w.*")
    return matching.claim(wants, links).select("page_id", "ord", "link", "state")


def page_link_audit(spark, sf_dir):
    """Own links of all pages against the sitemap of all pages, by verdict and reason."""
    p = table(spark, sf_dir, "pages")
    found = link_rules.audit(p, matching.sitemap(p), matching.language_prefix(p))
    return found.groupBy("verdict", "reason").agg(F.count("*").alias("rows"), F.sum("n").alias("links"), F.sum(F.size("suggested")).alias("suggested"))


def planted_link_audit(spark, sf_dir):
    """Links written into each page of the table to a neighbour of its host: named, misnamed, unlisted, without words, without destination."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", U.host_of(F.col("url")).alias("host"), F.regexp_replace(U.path_of(F.col("url")), r"\?.*$", "").alias("path"))
    w = W.partitionBy("host").orderBy("page_id")
    p = p.withColumn("to", F.coalesce(F.lead("path").over(w), F.lag("path").over(w), "path"))
    last = lambda c: F.concat(F.lit("Unit "), F.element_at(F.split(c, "/"), -1))
    a = lambda href, text: F.concat(F.lit('<a href="'), href if not isinstance(href, str) else F.lit(href), F.lit('">'), text if not isinstance(text, str) else F.lit(text), F.lit("</a>"))
    html = F.concat(
        F.lit("<h1>"), last("path"), F.lit("</h1>"), a(F.col("to"), last("to")), a(F.col("to"), last("path")), a(F.concat(F.lit("/nowhere/"), F.col("page_id").cast("string")), last("to")), a(F.col("to"), "Nothing alike"), a(F.col("url"), "This very page"),
        F.lit("<h2>About "), F.when(F.col("page_id") % 2 == 0, last("to")).otherwise("things"), F.lit("</h2>"), a(F.col("to"), "Read more"), a("#", last("to")), a("~/x", "Go"), a("javascript:run()", "Open"), a("#top", "Up"),
        F.lit('<div class="cta">'), last("to"), F.lit("</div>"), a(F.concat(F.lit("/"), F.element_at(F.split("to", "/"), -1)), "Short"),
    )
    planted = p.select("page_id", "url", html.alias("html")).repartition("page_id")
    found = link_rules.audit(planted, matching.sitemap(planted), matching.language_prefix(planted))
    return found.select("page_id", "kind", "text", "href", "verdict", "reason", F.array_join("suggested", ",").alias("suggested"), "confident", "n")


def page_audit_findings(spark, sf_dir):
    """What all page rules find in the given pages, from one record of each, by page, field and note."""
    found = page_audit.audit(page_audit.record(table(spark, sf_dir, "pages")))
    return found.groupBy("page_id", "category", "severity", "field", "note").agg(F.count("*").alias("n"))


def page_audit_tally(spark, sf_dir):
    """Breaks and checks of each page by all page rules."""
    return rules.tally(page_audit.audit(page_audit.record(table(spark, sf_dir, "pages"))), "page_id")


def turn_rows(spark, sf_dir):
    """For a part, the whole or the sorted words of each turn, the turn of its conversation that it comes from, if there is one answer."""
    t = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("brief_id"), F.col("turn").cast("int").alias("row"), F.col("text").alias("english"))
    words = F.split("english", " ")
    text = F.when(F.col("row") % 3 == 0, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(1))), " ")).when(F.col("row") % 3 == 1, F.col("english")).otherwise(F.array_join(F.array_sort(words), " "))
    found = briefs.find_row(t.select((F.col("brief_id") * 1000 + F.col("row")).alias("query_id"), "brief_id", text.alias("text")), t)
    return found.select("query_id", "how", "row", F.round("confidence", 9).alias("confidence"), F.array_join("others", ",").alias("others"))


QUERIES = {f.__name__: f for f in (turn_rows, page_audit_findings, page_audit_tally, doc_brief_components, doc_brief_models, page_sections, page_run_places, page_module_components, page_claims, page_link_audit, planted_link_audit)}

_KEY = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _named(text: str) -> str:
    """The type that a text names, spelled out for the other engine."""
    key = _KEY.format(text)
    names = " ".join(f"WHEN replace({key}, ' ', '') = '{n.lower().replace(' ', '')}' THEN '{t}'" for n, t in WORDS.names.items())
    signals = " ".join(f"WHEN contains(' ' || {key} || ' ', ' {p} ') THEN '{t}'" for t, phrases in WORDS.signals for p in phrases)
    return f"CASE {names} {signals} END"


_CHROME = "(" + " OR ".join(f"contains({_KEY}, '{c}')" for c in WORDS.chrome) + ")"
_BRIEFS = rf"""raw AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
headed AS (SELECT doc_id, i, line, regexp_replace(array_to_string(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')[1:3], ' '), '[.!?]+$', '') AS head FROM raw),
pieces AS (SELECT doc_id, i, 0 AS k, head || CASE WHEN length(line) % 3 = 0 THEN '?' ELSE '' END || '[1.' || i || ']' AS raw FROM headed WHERE head <> '' UNION ALL SELECT doc_id, i, 1, line FROM headed WHERE head <> '' AND length(line) % 4 <> 0),
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS pos, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM pieces),
kinds AS (SELECT *, regexp_extract(line, '^(.*?)\s*\[\d+\.\d+\]\s*$', 1) AS mark, regexp_extract(line, '(?i)Assets?\s*[-–]\s*(.+)$', 1) AS asset FROM numbered),
stream AS (SELECT doc_id, pos, CASE WHEN mark <> '' THEN 'heading' WHEN asset <> '' THEN 'image' WHEN length(line) <= 90 AND len(string_split(line, ' ')) <= 12 AND NOT regexp_matches(line, '[.!]$') THEN 'heading' ELSE 'copy' END AS kind, CASE WHEN mark <> '' THEN trim(mark) WHEN asset <> '' THEN trim(asset) ELSE line END AS text FROM kinds),
under AS (SELECT *, max(CASE WHEN kind = 'heading' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM stream),
leaf AS (SELECT doc_id, coalesce(h, 0) AS pos, h IS NULL AS ahead, any_value(CASE WHEN kind = 'heading' THEN text END) AS heading, coalesce(list(text ORDER BY pos) FILTER (kind = 'copy'), []) AS body, arg_min(CASE WHEN kind = 'image' THEN text END, CASE WHEN kind = 'image' THEN pos END) AS image, list(pos ORDER BY pos) AS rows FROM under GROUP BY doc_id, h),
lost AS (SELECT *, CASE WHEN ahead THEN left(array_to_string(list_concat(body, CASE WHEN image IS NULL THEN [] ELSE [image] END), ' / '), 200) ELSE heading END AS text FROM leaf WHERE ahead OR {_CHROME.format("heading", "heading")}),
kept AS (SELECT *, CASE WHEN regexp_matches(heading, '\?\s*$') AND len(body) = 1 AND image IS NULL THEN 'q' WHEN len(body) <= 1 AND image IS NULL AND coalesce(length(body[1]), 0) <= 320 THEN 'c' ELSE 'n' END AS cls FROM leaf WHERE NOT ahead AND NOT {_CHROME.format("heading", "heading")}),
marked AS (SELECT *, CASE WHEN cls = 'n' OR lag(cls) OVER w IS DISTINCT FROM cls THEN 1 ELSE 0 END AS new FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
runs AS (SELECT doc_id, run, cls, list({{'pos': pos, 'heading': heading, 'body': body, 'image': image, 'rows': rows}} ORDER BY pos) AS leaves, cls <> 'n' AND count(*) > 1 AS many FROM run GROUP BY doc_id, run, cls),
seen AS (SELECT *, NOT many AND len(leaves[1].body) = 0 AND leaves[1].image IS NULL AS bare FROM runs),
taken AS (SELECT *, CASE WHEN lag(bare) OVER w THEN lag(leaves) OVER w END AS before, bare AND coalesce(lead(many) OVER w, false) AS gone FROM seen WINDOW w AS (PARTITION BY doc_id ORDER BY run)),
titled AS (SELECT *, many AND before IS NULL AND len(leaves) >= 3 AND len(leaves[1].body) = 0 AND leaves[1].image IS NULL AS inside FROM taken WHERE NOT gone),
parts AS (SELECT *, CASE WHEN many THEN coalesce(before[1], CASE WHEN inside THEN leaves[1] END) END AS title, CASE WHEN inside THEN leaves[2:] ELSE leaves END AS own FROM titled),
told AS (SELECT *, CASE WHEN many THEN title.heading ELSE own[1].heading END AS heading, list_filter(list_transform(own[1].body, lambda b: {_named("b")}), lambda x: x IS NOT NULL)[1] AS body_named FROM parts),
typed AS (SELECT *, {_named("heading")} AS head_named, CASE WHEN regexp_matches(heading, '(?i)\bhero\b') THEN 'hero' WHEN regexp_matches(heading, '(?i)\baccordion\b|\bfaq\b') THEN 'accordion' WHEN regexp_matches(heading, '(?i)\bcta\b') THEN 'cta' WHEN regexp_matches(heading, '(?i)\bimage\b') THEN 'image' END AS slot FROM told),
components AS (SELECT doc_id, coalesce(title.pos, own[1].pos) AS pos, heading, many, len(own) AS n, own, title,
  CASE WHEN many AND cls = 'q' THEN ['accordion', 'repeats', 'medium'] WHEN many AND head_named IS NOT NULL THEN [head_named, 'named', 'high'] WHEN many AND len(list_filter(own, lambda x: NOT regexp_matches(x.heading, '(?i)^\s*(?:\d{{1,2}}\s*[.):]|step\s+\d+|passo\s+\d+|paso\s+\d+)'))) = 0 THEN ['steps', 'repeats', 'medium'] WHEN many THEN ['cards', 'repeats', 'medium']
    WHEN coalesce(head_named, body_named) IS NOT NULL THEN [coalesce(head_named, body_named), 'named', 'high'] WHEN slot IS NOT NULL THEN [slot, 'slot', 'high'] WHEN own[1].image IS NOT NULL AND len(own[1].body) <= 1 THEN ['hero', 'shape', 'medium'] WHEN len(own[1].body) > 0 THEN ['content', 'shape', 'medium'] ELSE ['generic', 'generic', 'low'] END AS v FROM typed)"""


def _shown(html: str) -> str:
    """Visible text of markup."""
    bare = rf"regexp_replace(regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:{'|'.join(INLINE_TAGS)})\b[^>]*>', '', 'g'), '(?i)</?[a-z][a-z0-9]*\b[^>]*>', ' ', 'g')"
    return _CLEAN.format(f"replace(replace(replace({bare}, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34))")


_END = r"(?:</?(?:p|li|ul|ol|div|article|section|footer|body|details|summary|h[1-6]|table|form)\b|$)"


def _cut(tag: str, html: str) -> str:
    """Contents of elements up to the next block tag."""
    return f"list_filter(list_transform(string_split_regex({html}, '(?i)<{tag}\\b')[2:], lambda x: {_shown(f'''regexp_extract(x, '(?is)^[^>]*>(.*?){_END}', 1)''')}), lambda t: t <> '')"


_HTML = "regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', ' ', 'g')"
_PAGES = f"""cut AS (SELECT page_id, string_split_regex(h, '(?i)<h1\\b[^>]*>')[1] AS above, regexp_extract(h, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(h, '(?is)</h1>(.*)$', 1) AS below FROM (SELECT page_id, {_HTML} AS h FROM pages)),
page AS (SELECT page_id, {_shown("h1")} AS heading, {_cut("li", "above")} AS strays, {_cut("p", "below")} AS body, list_filter(list_transform(regexp_extract_all(above, '(?is)<div\\b[^>]*>(.*?)</div>', 1), lambda x: {_shown("x")}), lambda t: t <> '' AND length(t) <= 200) AS loose FROM cut)"""
_LINKS = "(SELECT page_id, i - 1 AS k, a[i] AS a FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>') AS a FROM pages), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i))"


def _path_sql(url: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^(?i:https?://)', '')"
    short = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({bare}, '^[^/.]*\\.[^/]*$', '/'), '^[^/.]*\\.[^/]*/', '/'), '(?i)\\.(aspx|html?|jsp)($|\\?)', '\\2'), '(?i)/(index|default)($|\\?)', '\\2'), '/+$', '')"
    return f"lower(CASE WHEN {short} = '' THEN '/' ELSE {short} END)"


_PREFIXES = f"""SELECT host, prefix FROM (SELECT host, prefix, n, sum(n) OVER (PARTITION BY host) AS total, row_number() OVER (PARTITION BY host ORDER BY n DESC, prefix DESC) AS r FROM (SELECT host, regexp_extract(path, '^/([^/?]+)', 1) AS prefix, count(*) AS n FROM {_PATH} GROUP BY ALL)) WHERE r = 1 AND regexp_full_match(prefix, '[a-z][a-z](-[a-z][a-z])?') AND n * 10 >= total * 6"""


def _audit_sql(links: str) -> str:
    """Verdicts of links (page_id, host, own, pos, kind, text, href, title, body), each text met with all entries of its host."""
    return f"""l0 AS ({links}),
e AS (SELECT host, path, {_tokens("coalesce(segs[-1], '')")} AS last, {_tokens("array_to_string(segs, ' ')")} AS words, len(list_intersect(segs, [{_NAMED}])) > 0 AS named, segs FROM {_ENTRIES}),
bulk AS (SELECT host, section FROM (SELECT host, array_to_string(segs[1:i], '/') AS section FROM (SELECT host, segs, unnest(range(1, len(segs))) AS i FROM e)) GROUP BY ALL HAVING count(*) >= {matching.BULK_SECTION}),
ed AS (SELECT host, path, last, words, named OR EXISTS (SELECT 1 FROM bulk b WHERE b.host = e.host AND list_contains(list_transform(range(1, len(segs)), lambda i: array_to_string(segs[1:i], '/')), b.section)) AS editorial FROM e),
prefixes AS ({_PREFIXES}),
l1 AS (SELECT l0.*, prefix, CASE WHEN kind = 'link' THEN regexp_replace({_path_sql("href")}, '\\?.*$', '') END AS target, {_tokens("text")} AS tt, {_tokens("coalesce(title, '')")} AS ht, {_tokens("coalesce(body, '')")} AS bt FROM l0 LEFT JOIN prefixes USING (host)),
l2 AS (SELECT l1.*, CASE WHEN prefix IS NOT NULL AND coalesce(string_split(target, '/')[2], '') <> prefix THEN '/' || prefix || CASE WHEN target = '/' THEN '' ELSE target END END AS fixed FROM l1),
l3 AS (SELECT l2.*, k.path IS NOT NULL AS known, k.last AS klast, k.words AS kwords, f.path IS NOT NULL OR coalesce(fixed = own, false) AS short, row_number() OVER () AS id FROM l2 LEFT JOIN ed k ON k.host = l2.host AND k.path = l2.target LEFT JOIN ed f ON f.host = l2.host AND f.path = l2.fixed),
sc AS (SELECT id, ed.path, (len(list_filter(tt, lambda w: list_contains(ed.words, w))) + len(list_filter(tt, lambda w: list_contains(ed.last, w)))) / (2 * len(tt)) - 0.05::DOUBLE * (len(ed.last) - len(list_filter(tt, lambda w: list_contains(ed.last, w)))) AS score FROM l3 JOIN ed ON ed.host = l3.host WHERE len(tt) > 0
  AND (NOT editorial OR len(list_filter(tt, lambda w: list_contains([{_NAMED}], w) OR regexp_matches(w, '^(news|stor|press|reference|blog)'))) > 0)),
sr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, length(path), path) AS r FROM sc WHERE score > 0.2),
s AS (SELECT id, list(path ORDER BY r) FILTER (r <= 3) AS paths, arg_min(path, r) AS best, floor(min(CASE WHEN r = 1 THEN score END) * 100 + 0.5) / 100 AS s1, floor(min(CASE WHEN r = 2 THEN score END) * 100 + 0.5) / 100 AS s2, min(CASE WHEN r = 2 THEN path END) AS p2 FROM sr GROUP BY id),
c AS (SELECT id, list({{'p': path, 'n': len(ed.last)}} ORDER BY len(ed.last) DESC, length(path), path)[1:4] AS named FROM l3 JOIN ed ON ed.host = l3.host WHERE len(tt) = 0 AND NOT editorial AND len(ed.last) > 0 AND len(list_filter(ed.last, lambda w: NOT list_contains(ht, w))) = 0 GROUP BY id),
j AS (SELECT l3.*, coalesce(paths, []) AS paths, best, s1, coalesce(s1 >= 0.5 AND (s2 IS NULL OR s1 - s2 >= 0.1 OR starts_with(p2, best || '/')), false) AS sure, target = own AS self, len(tt) = 0 AS generic,
  list_filter(coalesce(named, []), lambda x: x.p <> own)[1:3] AS lead, list_filter(coalesce(named, []), lambda x: target IS NULL OR x.p <> target)[1:3] AS alt,
  (len(list_intersect(tt, kwords)) + len(list_intersect(tt, klast))) / (2 * len(tt)) - 0.05::DOUBLE * len(list_filter(klast, lambda w: NOT list_contains(tt, w))) AS mine,
  len(klast) > 0 AND len(list_filter(klast, lambda w: NOT list_contains(tt, w))) = 0 AS last_named, len(list_filter(klast, lambda w: NOT list_contains(list_concat(ht, bt), w))) = 0 AS around FROM l3 LEFT JOIN s USING (id) LEFT JOIN c USING (id)),
b AS (SELECT *, coalesce(best <> target AND s1 > mine + 0.05 AND s1 >= 0.5, false) AS better, list_filter(paths, lambda p: p <> target) AS rest, CASE WHEN generic THEN list_transform(lead, lambda x: x.p) ELSE paths END AS sug, CASE WHEN generic THEN coalesce(lead[1].n >= 2, false) ELSE sure END AS conf FROM j),
v AS (SELECT page_id, pos, kind, CASE WHEN text = '' THEN '(no label)' ELSE text END AS text, href, CASE
  WHEN kind = 'dead-cta' THEN {{'v': 'red', 'r': 'a call to action without a link', 's': sug, 'c': conf}} WHEN href IN ('', '#') THEN {{'v': 'red', 'r': 'no destination', 's': sug, 'c': conf}}
  WHEN starts_with(href, '~') THEN {{'v': 'red', 'r': 'editor path', 's': sug, 'c': conf}} WHEN kind = 'placeholder' THEN {{'v': 'red', 'r': 'runs a script', 's': sug, 'c': conf}}
  WHEN short THEN {{'v': 'red', 'r': 'language segment missing', 's': [fixed], 'c': true}} WHEN target = '/' OR coalesce(target = '/' || prefix, false) THEN NULL
  WHEN NOT known AND NOT self THEN {{'v': 'amber', 'r': 'the sitemap does not list this path', 's': sug, 'c': conf}}
  WHEN generic AND (self OR len(klast) = 0) THEN NULL WHEN generic AND around THEN {{'v': 'green', 'r': 'what stands around it is about the page', 's': [], 'c': true}}
  WHEN generic AND coalesce(alt[1].n >= 2, false) THEN {{'v': 'amber', 'r': 'what stands around it is about another page', 's': list_transform(alt, lambda x: x.p), 'c': true}} WHEN generic THEN NULL
  WHEN self THEN {{'v': 'green', 'r': 'leads to this page itself', 's': [], 'c': sure}} WHEN better AND starts_with(best, target || '/') THEN {{'v': 'amber', 'r': 'leads to a listing; a page below it is named', 's': rest, 'c': sure}}
  WHEN last_named OR (mine >= 0.6 AND NOT better) THEN {{'v': 'green', 'r': 'leads to the page its text names', 's': [], 'c': sure}} WHEN better THEN {{'v': 'amber', 'r': 'the text names another page better', 's': rest, 'c': sure}}
  ELSE {{'v': 'amber', 'r': 'the text does not name the page it leads to', 's': rest, 'c': sure}} END AS x FROM b),
g AS (SELECT page_id, kind, text, href, arg_min(x, pos) AS x, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY ALL)"""


_REAL = rf"""SELECT page_id, host, own, k AS pos, CASE WHEN href IN ('', '#') OR regexp_matches(href, '(?i)^(javascript:|~/)') THEN 'placeholder' ELSE 'link' END AS kind, text, href, NULL::VARCHAR AS title,
  array_to_string(list_filter(list(text) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda t: t <> '' AND t <> text)[-2:], ' ') AS body
  FROM (SELECT page_id, k, {_shown("a")} AS text, trim(regexp_extract(a, 'href="([^"]*)"', 1)) AS href FROM {_LINKS}) JOIN (SELECT page_id, host, regexp_replace(path, '\?.*$', '') AS own FROM {_PATH}) USING (page_id) WHERE NOT (starts_with(href, '#') AND href <> '#') AND NOT regexp_matches(href, '(?i)^(mailto|tel):') AND NOT starts_with(href, 'http') AND NOT starts_with(href, '//')"""
_PLANTED = rf"""SELECT page_id, host, own, pos, kind, text, href, CASE WHEN pos < 6 THEN 'Unit ' || string_split(own, '/')[-1] ELSE 'About ' || CASE WHEN page_id % 2 = 0 THEN unit ELSE 'things' END END AS title, NULL::VARCHAR AS body FROM (
  SELECT page_id, host, own, unit, unnest([
    {{'pos': 1, 'kind': 'link', 'text': unit, 'href': dst}}, {{'pos': 2, 'kind': 'link', 'text': 'Unit ' || string_split(own, '/')[-1], 'href': dst}}, {{'pos': 3, 'kind': 'link', 'text': unit, 'href': '/nowhere/' || page_id}}, {{'pos': 4, 'kind': 'link', 'text': 'Nothing alike', 'href': dst}}, {{'pos': 5, 'kind': 'link', 'text': 'This very page', 'href': trim(url)}},
    {{'pos': 6, 'kind': 'link', 'text': 'Read more', 'href': dst}}, {{'pos': 7, 'kind': 'placeholder', 'text': unit, 'href': '#'}}, {{'pos': 8, 'kind': 'placeholder', 'text': 'Go', 'href': '~/x'}}, {{'pos': 9, 'kind': 'placeholder', 'text': 'Open', 'href': 'javascript:run()'}}, {{'pos': 10, 'kind': 'dead-cta', 'text': unit, 'href': NULL}}, {{'pos': 11, 'kind': 'link', 'text': 'Short', 'href': '/' || string_split(dst, '/')[-1]}}], recursive := true)
  FROM (SELECT *, 'Unit ' || string_split(dst, '/')[-1] AS unit FROM (SELECT page_id, url, host, own, coalesce(lead(own) OVER w, lag(own) OVER w, own) AS dst FROM (SELECT *, regexp_replace(path, '\?.*$', '') AS own FROM {_PATH}) WINDOW w AS (PARTITION BY host ORDER BY page_id))))"""
_STOPS = ", ".join(f"'{w}'" for w in head_rules.TITLE_STOP_WORDS)
_VAGUE = ", ".join(f"'{w}'" for w in rules.GENERIC_LINK_TEXT)


def _keywords(text: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace({text}, '[™®©]', '', 'g')), '[^a-z0-9à-ÿ]+'), lambda w: length(w) > 2 AND NOT list_contains([{_STOPS}], w)), lambda w: regexp_replace(w, 's$', '')))"


_AUDIT = rf"""p AS (SELECT page_id, html, {_CLEAN.format("regexp_extract(html, '(?is)<title" + chr(92) + "b[^>]*>(.*?)</title>', 1)")} AS title, {_shown("regexp_extract(html, '(?is)<h1" + chr(92) + "b[^>]*>(.*?)</h1>', 1)")} AS h1, regexp_matches(html, '(?is)<meta\b[^>]*name="description"') AS described FROM pages),
k AS (SELECT *, {_keywords("title")} AS tw, {_keywords("h1")} AS hw FROM p),
lists AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(u, '(?is)<li\b[^>]*>(.*?)</li>', 1), lambda x: {_shown("x")}), lambda x: true) AS items FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul\b[^>]*>.*?</ul>')) AS u FROM pages)),
l AS (SELECT page_id, items, list_filter(items, lambda t: t <> '' AND NOT regexp_matches(t, ':$')) AS body FROM lists WHERE len(items) > 0),
a AS (SELECT page_id, k, trim(regexp_replace({_shown("a")}, '[\s→›»>.…]+$', '')) AS name, {_shown("a")} AS text, regexp_extract(a, 'href="([^"]*)"', 1) AS href, a LIKE '%href=%' AS has FROM {_LINKS}),
paras AS (SELECT page_id, {_cut("(?:p|li)", _HTML)} AS ps FROM pages),
found(page_id, category, severity, field, note, n) AS (
  SELECT page_id, 'metadata', 'check', 'Title', 'over 60 characters', 1 FROM k WHERE length(title) > 60
  UNION ALL SELECT page_id, 'metadata', 'break', 'Title', 'no title', 1 FROM k WHERE title = ''
  UNION ALL SELECT page_id, 'metadata', 'check', 'Title', 'leading or trailing spaces', 1 FROM pages WHERE regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) <> trim(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1))
  UNION ALL SELECT page_id, 'metadata', 'check', 'Description', 'no description', 1 FROM k WHERE NOT described
  UNION ALL SELECT page_id, 'metadata', 'check', 'hreflang', 'no alternates', 1 FROM k WHERE html NOT LIKE '%hreflang%'
  UNION ALL SELECT page_id, 'metadata', 'check', 'H1', 'shares no keyword with the title', 1 FROM k WHERE len(tw) > 0 AND len(hw) > 0 AND len(list_intersect(tw, hw)) = 0
  UNION ALL SELECT page_id, 'headings', 'break', 'H1', 'no H1', 1 FROM k WHERE NOT regexp_matches(html, '(?is)<h1\b[^>]*>.*?</h1>')
  UNION ALL SELECT page_id, 'links', 'break', 'Link', 'placeholder link', 1 FROM a WHERE href IN ('', '#')
  UNION ALL SELECT page_id, 'links', 'break', 'Link text', 'link without a name', 1 FROM a WHERE name = '' AND trim(href) NOT IN ('', '#')
  UNION ALL SELECT page_id, 'links', 'check', 'Link text', 'link text says nothing about its target', count(DISTINCT {{'k': lower(name), 'h': href}}) FROM a WHERE list_contains([{_VAGUE}], lower(name)) AND trim(href) NOT IN ('', '#') GROUP BY page_id
  UNION ALL SELECT page_id, 'lists', 'check', 'Flattened list', 'points belong below these items', 1 FROM l WHERE len(list_filter(items[1:-2], lambda t: regexp_matches(t, ':$'))) > 0
  UNION ALL SELECT page_id, 'lists', 'check', 'Mixed punctuation', 'items end in a full stop, others don''t', 1 FROM l WHERE len(body) >= 3 AND len(list_filter(body, lambda t: regexp_matches(t, '[.!?]$'))) BETWEEN 1 AND len(body) - 1
  UNION ALL SELECT page_id, 'lists', 'check', 'Empty list item', 'empty item', 1 FROM l WHERE list_contains(items, '')
  UNION ALL SELECT page_id, 'lists', 'check', 'Single-item list', 'one item', 1 FROM l WHERE len(items) = 1
  UNION ALL SELECT page_id, 'lists', 'check', 'Typed bullets', 'paragraphs start with a typed bullet', 1 FROM paras WHERE len(list_filter(ps, lambda t: regexp_matches(t, '^[•·▪●◦‣]|^[-–—]\s+'))) > 0)"""
_FIRST = "category IN ('headings', 'links') OR field IN ('Title', 'Description', 'Keywords', 'Page language')"


def _escaped(text: str) -> str:
    return f"replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


_BAG = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9À-ɏ]+'), lambda w: length(w) > 2)"
_TURN_ROWS = f"""WITH t AS (SELECT conv_id, turn, text, {_CLEAN.format("text")} AS english FROM conversations WHERE text IS NOT NULL),
q AS (SELECT conv_id, turn, {_CLEAN.format("CASE turn % 3 WHEN 0 THEN array_to_string(string_split(text, ' ')[2:1 + greatest(len(string_split(text, ' ')) - 2, 1)], ' ') WHEN 1 THEN text ELSE array_to_string(list_sort(string_split(text, ' ')), ' ') END")} AS needle FROM t),
m AS (SELECT q.conv_id * 1000 + q.turn AS query_id, t.turn AS row, english, CASE WHEN english = needle THEN 3 WHEN length(english) > 8 AND (contains(english, needle) OR contains(needle, english)) THEN 2 ELSE 1 END AS tier, {_BAG.format("english")} AS x, {_BAG.format("needle")} AS y FROM q JOIN t ON q.conv_id = t.conv_id WHERE needle <> '' AND english <> ''),
s AS (SELECT *, CASE tier WHEN 3 THEN 1.0 WHEN 2 THEN 0.9 ELSE CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_filter(x, lambda w: list_contains(y, w))) / greatest(len(x), len(y)) ELSE 0.0 END END::DOUBLE AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, CASE WHEN tier = 2 THEN -length(english) ELSE 0 END, score DESC, row) AS rank FROM s WHERE tier > 1 OR score >= 0.4),
p AS (SELECT query_id, max(tier) AS tier, count(*) FILTER (tier = 3) AS exact, arg_min(row, rank) AS row, arg_min(score, rank) AS score, list(row ORDER BY rank) FILTER (rank BETWEEN 2 AND 4 AND tier = 1) AS rest FROM r GROUP BY query_id),
h AS (SELECT q.conv_id * 1000 + q.turn AS query_id, p.* EXCLUDE (query_id), CASE WHEN tier IS NULL THEN 'none' WHEN exact > 1 THEN 'ambiguous' WHEN tier = 3 THEN 'exact' WHEN tier = 2 THEN 'contained' ELSE 'closest' END AS how FROM q LEFT JOIN p ON p.query_id = q.conv_id * 1000 + q.turn)
SELECT query_id, how, CASE WHEN how <> 'ambiguous' THEN row END::INT AS row, round(score, 9) AS confidence, CASE WHEN how = 'closest' THEN coalesce(array_to_string(rest, ','), '') ELSE '' END AS others FROM h"""
_TWO_WAYS = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM documents),
c AS (SELECT doc_id, word, string_split(word, '') AS l, count(*) AS n FROM w WHERE length(word) >= 6 GROUP BY ALL),
k AS (SELECT *, array_to_string(list_sort(l), '') AS letters, array_to_string(list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x), '') AS single FROM c),
pairs AS (SELECT DISTINCT a.doc_id, a.word, b.word AS other, a.l AS x, b.l AS y FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.n = 1 AND b.n >= 2 AND a.word <> b.word AND (a.letters = b.letters OR a.single = b.single) AND abs(len(a.l) - len(b.l)) <= 1),
d AS (SELECT *, CASE WHEN len(x) = len(y) THEN list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i]) END AS apart, CASE WHEN len(x) > len(y) THEN x ELSE y END AS long, CASE WHEN len(x) > len(y) THEN y ELSE x END AS short FROM pairs)
SELECT doc_id, word, other FROM d WHERE len(apart) = 1 OR (len(apart) = 2 AND apart[2] = apart[1] + 1 AND x[apart[1]] = y[apart[2]] AND x[apart[2]] = y[apart[1]])
  OR (apart IS NULL AND len(list_filter(range(1, len(long) + 1), lambda i: list_concat(long[1:i - 1], long[i + 1:]) = short)) > 0)"""
ORACLE_SQL = {
    "turn_rows": _TURN_ROWS,
    "doc_spelled_two_ways": _TWO_WAYS,
    "page_audit_findings": f"WITH {_AUDIT} SELECT page_id, category, severity, field, note, sum(n)::BIGINT AS n FROM found GROUP BY ALL",
    # the older queries, each with the families that it holds
    "page_findings": f"WITH {_AUDIT} SELECT category, severity, field, note, sum(n)::BIGINT AS n, count(DISTINCT page_id) AS pages FROM found WHERE {_FIRST} GROUP BY ALL",
    "page_tally": f"WITH {_AUDIT} SELECT page_id, coalesce(sum(n) FILTER (severity = 'break'), 0)::BIGINT AS breaks, coalesce(sum(n) FILTER (severity = 'check'), 0)::BIGINT AS checks, CASE WHEN count(*) FILTER (severity = 'break') > 0 THEN 'break' ELSE 'check' END AS worst FROM found WHERE {_FIRST} GROUP BY page_id",
    "page_list_findings": f"WITH {_AUDIT} SELECT severity, field, note, sum(n)::BIGINT AS n FROM found WHERE category = 'lists' GROUP BY ALL",
    "page_head_findings": f"WITH {_AUDIT} SELECT severity, field, note, sum(n)::BIGINT AS n FROM found WHERE field = 'hreflang' OR (category = 'metadata' AND field = 'H1') GROUP BY ALL",
    "page_briefs": f"""WITH {_PAGES}, own AS (SELECT DISTINCT page_id, {_path_sql("href")} AS path FROM (SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM {_LINKS}) WHERE starts_with(href, '/') AND NOT contains(href, '/content/')),
titled AS (SELECT page_id, {_CLEAN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS t FROM pages),
n AS (SELECT page_id AS brief_id, 'label' AS kind, (CASE WHEN t <> '' THEN 2 ELSE 0 END + (SELECT count(*) FROM own o WHERE o.page_id = titled.page_id))::BIGINT AS lines FROM titled UNION ALL SELECT page_id, 'heading', CASE WHEN heading <> '' THEN 1 ELSE 0 END FROM page UNION ALL SELECT page_id, 'copy', len(body) FROM page) SELECT * FROM n WHERE lines > 0""",
    "page_components": f"""WITH {_PAGES}, e AS (SELECT page_id, heading, list_transform(body, lambda b: '<p>' || {_escaped("b")} || '</p>') AS ps, CASE WHEN regexp_matches(lower(heading), '(?i)contact') THEN 'contact' WHEN regexp_matches(heading, '[?？]\\s*$') AND len(body) > 0 THEN 'question' WHEN len(body) > 0 THEN 'text' ELSE 'bare' END AS type FROM page WHERE heading <> '')
SELECT page_id, '<section class="' || type || '"><h2>' || {_escaped("heading")} || '</h2>' || array_to_string(ps, '') || '</section>' AS html, to_json([{{'type': type, 'title': heading, 'items': 1}}])::VARCHAR AS manifest FROM e""",
    "page_audit_tally": f"WITH {_AUDIT} SELECT page_id, coalesce(sum(n) FILTER (severity = 'break'), 0)::BIGINT AS breaks, coalesce(sum(n) FILTER (severity = 'check'), 0)::BIGINT AS checks FROM found GROUP BY page_id",
    "doc_brief_components": f"WITH {_BRIEFS} SELECT doc_id, pos AS line, v[1] AS type, v[2] AS tier, v[3] AS confidence, md5(coalesce(heading, '')) AS heading, CASE WHEN many THEN n ELSE 0 END::BIGINT AS items, CASE WHEN many THEN 0 ELSE len(own[1].body) END::BIGINT AS body, array_to_string(list_sort(list_distinct(list_concat(coalesce(title.rows, []), flatten(list_transform(own, lambda x: x.rows))))), ',') AS rows FROM components UNION ALL SELECT doc_id, pos, 'unresolved', NULL, NULL, md5(text), NULL, NULL, array_to_string(rows, ',') FROM lost",
    "doc_brief_models": f"""WITH {_BRIEFS}, per AS (SELECT doc_id, count(*) AS components, list(v[1]) AS types FROM components GROUP BY doc_id), gone AS (SELECT doc_id, count(*) AS unresolved FROM lost GROUP BY doc_id),
fit AS (SELECT doc_id, coalesce(components, 0) AS components, coalesce(unresolved, 0) AS unresolved, CASE WHEN list_contains(types, 'content') AND list_contains(types, 'cards') THEN 'mixed' WHEN list_contains(types, 'content') THEN 'article' WHEN list_contains(types, 'cards') THEN 'listing' ELSE 'unknown' END AS template FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN per USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, template, CASE WHEN template = 'mixed' AND components > 2 OR template IN ('article', 'listing') AND components > 1 THEN 'medium' ELSE 'low' END AS confidence, components, unresolved FROM fit""",
    "page_sections": f"""WITH {_PAGES} SELECT page_id, CASE WHEN t IS NOT NULL THEN t WHEN len(body) > 0 THEN 'content' ELSE 'generic' END AS type, CASE WHEN t IS NOT NULL THEN 'named' WHEN len(body) > 0 THEN 'shape' ELSE 'generic' END AS tier, md5(heading) AS heading, len(body) AS body, md5(array_to_string(body, chr(10))) AS copy FROM (SELECT *, {_named("heading")} AS t FROM page WHERE heading <> '' AND NOT {_CHROME.format("heading", "heading")})
UNION ALL SELECT page_id, 'unresolved', NULL, NULL, len(strays) + len(loose), md5(left(array_to_string(strays, ' / '), 200)) FROM page WHERE len(strays) + len(loose) > 0 UNION ALL SELECT page_id, 'unresolved', NULL, NULL, len(body) + 1, md5(heading) FROM page WHERE heading <> '' AND {_CHROME.format("heading", "heading")}""",
    "page_run_places": f"""WITH {_PAGES}, runs AS (SELECT page_id, NULL AS landmark, 'copy' AS kind, strays AS x FROM page UNION ALL SELECT page_id, NULL, 'loose', loose FROM page UNION ALL SELECT page_id, heading, 'copy', body FROM page)
SELECT page_id, md5(landmark) AS landmark, kind, len(x) AS runs, list_sum(list_transform(x, lambda t: length(t)))::BIGINT AS chars, CASE WHEN kind = 'copy' AND landmark IS NULL THEN len(x) + (SELECT len(loose) FROM page p WHERE p.page_id = runs.page_id) * 0 ELSE len(x) + CASE WHEN kind = 'loose' THEN (SELECT len(strays) FROM page p WHERE p.page_id = runs.page_id) ELSE 0 END END AS last FROM runs WHERE len(x) > 0""",
    "page_module_components": f"""WITH a AS (SELECT page_id, list({{'t': text, 'h': href}} ORDER BY k) AS l FROM (SELECT page_id, k, {_shown("a")} AS text, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM {_LINKS}) WHERE text <> '' GROUP BY page_id),
m AS (SELECT *, l[1:(page_id % 4)] AS few FROM a)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'accordion' WHEN {_named("l[1].t")} IS NOT NULL THEN {_named("l[1].t")} WHEN len(few) >= 2 THEN 'cards' ELSE 'generic' END AS type, CASE WHEN page_id % 3 = 0 OR {_named("l[1].t")} IS NOT NULL THEN 'named' WHEN len(few) >= 2 THEN 'repeats' ELSE 'generic' END AS tier, CASE WHEN page_id % 3 = 0 OR {_named("l[1].t")} IS NOT NULL OR len(few) >= 2 THEN 'high' ELSE 'low' END AS confidence,
  md5(l[1].t) AS heading, len(few) AS items, md5(array_to_string(list_transform(few, lambda x: x.t || '=' || x.h), '|')) AS pairs, '' AS body, NULL AS href FROM m WHERE page_id % 3 < 2
UNION ALL SELECT page_id, 'unresolved', NULL, NULL, md5('Breadcrumbs'), NULL, NULL, NULL, NULL FROM m WHERE page_id % 3 = 2
UNION ALL SELECT page_id, 'hero', 'named', 'high', md5(l[1].t), 0, md5(''), coalesce(l[2].t, ''), l[3].h FROM m""",
    "page_claims": f"""WITH RECURSIVE link AS (SELECT page_id, k, {_shown("a")} AS key, {_path_sql("href")} AS path, href FROM (SELECT page_id, k, a, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM {_LINKS}) WHERE a LIKE '%href=%'),
want AS (SELECT page_id, 2 * k + k % 2 AS ord, true AS bare, '' AS key, path, path AS goal FROM link WHERE key <> '' UNION ALL SELECT page_id, 2 * k + 1 - k % 2, key = {_CLEAN.format("to_href")}, key, {_path_sql("to_href")}, {_path_sql("to_href")} FROM (SELECT *, CASE WHEN k % 5 = 1 THEN href || 'x' ELSE href END AS to_href FROM link) WHERE key <> ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM want),
links AS (SELECT page_id, list({{'k': k, 'key': key, 'path': path}} ORDER BY k) AS l FROM link GROUP BY page_id),
walk AS (SELECT page_id, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS ord, NULL::BIGINT AS hit, NULL::VARCHAR AS state FROM links
  UNION ALL SELECT page_id, n, CASE WHEN h IS NULL THEN taken ELSE list_append(taken, h.k) END, ord, h.k, CASE WHEN h IS NULL THEN 'missing' WHEN NOT bare AND h.path <> goal THEN 'wrong target' ELSE 'found' END
  FROM (SELECT w.page_id, x.n, w.taken, x.ord, x.bare, x.goal, list_filter(l.l, lambda y: NOT list_contains(w.taken, y.k) AND CASE WHEN x.bare THEN y.path = x.path ELSE y.key = x.key END)[1] AS h FROM walk w JOIN numbered x ON x.page_id = w.page_id AND x.n = w.n + 1 JOIN links l ON l.page_id = w.page_id))
SELECT page_id, ord, hit AS link, state FROM walk WHERE n > 0""",
    "page_link_audit": f"WITH {_audit_sql(_REAL)} SELECT x.v AS verdict, x.r AS reason, count(*) AS rows, sum(n)::BIGINT AS links, sum(len(x.s))::BIGINT AS suggested FROM g GROUP BY ALL",
    "planted_link_audit": f"WITH {_audit_sql(_PLANTED)} SELECT page_id, kind, text, href, x.v AS verdict, x.r AS reason, array_to_string(x.s, ',') AS suggested, x.c AS confident, n FROM g",
}
