"""Forms of pages: which they carry, which they should, and whether everyone can use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators.rules import finding, union

# fixed values: address of a hosted form, and the field that carries its id when it is sent
HOSTED = r"(?i)^https?://[^/?#]*\btfaforms\.(?:net|com)/(?:publish/|rest/forms/view/|forms/view/)?(\d+)(?:[/?#]|$)"
ID_FIELD = "tfa_dbFormId"
# fixed values: sources of a form's id, the strongest first
ID_SOURCES = ("field", "element", "wrapper", "embed", "target")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _value(body: Column, name: str) -> Column:
    """Value of the input named ``name``; null without it or empty."""
    tag = F.regexp_extract(body, rf"(?is)(<input\b[^>]*\b(?:name|id)\s*=\s*[\"']{name}[\"'][^>]*>)", 1)
    return F.when(tag != "", F.nullif(T.attr(tag, "value"), F.lit("")))


def forms(pages: DataFrame) -> DataFrame:
    """(page_id, ord, embed, form_id, ids, action, path, site, country, unlabelled, empty_legends): every form of a page.

    ``embed`` is component (a wrapper with a target id and the script that fills it), script, iframe, markup (a hosted
    form's own elements), site-form (posts to the fragment that defines it) or other (posts elsewhere). Comments and
    bodies of scripts hold no forms. ``ids`` keeps the id by each source; ``form_id`` is the strongest source's.
    """
    src = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", " "), r"(?is)(<script\b[^>]*>).*?</script>", "$1</script>")
    base = pages.select("page_id", src.alias("src"))
    # a piece starts at every form, wrapper, script and iframe; forms run to their closing tag
    pieces = F.split("src", r"(?i)(?=<(?:form|script|iframe)\b|</form\b|<[a-z][a-z0-9-]*\b[^>]*FormAssemblyIntegration)")
    # the wrapper of a hosted form stands before it, in the piece that ends where the form starts
    wrapped = r"(?is)^.*\bid\s*=\s*[\"'](\d+)-WRPR[\"']"
    cut = F.transform(pieces, lambda x, i: F.struct(x.alias("piece"), F.regexp_extract(F.coalesce(F.get(pieces, i - 1), F.lit("")), wrapped, 1).alias("before")))
    rows = base.select("page_id", F.posexplode(cut).alias("ord", "x")).select("page_id", "ord", "x.*").where(F.col("piece").rlike(r"(?i)^<(form|script|iframe)\b|^<[a-z][^>]*FormAssemblyIntegration"))
    tag = F.regexp_extract("piece", r"(?s)^(<[^>]*>)", 1)
    rows = rows.withColumn("tag", tag).withColumn("name", F.lower(F.regexp_extract("piece", r"^<([a-zA-Z0-9-]+)", 1)))
    action, url = T.attr(F.col("tag"), "action"), T.attr(F.col("tag"), "src")
    embed_id = F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), HOSTED, 1), F.lit(""))
    number = lambda c: F.when(c.rlike(r"^\d+$"), c)
    inside = F.regexp_extract("piece", wrapped, 1)
    wrapper = F.when(F.col("name") == "form", F.coalesce(F.nullif(inside, F.lit("")), F.nullif("before", F.lit(""))))
    rows = rows.select(
        "page_id", "ord", "name", "tag", "piece", action.alias("action"), F.lower(F.coalesce(T.attr(F.col("tag"), "method"), F.lit("get"))).alias("method"),
        F.struct(_value(F.col("piece"), ID_FIELD).alias("field"), F.when(F.col("name") == "form", number(T.attr(F.col("tag"), "id"))).alias("element"), wrapper.alias("wrapper"), F.when(F.col("name").isin("script", "iframe"), embed_id).alias("embed"), number(T.attr(F.col("tag"), "data-target-id")).alias("target")).alias("ids"),
    )
    hosted = F.col("action").rlike("(?i)tfaforms") | F.col("ids.field").isNotNull()
    site = F.col("tag").rlike(r"(?i)data-nc\s*=\s*[\"']Form[\"']|class\s*=\s*[\"'][^\"']*\bcmp-form\b") & F.col("action").rlike(r"(?i)/content/experience-fragments/|formsubmit\.json")
    kind = (
        F.when(F.col("tag").rlike("FormAssemblyIntegration"), "component").when(F.col("name").isin("script", "iframe") & F.col("ids.embed").isNotNull(), F.col("name"))
        .when((F.col("name") == "form") & F.coalesce(hosted, F.lit(False)), "markup").when((F.col("name") == "form") & F.coalesce(site, F.lit(False)), "site-form")
        .when((F.col("name") == "form") & (F.col("method") == "post"), "other")
    )
    rows = rows.withColumn("embed", kind).where("embed is not null")
    path = F.coalesce(F.nullif(F.regexp_extract("action", r"(?i)/forms/(.+?)/_jcr_content/", 1), F.lit("")), F.nullif(F.regexp_extract("action", r"(?i)/experience-fragments/(.+?)/_jcr_content/", 1), F.lit("")), "action")
    served = F.lower(F.concat_ws("/", F.regexp_extract("action", r"(?i)/frontlines/([a-z]{2,3})/[a-z]{2,3}(?:/|$)", 1), F.regexp_extract("action", r"(?i)/frontlines/[a-z]{2,3}/([a-z]{2,3})(?:/|$)", 1)))
    own = F.col("embed") == "site-form"
    best = F.when(own, path).when(F.col("embed") != "other", F.coalesce(*[F.col(f"ids.{s}") for s in ID_SOURCES]))
    return rows.select(
        "page_id", "ord", "embed", best.alias("form_id"), "ids", "action", F.when(own, path).alias("path"), F.when(own & (served != "/"), served).alias("site"),
        F.when(own, F.regexp_extract("piece", r"(?is)<input\b[^>]*\bname\s*=\s*[\"'][a-z]*Country[\"'][^>]*\bvalue\s*=\s*[\"']([^\"']+)", 1)).alias("country"),
        F.when(F.col("name") == "form", unlabelled(F.col("piece"))).alias("unlabelled"),
        F.when(F.col("name") == "form", F.size(F.filter(_all(F.col("piece"), r"(?is)<legend\b[^>]*>(.*?)</legend>"), lambda x: T.strip_tags(x) == ""))).alias("empty_legends"),
    )


def unlabelled(body: Column) -> Column:
    """Names of fields a visitor fills in that no label, wrapping label or aria-label names, each once."""
    free = F.regexp_replace(body, r"(?is)<label\b[^>]*>(?:(?!</label).)*?<(?:input|select|textarea)\b.*?</label>", " ")
    labelled = _all(body, r"(?is)<label\b[^>]*\bfor\s*=\s*[\"']([^\"']+)")
    fields = _all(free, r"(?is)(<(?:input|select|textarea)\b[^>]*>)")
    name = lambda t: F.coalesce(T.attr(t, "name"), T.attr(t, "id"), F.lower(F.regexp_extract(t, r"^<(\w+)", 1)))
    filled = lambda t: ~F.lower(F.coalesce(T.attr(t, "type"), F.lit(""))).isin("hidden", "submit", "button", "reset", "image") & ~name(t).rlike("(?i)hptext")
    named = lambda t: F.coalesce(F.array_contains(labelled, T.attr(t, "id")), F.lit(False)) | F.coalesce(T.attr(t, "aria-label"), T.attr(t, "aria-labelledby")).isNotNull()
    return F.array_distinct(F.transform(F.filter(fields, lambda t: filled(t) & ~named(t)), name))


def carried(found: DataFrame, declared: DataFrame) -> DataFrame:
    """(page_id, ids, source, hosted, paths): ids of hosted forms, else the id a page's data declares; paths of its own forms.

    ``declared`` is (page_id, declared): one row for every page.
    """
    hosted = ~F.col("embed").isin("site-form", "other")
    per = found.groupBy("page_id").agg(F.array_sort(F.collect_set(F.when(hosted, F.col("form_id")))).alias("ids"), F.count_if(hosted).alias("hosted"), F.array_sort(F.collect_set("path")).alias("paths"))
    none = F.array().cast("array<string>")
    out = declared.join(per, "page_id", "left")
    use = F.coalesce(F.col("hosted") > 0, F.lit(False))
    return out.select("page_id", F.when(use, F.col("ids")).when(F.col("declared").isNotNull(), F.array("declared")).otherwise(none).alias("ids"), F.when(use, "embedded").when(F.col("declared").isNotNull(), "declared").alias("source"), F.coalesce("hosted", F.lit(0)).alias("hosted"), F.coalesce("paths", none).alias("paths"))


def id_verdicts(pages: DataFrame, expected: DataFrame, overrides: list[tuple[str, str]], market_ids: DataFrame) -> DataFrame:
    """(page_id, expected, ids, state): the id a page should carry against those it does.

    The id named for the address comes first, then the first override whose path it is under, then its market's.
    ``pages`` is ``carried`` with url, market and status; ``expected`` (page_id, form_id); ``market_ids`` (market, form_id).
    States: matches, differs, missing, no-form, own-forms and not-checked; only the second and third are wrong.
    """
    path = U.path_of(F.col("url"))
    fixed = F.coalesce(*[F.when(U.under_path(path, F.lit(p.lower().rstrip("/"))), F.lit(i)) for p, i in overrides], F.lit(None).cast("string"))
    rows = pages.join(expected.select("page_id", F.col("form_id").alias("listed")), "page_id", "left").join(market_ids.select("market", F.col("form_id").alias("usual")), "market", "left")
    rows = rows.withColumn("want", F.coalesce("listed", F.when(F.col("status") == "found", F.coalesce(fixed, "usual"))))
    trim = lambda c: F.lower(F.regexp_replace(c, "^/+|/+$", ""))
    by_path = F.col("listed").isNotNull() & ~F.col("listed").rlike(r"^\d+$")
    has_path = F.exists("paths", lambda x: trim(x) == trim(F.col("listed")))
    state = (
        F.when(by_path, F.when(has_path, "matches").otherwise("missing")).when((F.size("ids") == 0) & (F.size("paths") > 0) & F.col("listed").isNull(), "own-forms")
        .when(F.col("want").isNull(), "not-checked").when((F.col("hosted") > 0) & (F.size("ids") == 0), "missing")
        .when((F.size("ids") == 0) & F.col("listed").isNotNull(), "missing").when(F.size("ids") == 0, "no-form")
        .when(F.exists("ids", lambda x: x != F.col("want")), "differs").otherwise("matches")
    )
    return rows.select("page_id", F.col("want").alias("expected"), "ids", state.alias("state"))


def market_findings(found: DataFrame, market: DataFrame) -> DataFrame:
    """Own forms that serve another market than the page's, or several, or say no country; ``market`` is (page_id, site, country)."""
    own = found.where("embed = 'site-form'").groupBy("page_id", "path", "site").agg(F.array_sort(F.collect_set(F.nullif("country", F.lit("")))).alias("countries"), F.count_if(F.coalesce("country", F.lit("")) == "").alias("silent"))
    rows = own.join(market.select("page_id", F.col("site").alias("want"), F.col("country").alias("need")), "page_id", "left")
    sites = own.groupBy("page_id").agg(F.array_sort(F.collect_set("site")).alias("sites"))
    wrong = rows.select("page_id", "need", F.explode("countries").alias("c")).where("c <> need")
    return union([
        finding(sites.where("size(sites) > 1"), "structure", "break", "Form market", F.array_join("sites", ", "), "forms of more than one market"),
        finding(rows.where("want is not null and site is null"), "structure", "check", "Form market", F.col("path"), "posts to no market's site"),
        finding(rows.where("site <> want"), "structure", "break", "Form market", F.col("site"), "another market's form"),
        finding(wrong, "structure", "break", "Form market", F.col("c"), "sends another country"),
        finding(rows.where("want is not null and silent > 0"), "structure", "check", "Form market", F.col("path"), "sends no country"),
    ])


def wiring_findings(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Parts of one form that name different forms; a declared id that no embedded form has; fields and groups without names, once a form."""
    ids = F.array_distinct(F.filter(F.array(*[F.col(f"ids.{s}") for s in ID_SOURCES]), lambda x: x.isNotNull()))
    hosted = found.where("embed not in ('site-form', 'other')")
    embedded = hosted.where("form_id is not null").groupBy("page_id").agg(F.array_sort(F.collect_set("form_id")).alias("embedded"))
    off = embedded.join(declared, "page_id").where(~F.array_contains("embedded", F.col("declared")))
    key = F.coalesce("path", "form_id", F.col("ord").cast("string"))
    once = found.withColumn("key", key).groupBy("page_id", "key").agg(F.min(F.struct("ord", "unlabelled", "empty_legends")).alias("x")).select("page_id", "key", "x.*")
    return union([
        finding(hosted.where(F.size(ids) > 1), "structure", "break", "Form wiring", F.array_join(ids, ", "), "parts name different forms"),
        finding(off, "structure", "check", "Form id", F.array_join("embedded", ", "), "declared id is not embedded"),
        finding(once.where("size(unlabelled) > 0"), "structure", "check", "Form accessibility", F.array_join("unlabelled", ", "), "fields without a label"),
        finding(once.where("empty_legends > 0"), "structure", "check", "Form accessibility", F.col("empty_legends"), "groups without a name"),
    ])
