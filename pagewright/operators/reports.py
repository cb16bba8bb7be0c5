"""What is reported of findings, links, forms and places: tallies, groups, lists and what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link_tally(links: DataFrame, *by: str) -> DataFrame:
    """(by..., checked, ok, dead, unverified) of link verdicts; refused ones count as unverified."""
    count = lambda *v: F.count_if(F.col("verdict").isin(*v))
    return links.groupBy(*by).agg(F.count("*").alias("checked"), count("ok").alias("ok"), count("dead").alias("dead"), count("unverified", "refused").alias("unverified"))


def audit_counts(audit: DataFrame, *by: str) -> DataFrame:
    """(by..., red, amber, green) of an audit of links."""
    return audit.groupBy(*by).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("red", "amber", "green")])


def asked_for(wants: DataFrame, *by: str) -> DataFrame:
    """(by..., places): where a brief asks for a text, each section and row once, in order; wants are (by..., ord, section, row)."""
    row = F.concat(F.lit("row "), F.col("row").cast("string"))
    place = F.coalesce(F.concat_ws(", ", F.nullif("section", F.lit("")), row), F.lit(""))
    rows = wants.withColumn("place", place).where("place <> ''").groupBy(*by, "place").agg(F.min("ord").alias("ord"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "place"))), lambda x: x["place"]), "; ").alias("places"))


def unreported(findings: DataFrame, reported: DataFrame) -> DataFrame:
    """``findings`` (page_id, found, ...) but for those whose address the page's ``reported`` (page_id, found) has already."""
    return findings.join(reported.select("page_id", "found").where("found is not null").distinct(), ["page_id", "found"], "left_anti").select(*findings.columns)


def with_suggestions(findings: DataFrame, audit: DataFrame, suggestions: DataFrame) -> DataFrame:
    """``findings`` (page_id, found, ...) with ``suggest``: the best page for a dead or placeholder link of that text.

    ``audit`` is (page_id, ord, kind, text, text_id), ``suggestions`` (text_id, url, confident) one for each text. The first
    link of a text that has a suggestion decides; one that isn't sure says so.
    """
    dead = audit.where(F.col("kind").isin("dead-cta", "placeholder")).join(suggestions, "text_id")
    say = F.concat("url", F.when(F.col("confident"), "").otherwise(" (closest match — check it)"))
    first = dead.groupBy("page_id", F.col("text").alias("found")).agg(F.min_by(say, "ord").alias("suggest"))
    return findings.join(first, ["page_id", "found"], "left").select(*findings.columns, "suggest")


def place_of(offsets: DataFrame, modules: DataFrame, fields: DataFrame) -> DataFrame:
    """(page_id, offset, module, field): the module around each offset and the last of its fields that starts at or before it.

    ``modules`` is (page_id, module, start, end), ``fields`` (page_id, module, at, field). Pages are joined by id; of modules that
    overlap the one that starts first counts.
    """
    inside = offsets.join(modules, "page_id").where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")))
    inside = inside.groupBy("page_id", "offset").agg(F.min_by("module", "start").alias("module"))
    near = inside.join(fields, ["page_id", "module"], "left").groupBy("page_id", "offset", "module").agg(F.max_by(F.when(F.col("at") <= F.col("offset"), F.col("field")), F.when(F.col("at") <= F.col("offset"), F.col("at"))).alias("field"))
    return offsets.select("page_id", "offset").distinct().join(near, ["page_id", "offset"], "left").select("page_id", "offset", "module", "field")


def form_groups(forms: DataFrame) -> DataFrame:
    """(page_id, path, site, n, missing, topics, countries): a page's own forms by path, names in order of first use.

    ``forms`` is (page_id, ord, path, site, topic, country); ``missing`` counts forms without a country.
    """

    def names(column: str) -> DataFrame:
        seen = forms.where(F.coalesce(column, F.lit("")) != "").groupBy("page_id", "path", column).agg(F.min("ord").alias("ord"))
        return seen.groupBy("page_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda x: x[column]).alias("names"))

    per = forms.groupBy("page_id", "path").agg(F.min_by("site", "ord").alias("site"), F.count("*").alias("n"), F.count_if(F.coalesce("country", F.lit("")) == "").alias("missing"))
    per = per.join(names("topic").withColumnRenamed("names", "topics"), ["page_id", "path"], "left").join(names("country").withColumnRenamed("names", "countries"), ["page_id", "path"], "left")
    none = F.array().cast("array<string>")
    return per.select("page_id", "path", "site", "n", "missing", F.coalesce("topics", none).alias("topics"), F.coalesce("countries", none).alias("countries"))


def form_site_findings(groups: DataFrame, markets: DataFrame) -> DataFrame:
    """(page_id, severity, found, expected): forms of another market's site, of no site, of another country, or without one.

    ``markets`` is (page_id, site, country) of each page; pages whose market has no site are checked only for mixed sites.
    """
    sites = groups.where("site is not null").groupBy("page_id").agg(F.array_sort(F.collect_set("site")).alias("sites")).where("size(sites) > 1")
    mixed = sites.select("page_id", F.lit("break").alias("severity"), F.array_join("sites", ", ").alias("found"), F.lit(None).cast("string").alias("expected"))
    m = groups.join(markets.select("page_id", F.col("site").alias("want"), F.col("country").alias("home")), "page_id").where("want is not null")
    none = m.where("site is null").select("page_id", F.lit("check"), "path", F.lit(None).cast("string"))
    other = m.where("site <> want").select("page_id", F.lit("break"), "site", "want")
    abroad = m.where("home is not null").select("page_id", "home", F.explode("countries").alias("c")).where("c <> home").select("page_id", F.lit("break"), "c", "home")
    silent = m.where("missing > 0").select("page_id", F.lit("check"), "path", F.lit(None).cast("string"))
    return mixed.union(none).union(other).union(abroad).union(silent)


def label_stem(label: Column) -> Column:
    """A label in lower case with single spaces and without the number at its end."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(label), r"\s+", " ")), r"\s*\d+\s*$", "")


def stem_groups(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., stem, first, n, labels): labels (by..., ord, label) that differ by their last number only, in order."""
    one = F.array_sort(F.collect_list(F.struct("ord", "label")))
    return rows.groupBy(*by, label_stem(F.col("label")).alias("stem")).agg(F.min("ord").alias("first"), F.count("*").alias("n"), F.transform(one, lambda x: x["label"]).alias("labels"))


def expand_regions(codes: DataFrame, areas: DataFrame, frontlines: DataFrame) -> DataFrame:
    """(code, kind, market): the markets of each asked code, a frontline's own or those of an area's frontlines; unknown ones are invalid.

    ``codes`` is (code), compared in upper case, each once; ``areas`` (area, frontline), ``frontlines`` (frontline, market). A code that is both is a frontline.
    """
    asked = codes.select(F.upper(F.trim("code")).alias("code")).distinct()
    own = frontlines.select(F.upper("frontline").alias("code"), "market")
    of_area = areas.join(frontlines, "frontline").select(F.upper("area").alias("code"), "market")
    first = asked.join(own, "code").select("code", F.lit("frontline").alias("kind"), "market")
    left = asked.join(own.select("code").distinct(), "code", "left_anti")
    second = left.join(of_area, "code").select("code", F.lit("area").alias("kind"), "market").distinct()
    none = left.join(of_area.select("code").distinct(), "code", "left_anti").select("code", F.lit("invalid").alias("kind"), F.lit(None).cast("string").alias("market"))
    return first.union(second).union(none)


def registry_entries(countries: DataFrame) -> DataFrame:
    """The registry of markets with defaults: base name without a last part in brackets, lower-case domains, corporate titles allowed."""
    low = lambda c: F.lower(F.col(c))
    none = F.array().cast("array<string>")
    return countries.select(
        "name", F.regexp_replace("name", r"\s*\([^)]*\)\s*$", "").alias("base"), F.coalesce(low("domain"), F.lit("")).alias("domain"), F.nullif("lang_path", F.lit("")).alias("lang_path"),
        F.col("form_id").cast("string").alias("form_id"), F.coalesce("site_names", none).alias("site_names"), F.coalesce("draft_names", none).alias("draft_names"), low("site").alias("site"),
        F.coalesce("corporate_title", F.lit(True)).alias("corporate_title"), F.regexp_replace("root", "/+$", "").alias("root"), F.transform(F.coalesce("former", none), lambda x: F.lower(x)).alias("former"))


def market_of_brief(pages: DataFrame, said: DataFrame, by_domain: DataFrame, registry: DataFrame) -> DataFrame:
    """(page_id, market, basis): the market the page's brief names, if the registry knows it, else that of its domain."""
    known = said.join(registry.select(F.col("name").alias("market")), "market").groupBy("page_id").agg(F.min("market").alias("named"))
    out = pages.select("page_id").join(known, "page_id", "left").join(by_domain.select("page_id", F.col("market").alias("found")), "page_id", "left")
    return out.select("page_id", F.coalesce("named", "found").alias("market"), F.when(F.col("named").isNotNull(), "brief").when(F.col("found").isNotNull(), "domain").otherwise("none").alias("basis"))


def page_only(findings: DataFrame) -> DataFrame:
    """(page_id, category, breaks, checks) of what a page without a brief is found to have: findings (…, from_brief) of the brief go, empty categories don't show."""
    own = findings.where(~F.coalesce("from_brief", F.lit(False)))
    return own.groupBy("page_id", "category").agg(F.count_if(F.col("severity") != "check").alias("breaks"), F.count_if(F.col("severity") == "check").alias("checks"))


def form_id_rows(verdicts: DataFrame) -> DataFrame:
    """(page_id, field, source, expected, found, state): what is on screen for each page's form id, clean or not."""
    return verdicts.select("page_id", F.lit("Form id").alias("field"), F.nullif("source", F.lit("")).alias("source"), F.nullif("expected", F.lit("")).alias("expected"), F.nullif(F.array_join("ids", ", "), F.lit("")).alias("found"), "state")
