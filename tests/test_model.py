"""Models of briefs and pages: tiers, runs with their titles, modules with fields that repeat, sections by level."""

import json

import pytest

from pagewright.operators import model, places

WORDS = model.Vocabulary(
    names={"Accordion": "accordion", "Hero Banner": "hero", "Value Highlight": "value-highlights"},
    signals=(("form", ("form", "get a quote")), ("value-highlights", ("value highlights",)), ("cards", ("our services",))),
    chrome=("breadcrumb", "cookie notice"),
    slots={"hero": ("heading", "subtitle", "intro", "cta", "media"), "content": ("heading", "intro", "body")},
    templates=(("product", ("hero", "cards")), ("faq", ("accordion",)), ("campaign", ("hero", "cards", "accordion"))),
)
LONG = "This is a paragraph that is long enough to read as prose and that ends as a sentence does. "


def briefs(spark, *texts):
    return spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "brief_id long, text string")


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def rows(parts):
    return {k: [r for r in sorted(parts.collect(), key=lambda r: r.at) if r.page_id == k] for k in range(20)}


def test_brief_lines_become_blocks(spark):
    b = briefs(spark, ["URL Path\thttps://a.test/x", "Internal Links\t●\thttps://a.test/y", "●\thttps://a.test/z", "Sources\t●\thttps://s.test", "", "Doors[1.0]", "Hero image: Assets - big-door", LONG, "FAQs", "Late\tlabel here."])
    got = [(r.at, r.kind, r.text) for r in model.brief_stream(b).orderBy("at").collect()]
    assert got == [(2, "link", "https://a.test/y"), (3, "link", "https://a.test/z"), (6, "heading", "Doors"), (7, "image", "big-door"), (8, "copy", LONG.strip()), (9, "heading", "FAQs"), (10, "copy", "Late label here.")]


def test_runs_fold_and_take_their_titles(spark):
    question = lambda k: [f"What is {k}?[1.{k}]", LONG]
    card = lambda k: [f"Point {k}[2.{k}]", "Short text."]
    parts, lost = model.from_briefs(briefs(
        spark,
        ["Questions", *question(1), *question(2)],  # a bare heading before questions is their title
        ["Value highlights", *card(1), *card(2)],  # a bare heading inside cards is pulled out, and names the run
        [*card(1), *card(2)], ["Lead", *card(1)],  # two are a run, title or not
        ["1. Plan[1.0]", "Do it.", "Step 2[1.1]", "Do more."], [*question(1)], ["Cookie notice[1.0]", LONG],
        ["Internal Links\t●\thttps://a.test/y", "Doors[1.0]", LONG + LONG * 4], ["A sentence that stands before any heading of the brief at all, which makes it stray.", "Doors[1.0]", LONG * 5],
        ["Get a quote[1.0]", LONG * 5], ["Doors[1.0]", "Please send the form. " + LONG * 5], ["CTA[1.0]", LONG * 5], ["Doors[1.0]", "Assets - door"], [""],
    ), WORDS)
    got = rows(parts)
    assert [(r.type, r.tier, r.confidence, r.heading, len(r["items"])) for r in got[0]] == [("accordion", "repeats", "medium", "Questions", 2)]
    assert got[0][0].rows == [1, 2, 3, 4, 5] and got[0][0]["items"][0].title == "What is 1?"
    assert [(r.type, r.tier, r.heading, len(r["items"])) for r in got[1]] == [("value-highlights", "named", "Value highlights", 2)]
    assert [(r.type, r.heading, len(r["items"])) for r in got[2]] == [("cards", None, 2)]
    assert [(r.type, r.heading, [i.body for i in r["items"]]) for r in got[3]] == [("cards", None, [None, "Short text."])]
    assert [(r.type, r.confidence) for r in got[4]] == [("steps", "medium")]
    assert [(r.type, r.tier) for r in got[5]] == [("content", "shape")]
    assert got[6] == [] and got[13] == []
    assert [(r.type, len(r.links)) for r in got[7]] == [("cta", 1), ("content", 0)]
    assert [r.type for r in got[8]] == ["content"]
    assert [[(r.type, r.tier) for r in got[k]] for k in (9, 10, 11, 12)] == [[("form", "named")], [("form", "named")], [("cta", "slot")], [("hero", "shape")]]
    assert sorted((r.page_id, r.why) for r in lost.collect()) == [(6, "names a part of the page's frame"), (8, "stands before any heading")]


FIELD = '<!-- Start Component Field: {"XPath":"tcm:Content/custom:%s"} -->'


def field(path, value):
    return f"<div>{FIELD % path}{value}</div>"


FAQ = "".join(field(f"Accordion/custom:items[{k}]/custom:{leaf}", f"{leaf} {k}") for k in (2, 1) for leaf in ("title", "body"))
MODULES = [
    f'<section class="module module-faq" id="f1"><h2>Asked</h2>{FAQ}</section><section class="module module-faq"><p>Plain text</p></section>',
    f'<section class="x hero-banner">{field("Hero/custom:heading", "Big")}{field("Hero/custom:intro", "First")}{field("Hero/custom:body", "Second")}{field("Hero/custom:actionText", "Go")}{field("Hero/custom:actionUrl", "/go")}<section class="module-inner"><p>in</p></section></section>',
    f'<section class="module-list">{field("L/custom:rows[1]/custom:question", "Q1")}{field("L/custom:rows[1]/custom:answer", "A1")}{field("L/custom:rows[2]/custom:question", "Q2")}{field("L/custom:rows[3]/custom:icon", "none")}</section><section class="module-breadcrumbs">a</section>',
]


def test_modules_with_fields_that_repeat(spark):
    p = pages(spark, *MODULES)
    found = model.modules(p, components=[("Accordion", ["module", "module-faq"])])
    got = {(r.page_id, r.label, r.nth): r for r in found.collect()}
    assert set(got) == {(0, "FAQ", 1), (0, "FAQ", 2), (1, "Hero banner", 1), (2, "List", 1), (2, "Breadcrumbs", 1)}
    assert got[0, "FAQ", 1].anchor == "f1" and got[0, "FAQ", 1].component == "Accordion" and got[1, "Hero banner", 1].text.endswith("in")
    parts, lost = model.of_modules(found, places.fields(p), WORDS)
    by = rows(parts)
    assert [(r.type, r.tier, r.heading, [(i.title, i.body) for i in r["items"]]) for r in by[0]] == [("accordion", "named", "Asked", [("title 2", "body 2"), ("title 1", "body 1")]), ("accordion", "named", None, [])]
    assert by[0][1].body == ["Plain text"] and by[0][0].why == "editor fields say Accordion" and by[0][1].why == "classes say Accordion"
    hero = by[1][0]
    assert (hero.type, hero.heading, hero.body, [tuple(x) for x in hero.links]) == ("hero", "Big", ["First", "Second"], [("Go", "/go")])
    assert [(r.type, r.tier, [(i.title, i.body) for i in r["items"]]) for r in by[2]] == [("accordion", "repeats", [("Q1", "A1"), ("Q2", None)])]
    assert [(r.page_id, r.text) for r in lost.collect()] == [(2, "Breadcrumbs")]


@pytest.mark.parametrize("path, index, leaf, role", [
    ("Accordion/items[1]/title", 1, "title", "heading"), ("Hero/heading", None, "heading", "heading"), ("L/rows[12]/link/actionUrl", 12, "link/actionUrl", "href"),
    ("items[3]", 3, "items[3]", None), ("a/b[1]/c[2]/answer", 1, "c[2]/answer", "answer"), ("", None, "", None), ("x/my-list[4]/title", None, "title", "heading"),
])
def test_field_roles(spark, path, index, leaf, role):
    (r,) = model.field_roles(spark.createDataFrame([(1, 1, 1, path, "v")], "page_id long, module_at int, at int, path string, value string")).collect()
    assert (r["index"], r.leaf, r.role) == (index, leaf, role)


SECTIONS = [
    "<p>stray</p><h1>Title</h1><h2>One</h2><p>a</p><h3>Sub 1</h3><p>s1</p><p>more</p><h3>Sub 2</h3><p>s2</p><img src='/x/pic%20a.png?w=1'><h2>Two</h2><p>b</p>",
    "<h2>Why?</h2><details><summary>Q1</summary><p>A1</p></details><details><summary>Q2</summary></details>",
    "<h1>A</h1><p>x</p><h1>B</h1><h4>only sub</h4><p>below</p><h1>Breadcrumb</h1><p>y</p>", "<div class=a><div>loose 1</div><div><p>no</p></div></div><details><summary>Q</summary>A</details>", "", None,
    '<h3 style="display:none">hidden</h3><h3>Step 1</h3><h4>1. a</h4><h4>2. b</h4><h3>Our services</h3>',
]


def test_sections_by_level(spark):
    p = pages(spark, *SECTIONS)
    stream = model.page_stream(p)
    assert [(r.kind, r.text) for r in stream.where("page_id = 3").orderBy("at").collect()] == [("loose", "loose 1"), ("copy", "no"), ("fold", "Q")]
    parts, lost = model.sections(stream, WORDS)
    got = rows(parts)
    assert [(r.heading, r.type, r.body, [(i.title, i.body) for i in r["items"]], r.image) for r in got[0]] == [("Title", "generic", [], [], None), ("One", "cards", ["a", "more"], [("Sub 1", "s1"), ("Sub 2", "s2")], "pic a.png"), ("Two", "content", ["b"], [], None)]
    assert [(r.type, [(i.title, i.body) for i in r["items"]], r.body) for r in got[1]] == [("accordion", [("Q1", "A1"), ("Q2", None)], [])]
    assert [(r.heading, r.type, r.body, r["items"]) for r in got[2]] == [("A", "content", ["x"], []), ("B", "content", ["only sub: below"], [])]
    assert [(r.heading, r.type, r.body) for r in got[3]] == [(None, "generic", ["Q: A"])]
    assert got[4] == got[5] == []
    assert [(r.heading, r.type, len(r["items"])) for r in got[6]] == [("Step 1", "steps", 2), ("Our services", "cards", 0)]
    assert sorted((r.page_id, r.text) for r in lost.collect()) == [(0, "stray"), (2, "Breadcrumb"), (3, "no")]


def test_landmarks(spark):
    got = model.landmarks(model.page_stream(pages(spark, SECTIONS[0]))).orderBy("at").collect()
    assert [(r.text, r.landmark, r.nth) for r in got] == [("stray", None, 1), ("a", "One", 1), ("s1", "Sub 1", 1), ("more", "Sub 1", 2), ("s2", "Sub 2", 1), ("pic a.png", "Sub 2", 2), ("b", "Two", 1)]


def test_build_is_one_model_for_briefs_and_pages(spark):
    p = pages(spark, *MODULES, *SECTIONS)
    parts, lost = model.from_pages(p, WORDS, [("Accordion", ["module", "module-faq"])])
    got = {r.page_id: r for r in model.build(parts, lost, p, "page", WORDS).collect()}
    assert len(got) == len(MODULES) + len(SECTIONS)
    assert (got[0].template, got[0].confidence, got[0].components) == ("faq", "medium", 2) and (got[8].template, got[8].components, got[8].manifest) == ("unknown", 0, "[]")
    assert json.loads(got[1].manifest)[0]["slots"] == [{"slot": "heading", "text": "Big"}, {"slot": "intro", "text": "First"}, {"slot": "cta", "text": "Go"}]
    assert json.loads(got[1].manifest)[0]["unmapped"] == ["Second"] and got[2].unresolved == 1
    b = briefs(spark, ["Doors[1.0]", LONG * 5, "Who? TBD", LONG * 5])
    parts, lost = model.from_briefs(b, WORDS)
    (one,) = model.build(parts, lost, b.withColumnRenamed("brief_id", "page_id"), "brief", WORDS).collect()
    assert (one.origin, one.components, one.open_items) == ("brief", 2, 1)
    assert set(json.loads(one.manifest)[0]) <= set(json.loads(got[1].manifest)[0])
    none = model.from_pages(pages(spark).limit(0) if False else p.limit(0), WORDS)
    assert none[0].count() == none[1].count() == 0


def test_lines_of_briefs_are_read_before_the_windows(spark):
    """Above its only exchange the stream searches no text, so what reads it twice shares the work."""
    text = "Internal links\t/a\n ● \t https://b.test/x \nOwner\tme\nTop [1.1]\nAsset - pic.png\nShort line\nA line that ends.\n[2.2]"
    stream = model.brief_stream(spark.createDataFrame([(1, text)], "brief_id int, text string"))
    plan = stream._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(x in plan.split("Exchange")[0].lower() for x in ("regexp", "rlike"))
    got = [(r.at, r.kind, r.text, r.href) for r in stream.orderBy("at").collect()]
    assert got == [(1, "link", "/a", "/a"), (2, "link", "https://b.test/x", "https://b.test/x"), (4, "heading", "Top", None), (5, "image", "pic.png", None), (6, "heading", "Short line", None), (7, "copy", "A line that ends.", None), (8, "heading", "[2.2]", None)]
