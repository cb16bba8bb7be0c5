from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import copy, markup, places


def pages(spark, *html):
    return spark.createDataFrame([(k, "https://a.com/en/p", h) for k, h in enumerate(html)], "page_id int, url string, html string")


PAGE = """<header class="top"><nav style="display:none"><a href="/menu">m</a></nav></header><h2>Above</h2><a href="/loose">x</a>
<section class="module-a" id="one"><h2>First</h2><div class="teaser"><a href="/t1">a</a></div><div class="teaser"><h3>Second <b>teaser</b></h3><article><a href="/t2">b</a></article></div></section>
<section class="module-a"><!-- <a href="/gone">no</a> --><script>"<a href='/js'>"</script><a href="/t1">c</a><a href="#top">d</a></section><site-footer><footer><a href="/f">f</a></footer>"""


def test_link_places(spark):
    got = {(r.url, p.place, p.hidden, p.anchor) for r in places.link_places(pages(spark, PAGE)).collect() for p in r.places}
    assert got == {
        ("https://a.com/menu", "Header (hidden)", True, None),
        ("https://a.com/loose", 'Page body — "Above"', False, None),
        ("https://a.com/t1", "module-a #1 › teaser 1", False, "#one"),
        ("https://a.com/t2", 'module-a #1 › teaser 2 — "Second teaser"', False, "#one"),
        ("https://a.com/t1", "module-a #2", False, None),
        ("https://a.com/f", "Footer", False, None),
    }
    assert places.link_places(pages(spark, None, "", "no tags")).count() == 0


def test_places_of_forms_and_long_titles(spark):
    html = '<div id="tab1" role="tabpanel"><section class="module-f"><h2>' + "word " * 30 + '</h2><div id="inner"><form action="/x"></form></div></section></div>'
    r = places.form_places(pages(spark, html)).first()
    assert (r.near, r.panel) == ("inner", "tab1") and r.place.startswith('module-f #1 — "word word') and r.place.endswith('word…"') and len(r.place) < 90


def test_fields(spark):
    field = lambda path: '<!-- Start Component Field: {"XPath":"tcm:Content/custom:A/custom:' + path + '"} -->'
    html = f'<section class="module-a"><h2>{field("title")}Head <b>line</b></h2><a>Label{field("label")}</a><p>{field("body")}</p><i>{field("imageUrl")}</i><p>{field("note")}We have all the parts for you</p></section>'
    got = places.fields(pages(spark, html))
    assert {(r.path, r.value) for r in got.collect()} == {("A/title", "Head line"), ("A/label", "Label"), ("A/body", ""), ("A/imageUrl", ""), ("A/note", "We have all the parts for you")}
    found = places.field_findings(got, spark.createDataFrame([(0,)], "page_id int")).collect()
    assert sorted((r.note, r.found) for r in found) == [("field is empty on the page", 'module-a #1 — "Head line" › A/body'), ("field reads as English on a localised page", "We have all the parts for you")]


def test_image_findings(spark):
    img = spark.createDataFrame([(1, 0, "", "alt"), (1, 1, "/a.jpg", None), (1, 2, "/b.jpg", "b"), (1, 3, None, None)], "page_id int, ord int, src string, alt string")
    want = spark.createDataFrame([(1, "a.jpg", "/a.jpg"), (1, "z.jpg", None)], "page_id int, want string, src string")
    got = sorted((r.severity, r.found) for r in places.image_findings(img, want).collect())
    assert got == [("break", "(no alt)"), ("break", "/a.jpg"), ("break", "alt"), ("check", "z.jpg")]


def test_regions(spark):
    p = pages(spark, "<main> </main><div class='content x'>Copy</div>", "<body><nav>n</nav><p>Body</p></body>", "<main>M</main>", None)
    got = p.select("page_id", markup.main_region(F.col("html"), ("content",)).alias("r")).orderBy("page_id").collect()
    assert [(r.r.via, r.r.html.strip()) for r in got] == [(".content", "Copy"), ("body", "<p>Body</p>"), ("main", "M"), ("body", "")]
    html = '<div class="cta">Call us</div><div class="cta"><a href="/x">y</a></div><p class="ctas">z</p><button class="accordion-trigger">Why?</button><details><summary>S</summary>T</details><script>var a;</script><script>var digitalData = {pageID: "p1", "kind": 7}</script>'
    q = pages(spark, html, "<script>var other = 1</script>")
    assert [r.text for r in markup.dead_ctas(q).collect()] == ["Call us"]
    assert [r.text for r in markup.triggers(q).collect()] == ["Why?"]
    assert [(r.summary, r.text) for r in markup.details(q).collect()] == [("S", "T")]
    data = [r.d for r in q.orderBy("page_id").select(markup.page_data(F.col("html"), ("pageID", "kind", "none")).alias("d")).collect()]
    assert tuple(data[0]) == ("p1", "7", None) and data[1] is None


def test_numeric_entities(spark):
    df = spark.createDataFrame([("&#65;&#x42;&#x1F600; &#65; &#xD800; &#0;",), ("plain",), (None,)], "t string")
    assert [r.t for r in df.select(T.decode_numeric(F.col("t")).alias("t")).collect()] == ["AB😀 A &#xD800; &#0;", "plain", None]
    assert df.select(T.normalise(F.lit("It&#8217;s &amp;#65;&#160; now &lt;")).alias("t")).first().t == "It's A now <"


def test_copy_ledger(spark):
    wants = [(1, 0, "s", "Whole line here"), (1, 1, "s", "The first sentence is long enough. The second sentence is long enough."), (1, 2, "s", "The first sentence is long enough. This other sentence is not there."), (1, 3, "s", "Nowhere"), (1, 4, "s", "WHOLE line here"), (1, 5, "s", None), (2, 0, "s", "No page")]
    texts = [(1, "Whole line here. x The first sentence is long enough. y The second sentence is long enough. Whole line here")]
    mods = [(1, 0, "m", 1, "<p>Whole line here</p>"), (1, 1, "m", 2, "<p>The first sentence is long enough.</p>")]
    rows = copy.ledger(spark.createDataFrame(wants, "page_id int, ord int, section string, text string"), spark.createDataFrame(texts, "page_id int, text string"), spark.createDataFrame(mods, "page_id int, ord int, name string, nth int, body string"))
    got = {(r.page_id, r.ord): (r.status, r.page_count, r.place) for r in rows.collect()}
    assert got == {(1, 0): ("found", 2, "m #1"), (1, 1): ("found", 1, "m #2"), (1, 2): ("partial", 0, "m #2"), (1, 3): ("missing", 0, None), (1, 4): ("found", 2, "m #1"), (2, 0): ("missing", 0, None)}
    assert sorted((r.page_id, r.found) for r in copy.copy_findings(rows).collect()) == [(1, "Nowhere"), (1, "This other sentence is not there."), (2, "No page")]
    near = {r.ord: (r.before, r.after) for r in copy.bracketed(rows.where("page_id = 1")).collect()}
    assert near[3] == ("m #2", "m #1") and near[0] == (None, None)
    c = spark.createDataFrame([(10, 1), (10, 2), (7, 0)], "total int, found int")
    assert [r.suspect for r in copy.suspect(c).collect()] == [True, False, False]


def test_pages_are_handed_on_in_parts(spark):
    """Many pages of one batch: no more than a part is held at once, and every page keeps its own elements."""
    import pandas as pd

    at = []
    parts = list(places.in_parts(iter([pd.Series(["x" * (places.PART // 4)] * 10 + [None]), pd.Series([], dtype=object)]), lambda p: at.append(p) or [len(at)]))
    assert [len(p) for p in parts] == [4, 4, 3] and [x[0] for p in parts for x in p] == list(range(1, 12))
    filler = "y" * (places.PART // 3)
    p = spark.createDataFrame([(k, f'<p id="p{k}"><a href="/{k}">{filler}</a></p>') for k in range(9)] + [(9, None)], "page_id int, html string").coalesce(1)
    got = {r.page_id: [(e.kind, e.tag, [c.tag for c in e.chain]) for e in r.e] for r in p.select("page_id", places.marked_elements("html").alias("e")).collect()}
    assert got == {k: [("link", f'<a href="/{k}">', [f'<p id="p{k}">'])] for k in range(9)} | {9: []}
