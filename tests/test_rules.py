"""Rules, forms and links on small pages: what each catches, and what it leaves alone."""

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import forms, head_rules, link_rules, list_rules, markup, matching, proofing, rules
from tests.test_operators import pages, values


def notes(found, page=None):
    return sorted((r.field, r.note) for r in found.collect() if page is None or r.page_id == page)


def test_text_functions(spark):
    x = F.col("x")
    assert values(spark, T.fold(x), ["Él Ñandú Straße", None]) == ["el nandu straße", ""]
    assert values(spark, T.duplicate_part(x), ["Lift | Acme - Acme", "Lift - Acme - Acme India", "Acme lift - Acme", None]) == ["acme", "acme", None, None]
    assert values(spark, T.overlap(x, F.lit("lift for homes")), ["lift homes", "nothing", ""]) == [2 / 3, 0.0, 0.0]
    assert values(spark, T.match_case(x, F.lit("form")), ["FROM", "From", "from"]) == ["FORM", "Form", "form"]
    assert values(spark, T.humanise(x), ["cta-main-title", "hero"]) == ["CTA main title", "Hero"]
    assert values(spark, T.humanise(x), ["enß-9743", "ßpf-ßpfen", "ßpfen-x", "ﬁx"]) == ["ENẞ 9743", "ẞPF ßpfen", "ẞpfen X", "ﬁX"]
    assert values(spark, T.quoted_spans(x), ['say "keep this" and “that one”']) == [["keep this", "that one"]]
    assert values(spark, T.open_items(x), ["Price TBD here", "done"]) == [["Price TBD here"], []]


def test_url_functions(spark):
    x = F.col("x")
    assert values(spark, U.absolute(x, F.lit("https://a.com/b/c")), ["d#e", "/x?y", "//b.org/", "mailto:a@b", "#in", "", None]) == ["https://a.com/b/d", "https://a.com/x?y", "https://b.org/", None, None, None, None]
    assert values(spark, U.private_address(x), ["10.0.0.1", "8.8.8.8", "::ffff:127.0.0.1", "64:ff9b::a00:1", "2606:4700::1111", "no"]) == [True, False, True, True, False, True]
    assert values(spark, U.fetchable(x, ("a.com",)), ["https://w.a.com/", "ftp://a.com", "https://u:p@a.com", "https://a.com:22/", "http://1.2.3.4/", "https://ba.com", None]) == [None, "scheme", "credentials", "port", "address", "host", "scheme"]
    assert values(spark, U.looks_like_login(x), ["https://a.com/login?x", "https://a.com/blogins", None]) == [True, False, False]


def test_head_rules(spark):
    good = '<html><head><title>Lifts - Acme</title><link rel="canonical" href="https://a.com/0"></head><h1>Our lifts</h1>'
    bad = '<html><head><title>Lifts | Acme - Acme</title><link rel="canonical" href="https://a.com/x.aspx"><meta name="robots" content="NoIndex"><meta property="og:url" content="https://a.com/y"><meta property="og:image" content="i"><meta name="twitter:card" content="summary"></head><h1>Doors<br></h1>'
    p = pages(spark, good, bad)
    found = head_rules.head_findings(head_rules.facts(p))
    assert notes(found, 0) == []
    assert [f for f, _ in notes(found, 1)] == ["Canonical", "H1", "H1", "Page title", "Robots", "og:url", "twitter:card"]
    alt = '<link rel="canonical" href="https://a.com/gb"><link rel="alternate" hreflang="en-GB" href="https://a.com/gb"><link rel="alternate" hreflang="english" href="/x">'
    found = head_rules.hreflang_findings(pages(spark, alt, "<p>", alt.replace("gb", "us")))
    assert notes(found, 0) == [("hreflang", "no valid code")] and notes(found, 1) == [("hreflang", "no alternates")]


def test_title_format(spark):
    rows = spark.createDataFrame([(k, t, own, sep) for k, (t, own, sep) in enumerate([("Lift - Acme India", ["India"], None), ("Lift | Acme India", ["India"], "-"), ("Lift - Acme France", ["India"], None), ("Lift", ["India"], None), ("", None, None), ("Lift - Acme Corporation", ["India"], None), ("Lift - Acme Corporation - Acme India", ["India"], None), ("Lift - Acme India", None, None), ("Lift - Other", ["India"], None)])], "k int, t string, own array<string>, sep string")
    got = rows.orderBy("k").select(head_rules.title_format(F.col("t"), F.col("own"), F.col("sep"), True, ["India", "France"], "Acme").alias("x")).collect()
    assert [r.x.state for r in got] == ["green", "amber", "red", "amber", "red", "green", "amber", "amber", "amber"]


def test_live_findings(spark):
    tls = "struct<valid boolean, valid_to timestamp, days_left int, issuer string, error string>"
    schema = f"page_id long, url string, final_url string, status int, redirects array<struct<url string, to string>>, ms int, ttfb_ms int, tls {tls}, canonical string"
    hop = [("a", "b")]
    f = spark.createDataFrame([(0, "https://a.com/x", None, 200, [], 100, 50, (True, None, 90, None, None), "https://www.a.com/x/"), (1, "https://a.com/x", "http://a.com/y", 404, hop * 4, 4000, 900, (False, None, None, None, "expired"), "https://a.com/z"), (2, "https://a.com", None, 200, hop * 2, None, None, (True, None, 3, None, None), None)], schema)
    found = head_rules.live_findings(f)
    assert notes(found, 0) == [] and [x for x, _ in notes(found, 1)] == ["Canonical", "Certificate", "Final status", "First byte", "HTTPS", "Load time", "Redirect chain"]
    assert [x for x, _ in notes(found, 2)] == ["Certificate", "Redirect chain"]


def test_chrome_and_metadata(spark):
    html = '<div data-search-country="US" data-search-language="en"></div><a class="x-header__logo-link" href="/en-us">l</a><span class="language-button__label">US - EN</span>'
    market = spark.createDataFrame([(0, "us", "en", "en-us"), (1, "in", "en", "en-in")], "page_id long, country string, language string, lang_path string")
    found = head_rules.chrome_findings(pages(spark, html, html), market)
    assert notes(found, 0) == [] and len(notes(found, 1)) == 3
    page = '<title>T</title><meta name="description" content="D"><meta name="keywords" content="b, a"><link rel="canonical" href="https://a.com/x.html">'
    want = spark.createDataFrame([(0, "T", None, "E", "a,b", "a.com/x")], "page_id long, title string, name string, description string, keywords string, url string")
    assert {r.field: r.state for r in head_rules.metadata_compare(want, pages(spark, page)).collect()} == {"title": "matches", "description": "differs", "keywords": "matches", "url": "matches"}


def test_link_rules(spark):
    html = '<link rel="canonical" href="https://a.com/en/x"><img src="http://b.com/i.png"><script src="http://c.com/s.js"></script><a href="https://preview.a.com/q">q</a><a href="http://d.com">d</a>'
    p = pages(spark, html, "<a href='https://b.com'>b</a>")
    assert [(r.severity, r.found) for r in link_rules.leakage_findings(p).collect()] == [("break", "https://preview.a.com/q")]
    assert sorted((r.severity, r.found) for r in link_rules.mixed_content_findings(p).collect()) == [("break", "http://c.com/s.js"), ("check", "http://b.com/i.png")]
    to = link_rules.targets(p)
    assert sorted((r.page_id, r.dst) for r in to.collect()) == [(0, "http://d.com"), (0, "https://preview.a.com/q"), (1, "https://b.com")]
    status = spark.createDataFrame([("http://d.com", "dead", 404, None), ("https://b.com", "ok", 200, None), ("https://preview.a.com/q", "refused", None, "private")], "dst string, verdict string, status int, reason string")
    assert sorted((r.severity, r.field, r.note) for r in link_rules.status_findings(to, status, ("a.com",)).collect()) == [("break", "Broken link (external)", "answered 404"), ("check", "Link not verified (own)", "private")]
    reg = spark.createDataFrame([("us", "us", "a.com", "/us"), ("in", "in", "a.com", "/in")], "market string, base string, domain string, prefix string")
    q = pages(spark, '<a href="/in/x">1</a><a href="/in/y">2</a><a href="/us/z">3</a><a href="/content/dam/f.pdf">4</a><a href="/global">5</a>')
    m = spark.createDataFrame([(0, "us", "us", "a.com", "/us")], "page_id long, market string, base string, domain string, prefix string")
    assert sorted(r.found for r in link_rules.cross_market_findings(q, m, reg).collect()) == ["1 to /global", "2 to /in in"]
    links = spark.createDataFrame([(0, "Read it", "/x"), (0, "Read", "/y")], "page_id long, text string, href string")
    assert {r.href: r.verdict for r in link_rules.rulings_of(links, [("b.com", "read", "/x", "red"), (None, "^read it", "/x", "green")]).collect()} == {"/x": "green", "/y": None}


def test_link_audit(spark):
    body = (
        '<h2>Home lifts and doors</h2><p>About <a href="/en/lifts">Our lifts</a><a href="/en/lifts">Our lifts</a><a href="/lifts">Lifts</a><a href="#">Go</a><a href="/en/gone">Gone</a><a href="/en/doors">Stairs</a><a href="javascript:x()">Run</a>'
        '<a href="/en">Home</a><a href="https://b.com/x">Out</a><a href="#top">Up</a><a href="/en/lifts">Home lifts</a><a href="/en/page#a">This page</a><a href="~/x">Edit</a><a href="mailto:a@b.c">Mail</a><a href="/en/doors">Home lifts</a>'
        '<a href="/en/lifts/home-lifts">Read more</a><a href="/en/doors">Learn more</a><a href="/en/stairs">Learn more</a><a href="/en/missing">Click here</a><a href="#">Discover</a><div class="cta">Home lifts now</div><a href="/en/doors">Ruled text</a></p>'
    )
    urls = ["lifts", "doors", "stairs", "lifts/home-lifts", *[f"filler/{k}" for k in range(3)]]
    site = [*((f"https://a.com/en/{u}", "") for u in urls), ("https://a.com/en/page", body), ("https://c.com/", '<a href="/en/x">Some words</a>')]
    p = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(site)], "page_id long, url string, html string")
    prefix = matching.language_prefix(p)
    assert [tuple(r) for r in prefix.collect()] == [("a.com", "en")]
    got = {(r.text, r.href): r for r in link_rules.audit(p, matching.sitemap(p), prefix, [(None, "^ruled", "/en/doors", "green"), ("other.com", "stairs", "/en/doors", "red")]).collect()}
    want = {
        ("Our lifts", "/en/lifts"): ("green", "leads to the page its text names", []), ("Lifts", "/lifts"): ("red", "language segment missing", ["/en/lifts"]), ("Go", "#"): ("red", "no destination", ["/en/lifts/home-lifts", "/en/doors", "/en/lifts"]),
        ("Gone", "/en/gone"): ("amber", "the sitemap does not list this path", []), ("Stairs", "/en/doors"): ("amber", "the text names another page better", ["/en/stairs"]), ("Run", "javascript:x()"): ("red", "runs a script", []),
        ("Home lifts", "/en/lifts"): ("amber", "leads to a listing; a page below it is named", ["/en/lifts/home-lifts"]), ("This page", "/en/page#a"): None, ("Edit", "~/x"): ("red", "editor path", []),
        ("Home lifts", "/en/doors"): ("amber", "the text names another page better", ["/en/lifts/home-lifts", "/en/lifts"]), ("Read more", "/en/lifts/home-lifts"): ("green", "what stands around it is about the page", []),
        ("Learn more", "/en/doors"): ("green", "what stands around it is about the page", []), ("Learn more", "/en/stairs"): ("amber", "what stands around it is about another page", ["/en/lifts/home-lifts", "/en/doors", "/en/lifts"]),
        ("Click here", "/en/missing"): ("amber", "the sitemap does not list this path", ["/en/lifts/home-lifts", "/en/doors", "/en/lifts"]), ("Discover", "#"): ("red", "no destination", ["/en/lifts/home-lifts", "/en/doors", "/en/lifts"]),
        ("Home lifts now", None): ("red", "a call to action without a link", ["/en/lifts/home-lifts", "/en/lifts"]), ("Ruled text", "/en/doors"): ("green", "ruled", ["/en/doors"] and []), ("Some words", "/en/x"): ("amber", "the sitemap does not list this path", []),
    }
    assert {k: (r.verdict, r.reason, r.suggested) for k, r in got.items()} == {k: v for k, v in want.items() if v}
    assert got["Our lifts", "/en/lifts"].n == 2 and got["Lifts", "/lifts"].confident and got["Click here", "/en/missing"].confident and not got["Gone", "/en/gone"].confident


def test_list_rules(spark):
    html = "<ul><li>Kinds:</li><li>One.</li><li>Two</li><li>Three</li><ol><li>1. a</li><li></li></ol></ul><ul class='breadcrumb'><li>x</li></ul><ul><li>only</li></ul>"
    found = list_rules.list_findings(pages(spark, html, "<ul><li>a</li><li>b</li></ul>"))
    assert [f for f, _ in notes(found, 0)] == ["Double numbering", "Empty list item", "Single-item list"] and notes(found, 1) == []
    flat = list_rules.list_findings(pages(spark, "<ul><li>Kinds:</li><li>One.</li><li>Two</li><li>Three</li></ul>"))
    assert [f for f, _ in notes(flat)] == ["Flattened list", "Mixed punctuation"]
    typed = list_rules.typed_findings(pages(spark, "<h2>1. A</h2><h2>3. B</h2><p>• x</p><div></div><p>Types include:</p><p>one</p><p>two</p><p>End.</p>", "<h2>1. A</h2><h2>2. B</h2><p>Types:</p><p>one</p>"))
    assert [f for f, _ in notes(typed, 0)] == ["List as paragraphs", "Typed bullets", "Typed numbering"]
    assert [r.severity for r in typed.collect() if r.page_id == 1] == ["check"]
    n = spark.createDataFrame([(0, "recieve", 1), (0, "monospcae", 1), (0, "color", 1), (0, "colour", 2), (1, "receive", 1), (1, "monospace", 1)], "page_id long, word string, n int")
    got = list_rules.spelling_findings(n, {"recieve": "receive"}, ["MonoSpace"], [("color", "colour")])
    assert [f for f, _ in notes(got, 0)] == ["Misspelling", "Mixed spelling", "Product name"] and notes(got, 1) == []


def test_names_of_several_words_and_case(spark):
    texts = ["Ride a Monospace or monospace, a monospce and Mono Spaec; mono space", "MonoSpace Mono Space myBrand", "Mybrand mybrand MYBRAND mybrands Doorss", "Doors Door Mono", "", None]
    t = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    found = list_rules.name_findings(proofing.words_in_order(t, "page_id", "text"), ["MonoSpace", "Mono Space", "myBrand", "Doors"]).collect()
    got = {(r.page_id, r.severity, r.found) for r in found}
    assert len(got) == len(found)
    assert got == {
        (0, "check", "Monospace -> MonoSpace"), (0, "break", "monospce -> MonoSpace"), (0, "break", "Mono Spaec -> Mono Space"),
        (2, "check", "Mybrand -> myBrand"), (2, "check", "MYBRAND -> myBrand"), (2, "break", "mybrands -> myBrand"), (2, "break", "Doorss -> Doors"),
    }
    assert list_rules.name_findings(proofing.words_in_order(t, "page_id", "text"), []).count() == 0


def test_link_named_by_its_image(spark):
    found = rules.link_findings(pages(spark, '<a href="/x"><img src="l.png" alt="Logo"></a><a href="/y"><img src="l.png"></a><a href="/z" title="Named"></a>')).collect()
    assert [(r.field, r.found) for r in found] == [("Link text", "/y")]


def test_forms(spark):
    hosted = '<div class="wForm" id="752-WRPR"></div><form action="https://x.tfaforms.net/go" id="752" method="post"><label for="n">Name</label><input id="n" name="n"><input name="m"><label>Wrap <input name="w"></label><input type="hidden" name="tfa_dbFormId" value="753"><legend></legend></form>'
    site = '<form data-nc="Form" method="post" action="/content/experience-fragments/frontlines/us/en/forms/contact/_jcr_content/x.formsubmit.json"><input type="hidden" name="leadCountry" value="US"></form>'
    p = pages(spark, hosted, site, '<script src="https://x.tfaforms.net/publish/9"></script><!-- <form method="post"> -->', '<form method="get"></form><form method="post" action="https://z.com"></form>', "<p>")
    f = forms.forms(p).cache()
    assert {(r.page_id, r.embed): r.form_id for r in f.collect()} == {(0, "markup"): "753", (1, "site-form"): "contact", (2, "script"): "9", (3, "other"): None}
    first = f.where("page_id = 0").first()
    assert first.unlabelled == ["m"] and first.empty_legends == 1 and first.ids.wrapper == "752"
    declared = p.select("page_id", F.when(F.col("page_id") == 4, "77").when(F.col("page_id") == 0, "1").alias("declared"))
    c = forms.carried(f, declared)
    assert {r.page_id: (r.ids, r.source) for r in c.collect()} == {0: (["753"], "embedded"), 1: ([], None), 2: (["9"], "embedded"), 3: ([], None), 4: (["77"], "declared")}
    full = c.join(p.select("page_id", "url"), "page_id").withColumn("market", F.lit("us")).withColumn("status", F.lit("found"))
    ids = spark.createDataFrame([("us", "9")], "market string, form_id string")
    listed = spark.createDataFrame([(1, "/contact/"), (3, "5")], "page_id long, form_id string")
    assert {r.page_id: r.state for r in forms.id_verdicts(full, listed, [("/4", "77")], ids).collect()} == {0: "differs", 1: "matches", 2: "matches", 3: "missing", 4: "matches"}
    market = spark.createDataFrame([(1, "in/en", "IN")], "page_id long, site string, country string")
    assert sorted(r.note for r in forms.market_findings(f, market).collect()) == ["another market's form", "sends another country"]
    assert sorted((r.page_id, r.note) for r in forms.wiring_findings(f, declared).collect()) == [(0, "declared id is not embedded"), (0, "fields without a label"), (0, "groups without a name"), (0, "parts name different forms")]


def test_meta_of_resources(spark):
    assert {r.tag for r in markup.resources(pages(spark, '<a href="x"><img src="y"><video src="z">')).collect()} == {"a", "img", "video"}
