"""The audit of one record against the rules that each read the page by themselves."""

import itertools

from pagewright.operators import head_rules, link_rules, list_rules, markup, page_audit, places, rules

HEADS = ["", "<title> Lifts </title>", "<title>Lifts - Doors - Lifts</title>" + '<meta name="keywords" content=""><meta name="description" content="short">', '<title>Doors</title><link rel="canonical" href="https://a.test/p.aspx"><meta property="og:url" content="https://a.test/q/"><meta name="robots" content="noindex">', f"<title>{'Long title ' * 9}</title>" + '<link rel="canonical" href="https://preview.a.test/p">']
ALTS = ["", '<link rel="alternate" hreflang="en" href="https://a.test/p">', '<link rel="alternate" hreflang="english" href="https://a.test/p"><link rel="alternate" hreflang="de" href="x"><link rel="alternate" hreflang="de" href="y">']
BODIES = [
    "", "<h1>Lifts<br>doors</h1><h2>Same</h2><h3>same</h3><h2 style='display:none'>Same</h2><h3>SAME</h3>", "<h1>One</h1><h1>Two</h1><h2>1. A</h2><h2>3. B</h2>",
    '<a href="#">Go</a><a href="#" role="button">Menu</a><a href="/x"></a><a href="/x"><img src="l.png" alt="Logo"></a><a href="/y">Read more →</a><a href="/y">read more</a><a href="/z">Read more</a><a>none</a>',
    "<ul><li>Kinds:</li><li>One.</li><li>Two</li><li></li></ul><ol><li>1. a</li></ol><ul class='breadcrumb'><li>x</li></ul><ul><li>a<ul><li>b</li></ul></li></ul>", "<p>• x</p><p>Types:</p><p>one</p><p>two</p><p>End.</p><h4>1. A</h4><h4>2. B</h4>",
    '<img src=""><img src="a.png"><img src="data:x" data-src="b.png" alt="B"><script src="http://c.test/x.js"></script><script src="http://c.test/x.js"></script><link rel="stylesheet" href="http://c.test/y.css"><link rel="next" href="http://c.test/z"><img src="http://staging.a.test/i.png" alt="i"><a href="https://staging.a.test/k">K</a><a href="https://staging.a.test/k">L</a>',
]


def pages(spark):
    htmls = [f"<html lang='en' {lang}><head>{h}{a}</head><body>{b}</body></html>" for (h, a, b), lang in zip(itertools.product(HEADS, ALTS, BODIES), itertools.cycle(["", "data-lang='fr'", "data-lang='en-GB'"]))]
    return spark.createDataFrame([(k, f"https://a.test/p/{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")


def test_one_record_finds_what_all_rules_find(spark):
    p = pages(spark).cache()
    apart = rules.union([
        rules.title_findings(p), rules.metadata_findings(p), rules.heading_findings(p), rules.link_findings(p), head_rules.head_findings(head_rules.facts(p)), head_rules.hreflang_findings(p), list_rules.list_findings(p), list_rules.typed_findings(p),
        link_rules.mixed_content_findings(p), link_rules.leakage_findings(p), places.image_findings(markup.images(p), spark.createDataFrame([], "page_id long, want string, src string")),
    ])
    want = sorted(map(str, map(tuple, apart.collect())))
    records = page_audit.record(p).cache()
    got = sorted(map(str, map(tuple, page_audit.audit(records, suppress=False).collect())))
    assert got == want and len({str(r).split(", ")[3] for r in got}) > 15
    fewer = page_audit.audit(records).collect()
    assert len(fewer) < len(got)
    mixed = {(r.page_id, r.found) for r in fewer if r.field == "Mixed content"}
    assert mixed and not mixed & {(r.page_id, r.found) for r in fewer if r.note == page_audit.LEAK}


def test_one_scan_and_no_shuffle(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/pages")
    plan = page_audit.audit(page_audit.record(spark.read.parquet(f"{tmp_path}/pages")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan


def test_empty_and_null_pages(spark):
    p = spark.createDataFrame([(1, None, None), (2, "https://a.test", "")], "page_id long, url string, html string")
    got = {(r.page_id, r.field, r.note) for r in page_audit.audit(page_audit.record(p)).collect()}
    assert got == {(k, f, n) for k in (1, 2) for f, n in (("Title", "no title"), ("Description", "no description"), ("H1", "no H1"), ("hreflang", "no alternates"))}
    assert page_audit.audit(page_audit.record(p.limit(0))).count() == 0
