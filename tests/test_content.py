"""Briefs, matching, crawls and components on small inputs."""

from pyspark.sql import functions as F

from pagewright.operators import briefs, components, crawl, matching
from tests.test_operators import pages


def sheet(spark, *texts):
    return briefs.rows(spark.createDataFrame(list(enumerate(texts)), "brief_id int, text string"))


PROSE = "A long enough paragraph of copy that reads as prose in any case."


def test_orientation_and_unpivot(spark):
    by_field = f"x\ty\tz\nCountry\tHeader text\tBody text\nItaly\tCiao\t{PROSE}\nSpain\tHola\t{PROSE}\n"
    by_market = "Field\tEnglish\tItaly\nHeadline\ta\tb\nBody 1\tc\td\n"
    r = sheet(spark, by_field, by_market, "just text\nmore")
    shape = briefs.orientation(r)
    assert {x.brief_id: (x.orientation, x.header) for x in shape.collect()} == {0: ("markets-by-field", 2), 1: ("fields-by-market", None), 2: ("unknown", None)}
    got = briefs.unpivot(r, shape, {"(?i)header": "section", "(?i)body": "body"})
    assert sorted((x.market, x.role, x.text) for x in got.collect()) == [("Italy", "body", PROSE), ("Italy", "section", "Ciao"), ("Spain", "body", PROSE), ("Spain", "section", "Hola")]


def test_columns_and_target(spark):
    r = sheet(spark, "Level 2\tSpain\nField\tMaster\tItaly\tSpain\nTitle\ta\tb\tc\n")
    h = briefs.header_rows(r, ["Italy", "Spain"])
    assert h.first().row == 2 and briefs.master_column(h, r).first().master == 1
    assert briefs.target_market(r, h, ["Italy", "Spain"]).first().market == "spain"


def test_front_matter_and_pairs(spark):
    r = sheet(spark, "Market: Italy\nSources\t●\thttps://a.com\n●\thttps://b.com\nSome copy here without a label\nMarket: late\n")
    got = briefs.front_matter(r, {"market": "market", "sources": "sources"})
    assert [(x.field, x.ord, x.value) for x in got.orderBy("field", "ord").collect()] == [("market", 1, "Italy"), ("sources", 1, "https://a.com"), ("sources", 2, "https://b.com")]
    v = spark.createDataFrame([(1, 1, "CTA", "Go"), (1, 2, "CTA link", "/x"), (1, 3, "CTA", "Stay"), (1, 4, "CTA link", "tbd")], "brief_id int, row int, label string, value string")
    assert [(x.label, x.href) for x in briefs.paired(v).orderBy("n").collect()] == [("Go", "/x"), ("Stay", None)]


def test_find_row(spark):
    v = spark.createDataFrame([(1, 1, "Learn more"), (1, 2, "Learn more"), (1, 3, "Lifts for tall buildings"), (1, 4, "Doors for wide halls and rooms"), (1, 5, "Doors for wide halls")], "brief_id int, row int, english string")
    q = spark.createDataFrame([(1, 1, "Learn more"), (2, 1, "<b>Lifts</b> for tall buildings"), (3, 1, "Doors for wide halls and rooms here"), (4, 1, "tall buildings need lifts"), (5, 1, "zebra"), (6, 1, "")], "query_id int, brief_id int, text string")
    got = {x.query_id: (x.how, x.row) for x in briefs.find_row(q, v).collect()}
    assert got == {1: ("ambiguous", None), 2: ("exact", 3), 3: ("contained", 4), 4: ("closest", 3), 5: ("none", None), 6: ("none", None)}


def test_find_row_loses_no_pair(spark):
    """Against all pairs of queries and rows in plain Python, with far fewer candidates."""
    import random
    import re

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9)))
    values = [(b, r, text()) for b in range(3) for r in range(60)]
    asked = []
    for k in range(120):
        b, _, t = rng.choice(values)
        w = t.split()
        t = rng.choice([t, t[2:-1], " ".join(w[1:]), " ".join([*w, text()]), " ".join(rng.sample(w, len(w))) + " " + rng.choice(vocabulary), text(), t[:2], w[0]])
        asked.append((k, b, t))
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 2]

    def judged(needle, english):
        if needle == english:
            return 3, 1.0
        if len(english) > 8 and (needle in english or english in needle):
            return 2, 0.9
        x, y = words(english), words(needle)
        share = sum(w in y for w in x) / max(len(x), len(y)) if x and y else 0.0
        return (1, share) if share >= 0.4 else None

    expected = {}
    for k, b, t in asked:
        t = " ".join(t.split())
        hits = [(*got, r, english) for vb, r, english in values if vb == b and t and (got := judged(t, " ".join(english.split())))]
        expected[k] = {h[2] for h in hits}
    q = spark.createDataFrame(asked, "query_id int, brief_id int, text string")
    v = spark.createDataFrame(values, "brief_id int, row int, english string")
    met = briefs.row_candidates(q.selectExpr("query_id", "brief_id", "trim(text) as needle").where("needle <> ''"), v).collect()
    pairs = {(r.query_id, r.row) for r in met}
    assert len(pairs) == len(met) and {(k, r) for k, rs in expected.items() for r in rs} <= pairs
    assert len(pairs) < 0.4 * 120 * 60
    assert {r.query_id for r in briefs.find_row(q, v).collect() if r.how != "none"} == {k for k, rs in expected.items() if rs}


def test_find_row_broadcasts_nothing(spark):
    """Windows and words outgrow the table they come from, whose size would have them broadcast; briefs of few rows have none."""
    v = spark.createDataFrame([(b, r, f"line {r} of {b}") for b in range(2) for r in range(1 + 40 * b)], "brief_id int, row int, english string")
    q = spark.createDataFrame([(k, k % 2, "line 0 of 1") for k in range(4)], "query_id int, brief_id int, text string")
    found = briefs.find_row(q, v)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(x.query_id, x.how, x.row) for x in found.collect()} == {(0, "closest", 0), (1, "exact", 0), (2, "closest", 0), (3, "exact", 0)}


def test_budget_walk_against_a_queue(spark):
    """Against one queue a site in plain Python, with files that fail, repeat, and list each other."""
    import random

    rng = random.Random(9)
    files, roots = {}, []
    for site in range(6):
        names = [f"s{site}/f{k}" for k in range(40)]
        for k, name in enumerate(names):
            index = k < 8 and rng.random() < 0.7
            files[name] = (rng.random() < 0.85, index, [rng.choice(names) for _ in range(rng.randint(0, 9))] if index else [f"u{rng.randint(0, 60)}" for _ in range(rng.randint(0, 12))])
        roots += [(site, k, rng.choice([*names[:8], "absent"])) for k in range(rng.randint(1, 6))]
    f = spark.createDataFrame([(n, *x) for n, x in files.items()], "file string, ok boolean, is_index boolean, urls array<string>")
    r = spark.createDataFrame(roots, "site int, ord int, file string")
    for most_files, most_urls in ((50, 20_000), (6, 20_000), (12, 15), (1, 1)):
        want = {}
        for site in {x[0] for x in roots}:
            queue = [(n, 0) for s, _, n in sorted(roots) if s == site]
            seen, read, failed, urls, partial = set(), [], [], [], False
            while queue:
                if len(read) + len(failed) >= most_files or len(urls) >= most_urls:
                    partial = True
                    break
                batch, queue = queue[:4], queue[4:]
                for name, level in batch:
                    if name in seen:
                        continue
                    seen.add(name)
                    ok, index, listed = files.get(name, (False, False, []))
                    (read if ok else failed).append(name)
                    if ok and index and level < 2:
                        queue += [(u, level + 1) for u in listed]
                    elif ok and not index:
                        for u in listed:
                            if u not in urls and len(urls) < most_urls:
                                urls.append(u)
            want[site] = (sorted(read), sorted(failed), urls, partial)
        pages, states, counts = crawl.budget_walk(f, r, most_files=most_files, most_urls=most_urls)
        got = {c.site: ([], [], [], c.partial) for c in counts.collect()}
        for x in states.collect():
            got[x.site][x.state == "failed"].append(x.file)
        for x in sorted(pages.collect(), key=lambda x: x.ord):
            got[x.site][2].append(x.url)
        assert {s: (sorted(a), sorted(b), c, d) for s, (a, b, c, d) in got.items()} == want
        assert {c.site: (c.read, c.failed, c.urls) for c in counts.collect()} == {s: (len(a), len(b), len(c)) for s, (a, b, c, _) in want.items()}
    assert any(x[3] for x in want.values())


def test_carry_markup(spark):
    rows = spark.createDataFrame([(1, 'Ride <b>MonoX</b> <a href="/a?b&amp;c">now</a>', "MonoX < alles jetzt"), (2, None, "a & b"), (3, "<i>x</i>", None)], "k int, e string, t string")
    got = {r.k: tuple(r.x) for r in rows.select("k", briefs.carry_markup("e", "t").alias("x")).collect()}
    assert got == {1: ("<strong>MonoX</strong> &lt; alles jetzt", 1, 1), 2: ("a &amp; b", 0, 0), 3: ("", 0, 1)}


def test_votes_needs_signals(spark):
    u = spark.createDataFrame([(1, "https://x.it/a"), (1, "https://y.com"), (2, "https://x.it/tcm/a"), (3, "https://x.it")], "brief_id int, url string")
    assert {x.brief_id: x.platform for x in briefs.platform_vote(u, (".it",), ("/tcm/",)).collect()} == {1: "Mixed", 2: "old", 3: "new"}
    t = spark.createDataFrame([(1, "see https://a.com"), (2, "")], "text_id int, text string")
    assert {x.text_id: (x.have, x.missing) for x in briefs.needs(t, [("url", "?", "https?://"), ("copy", "?", "copy"), ("copy", "?", "see")]).collect()} == {1: (["url", "copy"], []), 2: ([], ["url", "copy"])}
    assert briefs.signals(t).where("urls = 1").count() == 1


def test_suggestions(spark):
    p = spark.createDataFrame([(k, u) for k, u in enumerate(["https://a.com/lifts/home-lifts", "https://a.com/lifts", "https://a.com/stories/lifts-won"])], "page_id long, url string")
    e = matching.sitemap(p)
    assert {r.path: r.editorial for r in e.collect()} == {"/lifts/home-lifts": False, "/lifts": False, "/stories/lifts-won": True}
    t = spark.createDataFrame([(1, "a.com", "Home lifts", None), (2, "a.com", "Découvrez les ascenseurs", None), (3, "a.com", "Lifts won: stories", None), (4, "a.com", "Home lifts", "/lifts/home-lifts"), (5, "b.com", "Home lifts", None)], "text_id int, host string, text string, exclude string")
    s = matching.suggest(t, e)
    assert {(r.text_id, r.path, r.confident) for r in matching.confident(s).collect()} == {(1, "/lifts/home-lifts", True), (3, "/stories/lifts-won", True), (4, "/lifts", True)}
    assert {r.url for r in s.where("text_id = 1 and rank = 1").collect()} == {"https://a.com/lifts/home-lifts"}
    c = matching.context_suggest(spark.createDataFrame([(1, "a.com", "Our home lifts and doors")], "text_id int, host string, text string"), e)
    assert [(r.path, r.words) for r in c.orderBy("rank").collect()] == [("/lifts/home-lifts", 2), ("/lifts", 1)]


def test_contexts(spark):
    kinds = [("paragraph", "a"), ("link", "go"), ("title", "T"), *[("paragraph", f"p{k}") for k in range(6)], ("link", "more")]
    s = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(kinds)], "page_id int, ord int, kind string, text string")
    assert [(r.text, r.title, r.body) for r in matching.contexts(s).orderBy("ord").collect()] == [("go", None, "a"), ("more", "T", "p2 p3 p4 p5")]
    # thirty links between the paragraphs and the last link, and its own text again and again
    kinds = [("title", "T"), ("paragraph", "a"), ("paragraph", "b"), *[("link", f"l{k}") for k in range(30)], *[("paragraph", "last")] * 20, ("link", "last")]
    s = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(kinds)], "page_id int, ord int, kind string, text string")
    got = matching.contexts(s).orderBy("ord").collect()
    assert len(got) == 31 and (got[-1].text, got[-1].title, got[-1].body) == ("last", "T", "a b") and got[0].body == "a b"


def test_market_status(spark):
    reg = spark.createDataFrame([("be-fr", "be", "x.be", "/fr", ["old.be"]), ("be-nl", "be", "x.be", "/nl", None), ("com", "com", "x.com", "", None)], "market string, base string, domain string, prefix string, former array<string>")
    p = spark.createDataFrame([(k, u) for k, u in enumerate(["x.be/fr/a", "x.be/france", "old.be/a", "x.com/q", "z.org"])], "page_id long, url string")
    assert {r.page_id: (r.market, r.status) for r in matching.market_status(p, reg).collect()} == {0: ("be-fr", "found"), 1: (None, "ambiguous"), 2: ("be-fr", "former"), 3: ("com", "found"), 4: (None, "unknown")}


def test_claim_and_assets(spark):
    w = spark.createDataFrame([(1, 1, "Go", "/a"), (1, 2, "Go", "/b"), (1, 3, "Go", "/c"), (1, 4, "/z", None)], "page_id int, ord int, label string, href string")
    have = spark.createDataFrame([(1, 1, "go", "/a"), (1, 2, "Go", "/x"), (1, 3, "else", "/z")], "page_id int, ord int, text string, href string")
    assert [(r.ord, r.href, r.state) for r in matching.claim(w, have, fold_case=True).orderBy("ord").collect()] == [(1, "/a", "found"), (2, "/x", "wrong target"), (3, None, "missing"), (4, "/z", "found")]
    assert [(r.ord, r.href, r.state) for r in matching.claim(w, have).orderBy("ord").collect()] == [(1, "/x", "wrong target"), (2, None, "missing"), (3, None, "missing"), (4, "/z", "found")]
    i = spark.createDataFrame([(1, "/dam/My-Pic_01.jpg")], "page_id int, src string")
    a = spark.createDataFrame([(1, "my pic 01"), (1, "other")], "page_id int, asset string")
    assert {r.want: r.src for r in matching.assets(a, i).collect()} == {"my pic 01": "/dam/My-Pic_01.jpg", "other": None}


def test_claims_compete_in_order(spark):
    """Against a walk in plain Python, on pages whose labels and addresses take from the same links."""
    import random

    rng = random.Random(3)
    labels, paths = ["Lifts", "lifts", "Doors", "", "Read &amp; go"], ["/a", "/a/", "/b", "/c.html", "https://x.test/c", None]
    wants, links = [], []
    for page in range(60):
        for k in range(rng.randint(0, 7)):
            href = rng.choice(paths)
            wants.append((page, k, rng.choice([*labels, href or "/b", href or "/c"]), href))
        links += [(page, k, rng.choice(labels), rng.choice(paths), rng.random() < 0.2) for k in range(rng.randint(0, 6))]
    path = lambda u: "/" + (u or "").replace("https://x.test", "").replace(".html", "").strip("/")
    norm = lambda t: t.replace("&amp;", "&").strip()
    expected = []
    for page in range(60):
        taken, mine = set(), [x for x in links if x[0] == page]
        for _, k, label, href in (x for x in wants if x[0] == page):
            bare = norm(label) == norm(href) if href is not None else label.startswith(("/", "http"))
            hit = next((x for x in mine if not x[4] and x[1] not in taken and (path(x[3]) == path(href or label) if bare else norm(x[2]) == norm(label) != "")), None)
            if hit:
                taken.add(hit[1])
            state = ("placeholder" if any(x[4] and norm(x[2]) == norm(label) for x in mine) else "missing") if not hit else "wrong target" if href and not bare and path(hit[3]) != path(href) else "found"
            expected.append((page, k, label, hit and hit[1], hit and hit[3], state))
    w = spark.createDataFrame(wants, "page_id long, ord int, label string, href string")
    have = spark.createDataFrame(links, "page_id long, ord int, text string, href string, placeholder boolean")
    got = sorted(map(tuple, matching.claim(w, have).collect()), key=lambda r: r[:2])
    assert got == expected and {r[-1] for r in got} == {"found", "missing", "placeholder", "wrong target"}
    assert matching.claim(w.limit(0), have).count() == 0 and {r.state for r in matching.claim(w, have.limit(0)).collect()} == {"missing"}


def test_pick(spark):
    p = spark.createDataFrame([(1, "https://a.com/x"), (2, "https://a.com/y"), (3, "https://a.com/z")], "page_id int, url string")
    b = spark.createDataFrame([(1, "a.com/x"), (2, None), (3, None)], "brief_id int, url string")
    c = spark.createDataFrame([(1, 2, 5, 5), (2, 2, 3, 4), (2, 3, 1, 4), (3, 2, 2, 4), (3, 3, 2, 4)], "page_id int, brief_id int, found int, total int")
    assert {r.page_id: (r.brief_id, r.how) for r in matching.pick(p, b, c).collect()} == {1: (1, "declared"), 2: (2, "coverage"), 3: (None, "ambiguous")}


def test_crawl(spark, tmp_path):
    files = spark.createDataFrame([("r", "s1", True), ("r", "u0", False), ("s1", "s2", True), ("s1", "u1", False), ("s1", "r", True), ("s2", "u1", False), ("s2", "u2", False)], "file string, url string, is_index boolean")
    found, partial = crawl.sitemap_walk(files, ["r"])
    assert sorted(map(tuple, found.collect())) == [("u0", 0), ("u1", 1), ("u2", 2)] and not partial.first().partial
    few, partial = crawl.sitemap_walk(files, ["r"], most=2)
    assert sorted(r.url for r in few.collect()) == ["u0", "u1"] and partial.first().partial
    u = spark.createDataFrame([("https://a.com/en/x",), ("https://b.com/en",), ("https://a.com/fr",), ("https://a.com/en/no",)], "url string")
    ok = spark.createDataFrame([("https://a.com/en/no", False)], "url string, allowed boolean")
    assert {r.url[8:]: r.reason for r in crawl.discover(u, "a.com", "/en", ok).collect()} == {"a.com/en/x": None, "b.com/en": "host", "a.com/fr": "path", "a.com/en/no": "robots"}
    crawl.write_csv(spark.createDataFrame([("=1", 'a"b')], "x string, y string").coalesce(1), str(tmp_path / "csv"))
    text = b"".join(f.read_bytes() for f in sorted((tmp_path / "csv").glob("part-*")))
    assert text.decode() == '﻿"x","y"\r\n"\'=1","a""b"\r\n'
    runs = spark.createDataFrame([("a", "ok", 10, 1), ("a", "ok", 11, 2), ("a", "dead", 99, 9)], "url string, verdict string, ms int, ttfb_ms int")
    assert tuple(crawl.average_runs(runs).first()) == ("a", 11, 2, 2)
    f = spark.createDataFrame([(1, "break", "A"), (1, "check", "B")], "page_id int, severity string, field string")
    t = spark.createDataFrame([(1, "green"), (1, "amber")], "page_id int, state string")
    got = {r.page_id: (r.breaks, r.checks, r.fields, r.title_format) for r in crawl.rows_of(f, spark.createDataFrame([(1,), (2,)], "page_id int"), t).collect()}
    assert got == {1: (1, 1, "A", "amber"), 2: (0, 0, "", None)}


HTML = '<head><title>Lifts</title><link rel="canonical" href="https://a.com/x"></head><body><h1>Lifts</h1><p>Copy.</p><h2 style="display:none">Hidden</h2><h2>Questions</h2><h3>Why?</h3><p>So & so.</p><h3>How?</h3><p>Thus.</p><h2>Kinds</h2><img src="/dam/a%20b.jpg"><p>One</p><a href="/y">y</a></body>'


def test_brief_round_trip(spark):
    text = components.brief_of(pages(spark, HTML)).first().brief
    assert text.split("\n") == ["Page Title/Title Tag\tLifts", "Page Name\tLifts", "URL Path\thttps://a.com/x", "Internal Links\t●\t/y", "", "Lifts[1.1]", "Copy.", "Questions[2.1]", "Why?[2.2]", "So & so.", "How?[2.3]", "Thus.", "Kinds[3.1]", "Asset - a b", "One"]
    back = components.read_brief(spark.createDataFrame([(0, text)], "brief_id int, text string"))
    own = components.stream(pages(spark, HTML)).orderBy("ord")
    assert [(r.kind, r.text) for r in back.where("kind <> 'label'").orderBy("ord").collect()] == [(r.kind, r.text) for r in own.collect()]


def test_components(spark):
    leaf = components.leaves(components.numbered(components.stream(pages(spark, HTML))), {"^kinds": "gallery"})
    parts = components.components(leaf)
    assert [(r.type, r.title, len(r["items"])) for r in parts.orderBy("ord").collect()] == [("text", "Lifts", 1), ("faq", "Questions", 2), ("gallery", "Kinds", 1)]
    out = components.render(parts).first()
    assert "<details><summary>Why?</summary><p>So &amp; so.</p></details>" in out.html and '"type":"faq","title":"Questions","items":2' in out.manifest
    assert components.template(parts, [("small", ["text"]), ("full", ["text", "faq"]), ("none", ["hero", "text", "faq"])]).first().template == "full"
    s = components.slots(parts, {"text": ["lead", "more"]})
    assert [(r.slot, r.text, r.left) for r in s.orderBy("slot").collect()] == [("lead", "Copy.", 0), ("more", None, 0)]


def test_modules(spark):
    html = 'x<section class="module-a"><section class="module-b">in</section>tail</section>y<section class="module-a">two</section><section class="plain">z</section>'
    got = components.modules(pages(spark, html)).orderBy("ord").collect()
    assert [(r.name, r.nth, r.of) for r in got] == [("module-a", 1, 2), ("module-a", 2, 2)] and "tail" in got[0].body and "y" not in got[0].body
    c = spark.createDataFrame([(1, ["cmp", "hero", "x"]), (2, ["cmp"]), (3, ["z"])], "element_id int, classes array<string>")
    assert {r.element_id: r.component for r in components.component_of(c, [("base", ["cmp"]), ("hero", ["cmp", "hero"])]).collect()} == {1: "hero", 2: "base", 3: None}


def test_sitemap_files_are_walked(spark):
    from pagewright import sources

    index = '<sitemapindex><sitemap><loc>https://a.com/s1.xml</loc></sitemap><sitemap><loc>https://a.com/s2.xml</loc></sitemap></sitemapindex>'
    texts = [("https://a.com/sitemap.xml", index), ("https://a.com/s1.xml", "<urlset><url><loc>https://a.com/x</loc></url></urlset>"), ("https://a.com/s2.xml", "<urlset><url><loc>https://a.com/y?a=1&amp;b=2</loc></url></urlset>"), ("https://a.com/empty.xml", "")]
    files = sources.sitemap_files(spark.createDataFrame(texts, "file string, text string"))
    assert {(r.file[14:], r.url[14:], r.is_index) for r in files.collect()} == {("sitemap.xml", "s1.xml", True), ("sitemap.xml", "s2.xml", True), ("s1.xml", "x", False), ("s2.xml", "y?a=1&b=2", False)}
    robots = spark.createDataFrame([("a.com", "User-agent: x\nDisallow: /\nSitemap: https://a.com/sitemap.xml # all\nsitemap:https://a.com/sitemap.xml\n#Sitemap: https://a.com/no.xml")], "host string, text string")
    named = [r.url for r in sources.robots_sitemaps(robots).collect()]
    assert named == ["https://a.com/sitemap.xml"]
    pages, _ = crawl.sitemap_walk(files, named)
    assert {(r.url[14:], r.level) for r in pages.collect()} == {("x", 1), ("y?a=1&b=2", 1)}


def test_structure_and_analysis(spark):
    from pagewright.operators.classify import classify
    from pagewright.plans.brief_queries import ASSETS, MARKETS, WORK

    b = spark.createDataFrame([(1, "India\nField\tItaly\tIndia\nTitle\ta\tb\n"), (2, None)], "brief_id int, text string")
    assert {r.brief_id: (r.platform, r.ready) for r in briefs.analyse(b, WORK, MARKETS).collect()} == {1: ("new", True), 2: ("Unknown", False)}
    assert briefs.analyse(b.where("brief_id < 0"), WORK, MARKETS).count() == 0
    s = briefs.structure(spark.createDataFrame([(1, "(https://a.it/x) HTTPS://A.it/X https://assets.test/a https://assets.test/a", "kept")], "brief_id int, text string, extra string"), ASSETS).first()
    assert s.site == ["https://a.it/x"] and s.assets == ["https://assets.test/a"] * 2 and s.extra == "kept" and s.asset and not s.rows_paired
    t = spark.createDataFrame([(1, "one two", True), (2, None, None)], "text_id int, text string, flag boolean")
    got = classify(t, [("b", "one", 2), ("a", "two", 2)], structural=[("b", "flag", 1)]).orderBy("text_id").collect()
    assert [(r.type, r.score, r.matched, r.confident) for r in got] == [("b", 3, "one, flag", True), ("a", 0, "", False)]
