"""Operators on small inputs: what each catches, and what it leaves alone."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright import sources
from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import briefs, classify, crawl, diff, markup, matching, proofing, rules
from pagewright.streaming import crawl as live


def values(spark, column, given):
    return [r[0] for r in spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, x string").orderBy("k").select(column).collect()]


@pytest.mark.parametrize(("url", "path"), [("https://www.a.com/En/Page.aspx?q=A#x", "/en/page?q=a"), ("https://a.com", "/"), ("/x/index.html", "/x"), ("a.com/b/", "/b"), ("local/b", "local/b"), ("", "/")])
def test_path_of(spark, url, path):
    assert values(spark, U.path_of(F.col("x")), [url]) == [path]


def test_url_functions(spark):
    assert values(spark, U.host_of(F.col("x")), ["HTTP://WWW.A.com:80/x", None]) == ["a.com:80", ""]
    assert values(spark, U.asset_identity(F.col("x")), ["/dam/My%20Pic-01.png:rendition?x", "/a/b+c.jpg"]) == ["mypic01", "bc"]
    assert values(spark, U.verdict_of(F.col("x").cast("int")), ["200", "404", "503", "403", "429"]) == ["ok", "dead", "dead", "unverified", "unverified"]
    assert values(spark, U.split_urls(F.col("x")), ["see https://a.com/x, HTTPS://A.com/x and https://b.com."]) == [["https://a.com/x", "https://b.com"]]


def test_text_functions(spark):
    assert values(spark, T.strip_tags(F.col("x")), ["a<b>b</b>, c<p>d</p><!-- no -->&amp;e"]) == ["ab, c d &e"]
    assert values(spark, T.english_score(F.col("x")), ["The lift is for you", "Der Aufzug"]) == [4, 0]
    assert values(spark, T.sentences(F.col("x")), ["This is a sentence of some length. No. Another one that is long enough! 3.5 tail"]) == [["This is a sentence of some length.", "Another one that is long enough!"]]
    assert values(spark, T.numbers_in(F.col("x")), ["1,5 and 20 or 3.25"]) == [["1,5", "20", "3.25"]]
    assert values(spark, T.occurrences(F.col("x"), F.lit("aa")), ["aaaaa", ""]) == [2, 0]
    assert values(spark, T.attr(F.col("x"), "href"), ['<a href="x y">', "<a href='q'>", "<a href=z>", "<a data-href=1>"]) == ["x y", "q", "z", None]
    assert values(spark, T.has_term(F.col("x"), "caf"), ["CAF x", "cafe", "a caf."]) == [True, False, True]
    assert values(spark, T.csv_cell(F.col("x")), ["=1+1", 'a"b', None]) == ["\"'=1+1\"", '"a""b"', '""']
    assert values(spark, T.same_list(F.col("x"), F.lit("b, a")), ["a,b", "a,a,b"]) == [True, False]


def pages(spark, *html):
    return spark.createDataFrame([(k, f"https://a.com/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")


def test_markup(spark):
    p = pages(spark, '<h1>A</h1><h2 style="display: none">B</h2><a href="/x">go</a><a href="#">todo</a><a href="#" aria-expanded="false">t</a><a href="#in">i</a><img data-src="r.png" src="data:x" alt=""><link rel="alternate" hreflang="en-GB" href="/gb">')
    assert [(r.level, r.text, r.hidden) for r in markup.headings(p).orderBy("ord").collect()] == [("h1", "A", False), ("h2", "B", True)]
    assert [(r.href, r.placeholder) for r in markup.links(p).orderBy("ord").collect()] == [("/x", False), ("#", True)]
    assert [(r.src, r.alt) for r in markup.images(p).collect()] == [("r.png", "")]
    assert [(r.code, r.href) for r in markup.alternates(p).collect()] == [("en-gb", "/gb")]


def test_rules_catch_and_stay_quiet(spark):
    good = '<title>Lifts | Acme</title><meta name="description" content="' + "d" * 100 + '"><h1>Lifts</h1><a href="/p">Lift prices</a>'
    bad = '<title> Acme | Acme</title><meta name="keywords" content=""><h1>A</h1><h1>a</h1><a href="/p">Read more</a><a href="/q"></a><a href="#">x</a>'
    found = rules.audit(pages(spark, good, bad, "")).collect()
    assert not [r for r in found if r.page_id == 0]
    assert sorted(r.note for r in found if r.page_id == 1) == sorted(["leading or trailing spaces", "a part repeats", "more than one H1", "heading repeats", "placeholder link", "link without a name", "link text says nothing about its target", "keywords are empty", "no description"])
    assert {r.page_id: (r.breaks, r.checks) for r in rules.tally(spark.createDataFrame(found), "page_id").collect()}[2] == (2, 1)


def test_briefs(spark):
    text = 'Copy\nField\tEnglish\tFrance\tSpain\nTitle\tLift 24\tAscenseur 24\tAscensor 42\nIntro\tSame\tSame\t\n"Body\n2"\tA ""q\tB\tC\n\t\t\n'
    r = briefs.rows(spark.createDataFrame([(1, text)], "brief_id int, text string"))
    assert [x.cells[0] for x in r.orderBy("row").collect()] == ["Copy", "Field", "Title", "Intro", "Body\n2"]
    assert {x.section for x in r.collect()} == {"Copy"}
    head = briefs.header_rows(r, ["France", "Spain"])
    assert head.first().row == 2
    got = briefs.market_values(r, head)
    assert got.count() == 5 and got.where("untranslated").count() == 1
    assert sorted((x.row, x.kind) for x in briefs.row_quality(got).collect()) == [(3, "number-mismatch"), (4, "ragged"), (4, "untranslated")]


def test_diff(spark):
    w = spark.createDataFrame([(1, "A", 1), (1, "a", 2), (1, "b", 3)], "p int, text string, ord int")
    f = spark.createDataFrame([(1, "a"), (1, "B"), (1, "b")], "p int, text string")
    got = {r.key: (r.missing, r.severity) for r in diff.bag_difference(w, f, "p").collect()}
    assert got == {"a": (1, "break"), "b": (0, "check")}
    c = diff.coverage(diff.bag_difference(w, f, "p"), "p").first()
    assert (c.total, c.found, c.missing, c.complete) == (3, 2, 1, False)
    assert diff.group_wants(w, "p").where("key = 'a'").first().text == "A"
    rows = spark.createDataFrame([(1, k, p) for k, p in enumerate([3, None, 1, 5])], "p int, ord int, pos int")
    assert [r.ord for r in diff.out_of_order(rows, "p", "ord", "pos").collect()] == [2]
    assert [(r.before, r.after) for r in diff.bracket(rows, "p", "ord", "pos").where("pos is null").collect()] == [(3, 1)]


def test_matching(spark):
    p = spark.createDataFrame([(k, u) for k, u in enumerate(["https://a.com/en/lifts/monospace", "https://a.com/en/lifts", "https://a.com/fr", "https://a.com/france", "https://b.org/x"])], "page_id long, url string")
    texts = spark.createDataFrame([(1, "a.com", "Learn more about monospace lifts", None), (2, "a.com", "here", None)], "text_id int, host string, text string, exclude string")
    assert [(r.text_id, r["rank"], r.path, r.score) for r in matching.suggest(texts, matching.sitemap(p)).orderBy("rank").collect()] == [(1, 1, "/en/lifts/monospace", 0.75), (1, 2, "/en/lifts", 0.5)]
    reg = spark.createDataFrame([("all", "a.com", ""), ("fr", "a.com", "/fr")], "market string, domain string, prefix string")
    assert {r.page_id: r.market for r in matching.longest_prefix(p, reg).collect()} == {0: "all", 1: "all", 2: "fr", 3: "all", 4: None}
    r = matching.robots_allows(p.select("page_id", U.path_of(F.col("url")).alias("path")), [(False, "/en"), (True, "/en/lifts$"), (False, "/x"), (True, "/x")])
    assert {x.page_id: x.allowed for x in r.collect()} == {0: False, 1: True, 2: True, 3: True, 4: True}


def test_crawl(spark):
    f = spark.createDataFrame([("a", []), ("b", [("b", "c"), ("c", "d")]), ("e", [("e", "f"), ("f", "e")]), ("g", [(str(k), str(k + 1)) for k in range(4)])], "url string, redirects array<struct<url string, to string>>")
    assert {r.url: r.severity for r in crawl.redirect_verdicts(f).collect()} == {"a": None, "b": "check", "e": "break", "g": "break"}
    edges = spark.createDataFrame([(k, "x") for k in range(5)] + [(1, "y")], "page_id long, dst string")
    status = spark.createDataFrame([("x", "dead"), ("y", "ok")], "dst string, verdict string")
    assert [(r.dst, r.pages, r.examples) for r in crawl.broken_links(edges, status).collect()] == [("x", 5, "0,1,2")]


def test_classify(spark):
    texts = spark.createDataFrame([(1, "update the form"), (2, "nothing"), (3, "form update form")], "text_id int, text string")
    got = {r.text_id: (r.type, r.score, r.confident) for r in classify.classify(texts, [("b", "form", 3), ("a", "update", 3), ("a", "the", 1)]).collect()}
    assert got == {1: ("a", 4, True), 2: ("a", 0, False), 3: ("a", 3, False)}


def test_proofing(spark):
    assert proofing.osa("ca", "abc") == 3 and proofing.osa("form", "from") == 1
    n = spark.createDataFrame([(1, "elevator", 3), (1, "elevaotr", 1), (1, "ellevator", 1), (1, "escalator", 1)], "id int, word string, n int")
    assert sorted(r.word for r in proofing.spelled_two_ways(n, "id").collect()) == ["elevaotr", "ellevator"]


def test_words_that_meet(spark):
    """Only words that may be of a pair are shuffled, with counts of all of a text."""
    unlike = " ".join("".join("abcdefghij"[int(d)] for d in f"{k * k:06}") for k in range(1, 900))
    texts = spark.createDataFrame([(k, f"{unlike} Elevator elevator elevaotr ellevator lobbies lobbies lobbies") for k in range(20)] + [(99, None), (None, "elevator elevator elevaotr"), (98, "short")], "id long, text string")
    met = proofing.meeting_counts(texts, "id", "text")
    every = proofing.word_counts(texts, "id", "text")
    assert every.count() > 20 * 800 and met.count() < 20 * 80
    assert met.exceptAll(every).count() == 0
    assert {(r.word, r.n) for r in met.where("id = 7").collect()} >= {("elevator", 2), ("elevaotr", 1), ("ellevator", 1)}
    assert met.where("word = 'lobbies' or id is null or id > 20").count() == 0


def test_words_that_meet_miss_no_pair(spark):
    """The same pairs as from the counts of all words, if rows share ids and texts are long too."""
    rng = random.Random(4)
    stems = ["".join(rng.choice("abéß\U00010428") for _ in range(rng.randint(5, 8))) for _ in range(150)]

    def slip(w):
        i = rng.randrange(len(w) - 1)
        return rng.choice([w, w, w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :], w.upper()])

    rows = [(rng.choice([k, k, k % 7, None]), " ".join(slip(rng.choice(stems)) for _ in range(rng.choice([0, 3, 60, 400])))) for k in range(120)] + [(500, None), (501, ""), (501, stems[0])]
    texts = spark.createDataFrame(rows, "id long, text string")
    want = {tuple(r) for r in proofing.spelled_two_ways(proofing.word_counts(texts, "id", "text"), "id").collect()}
    assert len(want) > 300
    for named, most in ((texts, 1_000_000), (texts, 1000), (texts.withColumn("id", F.concat(F.lit("n"), "id")), 0)):
        got = proofing.spelled_two_ways(proofing.meeting_counts(named, "id", "text", most), "id").collect()
        assert len(got) == len(want) and {(int(str(r.id).lstrip("n")), r.word, r.other) for r in got} == want


def test_sources(spark):
    t = spark.createDataFrame([("a", "<urlset><loc>https://a.com/x?a&amp;b</loc><loc>https://a.com/x?a&amp;b</loc></urlset>"), ("b", "# no\nhttps://b.com/1\nftp://b")], "site string, text string")
    assert sorted(tuple(r) for r in sources.sitemap_urls(t).collect()) == [("a", "https://a.com/x?a&b", 0), ("b", "https://b.com/1", 0)]
    r = spark.createDataFrame([("h", "User-agent: x\nDisallow: /x\nUser-agent: y\nUser-agent: *\nDisallow: /p # c\nAllow: /p/q\nDisallow:")], "host string, text string")
    assert sorted((x.allow, x.path) for x in sources.robots_rules(r).collect()) == [(False, "/p"), (True, "/p/q")]
    u = spark.createDataFrame([(1, "url,form"), (2, "https://a.com; 12"), (3, "https://a.com")], "line_no int, line string")
    assert [tuple(x) for x in sources.url_list(u).collect()] == [(2, "https://a.com", "12")]


def test_uploads(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    docx, xlsx = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Hi</w:t><w:tab/><w:t>you</w:t></w:r></w:p></w:body></w:document>")
    with zipfile.ZipFile(xlsx, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst {s}><si><t>one</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x"y</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "a.docx").write_bytes(docx.getvalue())
    (tmp_path / "b.xlsx").write_bytes(xlsx.getvalue())
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.csv").write_bytes(b'a, "b"\r\n"c",')
    (tmp_path / "e.xls").write_bytes(b"\xd0\xcf")
    read = sources.uploads(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [r.path.rsplit("/", 1)[1] for r in read if r.error] == ["e.xls"]
    got = {r.path.rsplit("/", 1)[1]: r.text for r in read}
    assert got == {"a.docx": "Hi\tyou\na\tb", "b.xlsx": 'one\t\t"x""y"', "c.txt": "plain", "d.csv": 'a\t"b\nc\t', "e.xls": None}


def test_live_rollup(spark, tmp_path):
    rows = spark.createDataFrame([("s", "ok", 0, 1), ("s", "dead", 2, 0)], "site string, verdict string, breaks long, checks long")
    rows.write.parquet(str(tmp_path / "in"))
    q = live.live_rollup(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "crawl_now", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("crawl_now").first()) == ("s", 2, 1, 1, 0, 2, 1)
