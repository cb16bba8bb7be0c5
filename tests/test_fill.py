from pagewright.operators import briefs, crawl, fill

TEXT = "Copy\tEnglish\tItaly\tSpain\nHead\tWelcome home\tBenvenuti\t\nBody\tRead the guide now\t\tLea\nNote\t\t\tx"


def rows(spark, text):
    return briefs.rows(spark.createDataFrame([(1, text)], "brief_id int, text string"))


def test_gaps_and_rows(spark):
    r = rows(spark, TEXT)
    head = briefs.header_rows(r, ["Italy", "Spain"])
    assert {(x.label, x.market) for x in fill.market_gaps(r, head).collect()} == {("Head", "spain"), ("Body", "italy")}
    p = fill.plain_rows(rows(spark, "Head\tWelcome\tBenvenuti\nTitle\tSolo\nalone\nGap\tx\t "))
    assert {(x.label, x.english, x.localised) for x in p.collect()} == {("Head", "Welcome", "Benvenuti"), ("Title", "", "Solo")}
    v = rows(spark, "Meta title\tx\t \nmeta TITLE\ty\tz\nMeta title\ty\tq\nMeta title\tshort")
    assert fill.localised_row(v, "Meta title").first().value == "z"
    assert fill.localised_row(v, "Nope").count() == 0


def test_fill(spark):
    q = spark.createDataFrame([(1, 1, "Read the <b>guide</b>"), (2, 1, "Nothing alike"), (3, 1, "Same")], "query_id int, brief_id int, text string")
    v = spark.createDataFrame([(1, 1, "Read the guide", "Leggi: guide & more"), (1, 2, "Same", "Uno"), (1, 3, "Same", "Due")], "brief_id int, row int, english string, localised string")
    got = {r.query_id: (r.how, r.row, r.html) for r in fill.fill(q, v).collect()}
    assert got == {1: ("exact", 1, "Leggi: <strong>guide</strong> &amp; more"), 2: ("none", None, None), 3: ("ambiguous", None, None)}


def test_suggest_form(spark):
    m = spark.createDataFrame([(1, "Italy"), (2, "belgium"), (3, "Belgium (FR)"), (4, "Mars"), (5, "Peru"), (6, None)], "brief_id int, market string")
    reg = spark.createDataFrame([("Italy", "7"), ("Belgium (FR)", "8"), ("Belgium (NL)", "9"), ("Peru", None)], "market string, form_id string")
    assert {(r.brief_id, r.market, r.form_id) for r in fill.suggest_form(m, reg).collect()} == {(1, "Italy", "7"), (3, "Belgium (FR)", "8")}


def test_summary_and_json(spark):
    p = spark.createDataFrame([(1, "https://a.com"), (2, None)], "page_id int, url string")
    f = spark.createDataFrame([(1, "links", "check", "Link", None, "vague"), (1, "links", "break", "Link", "x", "dead")], "page_id int, category string, severity string, field string, found string, note string")
    got = {r.page_id: r.text for r in crawl.summary_text(p, f, ("links", "forms")).collect()}
    assert got[1] == "QA summary - https://a.com\n\nLINKS (2)\n- [Fix] Link: x\n    dead\n- [Check] Link\n    vague\n\nFORMS (0)\n  nothing found"
    assert got[2] == "QA summary - pasted page\n\nLINKS (0)\n  nothing found\n\nFORMS (0)\n  nothing found"
    assert [r.value for r in crawl.json_rows(p.orderBy("page_id")).collect()] == ['{"page_id":1,"url":"https://a.com"}', '{"page_id":2,"url":null}']
