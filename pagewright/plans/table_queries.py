"""Queries over documents, conversations, events and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import classify, crawl, diff, matching, proofing, rules
from pagewright.sources import table

SIGNALS = [("licence", "licensed", 3), ("licence", "version 2", 2), ("contact", "phone", 1), ("contact", "@", 2), ("secret", "token", 2), ("secret", "password", 3)]


def _lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return rows.withColumn("text", F.trim("text")).where("text <> ''")


def doc_sections(spark, sf_dir):
    """Lines under each section, a section being the last short line."""
    short = F.when(F.length("text") <= 20, F.col("text"))
    return diff.forward_fill(_lines(spark, sf_dir), "doc_id", "ord", short).groupBy("doc_id", "section").agg(F.count("*").alias("lines"))


def doc_sentences(spark, sf_dir):
    """Sentences of 25 characters or more and the longest of each document."""
    s = T.sentences(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.size("s").cast("bigint").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("bigint").alias("longest"))


def doc_english_score(spark, sf_dir):
    """Distinct English function words of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", T.english_score(F.col("text")).cast("bigint").alias("score"))


def doc_numbers(spark, sf_dir):
    """Numbers of each document, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.numbers_in(F.col("text")), " ").alias("numbers")).where("numbers <> ''")


def doc_word_counts(spark, sf_dir):
    """Words of letters by number of documents and uses."""
    n = proofing.word_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return n.groupBy("word").agg(F.count("*").alias("docs"), F.sum("n").alias("uses"))


def word_slips(spark, sf_dir):
    """Pairs of part type words a letter apart, by plain column expressions."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), "[^a-z]+")).alias("word")).where("length(word) > 2").distinct()
    other = words.select(F.col("word").alias("other"), F.substring("word", 1, 1).alias("initial"))
    pairs = words.withColumn("initial", F.substring("word", 1, 1)).join(other, "initial").where("word < other")
    return pairs.where(proofing.one_edit(F.col("word"), F.col("other"))).select("word", "other")


def doc_spelled_two_ways(spark, sf_dir):
    """Words of a document that look like slips of others of it."""
    n = proofing.meeting_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return proofing.spelled_two_ways(n, "doc_id")


def doc_repeated_lines(spark, sf_dir):
    """Lines that a document carries more than once, against one of each wanted."""
    lines = _lines(spark, sf_dir)
    wants = lines.groupBy("doc_id", F.lower("text").alias("key")).agg(F.min_by("text", "ord").alias("text"))
    return diff.bag_difference(wants.select("doc_id", "text"), lines, "doc_id").where("severity = 'check'").select("doc_id", F.col("key").alias("line"), "found")


def doc_quality_severity(spark, sf_dir):
    """Labels as findings: breaks and checks of the documents of each language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("doc_id", "page_id")
    found = rules.checks(rows, [("toxic = 1", "copy", "break", "Tone", F.col("lang"), "toxic"), ("quality = 0", "copy", "check", "Quality", F.col("lang"), "poor")])
    return rules.tally(found.withColumnRenamed("found", "lang"), "lang")


def passage_presence(spark, sf_dir):
    """Documents that hold each benchmark passage."""
    return matching.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def turn_brackets(spark, sf_dir):
    """For each turn, the nearest user turns before and after it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("at"))
    return diff.bracket(rows, "conv_id", "turn", "at").select("conv_id", "turn", "before", "after")


def turn_runs(spark, sf_dir):
    """Runs of turns of one role."""
    return diff.runs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


def shorter_turns(spark, sf_dir):
    """Turns that are shorter than an earlier turn of their conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("chars"))
    return diff.out_of_order(rows, "conv_id", "turn", "chars")


def classified_documents(spark, sf_dir):
    """The heaviest type of each document by weighted terms."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return classify.classify(docs, SIGNALS).select("text_id", "type", F.col("score").cast("bigint").alias("score"), "confident")


def event_rollup(spark, sf_dir):
    """Events by type as a crawl: fast ones are ok, slow ones unverified, lost ones dead."""
    v = F.when(F.col("value").isNull(), "dead").when(F.col("value") > 50, "unverified").otherwise("ok")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), v.alias("verdict"), (F.col("value") > 90).cast("bigint").alias("breaks"), (F.col("value") > 75).cast("bigint").alias("checks"))
    return crawl.rollup(rows)


QUERIES = {f.__name__: f for f in (doc_sections, doc_sentences, doc_english_score, doc_numbers, doc_word_counts, word_slips, doc_spelled_two_ways, doc_repeated_lines, doc_quality_severity, passage_presence, turn_brackets, turn_runs, shorter_turns, classified_documents, event_rollup)}
_LINES = "(SELECT doc_id, ord, trim(line) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents) WHERE trim(line) <> '')"
_WORDS = ", ".join(f"'{w}'" for w in T.ENGLISH_WORDS)


def _term(term: str) -> str:
    import re

    a, b = ("\\b" if term[0].isalnum() else ""), ("\\b" if term[-1].isalnum() else "")
    return f"(?i){a}{re.escape(term)}{b}"


_SCORES = " UNION ALL ".join(f"SELECT doc_id AS text_id, '{t}' AS type, " + " + ".join(f"CASE WHEN regexp_matches(text, '{_term(x)}') THEN {w} ELSE 0 END" for k, x, w in SIGNALS if k == t) + " AS score FROM documents" for t in dict.fromkeys(k for k, _, _ in SIGNALS))
ORACLE_SQL = {
    "doc_sections": f"SELECT doc_id, section, count(*) AS lines FROM (SELECT doc_id, last_value(CASE WHEN length(text) <= 20 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM {_LINES}) GROUP BY ALL",
    "doc_sentences": r"""SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 25) AS s FROM documents)""",
    "doc_english_score": f"SELECT doc_id, CAST(len(list_intersect(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')), [{_WORDS}])) AS BIGINT) AS score FROM documents",
    "doc_numbers": r"SELECT * FROM (SELECT doc_id, array_to_string(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), ' ') AS numbers FROM documents) WHERE numbers <> ''",
    "doc_word_counts": r"SELECT word, count(DISTINCT doc_id) AS docs, count(*) AS uses FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY word",
    "word_slips": "WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(concat_ws(' ', p_type, p_name)), '[^a-z]+')) AS word FROM part) WHERE length(word) > 2) SELECT a.word, b.word AS other FROM w a JOIN w b ON a.word < b.word AND left(a.word, 1) = left(b.word, 1) AND damerau_levenshtein(a.word, b.word) = 1",
    "doc_repeated_lines": f"SELECT doc_id, lower(text) AS line, count(*) AS found FROM {_LINES} GROUP BY ALL HAVING count(*) > 1",
    "doc_quality_severity": "SELECT lang, count(*) FILTER (toxic = 1) AS breaks, count(*) FILTER (quality = 0) AS checks FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0 GROUP BY lang",
    "passage_presence": "SELECT item_id, count(*) AS docs, CAST(sum((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text)) AS BIGINT) AS hits FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id",
    "turn_brackets": "SELECT conv_id, turn, last_value(u IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(u IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS u FROM conversations)",
    "turn_runs": "SELECT conv_id, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM conversations) GROUP BY conv_id, role, island",
    "shorter_turns": "SELECT * FROM (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars, CAST(max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS reached FROM conversations) WHERE chars < reached",
    "classified_documents": f"SELECT text_id, type, CAST(score AS BIGINT) AS score, score >= 2 AND score > nxt AS confident FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM ({_SCORES}) WINDOW w AS (PARTITION BY text_id ORDER BY score DESC, type)) WHERE r = 1",
    "event_rollup": "SELECT event_type AS site, count(*) AS pages, count(*) FILTER (value <= 50) AS ok, count(*) FILTER (value IS NULL) AS dead, count(*) FILTER (value > 50) AS unverified, CAST(sum(CAST(value > 90 AS INT)) AS BIGINT) AS breaks, CAST(sum(CAST(value > 75 AS INT)) AS BIGINT) AS checks FROM events GROUP BY event_type",
}
