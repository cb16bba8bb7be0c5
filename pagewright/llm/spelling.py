"""Spelling variants: words one edit apart, found by Aho-Corasick automata over their halves.

An edit leaves one half of a word as it is, so a near word starts with its left half or ends with its right half. Automaton shards hold
the two halves of every word; every word is scanned, and a half found at the right offset in a word of fitting length is verified.
"""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import written

RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many, by crc32 of its document and itself, loses a code point.
DAMAGED = 31
#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LEAST_LENGTH, LEAST_N, TIMES = 7, 2, 10
#: Halves that one automaton holds on average.
SHARD = 100_000
#: A half of more words than this is dealt on by the rest of its words, less one code point each.
HOT = 10_000
#: A half of more words than this keeps them by their rests, if those have no more code points than SHORT; else a scanned word meets all of them.
FEW, SHORT = 8, 64
#: Hot halves are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_HALVES = 100_000


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all texts, A-Z lower-cased, after the damage that ids and runs decide.

    Words have LEAST_LENGTH code points and LEAST_N occurrences at least. Null texts have none, a null id reads as empty, repeated rows count each.
    """
    lower = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.filter(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0)), lambda w: F.length(w) >= LEAST_LENGTH)
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    summed = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = summed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return i < len(a) and a[i + 1 :] == b[i + (len(a) == len(b)) :]


def shared_rest(a: str, b: str) -> str:
    """Of the rests that two strings one edit apart have in common, each less one code point or whole, the one that they meet at."""
    if len(a) != len(b):
        return min(a, b, key=len)
    i = next(i for i in range(len(a)) if a[i] != b[i])
    return a[:i] + a[i + 1 :]


def rests(text: str) -> set[str]:
    """A string whole and less one code point each: strings one edit apart have one of these in common."""
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


def _scanned(batches):
    """Near words (word, near, n) from rows (shard, scan, side, half, rest, word, n) sorted by shard, entries before scanned words.

    The words of a frequent half are kept by their rests, so a word meets those it may be near to and not all that share the half.
    """

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out: list[list] = [[], [], []]

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "n"])
        for c in out:
            c.clear()
        return made

    def near(word: str, own: str, kept: list | dict, left: int, only: str | None = None) -> None:
        """Words of ``kept`` whose other part is one edit from ``own``; of a pair with both halves in place the left one is asked."""
        if isinstance(kept, list):
            asked = [(only, kept)]
        else:
            asked = [(rest, kept.get(rest, ())) for rest in (rests(own) if len(own) <= SHORT + 1 else ())]
            asked.append((None, kept[None]))
        for rest, found in asked:
            for w, n in found:
                b = w[left:] if left else w[: len(w) - len(word) + len(own)]
                if one_edit(own, b) and (rest is None or rest == shared_rest(own, b)) and (left or not word.startswith(w[: len(w) // 2])):
                    for c, v in zip(out, (word, w, n), strict=True):
                        c.append(v)

    for _, shard in groupby(rows(), itemgetter(0)):
        sides: dict[str, dict[str, list | dict]] = {"l": {}, "r": {}}
        dealt: dict[tuple[str, str, str], list] = {}
        halves, before = ahocorasick.Automaton(), None
        for _, scan, side, half, rest, word, n in shard:
            if not scan:
                halves.add_word(half, half)
                (sides[side].setdefault(half, []) if rest is None else dealt.setdefault((side, half, rest), [])).append((word, n))
                continue
            if halves.kind == ahocorasick.TRIE:
                halves.make_automaton()
                for s, kept in sides.items():
                    kept.update({h: by_rest(s, h, words) for h, words in kept.items() if len(words) > FEW})
            # one pass for all halves of a word in this shard; for a hot half it passes with each rest
            if halves.kind != ahocorasick.AHOCORASICK or rest is None and word == before:
                continue
            before, size = word if rest is None else before, len(word)
            lefts, rights = sides["l"], sides["r"]
            for end, hit in halves.iter(word):
                k = len(hit)
                # words whose left half has k code points have 2k or 2k + 1, those of such a right half 2k - 1 or 2k
                starts, ends = end + 1 == k and 2 * k - 1 <= size <= 2 * k + 2, end + 1 == size and 2 * k - 2 <= size <= 2 * k + 1
                if rest is not None:
                    if hit == half and (starts if side == "l" else ends):
                        near(word, word[k:] if side == "l" else word[:-k], dealt.get((side, half, rest), []), k * (side == "l"), rest)
                    continue
                if starts and hit in lefts:
                    near(word, word[k:], lefts[hit], k)
                if ends and hit in rights:
                    near(word, word[:-k], rights[hit], 0)
            if len(out[0]) > 10_000:
                yield batch()
    if out[0]:
        yield batch()


def by_rest(side: str, half: str, words: list) -> dict:
    """The words of a half by the rests of their other part; those of a longer one than SHORT under None."""
    kept: dict[str | None, list] = {None: []}
    for word, n in words:
        other = word[len(half) :] if side == "l" else word[: -len(half)]
        for rest in rests(other) if len(other) <= SHORT else (None,):
            kept.setdefault(rest, []).append((word, n))
    return kept


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, n): every ordered pair of words of (word, n) one edit apart, once, with the near word's n.

    A shard is a hash of the half, so a word is scanned only in the shards that may hold a half it starts or ends with, four at most; no
    word meets all shards. A half of over HOT words is dealt on by what is left of its words: whole or less one code point, which words one
    edit apart share. No half is capped; one of over SHORT code points stays in its shard.
    """
    shards = max(1, math.ceil(2 * vocabulary.count() / SHARD))
    word, size = F.col("word"), F.length("word")
    cut = (size / 2).cast("int")

    def left(k):
        return F.struct(F.lit("l").alias("side"), word.substr(F.lit(1), k).alias("half"))

    def right(k):
        return F.struct(F.lit("r").alias("side"), word.substr(size - k + 1, k).alias("half"))

    own = vocabulary.select("word", "n", F.explode(F.array(left(cut), right(size - cut))).alias("at"))
    # halves that words one longer, as long or one shorter would have in this one
    fits = [(F.floor((size + d) / 2).cast("int"), (size + d - F.floor((size + d) / 2)).cast("int")) for d in (-1, 0, 1)]
    seen = vocabulary.select("word", "n", F.explode(F.array_distinct(F.array(*[f(x) for a, b in fits for f, x in ((left, a), (right, b))]))).alias("at"))
    rows = own.withColumn("scan", F.lit(0)).union(seen.withColumn("scan", F.lit(1))).select("scan", "at.side", "at.half", "word", "n")
    hot = written(own.groupBy("at.side", "at.half").agg(F.count("*").alias("words")).where((F.col("words") > HOT) & (F.length("half") <= SHORT)).select("side", "half", F.lit(True).alias("hot")))
    marked = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_HALVES else hot, ["side", "half"], "left")
    left_over = F.when(F.col("side") == "l", word.substr(F.length("half") + 1, size)).otherwise(word.substr(F.lit(1), size - F.length("half")))
    less = F.transform(F.sequence(F.lit(1), F.length("left_over")), lambda i: F.concat(F.col("left_over").substr(F.lit(1), i - 1), F.col("left_over").substr(i + 1, F.length("left_over"))))
    rests = F.when(F.col("hot"), F.array_distinct(F.concat(F.array("left_over"), F.when(F.length("left_over") > 0, less).otherwise(F.array().cast("array<string>"))))).otherwise(F.array(F.lit(None).cast("string")))
    dealt = marked.withColumn("left_over", left_over).withColumn("rest", F.explode(rests))
    shard = F.pmod(F.xxhash64("side", "half", "rest"), F.lit(shards)).cast("int")
    dealt = dealt.select(shard.alias("shard"), "scan", F.when((F.col("scan") == 0) | F.col("hot"), F.col("side")).alias("side"), F.when((F.col("scan") == 0) | F.col("hot"), F.col("half")).alias("half"), "rest", "word", "n")
    return dealt.repartition("shard").sortWithinPartitions("shard", "scan", "word", "rest").mapInArrow(_scanned, "word string, near string, n bigint")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the more frequent word that each word is a variant of, and the end of the chain of those.

    A word's form is its near word of largest n, then first in code-point order, if that is TIMES as frequent. Forms get more frequent by that
    factor, so chains are short and their ends are found by doubling: four joins for any corpus. Texts without words and empty tables give no rows; other
    columns are ignored.
    """
    vocabulary = written(words(docs, id_col, text_col))
    best = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "near")).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    enough = -F.col("best.m") >= TIMES * F.col("n")
    known = written(joined.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.m")).alias("form_n")))
    most = known.agg(F.max("n")).first()[0] or 1
    ends = known.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, TIMES))))):
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = written(ends.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT coalesce(doc_id::varchar, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS hx FROM runs WHERE length(run) >= 7 GROUP BY id, run),
summed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::bigint)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM counted, crc_table),
words AS (
  SELECT word, sum(k)::bigint AS n, length(word) AS size FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (SELECT word, n, size, i, left(word, i::int) || substr(word, i::int + 2) AS rest FROM words, LATERAL (SELECT unnest(range(size)) AS i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -n, 'near': near}) AS b FROM pairs GROUP BY word),
known AS (
  SELECT word, n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN -b.m >= 10 * n THEN b.near END AS form, CASE WHEN -b.m >= 10 * n THEN (-b.m)::bigint END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS reached, 0 AS depth FROM known
  UNION ALL SELECT c.word, k.form, c.depth + 1 FROM chain c JOIN known k ON c.reached = k.word WHERE k.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN (SELECT word, arg_max(reached, depth) AS root FROM chain GROUP BY word) USING (word)
"""
