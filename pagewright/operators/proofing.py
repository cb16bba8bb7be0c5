"""Proofreading of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Least letters of a word that may be a slip or have one.
LONG = 6
#: Ids that several rows have are known by so many hashes, which bounds what is broadcast.
HASHES = 65_536
#: Characters of words looked through at once, and words in which longer texts are handed on.
AT_ONCE, SLICE = 1_000_000, 10_000


def word_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word, n) of lower-case words of letters."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}]+)"), F.lit(1))
    return texts.select(id_col, F.explode(words).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def words_in_order(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, word) of the words of letters of each text as written."""
    return texts.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(r"([\p{L}]+)"), F.lit(1))).alias("ord", "word"))


def osa(a: str, b: str) -> int:
    """Edits, with swaps of neighbours as one and no part edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x or "", y or "") for x, y in zip(a, b, strict=True)])


def one_edit(a: Column, b: Column) -> Column:
    """Whether ``distance`` is 1: one letter more, less or other, or two neighbours swapped."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (a != b) & ((F.levenshtein(a, b, 1) == 1) | ((F.length(a) == F.length(b)) & swapped))


def spelled_two_ways(counts: DataFrame, id_col: str) -> DataFrame:
    """(id, word, other): a word seen once that differs by a swap or a doubled letter from one seen more often.

    Swaps keep a word's sorted letters and doubling keeps its distinct runs, so each pair meets on one of two keys.
    """
    long = counts.where(F.length("word") >= LONG)
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    single = F.regexp_replace("word", r"(.)\1+", "$1")
    keyed = long.select(id_col, "word", "n", F.explode(F.array(F.concat(F.lit("s"), letters), F.concat(F.lit("d"), single))).alias("key"))
    rare, common = keyed.where("n = 1"), keyed.where("n >= 2").select(id_col, F.col("word").alias("other"), "key")
    pairs = rare.join(common, [id_col, "key"]).where("word <> other and abs(length(word) - length(other)) <= 1")
    return pairs.select(id_col, "word", "other").distinct().where(one_edit(F.col("word"), F.col("other")))


def _alike(key: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which words share their key with others of which one differs from them in size or order and two do not differ."""
    bucket = (key >> np.uint64(46)).astype(np.int64)
    some = np.flatnonzero(np.bincount(bucket)[bucket] >= 3)
    some = some[np.lexsort((size[some], order[some], key[some]))]
    found = np.zeros(len(key), bool)
    if len(some):
        new = np.r_[True, key[some[1:]] != key[some[:-1]]]
        other = new | np.r_[True, (order[some[1:]] != order[some[:-1]]) | (size[some[1:]] != size[some[:-1]])]
        first = np.flatnonzero(new)
        n, kinds = np.diff(np.r_[first, len(some)]), np.add.reduceat(other.astype(np.int64), first)
        found[some] = np.repeat((kinds >= 2) & (n > kinds), n)
    return found


def meeting(words: pa.StringArray, rows: np.ndarray) -> np.ndarray:
    """Which words of each row may be of a pair of ``spelled_two_ways``: no word of a pair is missed, a few others are kept.

    Words of equal letters, or of equal runs of them, have equal sums of what stands for these. Of a pair one word stands twice, and the other
    differs in size or in the sum of letters times their places: a swap or another letter changes this one, however it wraps.
    """
    letter = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py().encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    place = (np.arange(1, len(letter) + 1) - np.repeat(start, size)).astype(np.uint64)
    order = np.add.reduceat(letter * place, start)
    again = np.r_[False, letter[1:] == letter[:-1]]
    again[start] = False
    # any numbers that seldom sum up alike will do
    value = (letter + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(32)
    row = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    found = _alike(np.add.reduceat(value, start) + row, size, order)
    value[again] = 0
    return found | _alike(np.add.reduceat(value, start) + row, size, order)


def _handed_on(batches):
    """(id, word) from rows (id, whole, words): all words of whole rows, of others those that meet."""
    for b in batches:
        ids, whole, words = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2).flatten()
        end = np.cumsum(np.r_[0, pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)])
        bytes_to = np.cumsum(np.r_[0, pc.binary_length(words).to_numpy(zero_copy_only=False)])[end]
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(bytes_to, bytes_to[lo] + AT_ONCE, "right")) - 1)
            rows, part = np.repeat(np.arange(lo, hi), np.diff(end[lo : hi + 1])), words[end[lo] : end[hi]]
            if len(part):
                kept = whole[rows] if whole[lo:hi].all() else whole[rows] | meeting(part, rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[kept])), part.filter(pa.array(kept))], names=["id", "word"])
            lo = hi


def meeting_counts(texts: DataFrame, id_col: str, text_col: str, most: int = AT_ONCE) -> DataFrame:
    """The rows of ``word_counts`` that ``spelled_two_ways`` may pair, with their whole counts, and few others.

    A row whose id no other row has is looked through where it lies, and only those of its words that meet on a key are shuffled. Rows that
    share an id hand on all words, as do texts of over ``most`` characters; those meet by shuffles. Null ids pair with nothing.
    """
    texts = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(HASHES)).alias("hash")).where("id is not null")
    several = texts.groupBy("id", "hash").agg(F.count("*").alias("rows")).where("rows > 1").select("hash", F.lit(True).alias("shared")).distinct()
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{{LONG},}})"), F.lit(1))
    rows = texts.where("text is not null").join(F.broadcast(several), "hash", "left").select("id", F.coalesce("shared", F.length("text") > most).alias("whole"), words.alias("words"))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(SLICE)), lambda i: F.slice("words", i, SLICE))
    rows = rows.select("id", "whole", F.explode(F.when(F.col("whole"), parts).otherwise(F.array("words"))).alias("words"))
    found = rows.mapInArrow(_handed_on, StructType([texts.schema["id"], StructField("word", StringType())]))
    return found.groupBy(F.col("id").alias(id_col), "word").agg(F.count("*").alias("n"))
