"""URL filters: rules by host and path prefix, looked up in cascades of Bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import written

#: (host, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
_JOIN = "\n"


def _spots(h1: np.ndarray, h2: np.ndarray, depth: int, size: int, probes: int):
    """Bit positions of keys in the level at ``depth``; each level mixes the hashes anew."""
    salt = np.uint64((depth + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b = (h1 ^ salt) * np.uint64(0xFF51AFD7ED558CCD), (h2 + salt) * np.uint64(0xC4CEB9FE1A85EC53)
    a, b = a ^ (a >> np.uint64(33)), (b ^ (b >> np.uint64(29))) | np.uint64(1)
    for i in range(probes):
        yield (a + np.uint64(i) * b) % np.uint64(size)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: packed bits, their number, the number of probes of a key and its depth in the cascade."""

    bits: np.ndarray
    size: int
    probes: int
    depth: int

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in _spots(h1, h2, self.depth, self.size, self.probes):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the universe: a key is as the first level that lacks it says."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.ones(len(h1), bool)
    for k, level in enumerate(levels):
        gone = open_ & ~level.holds(h1, h2)
        out[gone] = k % 2 == 1
        open_ &= ~gone
    return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit(7))]


def _level(keys: DataFrame, n: int, rate: float, depth: int) -> Level:
    probes = max(1, round(-math.log2(rate)))
    size = max(64, math.ceil(n * probes / math.log(2)))

    def spots(frames):
        for f in frames:
            h1, h2 = (f[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            at = np.unique(np.concatenate(list(_spots(h1, h2, depth, size, probes)))) if len(f) else np.zeros(0, np.uint64)
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    # one row for every 64 bits of the filter, which grows with the list and not with the corpus
    words = keys.mapInPandas(spots, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(size // 64 + 1, np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return Level(bits.view(np.uint8), size, probes, depth)


def _held(level: Level):
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(level.holds(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)))

    return test


def cascade(universe: DataFrame, inside: DataFrame) -> list[Level]:
    """Levels for the keys of ``inside`` (key) against all others of ``universe`` (key, h1, h2).

    Level 0 holds the listed keys, level 1 the other keys that level 0 takes for listed, level 2 the listed ones that
    level 1 holds by mistake, and so on until a level errs for no key. The rate of level 0 keeps its errors near the
    number of listed keys, so all levels grow with the list, whatever the universe. Each level's errors are found and
    hashed by Spark; the driver receives the words of the filters.
    """
    keys = written(inside.select("key").distinct().select("key", *[h.alias(f"h{i + 1}") for i, h in enumerate(_hashes(F.col("key")))]))
    n = keys.count()
    if not n:
        return []
    others = written(universe.join(keys.select("key"), "key", "left_anti"))
    rate = min(0.5, n * math.sqrt(0.5) / max(1, others.count()))
    levels, sides, k = [], [keys, others], 0
    while n:
        level = _level(sides[k % 2], n, rate if k == 0 else 0.5, k)
        levels.append(level)
        test = F.pandas_udf(_held(level), "boolean")
        sides[(k + 1) % 2] = written(sides[(k + 1) % 2].where(test("h1", "h2")))
        n = sides[(k + 1) % 2].count()
        k += 1
    return levels


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between ``://`` and the first of / ? # with A-Z lower-cased; path from there to ? or #. Else both empty."""
    part = lambda g: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", g), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(part(1), upper, upper.lower()), part(2)


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule that fits each url, else ``default``.

    ``rules`` are rows (host, path, verdict), as tuples or as a DataFrame of any length. A url's keys are the endings of its host
    joined with the starts of its path, for each pair of label count and path length that some rule has. The distinct keys of all urls are the universe for which the cascades are exact, so the
    lookup needs no join. Null urls and those without ``://`` have empty host and path and fit no rule. Repeated rows
    are judged each; an empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    listing = (rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")).select("host", "path", "verdict")
    # pairs of two small numbers
    forms = sorted(tuple(r) for r in listing.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).distinct().collect())
    fits = [F.when((F.size(F.split("host", r"\.")) >= n) & (F.length("path") >= m) & (F.col("host") != ""), F.concat(F.substring_index("host", ".", -n), F.lit(_JOIN), F.substring("path", 1, m))) for n, m in forms]
    keys = F.filter(F.array(*fits), lambda k: k.isNotNull()) if fits else F.array().cast("array<string>")
    rows = written(rows.withColumn("keys", keys))
    universe = written(rows.select(F.explode("keys").alias("key")).distinct().select("key", *[h.alias(f"h{i + 1}") for i, h in enumerate(_hashes(F.col("key")))]))
    listing = listing.select(F.concat("host", F.lit(_JOIN), "path").alias("key"), "verdict")
    every, block = cascade(universe, listing), cascade(universe, listing.where("verdict = 'block'"))

    def member(levels):
        def test(a: pd.Series, b: pd.Series) -> pd.Series:
            sizes = a.map(len).to_numpy()
            flat = [np.concatenate([*x, np.array([], np.int64)]).astype(np.int64).view(np.uint64) for x in (a, b)]
            hit = listed(levels, *flat)
            return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]) if len(sizes) else [])

        return F.pandas_udf(test, "array<boolean>")

    h1, h2 = F.transform("keys", lambda k: _hashes(k)[0]), F.transform("keys", lambda k: _hashes(k)[1])
    rows = rows.withColumn("hit", member(every)(h1, h2)).withColumn("bad", member(block)(h1, h2))
    zipped = F.filter(F.arrays_zip("keys", "hit", "bad"), lambda x: x["hit"])
    best = F.element_at(F.array_sort(F.transform(zipped, lambda x: F.struct((-F.length(x["keys"])).alias("n"), x["keys"].alias("key"), x["bad"].alias("bad")))), 1)
    rows = rows.withColumn("best", F.when(F.size(zipped) > 0, best))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.bad"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.replace(F.col("best.key"), F.lit(_JOIN), F.lit("")).alias("rule"), verdict.alias("verdict"))


ORACLE = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(h, s, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, max_by(h || s, length(h || s)) AS rule, max_by(v, length(h || s)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id
"""
