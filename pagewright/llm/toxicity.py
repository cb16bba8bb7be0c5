"""Toxicity of texts after noisy-channel deobfuscation.

A character language model is counted over the whole corpus. Spans that look disguised (leetspeak, letters set apart,
repeated letters) become lattices of possible letters, and the Viterbi path under the model restores them. Words of
the text and restored words are then weighed by what labelled texts say about them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import crc_fold, written

#: Labelled rows that train the weights: those with the smallest hash of the id, at most so many.
SAMPLE = 20_000
#: Labelled toxic texts that a word or beginning must occur in.
LEAST = 4
#: Longest span whose decoding is remembered, in characters; longer ones are decoded each time.
SPAN = 48
#: Characters of text that are counted or weighed together.
SLICE = 1 << 20

# fixed values: letters that characters of leetspeak stand for
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "9": "g", "6": "g", "1": "il", "!": "i", "|": "li", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
_LETTER = "a-zß-öø-ÿ"
_WORD = re.compile(f"[{_LETTER}]+")
_LEETED = re.compile(rf"(?<![{_LETTER}0-9@$!|+])(?:[{_LETTER}]+[0-9@$!|+]+[{_LETTER}]|[0-9@$!|+]+[{_LETTER}]|[{_LETTER}]+[0-9@$+]+(?![0-9@$!|+]*[%#&*]))[{_LETTER}0-9@$!|+]*")
_SPACED = re.compile(rf"(?<![^\s])(?:[{_LETTER}0-9@$!|+][ ._*\-]){{2,}}[{_LETTER}0-9@$!|+](?![{_LETTER}0-9])")
_REPEATED = re.compile(rf"[{_LETTER}]*([{_LETTER}])\1\1[{_LETTER}]*")
SIZE = 60


def symbol(c: str) -> int:
    """1 to 59 for the letters of the model, 0 for all else, which is a border of words."""
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else o - 196 if 223 <= o <= 255 and o != 247 else 0


_CODE = np.zeros(256, np.int64)
for _o in range(256):
    _CODE[_o] = symbol(chr(_o))


def trigram_counts(texts) -> np.ndarray:
    """Counts of symbol trigrams, two borders before each text; a long text is counted by slices that carry their last symbols on."""
    total = np.zeros(SIZE**3, np.int64)
    for text in texts:
        before = np.zeros(2, np.int64)
        for at in range(0, len(text), SLICE):
            points = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "replace"), np.uint32)
            s = np.r_[before, _CODE[np.where(points < 256, points, 0)], *([0] if at + SLICE >= len(text) else [])]
            s = s[np.r_[True, True, (s[2:] != 0) | (s[1:-1] != 0)]]
            before = s[-2:]
            if len(s) > 2:
                total += np.bincount(s[:-2] * SIZE * SIZE + s[1:-1] * SIZE + s[2:], minlength=SIZE**3)
    return total


def by_size(texts: list, most: int = SLICE):
    """Ranges of ``texts`` of up to ``most`` characters together, or of one longer text."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        if k > start and held + len(text or "") > most:
            yield start, k
            start, held = k, 0
        held += len(text or "")
    if len(texts) > start:
        yield start, len(texts)


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities [a, b, c] of c after a, b from all texts; Spark sums the counts, of a fixed alphabet."""

    def count(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in by_size(texts):
                total = trigram_counts(["\n".join(t for t in texts[a:b] if t)])
                key = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], names=["key", "n"])

    counts = np.zeros(SIZE**3)
    # at most SIZE**3 = 216,000 rows
    for row in docs.select(text_col).mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect():
        counts[row["key"]] = row["n"]
    three = counts.reshape(SIZE, SIZE, SIZE)
    two = three.sum(axis=0) + 0.1
    back = two / two.sum(axis=1, keepdims=True)
    return np.log((three + 5.0 * back[None]) / (three.sum(axis=2, keepdims=True) + 5.0)).astype(np.float32)


def restore(span: str, model: np.ndarray) -> str:
    """Viterbi path of the span's lattice: letters stay; leet characters become one of their letters or go; marks between letters
    go or part words; of repeated letters any may go. A path is a chain of its letters back to the start, so the time is linear in the span."""
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last = ""
    for c in span:
        options: list[tuple[str, float]]
        if symbol(c):
            options = [(c, 0.0)] + ([("", -0.5)] if c == last else [])
        elif c in LEET:
            options = [(x, -0.7) for x in LEET[c]] + [("", -4.0)]
        else:
            options = [("", -0.3), (" ", -0.7)]
        last = c
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, out) in paths.items():
            for x, price in options:
                if not x:
                    state, total = (a, b), cost + price
                else:
                    k = symbol(x) if x != " " else 0
                    if not k and not b:
                        continue
                    state, total = ((b, k), cost + price + float(model[a, b, k]))
                if state not in new or new[state][0] < total:
                    new[state] = (total, (x, out) if x else out)
        paths = new
    if not paths:
        return span
    ends = [(cost + float(model[a, b, 0]), out) for (a, b), (cost, out) in paths.items()]
    best = max(cost for cost, _ in ends)
    return max(_spelled(out) for cost, out in ends if cost == best)


def _spelled(chain: tuple | None) -> str:
    letters = []
    while chain:
        x, chain = chain
        letters.append(x)
    return "".join(reversed(letters))


@dataclass
class Words:
    """Words of texts with the restored ones; remembers decoded spans up to SPAN."""

    model: np.ndarray
    memo: dict[str, str] = field(default_factory=dict)

    def of(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        found = set(_WORD.findall(low))
        spans = [m.group() for m in _SPACED.finditer(low)]
        raw = np.frombuffer(low.encode("latin-1", "replace"), np.uint8)
        if len(raw) > 2 and bool(((raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2]) & (_CODE[raw[2:]] > 0)).any()):
            spans += [m.group() for m in _REPEATED.finditer(low)]
        spans += [m.group() for m in _LEETED.finditer(low)]
        for span in spans:
            if len(span) > SPAN:
                found.update(restore(span, self.model).split())
                continue
            if span not in self.memo:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                self.memo[span] = restore(span, self.model)
            found.update(self.memo[span].split())
        return found


def features(word: str) -> list[str]:
    """The word, and its beginnings of three to six letters."""
    return [word, *("^" + word[:k] for k in range(3, min(6, len(word)) + 1))]


@dataclass
class Model:
    """Language model, weights of words and beginnings, and the coefficients of the score."""

    letters: np.ndarray
    weights: dict[str, float]
    coefficients: np.ndarray
    memo: dict[str, float] = field(default_factory=dict)

    def evidence(self, words: set[str]) -> tuple[float, float, float]:
        """Weights of the three heaviest words."""
        top = [0.0, 0.0, 0.0]
        memo, weights = self.memo, self.weights
        if len(memo) > 500_000:
            memo.clear()
        for w in words:
            v = memo.get(w)
            if v is None:
                v = memo[w] = max(weights.get(f, 0.0) for f in features(w)) if w else 0.0
            if v > top[2]:
                top = sorted([v, top[0], top[1]], reverse=True)
        return tuple(top)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Training sample (y, text) of at most SAMPLE rows outside the held-out fold; an id of several rows trains nothing."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = known.where(crc_fold(id_col) != 0).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    # at most SAMPLE rows of an id and a number
    single = docs.select(id_col).join(F.broadcast(known), id_col).groupBy(id_col, "y").agg(F.count("*").alias("n")).where("n = 1").select(id_col, "y")
    return docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(single), id_col).select("y", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most SAMPLE labelled rows whose crc32(id) mod 5 isn't 0; the language model reads all texts, no labels.

    Letters outside Latin-1 are borders of words here. Without labelled rows, or without toxic ones, every text scores low.
    """
    letters = language_model(docs, text_col)
    sample = written(_labelled(docs, labels, id_col, text_col, label_col))
    share = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = share.get(1, 0), share.get(0, 0)

    def count(batches):
        words = Words(letters)
        for batch in batches:
            ys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_size(texts):
                seen: dict[str, list[int]] = {}
                for y, text in zip(ys[a:b], texts[a:b], strict=True):
                    for f in {f for w in words.of(text) for f in features(w)}:
                        seen.setdefault(f, [0, 0])[1 if y == 1 else 0] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["f", "pos", "neg"])

    counted = sample.mapInArrow(count, "f string, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # a weight is the log odds at the lower end of a smoothed estimate, so rare words weigh little
    weight = F.log((F.col("pos") + 0.2) / (n_pos + 1)) - F.log((F.col("neg") + 1.0) / (n_neg + 1))
    # each stands in LEAST toxic texts of the sample at least, so the sample bounds them
    heavy = counted.where(F.col("pos") >= LEAST).select("f", weight.alias("w")).where("w > 1")
    weights = {r["f"]: r["w"] for r in heavy.toLocalIterator()}
    model = Model(letters, weights, np.zeros(4))

    def weigh(batches):
        words = Words(letters)
        for batch in batches:
            got = [model.evidence(words.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))], names=["y", "a", "b", "c"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(weigh, "y bigint, a double, b double, c double").collect()], dtype=float).reshape(-1, 4)
    return Model(letters, weights, logistic(np.c_[np.ones(len(rows)), rows[:, 1:]], rows[:, 0] == 1))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic regression by Newton's steps; without both classes only the constant is used."""
    beta = np.zeros(x.shape[1])
    if not len(x) or y.all() or not y.any():
        beta[0] = 3.0 if len(x) and y.all() else -3.0
        return beta
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, held_out, score, predicted) of every whole text.

    Null and empty texts have no evidence and get the score of that. Repeated rows are scored each; a null id counts as
    held out. An empty table gives an empty result.
    """
    names = [id_col, *(k for k in keep if k != id_col)]

    def run(batches):
        words, b = Words(model.letters), model.coefficients
        at = [*names, text_col].index(text_col)
        for batch in batches:
            got = np.array([model.evidence(words.of(t)) for t in batch.column(at).to_pylist()], dtype=float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(b[0] + got @ b[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(p)], names=[*names, "__score"])

    source = docs.select(*names, *([text_col] if text_col not in names else []))
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names) + ", __score double"
    scored = source.mapInArrow(run, schema)
    return scored.select(*names, (crc_fold(id_col) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns and no more. Null and empty texts stay."""
    at = docs.columns.index(text_col)

    def run(batches):
        words, b = Words(model.letters), model.coefficients
        for batch in batches:
            got = np.array([model.evidence(words.of(t)) for t in batch.column(at).to_pylist()], dtype=float).reshape(-1, 3)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(b[0] + got @ b[1:], -30, 30))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
