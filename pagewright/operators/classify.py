"""Weighted, explainable classification of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T


def type_scores(text: Column, signals: list[tuple[str, str, int]], structural: list[tuple[str, str, int]] = ()) -> Column:
    """Array of (type, score, matched): the weights of the terms that hit ``text``, and of the boolean columns that hold, for each type."""

    def of(kind):
        terms = [(T.has_term(text, term), term, w) for t, term, w in signals if t == kind]
        flags = [(F.col(flag), flag, w) for t, flag, w in structural if t == kind]
        hits = F.array(*[F.when(c, F.struct(F.lit(w).alias("w"), F.lit(what).alias("term"))) for c, what, w in terms + flags])
        return F.struct(F.lit(kind).alias("type"), F.filter(hits, lambda x: x.isNotNull()).alias("hits"))

    types = list(dict.fromkeys(t for t, _, _ in [*signals, *structural]))
    total = lambda x: F.aggregate(x["hits"], F.lit(0), lambda a, h: a + h["w"])
    names = lambda x: F.array_join(F.transform(x["hits"], lambda h: h["term"]), ", ")
    return F.transform(F.array(*map(of, types)), lambda x: F.struct(x["type"].alias("type"), total(x).alias("score"), names(x).alias("matched")))


def score_types(texts: DataFrame, signals: list[tuple[str, str, int]], structural: list[tuple[str, str, int]] = ()) -> DataFrame:
    """(text_id, type, score, matched): one row for each text and type."""
    return texts.select("text_id", F.explode(type_scores(F.col("text"), signals, structural)).alias("x")).select("text_id", "x.*")


def heaviest(scores: Column, least: int) -> Column:
    """(type, score, matched, confident) of the heaviest of ``type_scores``, first by name on a tie; sure if heavy enough and ahead of the next."""
    order = F.array_sort(F.transform(scores, lambda x: F.struct((-x["score"]).alias("k"), x["type"].alias("type"), x["score"].alias("score"), x["matched"].alias("matched"))))
    top, second = order[0], F.try_element_at(order, F.lit(2))
    sure = (top["score"] >= least) & (second.isNull() | (top["score"] > second["score"]))
    return F.struct(top["type"].alias("type"), top["score"].alias("score"), top["matched"].alias("matched"), sure.alias("confident"))


def classify(texts: DataFrame, signals: list[tuple[str, str, int]], least: int = 2, structural: list[tuple[str, str, int]] = ()) -> DataFrame:
    """(text_id, type, score, matched, confident): the heaviest type of each text, decided in its row."""
    return texts.select("text_id", heaviest(type_scores(F.col("text"), signals, structural), least).alias("x")).select("text_id", "x.*")
