"""Grouped metrics. BLEU and chrF++ follow the published definitions (Papineni et al. 2002; Popovic 2017); no other scorer was at hand to compare with."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def agreement_rate(a: Column, b: Column) -> Column:
    return F.avg(F.when(a.eqNullSafe(b), 1.0).otherwise(0.0))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.greatest(F.sum(w), F.lit(1.0))


def _overlap(h: list, r: list) -> int:
    return sum((Counter(h) & Counter(r)).values())


def _grams(x, n: int) -> list:
    return [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]


def _statistics(hyp: str, ref: str) -> list[int]:
    """For words 1-4: matches, hypothesis grams, reference grams; then for characters 1-6 without spaces."""
    h, r = (hyp or "").split(), (ref or "").split()
    a, b = "".join(h), "".join(r)
    out = []
    for x, y, most in ((h, r, 4), (a, b, 6)):
        for n in range(1, most + 1):
            g, k = _grams(x, n), _grams(y, n)
            out += [_overlap(g, k), len(g), len(k)]
    return out


def corpus_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, hyp, ref) to bleu and chrf of each group: n-gram counts per row, added up, then the closed forms."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def counts(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([_statistics(a, b) for a, b in zip(h, r, strict=True)])

    each = rows.select(*by, counts("hyp", "ref").alias("c"))
    sums = each.groupBy(*by).agg(*[F.sum(F.col("c")[i]).cast("double").alias(f"_{i}") for i in range(30)], F.count(F.lit(1)).alias("n"))
    p = lambda i: F.try_divide(F.col(f"_{i}"), F.col(f"_{i + 1}"))
    logs = sum((F.log(F.when(F.col(f"_{i}") > 0, p(i))) for i in (3, 6, 9)), F.log(F.when(F.col("_0") > 0, p(0)))) / 4
    brief = F.least(F.lit(0.0), 1 - F.try_divide(F.col("_2"), F.col("_1")))
    bleu = F.coalesce(100 * F.exp(logs + brief), F.lit(0.0))

    def f2(i: int) -> Column:
        precision, recall = F.coalesce(p(i), F.lit(0.0)), F.coalesce(F.try_divide(F.col(f"_{i}"), F.col(f"_{i + 2}")), F.lit(0.0))
        return F.coalesce(F.try_divide(5 * precision * recall, 4 * precision + recall), F.lit(0.0))

    parts = [f2(i) for i in (*range(12, 30, 3), 0, 3)]
    return sums.select(*by, F.bround(bleu, 2).alias("bleu"), F.bround(100 * sum(parts[1:], parts[0]) / len(parts), 2).alias("chrf"), "n")


def score_pivot(rows: DataFrame, key: str, model: str, score: str, models: list[str]) -> DataFrame:
    return rows.groupBy(key).pivot(model, models).agg(F.first(score))
