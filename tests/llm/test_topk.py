import math
import random

import pytest

from corpusloom.llm import topk


def brute(rows, k, ids):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i in ids}):
        v = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q and len(c) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # one common vector: many ties
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [float("nan")] * 6), (None, [0.1] * 6), (60, [0.2] * 6), (7, rows[7][1]), (504, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(5)
    for k, block in ((10, 4096), (3, 2), (1000, 4)):
        got = topk.top_k(df, topk.F.col("vec_id") % 60 == 0, k=k, query_block=block).collect()
        assert sorted(map(tuple, got)) == brute(rows, k, set(range(0, 600, 60)))


def test_large_components(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) * 2.0 ** r.choice([0, 30, 41]) for _ in range(2)]) for i in range(1, 60)]
    rows += [(100, [2.0**41, 0.0]), (101, [0.0, -(2.0**41)]), (0, [1.0, 1.0])]
    schema = "vec_id long, embedding array<double>"
    got = topk.top_k(spark.createDataFrame(rows, schema), topk.F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, {0})
    for large in (2.0**45, 2.0**60):  # a score, or a component, that cannot be held
        with pytest.raises(Exception, match="too large"):
            topk.top_k(spark.createDataFrame([(0, [large]), (1, [large])], schema), topk.F.col("vec_id") == 0).collect()


def test_vectors_of_several_lengths(spark):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(r.choice([0, 1, 2, 5]))]) for i in range(200)] + [(400, [0.5] * 9)]
    df = spark.createDataFrame([(*x, x[0]) for x in rows], "vec_id long, embedding array<double>, query_id long").repartition(3)
    got = topk.top_k(df, topk.F.col("vec_id") % 10 == 0, query_block=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, set(range(0, 500, 10)))


def test_empty(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(df.where("false"), topk.F.lit(True)).count() == 0
    assert topk.top_k(df, topk.F.lit(True)).count() == 0
