import random
import zlib

import numpy as np

from corpusloom.llm import labels, quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out_accuracy(spark, query, label, sf=SF):
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = query(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    return np.mean([r.predicted == marks[r.doc_id] for r in held]), max(np.mean([marks[r.doc_id] for r in held]), 1 - np.mean([marks[r.doc_id] for r in held])), got


def test_quality(spark):
    accuracy, majority, got = held_out_accuracy(spark, quality.op4_quality, "quality")
    assert accuracy > 0.97 and accuracy > majority
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def toxic_docs(n, seed=1):
    r = random.Random(seed)
    parts = ["er", "th", "on", "an", "re", "in", "ti", "ou", "ly"]
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 4)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(r.randint(20, 300))]
        y = i % 3 == 0
        if y:
            for _ in range(max(3, len(ws) // 25)):
                ws.insert(r.randint(0, len(ws)), r.choice(["blockhead", "dimwit", "numskull"]))
        out.append((i, " ".join(ws), int(y)))
    return out


def test_toxicity(spark):
    rows = toxic_docs(900)
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t, _ in rows] + [(None, None, "x", 9), (5000, "", "y", 9), (5001, "er th " * 40_000, "y", 9)], "doc_id long, text string, score string, toxic int")
    marks = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, marks).collect()}
    assert len(got) == 903
    held = [(got[i].score >= 0.5) == y for i, _, y in rows if got[i].held_out]
    assert np.mean(held) > 0.93
    assert got[5000].score < 0.5 and got[5001].score < 0.5 and not got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)


def test_toxicity_query(spark):
    accuracy, majority, got = held_out_accuracy(spark, toxicity.op3_toxicity, "toxic", "/root/testdata/sf0.1")
    assert accuracy > majority + 0.02
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_window_lengths_and_scores_by_brute_force(spark):
    import math

    import zstandard

    rows = toxic_docs(300, seed=4)
    common, pairs, weights = toxicity.fitted([t for _, t, _ in rows], [y for _, _, y in rows], {0: 200, 1: 100})
    how = zstandard.ZstdCompressionParameters(compression_level=6, window_log=17, min_match=4, strategy=zstandard.STRATEGY_LAZY2, search_log=6, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    size = lambda content, w: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict((content + common).ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(w))
    scorer = toxicity.Scorer(common, pairs, weights)
    for _, text, _ in rows[:12]:
        ws = text.lower().split()
        d = [[size(o, w) - size(t, w) for t, o in pairs] for w in ((" " + " ".join(ws[i : i + 24]) + " ").encode() for i in range(0, len(ws), 24))]
        assert abs(np.array(d) - scorer.differences(text)).max() <= 1  # a table made beforehand may cost a byte
        m = [sum(x) / len(x) for x in scorer.differences(text).tolist()]
        share = lambda f: sum(map(f, m)) / len(m)
        low = [min(x) for x in scorer.differences(text).tolist()]
        f = [1.0, sum(m) / len(m), math.sqrt(sum((x - sum(m) / len(m)) ** 2 for x in m) / len(m)), *[share(lambda x, s=s: x >= s) for s in (1, 2, 3, 4, 6, 8, 12)], *[share(lambda x, s=s: x <= -s) for s in (1, 2, 3, 4)],
             *[sum(x >= s for x in low) / len(low) for s in (1, 2, 3)], min(max(m), 30) / 30, math.log1p(len(m)) / 10]
        assert abs(1 / (1 + math.exp(-sum(a * b for a, b in zip(f, weights)))) - scorer.scores([text])[0]) < 1e-9
    sizes = {len(x) // 512 for p in pairs for x in p}
    assert max(sizes) - min(sizes) <= 1


def test_repeated_and_long_rows(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in toxic_docs(120)] * 2 + [(9000, "er th on " * 60_000, 1)], "doc_id long, text string, score int")
    marks = spark.createDataFrame([(i, y, y) for i, _, y in toxic_docs(120)], "doc_id long, toxic int, quality int")
    for m in (toxicity, quality):
        got = m.scored(docs, marks).collect()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert len(got) == 241 and all(len(x) == 1 for x in by.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id long, toxic int, quality int")
    for m in (toxicity, quality):
        assert m.scored(docs.where("false"), none).count() == 0
        assert all(abs(r.score - 0.5) < 1e-6 for r in m.scored(docs, none).collect())
        assert all(r.score > 0.5 for r in m.scored(docs, one).collect())
    assert quality.accepted(docs, one).columns == docs.columns


def test_sample_is_bounded_and_balanced(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(2000)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, quality int")
    texts, y, counts = labels.sample(docs, marks, "quality", labels.F.lit(True), 100)
    assert y.count(0) == y.count(1) == 100 and counts == {0: 1800, 1: 200} and len(set(texts)) == 200


def test_sample_of_repeated_ids_and_bytes(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(3000)] + [(i, "x" * 1000) for i in range(2, 400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    texts, y, _ = labels.sample(docs, marks, "quality", labels.F.lit(True), 50)
    assert y.count(0) == y.count(1) == 50 and sum(t.startswith("t") for t in texts) <= 1
    texts, y, counts = labels.sample(docs, marks, "quality", labels.F.lit(True), 50, most_bytes=9_500)
    assert 10 <= y.count(0) <= 11 and 10 <= y.count(1) <= 11 and counts == {0: 199, 1: 200}


def test_gradients():
    r = np.random.default_rng(1)
    m = quality.Model.start()
    x, starts, y, w = r.normal(size=(9, quality.SHAPES + quality.EXTRA)), np.array([0, 2, 3]), np.array([1.0, 0, 1]), np.array([0.5, 1, 2])
    loss = lambda: float((w * np.where(y == 1, -np.log(m.forward(x, starts)[-1]), -np.log(1 - m.forward(x, starts)[-1]))).sum())
    for p, g in zip(m.p, m.gradients(x, starts, y, w), strict=True):
        i = tuple(0 for _ in p.shape)
        p[i] += 1e-5
        up = loss()
        p[i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[i]) < 1e-4
        p[i] += 1e-5
