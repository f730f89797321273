import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import mixing
from corpusloom.session import durable
from tests.llm import test_decontaminate, test_similar, test_tokens

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(durable(stage(spark, kept[-1], SF), "test-stage"))
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = [sorted(map(tuple, k.select("doc_id", "text", "source").collect())) for k in kept[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    in_, out = ({r[0] for r in x} for x in rows[:2])
    judged = [(i in out) == labels[i] for i in in_ if i in labels]
    assert out < in_ and sum(judged) >= 0.95 * len(judged)
    least = {r[0]: r[0] for r in rows[1]}  # five-word shingles, a similarity of 0.8 or more

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in test_similar.pairs([r[:2] for r in rows[1]]):
        a, b = sorted((find(rows[1][i][0]), find(rows[1][j][0])))
        least[b] = a
    assert [r[0] for r in rows[2]] == sorted({find(i) for i in least})
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [x[0] for x in test_decontaminate.brute([r[:2] for r in rows[2]], bench) if x[2] == 0]
    assert [r[0] for r in rows[3]] == sorted(clean) and len(clean) < len(rows[2])
    times = {r.doc_id: r.copies for r in mixing.planned(kept[3]).collect()}
    assert Counter(r[0] for r in rows[4]) == Counter({i: n for i, n in times.items() if n})
    assert max(times.values()) <= 3
    assert sorted(map(tuple, kept[5].collect())) == sorted(test_tokens.brute([r[:2] for r in rows[4]]))


def test_run_and_sizes(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert got.count() > 0


def test_mixing_targets_against_resharing(spark):
    import random

    r = random.Random(6)
    for n in (1, 2, 5, 30):
        size = {f"s{i}" if i else None: r.choice([0, 1, 10, 1000, r.randint(0, 10**6)]) for i in range(n)}
        order = sorted(size, key=lambda s: (s is None, s))
        w = {s: i % 3 + 1 for i, s in enumerate(order)}
        target, full, left = dict.fromkeys(size, 0.0), set(), sum(size.values())
        while left > 1e-9 and len(full) < n:
            every = sum(w[s] for s in size if s not in full)
            share = {s: left * w[s] / every for s in size if s not in full}
            left = 0
            for s, x in share.items():
                target[s] += x
                if target[s] >= 3 * size[s]:
                    left += target[s] - 3 * size[s]
                    target[s] = 3.0 * size[s]
                    full.add(s)
        df = spark.createDataFrame(list(size.items()), "source string, size long")
        for few in (mixing.ONE_TASK_SOURCES, 0):  # 0: ranked by a distributed sort, the level in rounds
            got = {x.source: x.target for x in mixing.source_targets(df, in_one_task=few).collect()}
            assert got.keys() == target.keys() and all(abs(got[s] - target[s]) <= 1e-6 * max(1, target[s]) for s in size)


def test_mix_edges(spark):
    rows = [(1, "a b", None, 1), (1, "a b", None, 1), (2, None, "x", 1), (None, "", "y", 1), (3, "w " * 90_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.planned(df).collect()
    assert len(got) == 5 and {r.doc_id: r.size for r in got} == {1: 2, 2: 0, None: 0, 3: 90_000}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or "")) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.planned(df.repartition(3)).collect()))
    assert mixing.mix(df).columns == df.columns and mixing.mix(df.where("false")).count() == 0


NAMES = ["_id", "_none", "_text_key", "none", "id", "text_key", "row", "score", "_size", "size", "_copies", "copies", "_copy", "_of", "of", "rate", "target", "_dk", "_tk", "dk", "tk", "n_hit", "keeper", "fp"]


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    more = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    now, plain = more, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now, plain = (durable(stage(spark, x, SF), "test-names") for x in (now, plain))
        assert now.columns == more.columns
        rows = now.collect()
        assert all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in NAMES)
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())
    assert rows
    assert sorted(map(tuple, corpus_pipeline.write_ids(spark, now, SF).collect())) == sorted(map(tuple, corpus_pipeline.write_ids(spark, plain, SF).collect()))


def test_stages_of_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0
