import random

import xxhash

from corpusloom.llm import simhash


def brute(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    return out


def union(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for g in groups.values():
        least = min((ids[i] for i in g if ids[i] is not None), default=None)
        out |= dict.fromkeys(g, least)
    return [out[i] for i in range(len(ids))]


def fixture():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["É", "ß", "\U0001f600"]
    base = [" ".join(r.choices(words, k=r.choice([1, 2, 3, 40, 400]))) for _ in range(40)]
    near = [" ".join(w if r.random() > 0.01 else "zz" for w in base[i % 40].split()) for i in range(60)]
    texts = [*base, *near, *base[:5], None, "", " \n\t", "A b C", "a B c", "long " * 70_000]
    return texts


def test_fingerprints_and_components(spark):
    texts = fixture()
    ids = [None if i == 3 else i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string")
    want, fps = union(ids, brute(texts)), brute(texts)
    for limit in (2048, 1):  # 1: every bucket goes the way of large ones
        got = {r.text_key: r for r in simhash.near_duplicates(docs, limit).collect()}
        keys = [r.k for r in docs.selectExpr("xxhash64(text) k").collect()]
        for i, k in enumerate(keys):
            assert got[k].fp % 2**64 == fps[i]
            assert got[k].component_id == want[i], (limit, i)


def test_random_prints_in_large_buckets(spark):
    r = random.Random(9)
    seeds = [r.getrandbits(64) for _ in range(20)]
    prints = {simhash._signed(s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6)))) for s in seeds for _ in range(40)}
    prints = sorted(prints)
    want = union(prints, [p % 2**64 for p in prints])
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for limit in (2048, 4):
        roots = {x.u: x.v for x in simhash.components(simhash.links(df, limit)).collect()}
        assert [roots.get(p, p) for p in prints] == want


def test_one_stays_and_empty_table(spark):
    rows = [(1, "a b c d e", 1), (1, "a b c d e", 1), (2, "a b c d e", 2), (None, "q r s t", 3), (None, "q r s t", 3), (7, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keeper int")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d e", 1), (7, None, 4), (None, "q r s t", 3)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
