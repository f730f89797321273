import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from corpusloom.llm import similar


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def pairs(rows):
    """Pairs of rows with a similarity of 0.8 or more."""
    g = [grams(t) for _, t in rows]
    return [(i, j) for i, j in combinations(range(len(rows)), 2) if g[i] == g[j] or len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j])]


def fixture():
    r = random.Random(4)
    rows = []
    for i in range(30):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 60, 200, 600]))]
        rows.append(" ".join(words))
        for _ in range(6):  # chains of edits: near the one before, not the first
            for _ in range(max(1, len(words) // 70)):
                words[r.randrange(len(words))] = "ZZ"
            rows.append(" ".join(words))
    return [*enumerate(rows), (None, rows[0]), (900, None), (901, " ")]


def test_components_against_brute_force(spark):
    rows = fixture()
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs(rows):
        root[find(i)] = find(j)
    want = {}
    for i in range(len(rows)):
        want.setdefault(find(i), []).append(rows[i][0])
    least = {find(i): min(x for x in want[find(i)] if x is not None) for i in range(len(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for most in (similar.CHUNK_GRAMS, 500):  # 500: buckets are cut into chunks
        got = similar.near_duplicates(docs, chunk_grams=most).collect()
        assert sorted((str(x.doc_id), x.component_id) for x in got) == sorted((str(rows[i][0]), least[find(i)]) for i in range(len(rows)))
        assert {x.doc_id for x in got if x.keeper} == set(least.values())
    assert similar.near_duplicates(docs.where("false")).count() == 0


def test_links_across_components(spark):
    r = random.Random(8)
    sets = {i: sorted(r.sample(range(60), r.randint(20, 60))) for i in range(1, 40)}
    root = {i: i % 7 for i in sets}
    near = {(i, j) for i, j in combinations(sets, 2) if len({*sets[i]} & {*sets[j]}) >= 0.6 * len({*sets[i]} | {*sets[j]})}
    want = {i: i for i in sets}  # components by links across roots, each root being connected

    def find(i):
        while want[i] != i:
            i = want[i]
        return i

    for pairs_ in (near, [(i, j) for i, j in combinations(sets, 2) if root[i] == root[j]]):
        for i, j in pairs_:
            want[find(i)] = find(j)
    met = spark.createDataFrame([(1, i) for i in sets], "key long, set_key long")
    links = spark.createDataFrame([(i, j) for i, j in combinations(sets, 2) if root[i] == root[j]], "u long, v long")
    grams = spark.createDataFrame(list(sets.items()), "set_key long, grams array<long>")
    for most in (10**6, 200):
        got = {(x.v, x.u) for x in similar._across(met, links, grams, 0.6, most).collect()}
        assert got <= near and all(root[i] != root[j] for i, j in got)
        own = {i: i for i in sets}

        def top(i):
            while own[i] != i:
                i = own[i]
            return i

        for i, j in [*got, *((x.v, x.u) for x in links.collect())]:
            own[top(i)] = top(j)
        assert len({top(i) for i in sets}) == len({find(i) for i in sets})


def test_stage_leaves_no_similar_pair(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    assert pairs(kept) == []


def test_sets_meet_by_simhash(spark):
    texts = sorted({t for _, t in fixture() if t and t.split()} | {"a b c d e f g h", "a b c d e f g h i"})
    hashes = [similar.shingles(t) for t in texts]
    prints = [similar.fingerprint(h) for h in hashes]
    assert {len(p) * 8 for p in prints} == {128 * 14, 224 * 14}
    bits = [np.unpackbits(np.frombuffer(p, np.uint8)) for p in prints]
    for h, x in zip(hashes, bits, strict=True):  # a bit is the majority of the shingles' bits
        each = np.array([np.unpackbits(np.frombuffer(similar.fingerprint(h[i : i + 1]), np.uint8))[: len(x)] for i in range(len(h))])
        assert (x == (2 * each.sum(0, dtype=int) > len(h))).all()
    near = {i: set() for i in range(len(texts))}
    values = [[x[at : at + 14].tobytes() for at in range(0, len(x), 14)] for x in bits]
    for i, j in combinations(range(len(texts)), 2):
        if (bits[i][:192] != bits[j][:192]).sum() <= 60 and any(a == b for a, b in zip(values[i], values[j])):
            near[i].add(j)
            near[j].add(i)
    assert all(j in near[i] for i, j in pairs(list(enumerate(texts))))  # SimHash meets every similar pair here
    want = set()  # chains of near sets within each bucket
    for t in range(224):
        buckets = {}
        for i, v in enumerate(values):
            if t < len(v):
                buckets.setdefault(v[t], set()).add(i)
        for left in buckets.values():
            while left:
                todo = [left.pop()]
                group = set(todo)
                while todo:
                    found = near[todo.pop()] & left
                    left -= found
                    group |= found
                    todo += found
                if len(group) > 1:
                    want.add(frozenset(group))
    df = spark.createDataFrame([*enumerate(map(bytearray, prints)), (-1, bytearray())], "set_key long, print binary").repartition(3)
    for most in (similar.ALL_PAIRS, 1):  # 1: every bucket goes the way of large ones
        got = {}
        for r in similar.groups(df, most).collect():
            got.setdefault((r.key, r.n), set()).add(r.set_key)
        assert all(n == len(g) for (_, n), g in got.items())
        assert {frozenset(g) for g in got.values()} == want and len(got) == len(want)


def test_each_set_is_in_one_group_of_what_is_left(spark, monkeypatch):
    r = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):  # one large group of near copies, many of which are not similar to each other
        words = list(base)
        for at in r.sample(range(150), r.randint(1, 7)):
            words[at] = f"x{i}_{at}" if r.random() < 0.5 else f"y{at}"
        rows.append((i, " ".join(words)))
    least = {i: i for i, _ in rows}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in pairs(rows):
        a, b = sorted((find(i), find(j)))
        least[b] = a
    seen, across = [], similar._across

    def watched(met, *more):
        seen.append([tuple(x) for x in met.select("key", "set_key").collect()])
        return across(met, *more)

    monkeypatch.setattr(similar, "_across", watched)
    got = {x.doc_id: x.component_id for x in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: find(i) for i in least} and 1 < len(set(got.values())) < len(rows)
    assert len(seen) == 1 and len(seen[0]) == len({k for _, k in seen[0]}) > 20  # else as often as buckets that it shares


def test_sets_that_may_have_links(spark):
    r = random.Random(3)
    sets = {i: sorted(r.sample(range(i % 5 * 40, i % 5 * 40 + 60), r.randint(5, 50))) for i in range(1, 60)}
    sets |= {100: list(range(1000, 1040)), 101: list(range(1000, 1040)) + [5000], 102: [1 << 62, -1, 3000], 103: list(range(2000, 2010)), 104: list(range(2000, 2030))}
    roots = {i: i % 10 + 1 for i in sets if i < 100 and i % 3 == 0}
    root = {i: roots.get(i, i) for i in sets}
    want, steps = set(sets), []
    for _ in range(similar.ROUNDS):
        held = {}
        for i in want:
            for g in sets[i]:
                held.setdefault(g, set()).add(root[i])
        want = {i for i in want if sum(len(held[g]) > 1 for g in sets[i]) / len(sets[i]) >= 0.8}
        steps.append(len(want))
    grams = spark.createDataFrame(list(sets.items()), "set_key long, grams array<long>").repartition(3)
    got = similar._possible(grams, spark.createDataFrame(list(roots.items()), "set_key long, root long"), 0.8)
    assert sorted(x.set_key for x in got.collect()) == sorted(want) and {100, 101} <= want and 102 not in want and len(sets) > steps[0] > steps[1]
    similar_ = {x for i, j in combinations(sets, 2) if root[i] != root[j] and len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]}) for x in (i, j)}
    assert {100, 101} <= similar_ <= want and {103, 104}.isdisjoint(want)  # 104 goes first, then 103
