import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from corpusloom.llm import suffix_tree as m


def words(t):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def base(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in rows]


def close(a, b):
    return len(a) == len(b) and all(x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(sorted(a, key=str), sorted(b, key=str), strict=True))


def rows():
    r = random.Random(1)
    vocab = ["the", "The", "É", "été", "a", "b\x00", *[f"w{i}x" for i in range(300)]]
    out = [(i, r.choice([" ", "\n", "\t\x0b"]).join(r.choices(vocab, k=r.randint(0, 50)))) for i in range(200)]
    return [*out, (300, None), (301, ""), (None, "the the"), (5, "a b"), (5, "a b"), (302, "the w1x " * 30_000)]


def test_base_score(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows()], "doc_id long, text string, row int, score string")
    held = "crc32(cast(doc_id as string)) % 5 = 1"
    for hot in (m.HOT_WORDS, 3):
        got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in m.scored(df, m.F.expr(held), hot_words=hot).collect()]
        assert close(got, base(rows()))


def brute(tree_contexts, text):
    """Longest kept suffix by definition, without the automaton."""
    t = m.Tree(tree_contexts)
    kept = dict(_kept(tree_contexts))
    used = sorted(tree_contexts[b""])
    total, at = 0.0, 0
    for at, x in enumerate(text):
        c = text[max(0, at - m.DEPTH) : at]
        while c not in kept:
            c = c[1:]
        p = kept[c]
        total += math.log10(p[used.index(x)] if x in used else p[-1] / (256 - len(used)))
    assert t.kept == len(kept)
    return total


def _kept(contexts, smooth=m.SMOOTH, gain=m.MIN_GAIN):
    root = contexts[b""]
    used, n = sorted(root), sum(root.values())
    kept = {b"": np.array([*((root[x] + 0.5) / (n + 128) for x in used), 0.5 * (256 - len(used)) / (n + 128)])}
    for c in sorted((c for c in contexts if c), key=len):
        s = c[1:]
        while s not in kept:
            s = s[1:]
        k, parent = np.array([*(contexts[c].get(x, 0) for x in used), 0]), kept[s]
        if sum(v * math.log(v / k.sum() / p) for v, p in zip(k, parent) if v) >= gain:
            kept[c] = (k + smooth * parent) / (k.sum() + smooth)
    return kept


def test_tree_against_brute_force(spark):
    r = random.Random(7)
    texts = [" ".join(r.choices(["banana", "bandana", "cab", "é", "x"], k=r.randint(0, 200))) for _ in range(60)]
    want: dict[bytes, Counter] = {}
    for t in texts:
        s = m.symbols(m.tokens(t))
        for i, x in enumerate(s):
            for d in range(min(i, m.DEPTH) + 1):
                want.setdefault(s[i - d : i], Counter())[x] += 1
    counts = m.gathered(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    got = m.contexts_of(counts, p_min=0.001)
    n = sum(want[b""].values())
    assert got == {c: dict(k) for c, k in want.items() if sum(k.values()) >= max(2.0, 0.001 * n)}
    tree = m.Tree(got)
    assert tree.kept > 20
    tests = [m.symbols(m.tokens(t)) for t in [*texts[:8], "", "zebra banana", "cab " * 500]]
    assert np.allclose(tree.scores(tests), [brute(got, t) for t in tests], rtol=1e-5)
    probabilities = 10.0 ** tree.logs.reshape(-1, tree.width).astype(float)
    assert np.allclose(probabilities[:, :-1].sum(1) + probabilities[:, -1] * (257 - tree.width), 1, atol=1e-4)


def test_tree_in_pieces_against_tree_in_memory(spark):
    r = random.Random(11)
    texts = [" ".join(r.choices(["banana", "bandana", "cab", "é", "x"], k=r.randint(0, 200))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (70, "zebra banana \x07"), (71, None)], "doc_id long, text string")
    tree = m.Tree(m.contexts_of(m.gathered(docs.where("doc_id < 60"))))
    for piece in (m.PIECE, 5):
        assert (m.kept_pieces(m.gathered(docs.where("doc_id < 60")), piece)[0] > 1) == (piece == 5)
        got = {x.doc_id: x.score for x in m.scored(docs, m.F.expr("doc_id >= 60"), piece=piece).collect()}
        want = tree.scores([m.symbols(m.tokens(x.text)) for x in docs.orderBy("doc_id").collect()])
        assert np.allclose([got[i] for i in sorted(got)], want, rtol=1e-5)


def test_kept_contexts_do_not_fall_out_as_the_corpus_grows(spark):
    rare = "qzxj kvwq"
    few = [(i, rare) for i in range(6)]
    many = [*few, *((i, "the common words of a long text " * 400) for i in range(10, 210))]
    scores = []
    for rows in (few, many):
        df = spark.createDataFrame([*rows, (-1, rare)], "doc_id long, text string")
        scores += [x.score for x in m.scored(df, m.F.expr("doc_id < 0")).where("doc_id < 0").collect()]
    assert scores[1] > 3 * scores[0]  # both are negative: rare contexts are still there beside 2.5 MB of other text


def test_empty(spark):
    assert m.scored(spark.createDataFrame([], "doc_id long, text string"), m.F.lit(False)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = m.op5_suffix_tree(spark, sf).collect()
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert close([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], base(docs))
    # On held-out texts the contexts must be worth much more than symbol frequencies are.
    texts = dict(docs)
    train = Counter(b"".join(m.symbols(m.tokens(texts[r.doc_id])) for r in got if not r.held_out))
    flat = m.Tree({b"": dict(train)})
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.6 * flat.scores([m.symbols(m.tokens(texts[r.doc_id])) for r in held]).sum()
