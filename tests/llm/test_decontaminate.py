import hashlib
import random
import re

import duckdb

from corpusloom.llm import decontaminate as d


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def ws(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def wins(bench, size=10):
    out = {}
    for i, t in bench:
        w = ws(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[k : k + size]), set()).add(i)
    return out


def brute(docs, bench):
    out, all_wins = [], wins(bench)
    for i, t in docs:
        w, hit, items = ws(t), set(), set()
        for win, of in all_wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items |= of
        items.discard(None)
        out.append((i, len(w), len(hit), sorted(map(str, items))))
    return sorted(out, key=str)


def fixture():
    r = random.Random(3)
    vocab = ["the", "of", "É", "été", "a1", "ß", *[f"w{i}" for i in range(30)]]
    bench = [(i, " ".join(r.choices(vocab, k=r.choice([1, 2, 9, 10, 14, 30])))) for i in range(12)]
    bench += [(20, None), (21, "... "), (22, "of"), (None, "the the the"), (0, bench[0][1]), (23, bench[4][1])]
    docs = []
    for i in range(60):
        parts = r.choices(vocab, k=r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(parts))
            parts[at:at] = ws(r.choice(bench)[1])
        docs.append((i, "".join(w.upper() + r.choice([" ", "-", "\n", "!_"]) if w.isascii() else w + " " for w in parts)))
    docs += [(70, None), (71, ""), (None, "of the the the"), (5, "of"), (5, "of"), (5, "other"), (72, "of the " * 20_000)]
    return docs, bench


def test_against_brute_force(spark):
    docs, bench = fixture()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, dk int, n_hit string")
    bf = spark.createDataFrame([(i, t, 2) for i, t in bench], "item_id long, text string, doc_id int")
    got = d.contamination(df, bf)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()], key=str) == brute(docs, bench)
    clean = d.decontaminated(df, bf)
    assert clean.columns == df.columns
    hit = [x[0] for x in brute(docs, bench) if x[2] == 0]
    assert sorted([r.doc_id for r in clean.collect()], key=str) == sorted(hit, key=str)


def test_proximity(spark):
    bench = [(1, "aa bb cc dd"), (2, "zz")]
    docs = [(1, "aa x bb cc y dd"), (2, "dd aa bb cc"), (3, "aa " + "x " * 30 + "bb cc dd"), (4, "zz zz"), (5, "aa bb cc dd")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bf = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, " ".join(r.phrase)) for r in d.proximity_matches(df, bf, slack=3).collect()}
    # every term occurs four times: the rarest two are the first two
    assert {x for x in got if x[1] != "zz"} == {(1, "aa bb cc dd"), (2, "aa bb cc dd"), (5, "aa bb cc dd")}
    assert {x[0] for x in got if x[1] == "zz"} == {4}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bf = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert d.contamination(df.where("false"), bf).count() == 0
    assert [tuple(r) for r in d.contamination(df, bf.where("false")).collect()] == [(1, 2, 0, [])]


def test_sql_against_brute_force(spark):
    docs, bench = fixture()
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", bench)
    got = [(r[0], r[1], r[2], r[3], r[4]) for r in con.sql(d.OP10_SQL).fetchall()]
    want = [(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest()) for i, n, h, x in brute(docs, bench)]
    assert sorted(got, key=str) == sorted(want, key=str)
