import collections
import hashlib
import random
import re
import zlib

import duckdb

from corpusloom.llm import boosting, pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    t, out, dig = t or "", [], lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(dig(m[0])) <= 19 and luhn(dig(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(dig(m[0])) <= 15]
    return sorted(out)


def brute(rows):
    out = []
    for i, t in rows:
        b = base(t)
        out.append((i, *[sum(x[3] == k for x in b) for k in pii.BASE], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in b).encode()).hexdigest()))
    return sorted(out, key=str)


def test_base_spans(spark):
    r = random.Random(4)
    bits = ["a.b@c", "@", "x@y.zz", ".", "-", "_", "+1", "+", " ", "(555)", "4111111111111111", "4111 1111-1111 1111", "10.0.0.1", "256.1.1.1", "001.002.0255.3", "99", "é", "\U0001f600", "\n", "", "abc", "5"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 30)))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "a@b.cc"), (7, "a@b.cc"), (7, "a@b.cc"), (502, "1" * 100_000), (503, "x" * 50_000 + "@"), (504, "+1 (017) 555-7713 " * 3_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, added string, email int")
    got = pii.personal(df).collect()
    have = []
    for g in got:
        b = sorted((x.s, x.rank, x.e, x.kind) for k in pii.BASE for x in g[k])
        have.append((g.doc_id, *[len(g[k]) for k in pii.BASE], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in b).encode()).hexdigest()))
    assert sorted(have, key=str) == brute(rows)


def test_added_spans(spark):
    rows = [(i, f"call +1 ({i:03}) 555-{1000 + i} or mail u{i}@mail.example.com") for i in range(200)]
    rows += [(i, f"order {4111111111111112 + 10 * i} of 300.1.1.{i}") for i in range(200, 400)]
    rows += [(900, "please call (555) 123-4567 today"), (901, "order 1234567890123456")]
    got = {r.doc_id: r for r in pii.personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[400][1][x.s : x.e] for x in got[900].added] == ["(555) 123-4567"]
    assert got[901].added == [] and all(got[i].added == [] for i in range(400))


def bits(kind, m, before, after):
    d, low = len(re.sub("[^0-9]", "", m)), before.lower()
    flags = [kind == "contact", kind == "address", kind == "account", "@" in m, m.startswith("+"), bool(re.search(r"[()\[\]]", m)), bool(re.search(r"[\x20-]", m)), ":" in m, d >= 8, d >= 12, d >= 16,
             len(re.findall("[0-9]+", m)) >= 4, bool(re.search("[A-Za-z]{2,}$", m)), bool(re.search(pii.PERSONAL, low)), bool(re.search(pii.OTHER, low)), bool(re.search("[A-Za-z0-9_]$", low) or re.match("[A-Za-z0-9_]", after))]
    return sum(1 << i for i, f in enumerate(flags) if f)


def all_spans(rows):
    """The spans column of each row by brute force: candidates, labels, the trees of the training rows and their threshold."""
    tried = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found, counts = [], []
    for i, t in rows:
        t = t or ""
        good, cands = base(t), []
        every = [(m.start(), m.end()) for p in tried.values() for m in re.finditer(p, t)]
        for k, p in pii.LOOSE.items():
            for m in re.finditer(p.replace("(?:\\G|(?<![a-z0-9._%+-]))", ""), t):
                s, e = m.span()
                label = 1 if any(s < y and x < e for x, _, y, _ in good) else 0 if any((min(e, y) - max(s, x)) * 10 >= (e - s) * 9 for x, y in every) else None
                cands.append((s, pii.RANKS[k], e, k, bits(k, m[0], t[max(0, s - pii.CONTEXT) : s], t[e : e + 1]), label))
        found.append((i, good, cands))
        counts += [(zlib.crc32(str(i).encode()) % 5 == 0, c[4], c[5]) for c in cands if c[5] is not None]
    fit = collections.Counter((b, y) for out, b, y in counts if not out)
    start, trees = boosting.boosted([(*k, n) for k, n in fit.items()], pii.FEATURES)
    held = collections.Counter((b, y) for out, b, y in counts if out)
    least = boosting.threshold([(*k, n) for k, n in held.items()], start, trees, pii.PRECISION)
    out = {}
    for i, good, cands in found:
        more = [c[:4] for c in cands if c[5] != 1 and boosting.score_of(c[4], start, trees) >= least]
        out[i] = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(good + more))
    return out


def test_spans_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    rows = [(i, f"call +1 ({i:03}) 555-{1000 + i} or mail u{i}@mail.example.com, host 10.1.{i % 256}.7") for i in range(300)]
    rows += [(i, f"order {4111111111111112 + 10 * i} of 300.1.1.{i}") for i in range(300, 500)]
    more = ["mail jo [at] ex (dot) com", "write to ann at ex dot org", "host 2001:db8:0:1:2:3:4:5 up", "fe80::1:2", "iban DE89 3704 0044 0532 0130 00 now", "(555) 123-4567", "order 12345678", "10.0.0.1.5", "a:b", "version 1.2.3.4", "x@y"]
    rows += [(i, " ; ".join(r.choices(more, k=r.randint(1, 6)))) for i in range(600, 760)] + [(800, None), (801, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op9_pii(spark, str(tmp_path)).collect()
    want = all_spans(rows)
    assert {x.doc_id: x.spans for x in got} == want
    assert sum(x.n_added for x in got) > 0
    texts = dict(rows)
    added = [texts[x.doc_id][int(s[1]) : int(s[2])] for x in got for s in (y.split(":") for y in x.spans.split(",") if y) if s[0] in pii.LOOSE]
    assert {"jo [at] ex (dot) com", "ann at ex dot org"} <= {*added} and "12345678" not in added


def test_empty(spark):
    assert pii.personal(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boosting_and_threshold():
    xor = [(b, (b & 1) ^ (b >> 1 & 1), 50) for b in range(8)]
    start, trees = boosting.boosted(xor, 3)
    assert all((boosting.score_of(b, start, trees) > 0) == bool(y) for b, y, _ in xor)
    at = boosting.threshold(xor, start, trees, 0.99)
    assert all((boosting.score_of(b, start, trees) >= at) == bool(y) for b, y, _ in xor)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert sorted((tuple(r)[:6] for r in pii.op9_pii(spark, sf).collect()), key=str) == brute(rows)
