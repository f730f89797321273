"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base spans (emails, addresses, card and phone numbers that pass their checks)
always count. High-recall generators propose spans, which may overlap: contacts
(also spelt out), network addresses (also IPv6), digit groups of any length and
account numbers. Bits for a candidate's format and for the words around it are
the features of boosted trees; the base checks themselves (Luhn, 255, numbers of
digits) are not among them. The trees learn from this corpus: a candidate that
overlaps a base span is an example of 1, one that a base pattern matched (nine
tenths of it, at least) and its check refused is an example of 0; the others,
which the base cannot judge, are unlabelled. Rows with crc32(doc_id) mod 5 = 0 are
kept out of the fit, and set the score from which on PRECISION of the examples
are 1. Candidates of any kind from that score on are added, but for those that
overlap a base span.

Cases: a null or empty text has no spans; texts are read whole; with no examples
of both kinds nothing is added; null and repeated doc_ids do no harm; an empty
table gives an empty result; other columns are not touched. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.boosting import boosted, score, threshold
from corpusloom.llm.spans import joined, let, matches, tagged, unmarked
from corpusloom.session import durable, table

PRECISION = 0.99
CONTEXT = 32
#: A match cannot begin inside a run of these but where the match before ended; a later start would fail as the run's first does.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
RANKS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "contact": 4, "address": 5, "number": 6, "account": 7}
#: Generators.
LOOSE = {
    "contact": r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++(?:@|\x20?+[\[(]\x20?+at\x20?+[\])]\x20?+|\x20at\x20)[a-z0-9-]++(?:(?:\.|\x20?+[\[(]\x20?+dot\x20?+[\])]\x20?+|\x20dot\x20)[a-z0-9-]++)++",
    "address": r"(?<![0-9A-Fa-f.:])(?:[0-9]++(?:\.[0-9]++){3,}+|(?:[0-9A-Fa-f]{1,4}+:){5,7}+[0-9A-Fa-f]{1,4}+|(?:[0-9A-Fa-f]{1,4}+:){1,7}+(?::[0-9A-Fa-f]{1,4}+){1,7}+)(?![0-9A-Fa-f.:])",
    "number": r"\+?+\(?+[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
PERSONAL = r"mail|contact|correo|courriel|phone|tel|call|fax|mobile|anruf|card|visa|credit|iban|account|pay|konto|carte|tarjeta|\bip\b|host|server|addr"
OTHER = r"version|order|invoice|page|isbn|build|serial|fig|total|item"
FEATURES = 16


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(d: Column) -> Column:
    """The Luhn check of a string of digits."""
    value = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when((F.length(d) - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
    return (F.length(d) > 0) & (total % 10 == 0)


def _card(m: Column) -> Column:
    return let(digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))


def _quad(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


CHECKS = {"email": lambda m: F.lit(True), "ip": _quad, "card": _card, "phone": lambda m: F.length(digits(m)).between(10, 15)}


def _bits(kind: str, x: Column) -> Column:
    """Format and context of a candidate, FEATURES bits."""
    m, before = x["m"], F.lower(x["before"])
    n = F.length(digits(m))
    flags = [
        F.lit(kind == "contact"),
        F.lit(kind == "address"),
        F.lit(kind == "account"),
        F.contains(m, F.lit("@")),
        F.startswith(m, F.lit("+")),
        m.rlike(r"[()\[\]]"),
        m.rlike(r"[\x20-]"),
        F.contains(m, F.lit(":")),
        n >= 8,
        n >= 12,
        n >= 16,
        F.regexp_count(m, F.lit("[0-9]+")) >= 4,
        m.rlike(r"[A-Za-z]{2,}$"),
        before.rlike(PERSONAL),
        before.rlike(OTHER),
        before.rlike(r"[A-Za-z0-9_]$") | x["after"].rlike(r"[A-Za-z0-9_]"),
    ]
    out = F.lit(0)
    for i, f in enumerate(flags):
        out = out + F.when(f, F.lit(1 << i)).otherwise(F.lit(0))
    return out


def _meets(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))


def _covered(x: Column, spans: Column) -> Column:
    """A span of spans takes up nine tenths of x or more."""
    return F.exists(spans, lambda y: (F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"])) * 10 >= (x["e"] - x["s"]) * 9)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, tagged base spans by kind, and candidates (s, e, rank, kind, bits, label), written to the shared folder."""
    df = docs.select("doc_id", unmarked(F.col("text")).alias("_text"))
    df = df.select("doc_id", *[matches(F.col("_text"), p).alias(f"_{k}") for k, p in BASE.items()], *[matches(F.col("_text"), p, CONTEXT).alias(k) for k, p in LOOSE.items()])
    passed = lambda k: F.filter(f"_{k}", lambda x: CHECKS[k](x["m"])).alias(k)
    good = [passed(k) for k in BASE]
    df = df.select("doc_id", *[f"_{k}" for k in BASE], *good, *LOOSE)

    def proposed(k: str) -> Column:
        base, tried = F.concat(*BASE), F.concat(*[f"_{b}" for b in BASE])
        label = lambda x, b, t: F.when(_meets(x, b), F.lit(1)).when(_covered(x, t), F.lit(0))
        one = lambda x, b, t: F.struct(x["s"].alias("s"), F.lit(RANKS[k]).alias("rank"), x["e"].alias("e"), F.lit(k).alias("kind"), _bits(k, x).alias("bits"), label(x, b, t).alias("label"))
        return let(base, lambda b: let(tried, lambda t: F.transform(k, lambda x: one(x, b, t))))

    out = df.select("doc_id", *[tagged(F.col(k), RANKS[k], k).alias(k) for k in BASE], F.concat(*[proposed(k) for k in LOOSE]).alias("candidates"))
    return durable(out, "pii-spans")


def fitted(rows: DataFrame) -> tuple[float, list, float]:
    """Start score, trees and threshold from the labelled candidates of rows."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)), F.lit(1))
    seen = rows.select(fold.alias("fold"), F.explode("candidates").alias("x")).where("x.label is not null")
    counts = seen.groupBy((F.col("fold") == 0).alias("out"), F.col("x.bits").alias("bits"), F.col("x.label").alias("label")).count().collect()
    fit = [(r.bits, r.label, r["count"]) for r in counts if not r.out]
    if len({y for _, y, _ in fit}) < 2:
        return 0.0, [], float("inf")
    start, trees = boosted(fit, FEATURES)
    held = [(r.bits, r.label, r["count"]) for r in counts if r.out]
    return start, trees, threshold(held or fit, start, trees, PRECISION)


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, a column of tagged spans for each base kind, and added: the spans that the trees select, apart from base spans."""
    rows = scanned(docs)
    start, trees, least = fitted(rows)
    chosen = F.filter("candidates", lambda x: ~x["label"].eqNullSafe(F.lit(1)) & (score(x["bits"], start, trees) >= F.lit(least)))
    return rows.select("doc_id", *BASE, F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"))).alias("added"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = personal(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.concat(*BASE)), 256).alias("base_sha256"), joined(F.concat(*BASE, "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
