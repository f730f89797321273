"""Preparation of sentence pairs: sampling, rules, decontamination, keep-first, splits, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions import values as v
from corpusloom.session import durable

LATIN = r"[A-Za-z]+"


def sampling_rate(cap: Column, pairs: Column) -> Column:
    return F.when(cap.isNull() | (pairs == 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), cap / F.when(pairs != 0, pairs)))


def keep_by_rate(key: Column, rate: Column, seed: int) -> Column:
    """A hash of the raw key decides; a rate of 1 keeps all."""
    return (rate >= 1) | (F.pmod(t.h60(F.concat(F.lit(f"{seed}:"), key)), F.lit(1_000_000)) < rate * 1_000_000)


def copied_length(en: Column, ko: Column) -> Column:
    """Letters of Latin words in ko that en has too, each occurrence counted."""
    have = F.transform(F.regexp_extract_all(en, F.lit(LATIN), F.lit(0)), lambda w: F.lower(w))
    words = F.regexp_extract_all(ko, F.lit(LATIN), F.lit(0))
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.when(F.array_contains(have, F.lower(w)), F.length(w)).otherwise(0))


def check_pair(en: Column, ko: Column) -> Column:
    """The first rule that a normalised pair breaks, cheapest first; null if none."""
    n, m = F.length(en), F.length(ko)
    a, b = t.profile(en), t.profile(ko)
    either = lambda p: en.rlike(p) | ko.rlike(p)
    left = b["letters"] - copied_length(en, ko)
    return (
        F.when((n < v.MIN_CHARS) | (m < v.MIN_CHARS), "empty")
        .when(en == ko, "identical")
        .when((n > v.MAX_CHARS_EN) | (m > v.MAX_CHARS_KO), "too_long")
        .when(either(v.URL), "url")
        .when(either(v.ENTITY), "markup")
        .when(either(v.BOILERPLATE), "boilerplate")
        .when((n >= v.RATIO_MIN_LEN) & (m >= v.RATIO_MIN_LEN) & ~(F.try_divide(n, m)).between(v.RATIO_MIN, v.RATIO_MAX), "ratio")
        .when((a["letter_share"] < v.MIN_LETTER_SHARE) | (b["letter_share"] < v.MIN_LETTER_SHARE), "not_text")
        .when((b["hangul"] == 0) | ((left > 0) & (t.share(b["hangul"], left) < v.MIN_HANGUL_SHARE)), "ko_script")
        .when((a["hangul"] > 0) | (a["latin_share"] < v.MIN_LATIN_SHARE), "en_script")
    )


def held_out_flags(rows: DataFrame, keys: dict[str, DataFrame]) -> DataFrame:
    """rows with in_eval_set: a key column is among the distinct keys given for it. One equi-join a column, never an OR."""
    flags = []
    for i, (column, have) in enumerate(keys.items()):
        own = have.select(F.col(have.columns[0]).alias(f"_key{i}")).distinct()
        rows = rows.join(own, rows[column] == own[f"_key{i}"], "left")
        flags.append(f"_key{i}")
    hit = F.lit(False)
    for f in flags:
        hit = hit | F.col(f).isNotNull()
    return rows.withColumn("in_eval_set", hit).drop(*flags)


def keep_first(rows: DataFrame, key: str, *order: Column, where: Column | None = None) -> DataFrame:
    """rows with is_first: the first of its key by order, among those where holds; copies beyond it are False, rows outside null.

    The least order per key is aggregated (map-side first) and joined back, so
    that a key with a third of all rows meets in no window. rows are read twice:
    they should be a table, with a hash for a key that is long.
    """
    mark = F.struct(*order)
    live = rows.withColumn("_mark", F.when(where if where is not None else F.lit(True), mark))
    least = live.where("_mark is not null").groupBy(F.col(key).alias("_of")).agg(F.min("_mark").alias("_least"))
    joined = live.join(least, live[key].eqNullSafe(F.col("_of")), "left")
    return joined.withColumn("is_first", F.when(F.col("_mark").isNotNull(), F.col("_mark") == F.col("_least"))).drop("_mark", "_of", "_least")


def split_of(key: Column, n: Column, dev: int, test: int, seed: int) -> Column:
    """train, dev or test by hash; the rates follow from the number of rows."""
    d, e = F.least(F.lit(0.5), dev / n), F.least(F.lit(0.5), test / n)
    u = F.pmod(t.h60(F.concat(F.lit(f"split:{seed}:"), key)), F.lit(1_000_000)) / 1_000_000
    return F.when(u < d, "dev").when(u < d + e, "test").otherwise("train")


def first_n(rows: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def outcomes(docs: DataFrame, benchmark: DataFrame, max_chars: int = 20_000) -> DataFrame:
    """docs (doc_id, text, source) with one outcome each: empty, too_long, not_text, in_eval_set, duplicate or kept."""
    texts = docs.select("doc_id", "source", t.clean(F.col("text")).alias("text"))
    n = F.length("text")
    shares = t.share(t.count_without(F.col("text"), r"\P{L}+"), F.length(F.replace("text", F.lit(" "), F.lit(""))))
    rule = F.when(n < 1, "empty").when(n > max_chars, "too_long").when(shares < v.MIN_LETTER_SHARE, "not_text")
    rows = durable(texts.select("doc_id", "source", rule.alias("rule"), F.md5(t.squash(F.col("text"))).alias("key")), "outcome-rows")
    held = benchmark.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select(t.clean(F.col("line")).alias("line")).where("line <> ''").distinct()
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select("doc_id", t.clean(F.col("line")).alias("line"))
    hit = lines.join(held, "line", "left_semi").select(F.col("doc_id").alias("_hit")).distinct()
    rows = durable(rows.join(hit, F.col("doc_id") == F.col("_hit"), "left"), "outcome-hits")
    live = F.col("rule").isNull() & F.col("_hit").isNull()
    rank = F.try_to_number(F.regexp_replace("source", "[^0-9]", ""), F.lit("999999")).cast("int")
    rows = keep_first(rows, "key", F.coalesce(rank, F.lit(0)).alias("rank"), F.col("source"), F.col("doc_id"), where=live)
    outcome = F.coalesce("rule", F.when(F.col("_hit").isNotNull(), "in_eval_set").when(~F.col("is_first"), "duplicate"), F.lit("kept"))
    return rows.select("doc_id", "source", outcome.alias("outcome"))


def outcome_report(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"))


OUTCOMES = ("kept", "duplicate", "in_eval_set", "empty", "too_long", "not_text")


def outcome_pivot(tagged: DataFrame) -> DataFrame:
    counts = tagged.groupBy("source").pivot("outcome", list(OUTCOMES)).agg(F.count(F.lit(1)))
    return counts.select("source", *[F.coalesce(o, F.lit(0)).alias(o) for o in OUTCOMES])


def outcome_totals(tagged: DataFrame) -> DataFrame:
    return tagged.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("outcome") == "kept").cast("long")).alias("kept"))
