"""Language routes, model inventory and history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.values import LANGS
from corpusloom.operators.layout import ranked

# Files of a directed pair.
PAIR_FILES = ("encoder.onnx", "decoder.onnx", "source.spm.tsv", "vocab.tsv", "config.json")

# Directed pairs, in order, and the published models they are made from.
PAIR_MODELS = (
    ("en", "ko", "Helsinki-NLP/opus-mt-tc-big-en-ko"), ("ko", "en", "Helsinki-NLP/opus-mt-ko-en"), ("en", "ja", "Helsinki-NLP/opus-mt-en-jap"),
    ("ja", "en", "Helsinki-NLP/opus-mt-ja-en"), ("en", "zh", "Helsinki-NLP/opus-mt-en-zh"), ("zh", "en", "Helsinki-NLP/opus-mt-zh-en"),
)


def languages(spark: SparkSession) -> DataFrame:
    rows = [(i, k, e, n, u) for i, (k, (e, n, u)) in enumerate(LANGS.items())]
    return spark.createDataFrame(rows, "rank int, code string, english_name string, native_name string, user_facing boolean")


def directed_pairs(langs: DataFrame) -> DataFrame:
    a, b = langs.select(F.col("code").alias("src")), langs.select(F.col("code").alias("tgt"))
    return a.join(b, F.col("src") != F.col("tgt")).withColumn("pair", F.concat_ws("-", "src", "tgt"))  # a few fixed languages


def pair_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PAIR_MODELS)], "rank int, src string, tgt string, model string")


def routes(pairs: DataFrame) -> DataFrame:
    """From pairs (src, tgt) that are there: every route, direct where possible, else over English."""
    one = pairs.select("src", "tgt", F.lit("direct").alias("route"))
    first = pairs.where("tgt = 'en'").select("src", F.col("tgt").alias("via"))
    second = pairs.where("src = 'en'").select(F.col("src").alias("via"), "tgt")
    two = first.join(second, "via").where("src <> tgt").select("src", "tgt", F.lit("pivot").alias("route"))
    return one.unionAll(two.join(pairs, ["src", "tgt"], "left_anti"))


def required_files(langs: DataFrame) -> DataFrame:
    pairs = directed_pairs(langs.where("user_facing"))
    files = pairs.withColumn("file", F.explode(F.array(*map(F.lit, PAIR_FILES))))
    return files.select("src", "tgt", "pair", F.concat_ws("/", F.lit("mt"), "pair", "file").alias("path"))


def existing(paths: DataFrame, present: DataFrame) -> DataFrame:
    """The paths (path) that are among those present."""
    return paths.join(present.select("path").distinct(), "path", "left_semi")


def missing_files(required: DataFrame, present: DataFrame) -> DataFrame:
    """Absent files of pairs that touch English."""
    return required.where("src = 'en' or tgt = 'en'").join(present, "path", "left_anti").select("pair", "path")


def available_pairs(required: DataFrame, present: DataFrame) -> DataFrame:
    have = required.join(present.withColumn("there", F.lit(True)), "path", "left")
    return have.groupBy("pair").agg(F.every(F.coalesce("there", F.lit(False))).alias("available"))


def decoded_history(rows: DataFrame) -> DataFrame:
    """Nulls and unknown codes become the defaults of the store."""
    known = list(LANGS)
    lang = lambda c, d: F.when(F.col(c).isin(known), F.col(c)).otherwise(d)
    kind = F.upper(F.coalesce("kind", F.lit("")))
    return rows.select(
        "id", F.when(kind.isin("IMAGE", "CAMERA", "PDF", "TEXT"), kind).otherwise("IMAGE").alias("kind"), lang("source_lang", "en").alias("source_lang"), lang("target_lang", "zh").alias("target_lang"),
        F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("translated_text", F.lit("")).alias("translated_text"), "image_path", "created_at",
    )


def recent(rows: DataFrame, limit: int = 200) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def appended(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows and new with the next ids, in the order of created_at."""
    last = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = ranked(new, "id", F.col("created_at"), F.col("source_text")).crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("id")).drop("last")  # last is one row
    return rows.unionByName(numbered.select(*rows.columns))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_anti")
