"""Mixing sources to target weights, with DataFrame functions only.

Tokens (words) are added up per source, each source's repetition rate is its
target over its size, and a document is emitted floor(rate) times plus once
more where a hash-seeded draw falls below the rate's fraction.

Cases: a null or empty text has size 0 and takes nothing; a null source is a
source of its own, last in order; sources whose sizes are all 0 get target 0;
an empty table gives an empty result; repeated rows with the same doc_id share
one draw, so reruns and retries agree; other columns, of any name, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.layout import ranked
from corpusloom.session import durable, sent, table

WORD = r"[^\x20\x09-\x0D]+"
#: Most a source is repeated.
MAX_RATE = 3
#: A table of sources of up to this many rows (about 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Sources that are ranked in one task (about 100 bytes each).
ONE_TASK_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the hash of the id: 52 bits, exact as a double."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_rate: int = MAX_RATE, in_one_task: int = ONE_TASK_SOURCES) -> DataFrame:
    """A row for each source: source, source_size, target.

    sizes has source and size. Weights repeat over the sources in code-point
    order. A target is min(max_rate * source_size, level * weight), where level
    shares out the total; it is the fixed point of resharing what is above the
    caps. Up to `in_one_task` sources are ranked in windows of one task; more (URLs,
    say) by a distributed sort, and the level is found by resharing in rounds.
    """
    per = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    few = per.count() <= in_one_task
    by_source = F.col("source").asc_nulls_last()
    ranks = per.withColumn("rank", F.row_number().over(Window.orderBy(by_source))) if few else ranked(per, "rank", by_source)
    w = F.array(*[F.lit(x) for x in weights])
    per = ranks.withColumn("weight", F.element_at(w, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")).drop("rank")
    per = per.withColumn("cap", F.col("source_size") * max_rate).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = _level_in_windows if few else _level_in_rounds
    return level(per).select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def _level_in_windows(per: DataFrame) -> DataFrame:
    """per with level: that of the first source, by ratio, that its share does not fill."""
    every = Window.partitionBy()
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    open_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    per = per.withColumn("own", left / open_weight)
    return per.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("own"), F.struct("ratio", "own"))).over(every).getField("own"))


def _level_in_rounds(per: DataFrame) -> DataFrame:
    """As in windows: each round shares what is left among the sources that the level of the round before did not fill."""
    per = durable(per, "mix-ranked")
    level, full = 0.0, F.lit(False)
    while True:
        total, caps, weight = per.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not weight or (now := (total - caps) / weight) <= level:
            return per.withColumn("level", F.lit(float(level)))
        level, full = now, F.col("ratio") < now


def planned(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """row (docs' columns), doc_id, size, source_size, target and copies of each document."""
    row = F.struct(*[docs[c] for c in docs.columns])
    sized = docs.select(row.alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"))
    targets = durable(source_targets(sized.select("source", "size"), weights), "mix-targets")
    targets = sent(targets.withColumnRenamed("source", "of"), BROADCAST_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "inner").withColumn("rate", rate)
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return out.select("row", "doc_id", "size", "source_size", "target", (F.floor("rate") + extra).alias("copies"))


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    kept = planned(docs, seed, weights).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    found = planned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM per),
ratios AS (SELECT *, cap::DOUBLE / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::DOUBLE AS level
  FROM ratios WINDOW below AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT coalesce((SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, level LIMIT 1), 0) AS level),
targets AS (
  SELECT l.source, l.source_size, least(l.cap::DOUBLE, w.level * l.weight) AS target FROM levels l, water w),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM rated
"""
