"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import durable


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(doc_id.cast("string")) % n


#: Bytes of text of each class that go to the driver.
FIT_BYTES = 24 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, most_bytes: int = FIT_BYTES) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and labels of up to `rows` learnable documents of each class, by a hash of the id; and all counts by class.

    Ids are chosen first, so that texts are scanned once and never shuffled: the
    chosen ids, `rows` a class at most, are broadcast. Rows with a null id or
    label are not learnt from, nor are null texts. Of an id that documents repeat,
    one row is taken. Texts are taken in that order up to `most_bytes` of each class
    (the last may pass it). A class's share of all labelled documents is in the
    counts, since the sample is balanced.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    known = durable(docs.where(F.col("text").isNotNull() & learn).select("doc_id").distinct().join(marks, "doc_id"), "labelled-ids")
    counts = {r._label: r["count"] for r in known.groupBy("_label").count().collect()}
    texts, marked = [], []
    if not counts:
        return texts, marked, counts
    chosen = None
    for y in sorted(counts):
        own = known.where(F.col("_label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = own if chosen is None else chosen.unionAll(own)
    both = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(durable(chosen, "chosen-ids")), "doc_id")
    one = both.groupBy("doc_id", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row")).select("doc_id", "_label", "row.text")
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    for r in one.withColumn("_before", before).where(f"_before is null or _before < {most_bytes}").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        texts.append(r.text)
        marked.append(r._label)
    return texts, marked, counts
