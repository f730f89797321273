"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

A benchmark item's windows are its runs of ten words. The corpus frequency of
every benchmark term is counted; the postings (term, document, position) of the
two rarest terms of each window are stored; their lists, moved by the terms'
offsets, are intersected: equal starts give phrase candidates, starts within a
slack give proximity matches. Phrase candidates are then compared word by word
in the documents that hold one.

A document is known by its id and a hash of its text. Hot terms and passages
cost rows in proportion to their occurrences: no lists are joined with each
other but by document, window and start, and only as semi-joins.

Cases: a null or empty text has no words and no hits; an item without words has
no window, one of fewer than ten words has one window; items with a null id
mark words but are not counted or named; repeated items and repeated rows do no
harm; a null doc_id is an id like others; empty tables give no hits; other
columns, of any name, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import durable, table

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a benchmark-side table (about 200 bytes each) and keys of documents (24 bytes) that are broadcast; beyond, joins shuffle.
BROADCAST_TERMS = 200_000
BROADCAST_KEYS = 1_000_000


def lower_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), "")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of each row: dk, tk (long, not null)."""
    key = F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("dk", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("tk", key)


def _sent(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """phrase (array of words), items (their ids as strings), one row for each different window."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (size - 1)))
    each = rows.select("item", "ws", F.explode(starts).alias("at")).select("item", F.slice("ws", F.col("at"), F.lit(size)).alias("phrase"))
    return each.groupBy("phrase").agg(F.collect_set("item").alias("items"))


def anchored(wins: DataFrame, docs: DataFrame) -> DataFrame:
    """wins with wid and the rarest terms (first, then second or null), each (n, at, term); windows with a term that no document has are left out."""
    vocab = _sent(durable(wins.select(F.explode("phrase").alias("term")).distinct(), "decon-terms"), BROADCAST_TERMS)
    counts = durable(docs.select(F.explode(words(F.col("text"))).alias("term")).join(vocab, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "decon-counts")
    each = wins.select("phrase", "items", F.posexplode("phrase").alias("at", "term")).join(_sent(counts, BROADCAST_TERMS), "term", "left")
    lists = each.groupBy("phrase", "items").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("terms"))
    return lists.where("terms[0].n > 0").select(F.xxhash64("phrase").alias("wid"), "phrase", "items", F.col("terms")[0].alias("first"), F.get("terms", F.lit(1)).alias("second"))


def postings(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The stored index: term, dk, tk, pos of the terms that anchors has."""
    terms = anchors.select(F.col("first.term").alias("term")).unionAll(anchors.where("second is not null").select("second.term")).distinct()
    each = keyed(docs).select("dk", "tk", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return durable(each.join(_sent(durable(terms, "decon-anchors"), BROADCAST_TERMS), "term"), "decon-postings")


def _moved(index: DataFrame, anchors: DataFrame, which: str) -> DataFrame:
    """The lists of one anchor moved by its offset: dk, tk, wid, start; alone: the window has no second term."""
    own = anchors.where(f"{which} is not null").select("wid", F.col(f"{which}.term").alias("term"), F.col(f"{which}.at").alias("at"), F.col("second").isNull().alias("alone"))
    moved = index.join(_sent(own, BROADCAST_TERMS), "term").select("dk", "tk", "wid", (F.col("pos") - F.col("at")).alias("start"), "alone")
    return moved.where("start >= 0").distinct() if which == "first" else moved


def phrase_candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    first, second = _moved(index, anchors, "first"), _moved(index, anchors, "second").drop("alone")
    key = ["dk", "tk", "wid", "start"]
    return first.where("alone").select(*key).unionAll(first.where("not alone").join(second, key, "left_semi").select(*key))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int = 5, size: int = WINDOW) -> DataFrame:
    """doc_id, phrase, start: the two rarest terms of a window lie at most slack words off their distance in it.

    Starts are dealt in buckets of slack + 1. All of one bucket are near each
    other; of the buckets beside, the least and the greatest start decide.
    """
    anchors = durable(anchored(windows(benchmark, size), docs), "decon-windows")
    index = postings(docs, anchors)
    first, second = _moved(index, anchors, "first"), _moved(index, anchors, "second").drop("alone")
    bucket = F.floor(F.col("start") / F.lit(slack + 1)).cast("int")
    per = second.withColumn("b", bucket).groupBy("dk", "tk", "wid", "b").agg(F.min("start").alias("least"), F.max("start").alias("most"))
    near = first.where("not alone").withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("b", bucket + F.col("step"))
    near = near.join(per, ["dk", "tk", "wid", "b"]).where((F.col("step") == 0) | ((F.col("step") < 0) & (F.col("most") >= F.col("start") - slack)) | ((F.col("step") > 0) & (F.col("least") <= F.col("start") + slack)))
    both = near.select("dk", "tk", "wid", "start").unionAll(first.where("alone").select("dk", "tk", "wid", "start")).distinct()
    ids = keyed(docs.select("doc_id", "text")).select("doc_id", "dk", "tk").distinct()
    return both.join(_sent(anchors.select("wid", "phrase"), BROADCAST_TERMS), "wid").join(ids, ["dk", "tk"]).select("doc_id", "phrase", "start")


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Two tables: dk, tk, n_hit of each document with hits; and dk, tk, items (sorted ids) of those."""
    docs = docs.select("doc_id", "text")
    anchors = durable(anchored(windows(benchmark, size), docs), "decon-windows")
    found = durable(phrase_candidates(postings(docs, anchors), anchors), "decon-candidates")
    phrases = found.join(_sent(anchors.select("wid", "phrase"), BROADCAST_TERMS), "wid")
    # At a start, at most one window of each length can be: a list is bounded by its text.
    per = durable(phrases.groupBy("dk", "tk").agg(F.collect_list(F.struct("start", "wid", "phrase")).alias("cands")), "decon-documents")
    texts = keyed(docs)
    if per.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(per.select("dk", "tk")), ["dk", "tk"], "left_semi")
    texts = texts.select("dk", "tk", words(F.col("text")).alias("ws")).dropDuplicates(["dk", "tk"])
    true = F.filter("cands", lambda c: F.slice("ws", c["start"] + 1, F.size(c["phrase"])) == c["phrase"])
    hits = texts.join(per, ["dk", "tk"]).select("dk", "tk", true.alias("hits")).where("size(hits) > 0")
    spans = F.array_sort(F.transform("hits", lambda c: F.struct(c["start"].alias("a"), (c["start"] + F.size(c["phrase"])).alias("b"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
        lambda s: s["n"],
    )
    hits = durable(hits.select("dk", "tk", covered.alias("n_hit"), F.array_distinct("hits.wid").alias("wids")), "decon-hits")
    named = anchors.select("wid", F.explode("items").alias("item"))
    if named.count() <= BROADCAST_TERMS:
        named = F.broadcast(named)
    items = hits.select("dk", "tk", F.explode("wids").alias("wid")).join(named, "wid").groupBy("dk", "tk").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return hits.select("dk", "tk", "n_hit"), durable(items, "decon-items")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items."""
    hits, items = occurrences(docs, benchmark)
    hits = hits.join(items, ["dk", "tk"], "left")
    base = keyed(docs.select("doc_id", "text")).select("doc_id", "dk", "tk", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if (items.agg(F.sum(1 + F.size("items"))).first()[0] or 0) <= BROADCAST_KEYS:
        hits = F.broadcast(hits)
    return base.join(hits, ["dk", "tk"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit, with their columns, of any name."""
    hits, _ = occurrences(docs, benchmark)
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = keyed(docs.select(row.alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text")))
    kept = rows.join(_sent(hits.select("dk", "tk"), BROADCAST_KEYS), ["dk", "tk"], "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(list_slice(ws, p, p + 9), ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS p FROM bw WHERE len(ws) > 0)),
grams AS (
  SELECT row, p, size, array_to_string(list_slice(ws, p, p + size - 1), ' ') AS phrase
  FROM (SELECT row, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS p FROM dw, (SELECT DISTINCT size FROM wins) WHERE len(ws) >= size)),
hits AS (SELECT g.row, g.p, g.size, w.item_id FROM grams g JOIN wins w ON g.phrase = w.phrase AND g.size = w.size),
covered AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(generate_series(p, p + size - 1)) AS pos FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""
