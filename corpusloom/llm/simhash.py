"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits fall into six blocks. Two fingerprints that differ in
at most three bits agree on at least three of the six, so each of the twenty
choices of three blocks gives a key, and a linked pair shares one of them. Rows
meet by key and their Hamming distance is verified. Copies are folded before:
only different fingerprints are keyed.

A key's rows are compared in one task only where they are at most
`bucket_rows`; they give a star for each local component, not all pairs. Larger
buckets go an exact way that is linear in their rows: every fingerprint
announces all values within two bits of it (in the bits that the key leaves
free), and a value that is within one bit of some fingerprint r links r to all
that announced it. Those are within three bits of r, and a pair x, y within
three bits has such a value: one bit from x, two from y.

Cases: a null or empty text, or one of white space, has fingerprint 0 and is
linked like any other; null ids take part, but a component bears the smallest
id that is not null; repeated rows share their fingerprint and component; an
empty table gives an empty result; other columns, of any name, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import lean, parts
from corpusloom.llm.components import components
from corpusloom.session import durable, sent, table

SEED, WORDS, DISTANCE = 42, 3, 3
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Different fingerprints that one task compares with each other.
BUCKET_ROWS = 2048
#: Shingles whose bits are unpacked at once (64 bytes each).
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = tuple(_signed(sum(((1 << n) - 1) << at for at, n in three)) for three in combinations(BLOCKS, 6 - DISTANCE))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text."""
    from xxhash import xxh64_intdigest

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(ws))
    ends = ends[k - 1 :]
    starts = starts[: len(ends)]
    ones, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, CHUNK):
        h = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for whole in batches for x in parts(whole)):
        fp = pa.array([_signed(fingerprint(t)) for t in b.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), fp], names=["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (long) for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(lean(_fingerprints), "doc_id long, text_key long, fp long")


def _stars(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links within a bucket as stars around the smallest of each component."""
    fp = np.sort(fp)
    left, out = np.ones(len(fp), bool), []
    u = fp.view(np.uint64)
    for i in range(len(fp)):
        if left[i]:
            left[i] = False
            todo = [i]
            while todo:
                near = np.flatnonzero(left & (np.bitwise_count(u ^ u[todo.pop()]) <= DISTANCE))
                left[near] = False
                todo += near.tolist()
                out += [(int(fp[j]), int(fp[i])) for j in near]
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp) sorted by (t, key): links within each bucket."""
    rest = None
    for b in (*batches, None):
        if b is not None:
            got = [b.column(i).to_numpy() for i in range(3)]
            rest = got if rest is None else [np.concatenate(x) for x in zip(rest, got, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        t, key, fp = rest
        new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate(([0], new, [len(t)]))
        whole = len(bounds) - 1 if b is None else len(bounds) - 2
        sizes, first = np.diff(bounds[: whole + 1]), bounds[:whole]
        two = first[sizes == 2]
        near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= DISTANCE]
        out = [(int(fp[i]), int(fp[i + 1])) for i in near]
        for at, size in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            out += _stars(fp[at : at + size])
        rest = [x[int(bounds[whole]) :] for x in rest]
        if out:
            found = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row (t, fp) all values z within two bits of fp in the bits that key t leaves free; one: z is within one bit."""
    for b in batches:
        ts, fps = b.column("t").to_numpy(), b.column("fp").to_numpy()
        for t in np.unique(ts):
            free = [1 << i for i in range(64) if not (MASKS[t] >> i) & 1]
            flips = [0, *free, *(x | y for x, y in combinations(free, 2))]
            flips, one = np.array([_signed(x) for x in flips], np.int64), np.arange(len(flips)) <= len(free)
            own = fps[ts == t]
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part) * len(flips), t, np.int32)), pa.array((part[:, None] ^ flips).ravel()), pa.array(np.repeat(part, len(flips))), pa.array(np.tile(one, len(part)))],
                    names=["t", "z", "fp", "one"],
                )


def links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) between different fingerprints of the column fp, enough to connect every component."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(MASKS)]))
    keyed = distinct.select("fp", keys.alias("k")).select("k.t", "k.key", "fp")
    sizes = durable(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    small, large = (sent(sizes.where(F.col("n") <= bucket_rows).drop("n")), sent(sizes.where(F.col("n") > bucket_rows).drop("n")))
    dealt = keyed.join(small, ["t", "key"]).repartition("t", "key").sortWithinPartitions("t", "key")
    cold = durable(dealt.mapInArrow(_bucket_links, "u long, v long"), "simhash-links")
    balls = keyed.join(large, ["t", "key"]).select("t", "fp").mapInArrow(_balls, "t int, z long, fp long, one boolean")
    # A value has at most as many announcers as there are flips, 529.
    met = balls.groupBy("t", "z").agg(F.min(F.when(F.col("one"), F.col("fp"))).alias("v"), F.collect_set("fp").alias("us")).where("v is not null and size(us) > 1")
    return cold.unionAll(met.select(F.explode("us").alias("u"), "v").where("u <> v"))


def near_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text_key, fp, component_id, keeper for each row of docs.

    keeper is true on the row that stays of its component: the smallest id
    (ids that are null come last), of rows with that id the smallest text_key;
    repeated rows of one id and text are all marked.
    """
    prints = durable(fingerprints(docs), "simhash-prints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    distinct = durable(prints.groupBy("fp").agg(F.min(row).alias("least")), "simhash-distinct")
    stars = components(links(distinct.select("fp"), bucket_rows)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = durable(distinct.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("first")), "simhash-roots")
    per = durable(rooted.select("fp", "root").join(least, "root").select("fp", "first"), "simhash-components")
    keeper = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return prints.join(per, "fp").select("doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"), keeper.alias("keeper"))


def deduplicated(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay: one of each component of found (near_duplicates, by default).

    Columns of any name pass through. Repeated rows are folded where they lie, then the texts are shuffled
    once: the join finds them dealt by what it asks for.
    """
    found = near_duplicates(docs) if found is None else found
    keys = ["none", "id", "text_key"]
    kept = found.where("keeper").select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key").distinct()
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(row, docs["doc_id"].isNull().alias("none"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("id"), F.xxhash64(docs["text"]).alias("text_key"))
    stay = rows.dropDuplicates(keys).join(kept, keys, "left_semi")
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
