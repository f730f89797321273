"""Writers of line formats and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> int:
    """JSON lines with nulls written out; the number of rows comes with the write."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", "false").mode("overwrite").json(path)
    return seen.get["n"]


def tsv(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *df.columns).alias("value")).write.mode("overwrite").text(path)


def vocab(df: DataFrame, path: str) -> None:
    """token, id by id; a tab or line feed in a token is an error."""
    safe = F.when(F.col("token").rlike(r"[\t\n]"), F.raise_error(F.lit("tab or line feed in a token"))).otherwise(F.concat_ws("\t", "token", F.col("id").cast("string")))
    df.repartitionByRange("id").sortWithinPartitions("id").select(safe.alias("value")).write.mode("overwrite").text(path)


def pieces(df: DataFrame, path: str) -> None:
    """piece, score by id; a tab or line feed in a piece is an error."""
    safe = F.when(F.col("piece").rlike(r"[\t\n]"), F.raise_error(F.lit("tab or line feed in a piece"))).otherwise(F.concat_ws("\t", "piece", F.col("score").cast("string")))
    df.repartitionByRange("id").sortWithinPartitions("id").select(safe.alias("value")).write.mode("overwrite").text(path)


def manifest(outputs: dict[str, DataFrame]) -> str:
    """JSON of the outputs, by name: rows and content hash of each, and sha256 over the hashes of all."""
    import hashlib
    import json

    hashes = {name: content_hash(df) for name, df in sorted(outputs.items())}
    rows = {name: int(h.rsplit("-", 1)[1]) for name, h in hashes.items()}
    sha = {name: hashlib.sha256(h.encode()).hexdigest() for name, h in hashes.items()}
    return json.dumps({"splits": rows, "sha256": sha}, indent=2)


def content_hash(df: DataFrame) -> str:
    """A hash of the rows, whatever their order and files: the 128-bit sums of their md5 halves."""
    row = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    half = lambda a: F.sum(F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)"))
    got = df.agg(half(1), half(17), F.count(F.lit(1))).first()
    return "-".join(str(x or 0) for x in got)


def pages_text(paras: DataFrame) -> DataFrame:
    """page_no, text to one text with a blank line between pages."""
    every = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return paras.groupBy("doc").agg(F.array_join(F.transform(every, lambda x: x["text"]), "\n\n").alias("text"))
