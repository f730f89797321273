"""Secret scan with multipart credential linking, with DataFrame functions only.

Base spans (assignments, access keys, long hex runs) stand by themselves. Weak
candidates (account-like identifiers and e-mail addresses, mixed or upper-case
tokens, endpoints) are reported only
where complementary parts co-occur within a scope of SCOPE characters: an
identifier with a secret, a secret with an identifier, an endpoint with both.
Base access keys count as identifiers, base assignments and hex runs as secrets.

The scope join is an interval join on buckets as wide as the scope: parts of one
bucket and role are folded to their least and greatest start before the join, so
that a text with many parts gives three rows a candidate, not pairs.

Cases: a null or empty text has no spans; texts of any length are read whole;
null and repeated doc_ids do no harm, since rows are joined by a number that is
written with them; an empty table gives an empty result; other columns are not
touched. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.spans import joined, let, matches, tagged, unmarked
from corpusloom.session import durable, table

SCOPE = 400
BASE = {
    "assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Weak candidates, by role.
WEAK = {
    "id": r"""(?i:\b(?:client_?id|access_?key_?id|account_?id|user_?name|login))["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9_.@-]{3,}+|(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++""",
    "key": r"(?<![A-Za-z0-9+/_=-])(?:(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+=*+|(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{20,}+)(?![A-Za-z0-9+/_=-])",
    "endpoint": r"""(?i:\bhttps?://[a-z0-9.-]++(?::[0-9]++)?+(?:/[A-Za-z0-9._~/-]*+)?+|\b(?:endpoint|host|server|base_?url)["']?+\x20*+[:=]\x20*+["']?+[a-z0-9.:/-]{4,}+)""",
}
RANKS = {"assign": 0, "access": 1, "hex": 2, "id": 3, "key": 4, "endpoint": 5}
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
NEEDS = {"id": ("secret",), "key": ("identifier",), "endpoint": ("identifier", "secret")}


def _apart(spans, base):
    """Spans that no base span overlaps."""
    return let(base, lambda b: F.filter(spans, lambda x: ~F.exists(b, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))))


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id and a column of tagged spans for each kind, written to the shared folder."""
    df = docs.select("doc_id", unmarked(F.col("text")).alias("_text"))
    df = df.select("doc_id", *[matches(F.col("_text"), p).alias(k) for k, p in (BASE | WEAK).items()])
    kept = F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], VALUE, 1)) >= 6)
    df = df.withColumn("assign", kept).withColumn("_base", F.concat("assign", "access", "hex"))
    df = df.select("doc_id", *BASE, *[_apart(F.col(k), F.col("_base")).alias(k) for k in WEAK])
    return durable(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[tagged(F.col(k), RANKS[k], k).alias(k) for k in RANKS]), "secret-spans")


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row and the weak spans of it that their complements confirm."""
    some = rows.where(" or ".join(f"size({k}) > 0" for k in WEAK))
    all_parts = some.select("row", F.explode(F.concat(*RANKS)).alias("x")).select("row", "x", F.floor(F.col("x.s") / F.lit(scope)).alias("bucket"))
    role = F.element_at(F.create_map(*[F.lit(v) for kv in ROLES.items() for v in kv]), F.col("x.kind"))
    per = all_parts.groupBy("row", "bucket", role.alias("role")).agg(F.min("x.s").alias("least"), F.max("x.s").alias("most"))
    needs = F.element_at(F.create_map(*[y for k, v in NEEDS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("x.kind"))
    weak = all_parts.where(F.col("x.kind").isin(*WEAK)).withColumn("needs", needs).withColumn("role", F.explode("needs"))
    weak = weak.withColumn("step", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn("bucket", F.col("bucket") + F.col("step"))
    near = (F.col("step") == 0) | ((F.col("step") < 0) & (F.col("most") >= F.col("x.s") - scope)) | ((F.col("step") > 0) & (F.col("least") <= F.col("x.s") + scope))
    met = weak.join(per, ["row", "bucket", "role"]).where(near).select("row", "x", "needs", "role").distinct()
    whole = met.groupBy("row", "x", "needs").count().where("count = size(needs)")
    return whole.groupBy("row").agg(F.collect_list("x").alias("weak"))


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and base, weak: arrays of spans (s, rank, e, kind), and the three base columns."""
    rows = scanned(docs)
    found = rows.join(linked(rows, scope), "row", "left")
    return found.select("doc_id", *BASE, F.concat(*BASE).alias("base"), F.coalesce("weak", F.filter("id", lambda _: F.lit(False))).alias("weak"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "weak")).alias("spans"))
