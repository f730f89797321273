"""Named queries over the driver's tables and over small fixed rows, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions import udfs
from corpusloom.functions import values as v
from corpusloom.operators import arrays, layout, metrics, pairs, routes, rules
from corpusloom.session import durable, table
from corpusloom.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Rows:
    """Small fixed rows: a DataFrame here, VALUES in the oracle."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def sql(self, name: str) -> str:
        def lit(x):
            if isinstance(x, (list, tuple)):
                return "[" + ", ".join(map(lit, x)) + "]"
            return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

        names = [c.split()[0] for c in self.schema.split(", ")]
        return f"{name}({', '.join(names)}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in self.rows) + ")"


SPACE = r"[ \t\n\x0B\f\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{85}]+"
CLEAN = r"trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[\x00-\x08\x0B-\x1F\x7F\x{{200B}}-\x{{200F}}\x{{2028}}\x{{2029}}\x{{FEFF}}]', '', 'g'), '" + SPACE.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
SQUASH = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
H60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
RANK = "coalesce(try_cast(regexp_replace(source, '[^0-9]', '', 'g') AS INT), 0)"


def _rank():
    return F.coalesce(F.expr("try_cast(regexp_replace(source, '[^0-9]', '') as int)"), F.lit(0))


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) BETWEEN 20 AND 80")
def scan_filter_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.length("line").between(20, 80))


@query(f"SELECT doc_id, {CLEAN.format('text')} AS clean FROM documents")
def normalize_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", t.clean(F.col("text")).alias("clean"))


WIDE = Rows("doc_id long, text string", (-1, "Ｈｅｌｌｏ　 wörld​"), (-2, "a\rb\x07 ①"), (-3, None), (-4, "ﬁne ½ Å"), (-5, "x²"))
#: Compatibility characters of the fixed rows; the documents hold none, nor letters that are not composed.
COMPATIBLE = (("Ｈ", "H"), ("ｅ", "e"), ("ｌ", "l"), ("ｏ", "o"), ("　", " "), ("①", "1"), ("ﬁ", "fi"), ("½", "1⁄2"), ("\u212b", "\u00c5"), ("²", "2"))


def _compatible(text: str) -> str:
    for a, b in COMPATIBLE:
        text = f"replace({text}, '{a}', '{b}')"
    return text


@query(f"WITH {WIDE.sql('w')}, r AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM w) SELECT doc_id, {CLEAN.format(_compatible('text'))} AS normal FROM r")
def normalize_nfkc(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").unionByName(WIDE.df(spark))
    return rows.select("doc_id", udfs.normalize(F.col("text")).alias("normal"))


@query()
def blake_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", udfs.blake64("text").alias("h64"))


GLUED = Rows("id int, text string", (1, "파일 크기Name"), (2, "열기.Comment"), (3, "Open Name"), (4, "닫기)GenericName"), (5, "NameName"), (6, "끝?Keywords"), (7, ""))


@query(f"WITH {GLUED.sql('r')} SELECT id, regexp_replace(text, '([가-힣)\\].!?])(Comment|GenericName|Name|Keywords)$', '\\1') AS stripped FROM r")
def strip_artifacts(spark, d):
    return GLUED.df(spark).select("id", t.strip_artifacts(F.col("text")).alias("stripped"))


@query(f"SELECT doc_id, {SQUASH.format('text')} || chr(9) || {SQUASH.format('lang')} AS key FROM documents")
def dedup_key(spark, d):
    return table(spark, d, "documents").select("doc_id", t.dedup_key(F.col("text"), F.col("lang")).alias("key"))


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY {SQUASH.format('text')} ORDER BY {RANK}, doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, d):
    rows = durable(table(spark, d, "documents").select("doc_id", "source", F.md5(t.squash(F.col("text"))).alias("key")), "keep-first")
    return pairs.keep_first(rows, "key", _rank().alias("rank"), F.col("doc_id")).where("is_first").select("doc_id", "source")


@query(f"SELECT lang, count(*) AS n, count(DISTINCT {SQUASH.format('text')}) AS distinct_n FROM documents GROUP BY lang")
def dedup_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(t.squash(F.col("text"))).alias("distinct_n"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '\p{L}')) AS letters, coalesce(len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 0) AS latin_share FROM documents")
def script_profile(spark, d):
    p = t.profile(F.col("text"))
    return table(spark, d, "documents").select("doc_id", p["latin"].cast("long").alias("latin"), p["letters"].cast("long").alias("letters"), p["latin_share"].alias("latin_share"))


SCRIPTS = Rows("doc_id long, text string", (-1, "안녕하세요"), (-2, "こんにちは世界"), (-3, "你好世界"), (-4, "Hello"), (-5, "123 !?"), (-6, None), (-7, "東京"), (-8, "The quick brown fox jumps 안"), (-9, "日本のabc"))
IN_HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"
IN_LATIN = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"
COUNT = "len(regexp_extract_all(coalesce({0}, ''), '{1}'))"


@query(
    f"WITH {SCRIPTS.sql('s')}, r AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM s), "
    f"c AS (SELECT doc_id, {COUNT.format('text', IN_HANGUL)} AS hangul, {COUNT.format('text', '[' + chr(0x3040) + '-' + chr(0x30FF) + ']')} AS kana, "
    + f"{COUNT.format('text', '[' + chr(0x3400) + '-' + chr(0x4DBF) + chr(0x4E00) + '-' + chr(0x9FFF) + ']')} AS han, {COUNT.format('text', IN_LATIN)} AS latin FROM r), "
    "n AS (SELECT *, hangul + kana + han + latin AS total FROM c) "
    "SELECT doc_id, CASE WHEN total = 0 THEN 'xx' WHEN hangul::DOUBLE / total > 0.08 THEN 'ko' WHEN kana::DOUBLE / total > 0.08 THEN 'ja' WHEN han > 0 AND han >= latin THEN 'zh' WHEN latin > 0 THEN 'en' ELSE 'xx' END AS lang FROM n"
)
def script_detect(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").unionByName(SCRIPTS.df(spark))
    return rows.select("doc_id", t.detect_script(F.col("text"), F.lit("xx")).alias("lang"))


PAIRS = Rows(
    "id string, en string, ko string",
    ("1", "Open the file", "파일을 여십시오"), ("2", "", "가"), ("3", "OK", "OK"), ("4", "See www.x.org now", "지금 보기"), ("5", "A &kde; b", "가 나"), ("6", "Retrieved 2018", "검색"),
    ("7", "This is a very very long sentence that goes on and on for ever and ever, truly so", "짧은 문장입니다 열두자"), ("8", "1 2 3 4", "가나다"), ("9", "Hello there", "Bonjour"), ("10", "Hola señor ñ 안녕", "안녕하세요"),
    ("11", "Start Konqueror now", "Konqueror를 켭니다"), ("12", "x" * 401, "가"), ("13", "ab cd ef gh ij", "가나다라마바사아자차카타파하가나다라마바사아자차"), ("14", "Ünïcödé ñandú", "한국어 문장"),
)


def _turns(spark, d):
    rows = table(spark, d, "conversations")
    a, b = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("en")), rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ko"))
    return a.join(b, ["conv_id", "turn"])


TURNS = "t AS (SELECT a.conv_id, a.turn, a.text AS en, b.text AS ko FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role = 'assistant')"


COPIED = "coalesce(list_sum(list_transform(list_filter(regexp_extract_all(ko, '[A-Za-z]+'), lambda w: list_contains(list_transform(regexp_extract_all(en, '[A-Za-z]+'), lambda e: lower(e)), lower(w))), lambda w: length(w))), 0)"
SHARE = "coalesce({0}::DOUBLE / nullif({1}, 0), 0)"
NO_SPACE = r"[^ \t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
IN_PROFILE = r"[가-힣ᄀ-ᇿ㄰-㆏]"


def _either(pattern: str) -> str:
    return f"(regexp_matches(en, '{pattern}') OR regexp_matches(ko, '{pattern}'))"


@query(
    f"WITH {TURNS}, {PAIRS.sql('p')}, r AS (SELECT conv_id || '-' || turn AS id, en, ko FROM t UNION ALL SELECT id, en, ko FROM p), "
    f"c AS (SELECT *, length(en) AS n, length(ko) AS m, {COUNT.format('en', r'\\p{L}')} AS en_letters, {COUNT.format('ko', r'\\p{L}')} AS ko_letters, {COUNT.format('en', NO_SPACE)} AS en_total, {COUNT.format('ko', NO_SPACE)} AS ko_total, "
    f"{COUNT.format('en', IN_PROFILE)} AS en_hangul, {COUNT.format('ko', IN_PROFILE)} AS ko_hangul, {COUNT.format('en', '[A-Za-z]')} AS en_latin, {COPIED} AS copied FROM r) "
    f"SELECT id, CASE WHEN n < 1 OR m < 1 THEN 'empty' WHEN en = ko THEN 'identical' WHEN n > 400 OR m > 250 THEN 'too_long' WHEN {_either(v.URL)} THEN 'url' WHEN {_either(v.ENTITY)} THEN 'markup' WHEN {_either(v.BOILERPLATE)} THEN 'boilerplate' "
    f"WHEN n >= 12 AND m >= 12 AND NOT n::DOUBLE / m BETWEEN 0.7 AND 6.0 THEN 'ratio' WHEN {SHARE.format('en_letters', 'en_total')} < 0.3 OR {SHARE.format('ko_letters', 'ko_total')} < 0.3 THEN 'not_text' "
    f"WHEN ko_hangul = 0 OR (ko_letters - copied > 0 AND {SHARE.format('ko_hangul', '(ko_letters - copied)')} < 0.5) THEN 'ko_script' WHEN en_hangul > 0 OR {SHARE.format('en_latin', 'en_letters')} < 0.7 THEN 'en_script' END AS reason FROM c".replace("\\\\p", "\\p")
)
def check_pair_reasons(spark, d):
    rows = _turns(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "en", "ko").unionByName(PAIRS.df(spark))
    return rows.select("id", pairs.check_pair(F.col("en"), F.col("ko")).alias("reason"))


@query(f"WITH {TURNS}, w AS (SELECT conv_id, turn, en, unnest(regexp_extract_all(ko, '[A-Za-z]+')) AS w FROM t), c AS (SELECT conv_id, turn, sum(CASE WHEN list_contains(regexp_extract_all(lower(en), '[a-z]+'), lower(w)) THEN length(w) ELSE 0 END)::BIGINT AS n FROM w GROUP BY ALL) SELECT conv_id, turn, coalesce(n, 0) AS copied FROM (SELECT DISTINCT conv_id, turn FROM t) LEFT JOIN c USING (conv_id, turn)")
def copied_words(spark, d):
    ascii_en = F.translate("en", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _turns(spark, d).select("conv_id", "turn", pairs.copied_length(ascii_en, F.col("ko")).cast("long").alias("copied")).distinct()


@query(f"WITH {TURNS} SELECT conv_id, turn, length(en)::INT AS en_chars, length(ko)::INT AS ko_chars FROM t")
def pair_zip(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.length("en").alias("en_chars"), F.length("ko").alias("ko_chars"))


@query(f"WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT doc_id, source FROM documents JOIN n USING (source) WHERE least(1.0::DOUBLE, 20.0::DOUBLE / n) >= 1 OR {H60.format(chr(39) + '7:' + chr(39) + ' || text || chr(9) || lang')} % 1000000 < least(1.0::DOUBLE, 20.0::DOUBLE / n) * 1000000")
def hash_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text", "lang")
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rate = pairs.sampling_rate(F.lit(20.0), F.col("n"))
    return docs.join(n, "source").where(pairs.keep_by_rate(F.concat("text", F.lit("\t"), "lang"), rate, 7)).select("doc_id", "source")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def first_n_per_source(spark, d):
    return pairs.first_n(table(spark, d, "documents").select("doc_id", "source"), "source", 5, F.col("doc_id"))


HELD = f"held AS (SELECT DISTINCT line FROM (SELECT {CLEAN.format('l')} AS line FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM benchmark)) WHERE line <> '')"
HIT = f"hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, {CLEAN.format('l')} AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)) SEMI JOIN held USING (line))"


@query(f"WITH {HELD}, {HIT} SELECT doc_id, doc_id IN (SELECT doc_id FROM hit) AS in_eval_set FROM documents")
def decontaminate_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l")).select("doc_id", t.clean(F.col("l")).alias("line"))
    held = table(spark, d, "benchmark").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l")).select(t.clean(F.col("l")).alias("line")).where("line <> ''")
    return pairs.held_out_flags(docs, {"line": held}).groupBy("doc_id").agg(F.bool_or("in_eval_set").alias("in_eval_set"))


OUTCOME = f"""{HELD}, {HIT}, r AS (
  SELECT doc_id, source, {RANK} AS rank, {CLEAN.format('text')} AS c, doc_id IN (SELECT doc_id FROM hit) AS held FROM documents),
ruled AS (SELECT *, CASE WHEN length(c) < 1 THEN 'empty' WHEN length(c) > 20000 THEN 'too_long'
  WHEN coalesce(len(regexp_extract_all(c, '\\p{{L}}'))::DOUBLE / nullif(len(regexp_extract_all(c, '[^ ]')), 0), 0) < 0.3 THEN 'not_text' WHEN held THEN 'in_eval_set' END AS rule FROM r),
o AS (SELECT doc_id, source, coalesce(rule, CASE WHEN row_number() OVER (PARTITION BY rule IS NULL, {SQUASH.format('c')} ORDER BY rank, source, doc_id) > 1 THEN 'duplicate' ELSE 'kept' END) AS outcome FROM ruled)"""


def _outcomes(spark, d):
    return pairs.outcomes(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "benchmark"))


@query(f"WITH {OUTCOME} SELECT source, outcome, count(*) AS n FROM o GROUP BY ALL")
def outcome_report(spark, d):
    return pairs.outcome_report(_outcomes(spark, d))


@query(f"WITH {OUTCOME} SELECT source, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in pairs.OUTCOMES) + " FROM o GROUP BY source")
def outcome_pivot(spark, d):
    return pairs.outcome_pivot(_outcomes(spark, d))


@query(f"WITH {OUTCOME} SELECT source, count(*) AS n, (count(*) FILTER (outcome = 'kept'))::BIGINT AS kept FROM o GROUP BY ROLLUP (source)")
def outcome_totals(spark, d):
    return pairs.outcome_totals(_outcomes(spark, d))


RELEASES = Rows("corpus string, version string, pairs long", ("TED2020", "v1", 390_000), ("KDE4", "v2", 80_000), ("WikiMatrix", "v1", 300_000), ("Tatoeba", "v9", 10), ("XLEnt", "v1", 0))
CATALOGUE = Rows("rank int, name string, cap int, core boolean", *[(i, n, c, "core" in p) for i, (n, c, p) in enumerate(v.CORPORA)])


@query(f"WITH {CATALOGUE.sql('c')}, {RELEASES.sql('r')} SELECT rank, name, CASE WHEN corpus IS NULL THEN 'not available' ELSE 'available' END AS status, CASE WHEN corpus IS NULL THEN NULL WHEN cap IS NULL OR pairs = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, cap::DOUBLE / pairs) END AS rate FROM c LEFT JOIN r ON name = corpus WHERE core AND name NOT IN ('Tatoeba')")
def catalogue_left_join(spark, d):
    rows = spark.createDataFrame([(i, n, c, list(p)) for i, (n, c, p) in enumerate(v.CORPORA)], "rank int, name string, cap int, profiles array<string>")
    rows = rows.where(F.array_contains("profiles", "core") & ~F.col("name").isin(*v.EXCLUDED)).join(RELEASES.df(spark), F.col("name") == F.col("corpus"), "left")
    there = F.col("corpus").isNotNull()
    return rows.select("rank", "name", F.when(there, "available").otherwise("not available").alias("status"), F.when(there, pairs.sampling_rate(F.col("cap"), F.col("pairs"))).alias("rate"))


@query("SELECT doc_id AS id, source AS src, length(text)::INT AS n FROM documents UNION ALL SELECT item_id, 'benchmark', length(text)::INT FROM benchmark")
def union_all_tagged(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.length("text").alias("n"))
    return a.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("src"), F.length("text").alias("n")))


@query("SELECT unnest(['src1', 'src2', 'src99', 'nowhere']) AS source EXCEPT SELECT source FROM documents")
def except_sources(spark, d):
    asked = spark.createDataFrame([(s,) for s in ("src1", "src2", "src99", "nowhere")], "source string")
    return asked.subtract(table(spark, d, "documents").select("source"))


@query(f"WITH n AS (SELECT count(*) AS n FROM documents), u AS (SELECT doc_id, {H60.format(chr(39) + 'split:5:' + chr(39) + ' || text')} % 1000000 / 1000000.0::DOUBLE AS u FROM documents) SELECT doc_id, CASE WHEN u < least(0.5::DOUBLE, 100.0::DOUBLE / n) THEN 'dev' WHEN u < least(0.5::DOUBLE, 100.0::DOUBLE / n) + least(0.5::DOUBLE, 50.0::DOUBLE / n) THEN 'test' ELSE 'train' END AS split FROM u, n")
def hash_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return docs.crossJoin(F.broadcast(n)).select("doc_id", pairs.split_of(F.col("text"), F.col("n"), 100, 50, 5).alias("split"))  # n is one row


@query(f"SELECT doc_id FROM documents ORDER BY {H60.format(chr(39) + 'order:5:' + chr(39) + ' || text')}, doc_id LIMIT 50")
def hash_order_topk(spark, d):
    return table(spark, d, "documents").orderBy(t.h60(F.concat(F.lit("order:5:"), "text")), "doc_id").limit(50).select("doc_id")


@query("WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 43200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM g) SELECT user_id, island, count(*) AS n FROM i GROUP BY ALL")
def event_islands(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return layout.islands(rows, ["user_id"], [F.col("us"), F.col("event_id")], gap > 43_200_000_000).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))


def _box(x, y, w, h):
    return [float(a) for a in (x, y, x + w, y, x + w, y + h, x, y + h)]


QUADS = Rows(
    "page_id long, line_no int, quad array<double>",
    (-1, 0, _box(0, 0, 100, 10)), (-1, 1, _box(0, 12, 90, 10)), (-1, 2, _box(2, 60, 95, 10)), (-1, 3, _box(0, 72, 95, 30)), (-1, 4, _box(300, 0, 80, 10)), (-1, 5, _box(300, 61, 80, 10)), (-2, 0, _box(0, 0, 50, 0)), (-2, 1, _box(0, 5, 50, 10)),
)
BOXES = f"""{QUADS.sql('own')}, b AS (
  SELECT l_orderkey AS page_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INT AS line_no, (l_partkey % 3 * 70)::DOUBLE AS x, (l_linenumber * 14 + l_suppkey % 23)::DOUBLE AS y, (60 + l_quantity::INT)::DOUBLE AS w, (8 + l_partkey % 7)::DOUBLE AS h FROM lineitem),
q AS (SELECT page_id, line_no, x AS l, x + w AS r, y AS t, y + h AS b, h FROM b UNION ALL SELECT page_id, line_no, quad[1], quad[3], quad[2], quad[8], quad[8] - quad[2] FROM own)"""


def _lines(spark, d):
    """A page for each order, a line for each of its items, and the fixed pages."""
    x, y = (F.col("l_partkey") % 3 * 70).cast("double"), (F.col("l_linenumber") * 14 + F.col("l_suppkey") % 23).cast("double")
    w, h = (60 + F.col("l_quantity").cast("int")).cast("double"), (8 + F.col("l_partkey") % 7).cast("double")
    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("page_id"), no.alias("line_no"), F.array(x, y, x + w, y, x + w, y + h, x, y + h).alias("quad"))
    return rows.unionByName(QUADS.df(spark))


@query(
    f"WITH {BOXES}, p AS (SELECT *, lag(l) OVER w AS pl, lag(r) OVER w AS pr, lag(t) OVER w AS pt, lag(b) OVER w AS pb, lag(h) OVER w AS ph FROM q WINDOW w AS (PARTITION BY page_id ORDER BY line_no)), "
    "g AS (SELECT *, coalesce(least(h, ph) > 0 AND greatest(h, ph) <= least(h, ph) * 1.7 AND t - pb <= greatest(h, ph) * 1.6 AND (t + b) / 2 >= (pt + pb) / 2 AND least(r - l, pr - pl) > 0 AND least(r, pr) - greatest(l, pl) >= least(r - l, pr - pl) * 0.25, false) AS goes_on FROM p) "
    "SELECT page_id, line_no, sum(CASE WHEN goes_on AND ph IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY line_no)::BIGINT AS para FROM g"
)
def paragraph_islands(spark, d):
    return layout.paragraphs(_lines(spark, d)).select("page_id", "line_no", "para")


@query(
    f"WITH {BOXES}, c AS (SELECT *, (t + b) / 2 AS c FROM q), n AS (SELECT *, coalesce(CASE WHEN c - lag(c) OVER w > least(b - t, lag(b - t) OVER w) * 0.6 THEN 1 ELSE 0 END, 1) AS new, lag(c) OVER w IS NULL AS first FROM c WINDOW w AS (PARTITION BY page_id ORDER BY c, l, line_no)), "
    "k AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE new END) OVER (PARTITION BY page_id ORDER BY c, l, line_no) AS band FROM n) SELECT page_id, line_no, row_number() OVER (PARTITION BY page_id ORDER BY band, l, line_no)::INT AS pos FROM k"
)
def reading_order(spark, d):
    return layout.reading_order(_lines(spark, d)).select("page_id", "line_no", "pos")


@query(f"WITH {BOXES} SELECT page_id, line_no, r - l AS width, b - t AS height, 0.0::DOUBLE AS angle, l AS \"left\", t AS top FROM q")
def quad_metrics(spark, d):
    m = layout.quad_metrics(F.col("quad"))
    return _lines(spark, d).select("page_id", "line_no", *[m[k].alias(k) for k in ("width", "height", "angle", "left", "top")])


@query(f"WITH {BOXES} SELECT page_id, max(r - l) AS width FROM q GROUP BY page_id")
def line_widths(spark, d):
    return layout.line_widths(_lines(spark, d), ["page_id"])


@query("SELECT o_orderpriority, o_totalprice AS upper_median FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k = n // 2 + 1")
def upper_median(spark, d):
    return layout.upper_median(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS page FROM conversations GROUP BY conv_id")
def ordered_concat(spark, d):
    every = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(layout.page_text(F.transform(every, lambda x: x["text"])).alias("page"))


LINES = Rows("doc_id long, text string", (-1, "Hello\nworld"), (-2, "日本\n語です"), (-3, "日本\nabc"), (-4, "안녕\n하세요"), (-5, " a\n"), (-6, "。\n次"))
CJK_CHAR = t.CJK


@query(
    f"WITH {LINES.sql('own')}, r AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM own) "
    f"SELECT doc_id, trim(list_reduce(list_prepend('', string_split(text, chr(10))), lambda s, x: CASE WHEN s = '' THEN x WHEN regexp_matches(right(s, 1), '^{CJK_CHAR}$') AND regexp_matches(left(x, 1), '^{CJK_CHAR}$') THEN s || x ELSE s || ' ' || x END)) AS joined FROM r"
)
def cjk_concat(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").unionByName(LINES.df(spark))
    return rows.select("doc_id", layout.join_lines(F.split("text", "\n")).alias("joined"))


@query()
def redistribute_lines(spark, d):
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w) % 7)
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text"), F.slice(lengths, F.lit(1), F.lit(12)).alias("lengths")).where("text is not null")
    return rows.select("conv_id", "turn", "role", layout.redistribute(F.col("text"), F.col("lengths")).alias("lines"), layout.redistribute(F.col("text"), F.col("lengths"), strict=True).alias("strict"))


MARKS = r".!?。！？…\n"


@query(
    f"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^{MARKS}]*[{MARKS}][ \\t\\n\\x0B\\f\\r]*|[^{MARKS}]+'), lambda p: regexp_replace(p, '([{MARKS}])[ \\t\\n\\x0B\\f\\r]+$', '\\1')), lambda p: p <> '') AS ss FROM documents), "
    "e AS (SELECT doc_id, list_transform(ss, lambda p: {'n': len(string_split(p, ' ')), 'out': [p]}) AS es FROM s WHERE len(ss) > 0), "
    "r AS (SELECT doc_id, list_reduce(es, lambda a, x: CASE WHEN a.n + x.n <= 192 THEN {'n': a.n + x.n, 'out': list_concat(a.out[:len(a.out) - 1], [a.out[len(a.out)] || ' ' || x.out[1]])} ELSE {'n': x.n, 'out': list_concat(a.out, x.out)} END).out AS chunks FROM e) "
    "SELECT doc_id, (i - 1)::INT AS chunk, chunks[i] AS text FROM (SELECT doc_id, chunks, unnest(generate_series(1, len(chunks))) AS i FROM r)"
)
def sentence_chunks(spark, d):
    cost = lambda s: F.size(F.split(s, " "))
    return table(spark, d, "documents").select("doc_id", F.posexplode(layout.chunks(t.sentences(F.col("text")), cost)).alias("chunk", "text"))


@query("WITH b AS (SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) // 6 AS batch FROM documents) SELECT source, batch, count(*) AS n, max(n_chars) AS most FROM b GROUP BY ALL")
def length_batches(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    k = F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))
    return rows.withColumn("batch", F.floor((k - 1) / 6).cast("long")).groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("most"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax FROM embeddings")
def argmax_first(spark, d):
    return table(spark, d, "embeddings").select("vec_id", arrays.argmax_first(F.col("embedding")).alias("argmax"))


@query(
    "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 40)::INT % 5)) AS labels, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS maxima FROM embeddings), "
    "k AS (SELECT *, list_filter(range(1, len(labels) + 1), lambda i: labels[i] <> 0 AND (i = 1 OR labels[i] <> labels[i - 1])) AS kept FROM s) "
    "SELECT vec_id, array_to_string(list_transform(kept, lambda i: coalesce(['a', 'b', 'c'][labels[i]], ' ')), '') AS text, round(coalesce(list_sum(list_transform(kept, lambda i: maxima[i])) / nullif(len(kept), 0), 0), 9) AS confidence FROM k"
)
def ctc_collapse(spark, d):
    glyphs = F.array(*map(F.lit, "abc"))
    size = lambda x: F.abs(x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (F.floor(size(x) * 40) % 5).cast("int")).alias("labels"), F.transform("embedding", size).alias("maxima"))
    return rows.select("vec_id", arrays.ctc_text(F.col("labels"), glyphs).alias("text"), F.round(arrays.ctc_confidence(F.col("labels"), F.col("maxima")), 9).alias("confidence"))


VOCAB = Rows("line_no long, value string", (0, "<unk>\t1"), (1, "the\t5"), (2, "of\t6"), (3, "bad"), (4, "the\t7"), (5, "x\ty\t8"), (6, "and\tnine"), (7, "de\t9"))
LOADED = "voc AS (SELECT regexp_extract(value, '^(.+)\\t([^\\t]*)$', 1) AS token, arg_max(try_cast(regexp_extract(value, '^(.+)\\t([^\\t]*)$', 2) AS INT), line_no) AS id FROM l WHERE try_cast(regexp_extract(value, '^(.+)\\t([^\\t]*)$', 2) AS INT) IS NOT NULL GROUP BY 1)"


@query(f"WITH {VOCAB.sql('l')}, {LOADED} SELECT token, id FROM voc")
def vocab_load(spark, d):
    return readers.vocab(VOCAB.df(spark))


@query(f"WITH {VOCAB.sql('l')}, {LOADED}, w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents) SELECT doc_id, coalesce(id, 1) AS id, count(*) AS n FROM w LEFT JOIN voc USING (token) GROUP BY ALL")
def vocab_encode(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("token"))
    ids = words.join(readers.vocab(VOCAB.df(spark)), "token", "left").select("doc_id", F.coalesce("id", F.lit(1)).alias("id"))
    return ids.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n"))


IDS = Rows("at int, id int, token string", (0, 7, "the"), (1, 99, ""), (2, 6, "of"), (3, None, ""), (4, 1, "<unk>"))


@query(f"WITH {IDS.sql('i')} SELECT at_ AS at, token FROM (SELECT \"at\" AS at_, token FROM i)".replace("i(at,", 'i("at",').replace("AS at,", 'AS "at",'))
def vocab_decode(spark, d):
    return IDS.df(spark).drop("token").join(readers.vocab(VOCAB.df(spark)), "id", "left").select("at", F.coalesce("token", F.lit("")).alias("token"))


@query()
def viterbi_pieces(spark, d):
    run = udfs.segmenter({"▁hel": -1.0, "lo": -1.5, "▁hello": -2.0, "▁": -3.0, "wor": -2.0, "ld": -2.0, "▁wor": -1.0, "er": -2.5, "▁the": -2.0, "in": -2.5, "ti": -2.5, "on": -2.2})
    fixed = spark.createDataFrame([(-1, 0, "", "hello world"), (-2, 0, "", "　ｈｅｌｌｏ"), (-3, 0, "", "  "), (-4, 0, "", None), (-5, 0, "", "help")], "conv_id long, turn int, role string, text string")
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(fixed)
    return rows.select("conv_id", "turn", "role", run("text").alias("pieces")).withColumn("back", t.pieces_to_text(F.col("pieces")))


HAVE = Rows("src string, tgt string", ("en", "ja"), ("ja", "en"), ("en", "zh"), ("zh", "en"))


@query(f"WITH {HAVE.sql('p')} SELECT src, tgt, 'direct' AS route FROM p UNION ALL SELECT a.src, b.tgt, 'pivot' FROM p a JOIN p b ON a.tgt = b.src AND a.tgt = 'en' AND a.src <> b.tgt WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.src = a.src AND p.tgt = b.tgt)")
def language_routes(spark, d):
    return routes.routes(HAVE.df(spark))


@query("WITH l AS (SELECT unnest(['en', 'ja', 'zh']) AS c) SELECT a.c AS src, b.c AS tgt, a.c || '-' || b.c AS pair FROM l a, l b WHERE a.c <> b.c")
def pair_matrix(spark, d):
    return routes.directed_pairs(routes.languages(spark).where("user_facing"))


def _present(spark):
    need = routes.required_files(routes.languages(spark))
    return need.where("src = 'en' and tgt = 'ja' or src = 'ja' and tgt = 'en' and not endswith(path, 'config.json')").select("path")


FILES = "l AS (SELECT unnest(['en', 'ja', 'zh']) AS c), f AS (SELECT a.c AS src, b.c AS tgt, a.c || '-' || b.c AS pair, unnest(['encoder.onnx', 'decoder.onnx', 'source.spm.tsv', 'vocab.tsv', 'config.json']) AS f FROM l a, l b WHERE a.c <> b.c), r AS (SELECT *, pair = 'en-ja' OR pair = 'ja-en' AND f <> 'config.json' AS there FROM f)"


@query(f"WITH {FILES} SELECT pair, 'mt/' || pair || '/' || f AS path FROM r WHERE NOT there AND (src = 'en' OR tgt = 'en')")
def missing_files(spark, d):
    return routes.missing_files(routes.required_files(routes.languages(spark)), _present(spark))


@query(f"WITH {FILES} SELECT pair, bool_and(there) AS available FROM r GROUP BY pair")
def available_pairs(spark, d):
    return routes.available_pairs(routes.required_files(routes.languages(spark)), _present(spark))


CODES = Rows("code string", ("en",), (" JP ",), ("zh-Hans",), ("en_US",), ("KO-kr",), ("xx",), (None,), ("_en",), ("zho",), ("kor",))
KNOWN = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in (v.ALIASES | {k: k for k in v.LANGS}).items())
FROM_CODE = f"CASE CASE WHEN contains(lower(trim(code)), '-') THEN split_part(lower(trim(code)), '-', 1) WHEN instr(lower(trim(code)), '_') > 1 THEN split_part(lower(trim(code)), '_', 1) ELSE lower(trim(code)) END {KNOWN} END"
ALL_CODES = f"{CODES.sql('own')}, r AS (SELECT DISTINCT lang || suffix AS code FROM documents, (VALUES (''), ('-x'), ('_Y'), ('z')) s(suffix) UNION ALL SELECT code FROM own), k AS (SELECT code, {FROM_CODE} AS lang FROM r)"


def _codes(spark, d):
    made = table(spark, d, "documents").select(F.explode(F.array(*[F.concat("lang", F.lit(x)) for x in ("", "-x", "_Y", "z")])).alias("code")).distinct()
    return made.unionByName(CODES.df(spark))


@query(f"WITH {ALL_CODES} SELECT code, lang FROM k")
def lang_from_code(spark, d):
    return _codes(spark, d).select("code", t.lang_from_code(F.col("code")).alias("lang"))


LANGUAGES = Rows("code string, english_name string, native_name string, user_facing boolean", *[(k, *x) for k, x in v.LANGS.items()])


@query(f"WITH {ALL_CODES}, {LANGUAGES.sql('l')} SELECT k.code, coalesce(k.lang, 'zh') AS known, CASE WHEN l.user_facing THEN k.lang ELSE 'en' END AS shown, CASE WHEN k.lang = 'en' THEN english_name ELSE english_name || ' (' || native_name || ')' END AS name FROM k LEFT JOIN l ON k.lang = l.code")
def lang_names(spark, d):
    code = F.col("code")
    return _codes(spark, d).select("code", t.from_code_or(code, "zh").alias("known"), t.user_facing_or(code, "en").alias("shown"), t.display_name(t.lang_from_code(code)).alias("name"))


@query(f"WITH {LANGUAGES.sql('l')} SELECT code FROM l WHERE user_facing AND (contains(lower(english_name), 'ese') OR contains(lower(native_name), 'ese') OR contains(lower(code), 'ese'))")
def lang_search(spark, d):
    q = F.lit("ese")
    langs = routes.languages(spark).where("user_facing")
    return langs.where(F.contains(F.lower("english_name"), q) | F.contains(F.lower("native_name"), q) | F.contains(F.lower("code"), q)).select("code")


HISTORY = Rows(
    "id long, kind string, source_lang string, target_lang string, source_text string, translated_text string, image_path string, created_at long",
    (1, "image", "en", "zh", "first line\nsecond", "x", None, 1000), (2, "PDF", "xx", None, None, "y", "/a.png", 3000), (3, "nope", "ja", "en", "  " + "long " * 20, None, None, 3000), (4, None, "ko", "ja", "a", "b", "/b.png", 2000),
)


@query(f"WITH {HISTORY.sql('h')} SELECT id, CASE WHEN upper(kind) IN ('IMAGE', 'CAMERA', 'PDF', 'TEXT') THEN upper(kind) ELSE 'IMAGE' END AS kind, CASE WHEN source_lang IN ('en', 'ko', 'ja', 'zh') THEN source_lang ELSE 'en' END AS source_lang, CASE WHEN target_lang IN ('en', 'ko', 'ja', 'zh') THEN target_lang ELSE 'zh' END AS target_lang, coalesce(source_text, '') AS source_text, created_at::BIGINT AS created_at FROM h ORDER BY created_at DESC, id DESC LIMIT 3")
def history_recent(spark, d):
    return routes.recent(routes.decoded_history(HISTORY.df(spark)), 3).select("id", "kind", "source_lang", "target_lang", "source_text", "created_at")


@query(f"WITH {HISTORY.sql('h')} SELECT id, source_text, image_path FROM h WHERE id = 4 LIMIT 1")
def history_by_id(spark, d):
    return HISTORY.df(spark).where("id = 4").limit(1).select("id", "source_text", "image_path")


@query(f"WITH {HISTORY.sql('h')} SELECT count(*) AS n, count(image_path) AS with_image FROM h")
def history_count(spark, d):
    return HISTORY.df(spark).agg(F.count(F.lit(1)).alias("n"), F.count("image_path").alias("with_image"))


@query(f"WITH {HISTORY.sql('h')}, s AS (SELECT id, trim(string_split(trim(coalesce(source_text, '')), chr(10))[1]) AS s FROM h) SELECT id, CASE WHEN length(s) > 60 THEN s[:60] || '…' ELSE s END AS title FROM s")
def history_title(spark, d):
    return HISTORY.df(spark).select("id", t.title(F.col("source_text")).alias("title"))


@query(
    "WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{\"max_length\": ' || p_size * 20 || '}' ELSE '{\"unk_token_id\": ' || p_size || ', \"vocab_size\": ' || p_partkey || '}' END AS json FROM part) "
    "SELECT p_partkey, greatest(8, least(512, coalesce((json->>'max_length')::INT, 256))) AS max_length, coalesce((json->>'unk_token_id')::INT, 1) AS unk, coalesce((json->>'vocab_size')::INT, 58101) - 1 AS pad FROM r"
)
def json_defaults(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    json = F.when(key % 3 == 0, "{}").when(key % 3 == 1, F.concat(F.lit('{"max_length": '), (F.col("p_size") * 20).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"unk_token_id": '), size, F.lit(', "vocab_size": '), key.cast("string"), F.lit("}")))
    c = readers.config(json)
    return table(spark, d, "part").select("p_partkey", c["max_length"].alias("max_length"), c["unk"].alias("unk"), c["pad"].alias("pad"))


@query(r"SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '[\x00-\x08\x0A-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '" + '"' + r"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark, d):
    return table(spark, d, "pages").select("page_id", t.xml_escape(F.col("html")).alias("escaped"))


@query()
def noise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", udfs.add_noise(F.col("text"), F.col("lang"), F.col("doc_id"), probability=0.3).alias("noisy"))


@query("SELECT avg(CASE WHEN quality IS NOT DISTINCT FROM 1 - toxic THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate FROM labels")
def agreement_rate(spark, d):
    return table(spark, d, "labels").agg(metrics.agreement_rate(F.col("quality"), 1 - F.col("toxic")).alias("rate"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 9) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 9).alias("mean"))


@query("SELECT source, " + ", ".join(f"max(n) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def score_pivot(spark, d):
    rows = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return metrics.score_pivot(rows, "source", "lang", "n", ["de", "en", "es", "fr"])


@query(
    f"WITH {TURNS}, r AS (SELECT row_number() OVER () AS id, conv_id % 3 AS fold, regexp_extract_all(coalesce(ko, ''), '{NO_SPACE}+') AS h, regexp_extract_all(coalesce(en, ''), '{NO_SPACE}+') AS g FROM t), "
    "s AS (SELECT id, fold, 'h' AS side, h AS ws, array_to_string(h, '') AS cs FROM r UNION ALL SELECT id, fold, 'g', g, array_to_string(g, '') FROM r), "
    "w AS (SELECT id, fold, side, 'w' AS kind, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM s, generate_series(1, 4) o(n))), "
    "k AS (SELECT id, fold, side, 'c' AS kind, n, substr(cs, i, n) AS gram FROM (SELECT *, unnest(generate_series(1, length(cs) - n + 1)) AS i FROM s, generate_series(1, 6) o(n))), "
    "c AS (SELECT id, fold, kind, n, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'g') AS g FROM (SELECT * FROM w UNION ALL SELECT * FROM k) GROUP BY ALL), "
    "m AS (SELECT fold, kind, n, sum(least(h, g))::DOUBLE AS m, sum(h)::DOUBLE AS h, sum(g)::DOUBLE AS g FROM c GROUP BY ALL), "
    "b AS (SELECT fold, CASE WHEN count(*) FILTER (m > 0) = 4 THEN 100 * exp(sum(ln(CASE WHEN m > 0 THEN m / h END)) / 4 + least(0, 1 - max(g) FILTER (n = 1) / max(h) FILTER (n = 1))) ELSE 0 END AS bleu FROM m WHERE kind = 'w' GROUP BY fold), "
    "f AS (SELECT fold, 100 * sum(coalesce(5 * (m / nullif(h, 0)) * (m / nullif(g, 0)) / nullif(4 * (m / nullif(h, 0)) + m / nullif(g, 0), 0), 0)) / 8 AS chrf FROM m WHERE kind = 'c' OR n <= 2 GROUP BY fold) "
    "SELECT fold, round(coalesce(bleu, 0), 2) AS bleu, round(coalesce(chrf, 0), 2) AS chrf, n FROM (SELECT fold, count(*) AS n FROM r GROUP BY fold) LEFT JOIN b USING (fold) LEFT JOIN f USING (fold)"
)
def corpus_scores(spark, d):
    rows = _turns(spark, d).select((F.col("conv_id") % 3).alias("fold"), F.col("ko").alias("hyp"), F.col("en").alias("ref"))
    return metrics.corpus_scores(rows, ["fold"])


NOTES = Rows("id int, direct boolean, there boolean, back boolean", (1, True, False, False), (2, False, True, True), (3, False, True, False))


@query(f"WITH {NOTES.sql('r')} SELECT id, CASE WHEN direct THEN NULL WHEN there AND back THEN 'pivoted' ELSE 'unavailable' END AS note FROM r")
def route_notes(spark, d):
    return NOTES.df(spark).select("id", rules.note_for(F.col("direct"), F.col("there"), F.col("back")).alias("note"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END), ''), source) AS shown, CASE WHEN trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END) = '' THEN '' WHEN lang = 'en' THEN lang END AS plain FROM documents")
def fallback_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("x"))
    return rows.select("doc_id", rules.fallback(F.col("x"), F.col("source")).alias("shown"), rules.translatable(F.col("x"), F.col("lang"), F.lit("en")).alias("plain"))


@query("SELECT conv_id, turn, role FROM conversations WHERE turn >= 1 AND turn <= 2")
def page_range(spark, d):
    return rules.page_range(table(spark, d, "conversations").withColumnRenamed("turn", "page_no"), 0, 2).select("conv_id", F.col("page_no").alias("turn"), "role")




@query(
    "WITH k AS (SELECT conv_id, turn, role, list_filter(string_split(text, ' '), lambda x: x <> '' AND NOT regexp_matches(x, '^<.*>$')) AS kept FROM conversations WHERE text IS NOT NULL) "
    "SELECT conv_id, turn, role, len(kept)::INT AS n, array_to_string(list_append(list_transform(kept, lambda x: CASE x WHEN 'the' THEN 4 WHEN 'of' THEN 5 ELSE 1 END), 0), ' ') AS ids FROM k"
)
def special_tokens(spark, d):
    kept = rules.without_special(F.split("text", " "))
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "role", kept.alias("kept"))
    return rows.select("conv_id", "turn", "role", F.size("kept").alias("n"), F.array_join(F.transform(rules.encoded(F.col("kept"), {"the": 4, "of": 5}, 1, 0), lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT p_partkey, greatest(32, floor(p_size * 7.0 / 32 + 0.5)::INT * 32) AS rounded, greatest(320, least(2048, p_size * 60)) AS side, least(512, greatest(16, 3 * p_size + 8)) AS decode_limit FROM part")
def size_rules(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", rules.round_to_32(size * 7.0).alias("rounded"), rules.clamped(size * 60, 320, 2048).alias("side"), rules.decode_limit(size, F.lit(512)).alias("decode_limit"))


@query("WITH p AS (SELECT l_orderkey % 100 AS image_id, (l_partkey * 7919 % 16777216)::BIGINT AS argb FROM lineitem), l AS (SELECT *, (argb >> 16 & 255) AS r, (argb >> 8 & 255) AS g, (argb & 255) AS b, ((argb >> 16 & 255) * 299 + (argb >> 8 & 255) * 587 + (argb & 255) * 114) // 1000 AS lum FROM p), m AS (SELECT *, lum <= (min(lum) OVER (PARTITION BY image_id) + max(lum) OVER (PARTITION BY image_id)) / 2.0 AS dark FROM l), n AS (SELECT image_id, count(*) FILTER (dark) <= count(*) FILTER (NOT dark) AS ink_dark FROM m GROUP BY 1) SELECT image_id, floor(avg(r) FILTER (dark = ink_dark))::INT AS ink_r, floor(avg(g) FILTER (dark = ink_dark))::INT AS ink_g, floor(avg(b) FILTER (dark <> ink_dark))::INT AS ground_b FROM m JOIN n USING (image_id) GROUP BY 1")
def two_colours(spark, d):
    pixels = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("image_id"), (F.col("l_partkey") * 7919 % 16777216).cast("int").alias("argb"))
    return rules.two_colours(pixels).select("image_id", F.col("ink")[0].alias("ink_r"), F.col("ink")[1].alias("ink_g"), F.col("ground")[2].alias("ground_b"))


@query("WITH p AS (SELECT 'file ' || c_custkey AS path FROM customer) SELECT (SELECT string_agg(path, chr(10) ORDER BY path) FROM (SELECT path FROM p ORDER BY path LIMIT 12)) || CASE WHEN count(*) > 12 THEN chr(10) || '… and ' || (count(*) - 12) || ' more' ELSE '' END AS summary FROM p")
def missing_summary(spark, d):
    paths = table(spark, d, "customer").select(F.concat(F.lit("file "), F.col("c_custkey").cast("string")).alias("path"))
    return rules.missing_summary(paths)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') AND o_orderstatus <> 'O' AND o_orderpriority <> '' THEN o_orderstatus ELSE 'O' END AS lang, CASE o_orderpriority WHEN '1-URGENT' THEN 'red' WHEN '5-LOW' THEN 'green' ELSE 'grey' END AS flag FROM orders")
def lookups(spark, d):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", rules.detected(status, F.lit("O"), priority, ["F"]).alias("lang"), rules.looked_up(priority, {"1-URGENT": "red", "5-LOW": "green"}, "grey").alias("flag"))


@query("WITH t(s) AS (VALUES ('{n} {item}'), ('the {item} of {n}')), i(x) AS (VALUES ('cat'), ('sign'), ('door')), e AS (SELECT DISTINCT replace(replace(s, '{item}', x), '{n}', n::VARCHAR) AS source FROM t, i, generate_series(2, 99) g(n)) SELECT source FROM e ORDER BY ('0x' || substr(md5('11:' || source), 1, 15))::BIGINT, source LIMIT 100")
def mock_pairs(spark, d):
    return rules.mock_pairs(spark, [("{n} {item}", "{item} {n}"), ("the {item} of {n}", "{n} {item}")], [("cat", "a"), ("sign", "b"), ("door", "c")], 100, 11).select("source")


@query("SELECT source, batch, count(*) AS n, max(padded) AS padded FROM (SELECT source, batch, greatest(16, least(1200, ceil(max(n_chars / 100.0) OVER (PARTITION BY source, batch) * 48 / 8)::INT * 8)) AS padded FROM (SELECT source, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars / 100.0, doc_id) - 1) // 6 AS batch FROM documents)) GROUP BY ALL")
def aspect_batches(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", (F.col("n_chars") / 100.0).alias("ratio"))
    return layout.aspect_batches(rows, ["source"], "ratio", F.col("doc_id")).groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("padded").alias("padded"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 50 AS batch FROM orders")
def fixed_batches(spark, d):
    return layout.batches(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, F.col("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "batch")


@query("SELECT l_orderkey, l_linenumber, trim(l_returnflag) AS text FROM lineitem WHERE trim(l_returnflag) <> '' AND l_discount * 10 >= 0.5")
def confident_lines(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("text"), (F.col("l_discount") * 10).alias("confidence"))
    return rules.confident_lines(rows).select("l_orderkey", "l_linenumber", "text")


@query("SELECT map_id, seed, line FROM (SELECT l_suppkey AS map_id, l_orderkey AS seed, l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_quantity >= 12 AND l_discount * 10 >= 0.6 AND l_quantity / 4 >= 3.5) WHERE n <= 20")
def sound_components(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("map_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seed"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("size"), (F.col("l_discount") * 10).alias("score"), (F.col("l_quantity") / 4).alias("side"))
    return rules.sound_components(rows, side=3.5, most=20).select("map_id", F.col("o").alias("seed"), "line")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def only_regions(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return rules.only(rows, "r_name", ["ASIA", "EUROPE"], {r.r_name for r in table(spark, d, "region").select("r_name").collect()})  # a few regions


@query(f"WITH {TURNS} SELECT ko AS source, en AS target, true AS noisy FROM t")
def role_projection(spark, d):
    return rules.roles(_turns(spark, d), "ko", "en", True)


@query("SELECT doc_id, upper(lang) || ' → ' || upper(source) AS label, replace(text, '|', '\\|') AS cell FROM documents")
def labels_and_cells(spark, d):
    return table(spark, d, "documents").select("doc_id", t.direction_label(F.col("lang"), F.col("source")).alias("label"), t.markdown_cell(F.col("text")).alias("cell"))


@query("WITH s AS (SELECT doc_id, lang || CASE WHEN doc_id % 2 = 0 THEN '=' || source || '=x' ELSE '' END AS spec FROM documents) SELECT doc_id, split_part(spec, '=', 1) AS name, CASE WHEN contains(spec, '=') THEN spec[instr(spec, '=') + 1:] ELSE '' END AS path FROM s")
def model_specs(spark, d):
    spec = F.concat("lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("="), "source", F.lit("=x"))).otherwise(""))
    return table(spark, d, "documents").select("doc_id", t.name_and_path(spec).alias("s")).select("doc_id", "s.name", "s.path")


PARTICLES = "CASE WHEN unicode(right(word, 1)) BETWEEN 44032 AND 55203 AND (unicode(right(word, 1)) - 44032) % 28 <> 0 THEN '을' ELSE '를' END"


@query(f"WITH w AS (SELECT doc_id, lang || chr((44032 + doc_id * 13 % 11172)::INT) AS word FROM documents) SELECT doc_id, word, {PARTICLES} AS particle FROM w")
def particles(spark, d):
    code = F.lit(44032) + F.col("doc_id") * 13 % 11172
    octets = F.concat(F.hex((F.lit(224) + F.floor(code / 4096))), F.hex(F.lit(128) + F.floor(code / 64) % 64), F.hex(F.lit(128) + code % 64))
    word = F.concat("lang", F.decode(F.unhex(octets), "UTF-8"))
    return table(spark, d, "documents").select("doc_id", word.alias("word")).withColumn("particle", t.topic_particle(F.col("word"), "을", "를"))


@query("SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice::DOUBLE * 1.6 / (p_size - 5) ELSE 0.0 END AS unclip FROM part")
def unclip_distances(spark, d):
    return table(spark, d, "part").select("p_partkey", layout.unclip_distance(F.col("p_retailprice").cast("double"), (F.col("p_size") - 5).cast("double")).alias("unclip"))


@query("SELECT p_partkey, CASE WHEN p_partkey >= 4800 THEN pow(2, floor(log2(p_partkey / 2400.0)))::INT ELSE 1 END AS sample, [greatest(0.0, least(40.0, p_size * 2.0)), greatest(0.0, least(30.0, (p_size - 9) * 0.5))]::VARCHAR AS corner FROM part")
def sizes_and_corners(spark, d):
    quad = F.array(*[F.col("p_size").cast("double"), (F.col("p_size") - 9).cast("double")] * 4)
    corner = F.slice(rules.clamped_corners(rules.scaled_corners(quad, 2.0, 0.5), 40.0, 30.0), F.lit(1), F.lit(2))
    return table(spark, d, "part").select("p_partkey", rules.sample_size(F.col("p_partkey"), 2400).alias("sample"), F.concat(F.lit("["), F.array_join(F.transform(corner, lambda x: x.cast("string")), ", "), F.lit("]")).alias("corner"))


@query("SELECT doc_id, text FROM documents WHERE trim(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE text END) <> ''")
def translated_blocks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("text")).alias("translation"))
    return rules.translated_blocks(rows).select("doc_id", "text")


@query("SELECT conv_id AS source, min(text) FILTER (turn = lo) AS reference, max(text) FILTER (role = 'user' AND turn = hi_u) AS user, max(text) FILTER (role = 'assistant' AND turn = hi_a) AS assistant FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS hi_u, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS hi_a FROM conversations) GROUP BY conv_id")
def sample_table(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("source"), F.col("text").alias("reference"), F.col("role").alias("model"), F.col("text").alias("hypothesis"), F.col("turn").alias("at"))
    return rules.sample_table(rows, ["user", "assistant"]).select("source", "reference", "user", "assistant")


@query("SELECT source, min(side) AS side, arg_min(at_, (side, at_)) AS at FROM (SELECT lang AS source, 0 AS side, doc_id AS at_ FROM documents UNION ALL SELECT source, 1, doc_id FROM documents) GROUP BY source")
def ordered_union(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("at"), "lang", "source")
    return rules.ordered_union(rows.select(F.col("lang").alias("source"), "at"), rows.select("source", "at"), "source")


@query("SELECT src || '-' || tgt AS pair, rank FROM (VALUES (0, 'en', 'ko'), (1, 'ko', 'en'), (2, 'en', 'ja'), (3, 'ja', 'en'), (4, 'en', 'zh'), (5, 'zh', 'en')) p(rank, src, tgt) WHERE 'mt/' || src || '-' || tgt IN ('mt/en-ja', 'mt/zh-en', 'mt/none')")
def existing_pairs(spark, d):
    paths = routes.pair_models(spark).select("rank", F.concat_ws("-", "src", "tgt").alias("pair")).withColumn("path", F.concat(F.lit("mt/"), "pair"))
    return routes.existing(paths, spark.createDataFrame([("mt/en-ja",), ("mt/zh-en",), ("mt/none",)], "path string")).select("pair", "rank")


@query(f"WITH {HISTORY.sql('h')} SELECT id, image_path FROM h WHERE image_path IS NOT NULL")
def history_images(spark, d):
    return HISTORY.df(spark).where("image_path is not null").select("id", "image_path")


@query()
def side_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", udfs.side_key(F.col("text")).alias("side_key"))


@query()
def map_boxes(spark, d):
    """Every vector as a map eight cells wide."""
    rows = table(spark, d, "embeddings").where("size(embedding) % 8 = 0 and size(embedding) > 0")
    maps = rows.select(F.col("vec_id").alias("map_id"), F.lit(8).alias("width"), (F.size("embedding") / 8).cast("int").alias("height"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * 4).alias("cells"))
    return arrays.map_boxes(maps, least=3, score=0.4)
