"""Readers of line formats: each keeps its own leniency."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.session import durable


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0 in each file) and value of text files. Parts of a file are counted apart; no task reads a whole one."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = durable(rows, "numbered-lines")
    parts = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each part of a file
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = parts.select("file", "block", (before - F.col("first")).alias("shift"))
    return rows.join(starts, ["file", "block"]).select((F.col("at") + F.col("shift")).cast("long").alias("line_no"), "value")


def moses(spark: SparkSession, en_path: str, ko_path: str) -> DataFrame:
    """Lines side by side, to the end of the shorter file."""
    a = numbered_lines(spark, en_path).withColumnRenamed("value", "en")
    b = numbered_lines(spark, ko_path).withColumnRenamed("value", "ko")
    return a.join(b, "line_no")


def parallel_strict(spark: SparkSession, en_path: str, ko_path: str) -> DataFrame:
    """As moses; files of different length are an error."""
    n = [spark.read.text(p).count() for p in (en_path, ko_path)]
    if n[0] != n[1]:
        raise ValueError(f"line counts differ: {n[0]} and {n[1]}")
    return moses(spark, en_path, ko_path)


PAIRED = "line_no long, en string, ko string"


def _archive(spark: SparkSession, path: str, pairs) -> DataFrame:
    """line_no, en, ko of archives, each read in one task: pairs(bytes) gives two iterators of lines."""

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                a = enumerate(pairs(data.as_py()))
                while part := list(islice(a, 10_000)):
                    yield pa.RecordBatch.from_pydict({"line_no": [i for i, _ in part], "en": [x for _, (x, _) in part], "ko": [y for _, (_, y) in part]}, pa.schema([("line_no", pa.int64()), ("en", pa.string()), ("ko", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PAIRED)


def moses_zip(spark: SparkSession, path: str) -> DataFrame:
    """The first .en and .ko members of a zip file side by side, to the end of the shorter; bad bytes are replaced."""

    def pairs(data: bytes):
        import io
        import zipfile

        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members = [next((n for n in z.namelist() if n.endswith(end)), None) for end in (".en", ".ko")]
            if None in members:
                raise ValueError(f"no .en and .ko members in {z.namelist()}")
            with z.open(members[0]) as a, z.open(members[1]) as b:
                both = [(x.rstrip("\n") for x in io.TextIOWrapper(f, encoding="utf-8", errors="replace")) for f in (a, b)]
                yield from zip(*both, strict=False)

    return _archive(spark, path, pairs)


def flores_tar(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The English and Korean members of a split of a gzipped tar file, line by line; different lengths are an error."""

    def pairs(data: bytes):
        import io
        import tarfile

        sides = {}
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
            for m in t:
                for lang in ("eng_Latn", "kor_Hang"):
                    if m.name.endswith(f"{split}/{lang}.{split}"):
                        sides[lang] = t.extractfile(m).read().decode("utf-8").splitlines()
        en, ko = sides["eng_Latn"], sides["kor_Hang"]
        if len(en) != len(ko):
            raise ValueError(f"{split}: {len(en)} English lines, {len(ko)} Korean")
        yield from zip(en, ko, strict=True)

    return _archive(spark, path, pairs)


def lines_strict(spark: SparkSession, path: str) -> DataFrame:
    """line_no and value, blank lines too; an empty file is an error."""
    rows = numbered_lines(spark, path)
    if rows.isEmpty():
        raise ValueError(f"{path}: empty")
    return rows


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content (binary) and text (UTF-8) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.decode("content", "UTF-8").alias("text"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, name (the last part), length and size label of the files under a folder, from metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("size", t.size_label(F.col("length")))


def evaluation_sets(spark: SparkSession, folder: str, names: list[str], most: int = 0, schema: str = "en string, ko string, src string") -> tuple[DataFrame, list[str]]:
    """Rows of the sets (name.jsonl) that are there, tagged with set; and the names of those that are not. most > 0: so many rows of each."""
    present, out = {r.name for r in listed(spark, folder).select("name").collect()} if names else set(), None
    for name in names:
        if f"{name}.jsonl" in present:
            rows = jsonl(spark, f"{folder}/{name}.jsonl", schema)
            rows = (rows.limit(most) if most > 0 else rows).withColumn("set", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
    empty = spark.createDataFrame([], f"{schema}, set string")
    return empty if out is None else out, [n for n in names if f"{n}.jsonl" not in present]


def tatoeba(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return spark.read.text(path).where((F.size(f) >= 4) & (f[0] == "eng") & F.startswith(F.get(f, F.lit(1)), F.lit("kor"))).select(F.get(f, F.lit(2)).alias("en"), F.get(f, F.lit(3)).alias("ko"))


def app_domain(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered_lines(spark, path).where("line_no > 0 and trim(value) <> '' and not startswith(value, '#')")
    f = F.split("value", "\t")
    return rows.select(*[F.coalesce(F.get(f, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("en", "ko", "category"))])


def jsonl(spark: SparkSession, path: str, schema: str = "en string, ko string, src string") -> DataFrame:
    """Blank lines are skipped, malformed ones an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tsv_strict(spark: SparkSession, path: str) -> DataFrame:
    """Exactly two fields that are not blank; anything else, or an empty file, is an error that names the line."""
    f = F.split("value", "\t")
    rows = numbered_lines(spark, path).where("trim(value) <> ''")
    good = (F.size(f) == 2) & (F.trim(f[0]) != "") & (F.trim(F.get(f, F.lit(1))) != "")
    bad = rows.where(~good).agg(F.min("line_no"), F.count(F.lit(1))).first()
    if bad[1]:
        raise ValueError(f"{path}:{bad[0] + 1}: expected two fields")
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    return rows.select(F.trim(f[0]).alias("source"), F.trim(f[1]).alias("target"))


def vocab(lines: DataFrame) -> DataFrame:
    """line_no, value to token, id: parted at the last tab; bad ids are skipped, the last of equal tokens wins."""
    parts = lines.select("line_no", F.regexp_extract("value", r"^(.+)\t([^\t]*)$", 1).alias("token"), F.expr(r"try_cast(regexp_extract(value, '^(.+)\\t([^\\t]*)$', 2) as int)").alias("id"))
    return parts.where("token <> '' and id is not null").groupBy("token").agg(F.max_by("id", "line_no").alias("id"))


def vocab_strict(lines: DataFrame) -> tuple[DataFrame, int]:
    """vocab, and the id of <unk> (0 if it has none); no rows are an error."""
    rows = vocab(lines)
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("token") == "<unk>", F.col("id"))).alias("unk")).first()
    if not got.n:
        raise ValueError("a vocabulary without rows")
    return rows, got.unk or 0


def exported_vocab(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Source and target vocabulary of an export; without a source table both are the target's."""
    names = {r.name for r in listed(spark, folder).select("name").collect()}
    target = vocab(numbered_lines(spark, f"{folder}/vocab.tsv"))
    return (vocab(numbered_lines(spark, f"{folder}/source_vocab.tsv")) if "source_vocab.tsv" in names else target), target


def pieces(lines: DataFrame) -> DataFrame:
    """line_no, value to piece, score: parted at the first tab; bad scores are skipped, the last wins."""
    parts = lines.where(F.instr("value", "\t") > 1).select("line_no", F.substring_index("value", "\t", 1).alias("piece"), F.expr(r"try_cast(substr(value, instr(value, '\t') + 1) as float)").alias("score"))
    return parts.where("score is not null").groupBy("piece").agg(F.max_by("score", "line_no").alias("score"))


def longest_piece(rows: DataFrame) -> int:
    """The length of the longest piece, 0 without any."""
    return rows.agg(F.coalesce(F.max(F.length("piece")), F.lit(0))).first()[0]


def char_dict(glyphs: list[str], classes: int) -> list[str]:
    """Labels by class: 0 is the blank; one class beyond the glyphs is a space. Trailing empty lines do not count."""
    while glyphs and glyphs[-1] == "":
        glyphs = glyphs[:-1]
    if classes - len(glyphs) not in (1, 2):
        raise ValueError(f"{classes} classes do not fit {len(glyphs)} glyphs")
    return ["", *glyphs, *[" "] * (classes - len(glyphs) - 1)]


CONFIG = "vocab_size int, eos_token_id int, unk_token_id int, pad_token_id int, decoder_start_token_id int, max_length int"


def config(json) -> dict:
    """Columns of a model configuration with its defaults; max_length lies in 8 to 512."""
    c = F.from_json(json, CONFIG)
    own = lambda k, d: F.coalesce(c[k], d)
    pad = own("pad_token_id", own("vocab_size", F.lit(58_101)) - 1)
    return {"eos": own("eos_token_id", F.lit(0)), "unk": own("unk_token_id", F.lit(1)), "pad": pad, "start": own("decoder_start_token_id", pad), "max_length": F.greatest(F.lit(8), F.least(F.lit(512), own("max_length", F.lit(256))))}


def releases(spark: SparkSession, path: str) -> DataFrame:
    """corpus, version, url, pairs from a catalogue document; null pairs are 0, the last of equal names wins."""
    schema = "corpora array<struct<corpus:string,version:string,url:string,alignment_pairs:bigint>>"
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("corpora").alias("at", "c"))
    last = each.groupBy(F.col("c.corpus").alias("corpus")).agg(F.max_by("c", "at").alias("c"))
    return last.select("corpus", "c.version", "c.url", F.coalesce("c.alignment_pairs", F.lit(0)).alias("pairs"))
