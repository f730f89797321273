"""Small filters, classifications and closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(rows: DataFrame, column: str, wanted: list[str], known: set[str]) -> DataFrame:
    """Rows whose column is among wanted, in their own order; a name that is not known, or none at all, is an error. No names: all rows."""
    if missing := sorted(set(wanted) - known):
        raise ValueError(f"unknown: {', '.join(missing)}")
    out = rows.where(F.col(column).isin(*wanted)) if wanted else rows
    if out.isEmpty():
        raise ValueError("nothing matches")
    return out


def confident_lines(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Trimmed lines with text and enough confidence."""
    return lines.withColumn("text", F.trim("text")).where((F.col("text") != "") & (F.col("confidence") >= least))


def sound_components(rows: DataFrame, size: int = 12, score: float = 0.6, side: float = 3.0, most: int = 1000) -> DataFrame:
    """Components (map_id, seed, size, score, side) that pass, the first `most` of a map by seed."""
    from pyspark.sql import Window

    good = rows.where((F.col("size") >= size) & (F.col("score") >= score) & (F.col("side") >= side))
    return good.withColumn("_n", F.row_number().over(Window.partitionBy("map_id").orderBy("seed"))).where(F.col("_n") <= most).drop("_n")


def note_for(direct: Column, to_english: Column, from_english: Column) -> Column:
    """Null where a direct route is there, pivoted where both halves are, else unavailable."""
    return F.when(direct, F.lit(None).cast("string")).when(to_english & from_english, "pivoted").otherwise("unavailable")


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages from max(1, first) to last, to the end where last is 0 or less."""
    out = pages.where(F.col("page_no") >= max(1, first))
    return out if last <= 0 else out.where(F.col("page_no") <= last)


def fallback(translation: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(translation), F.lit("")), source)


def translatable(text: Column, source: Column, target: Column) -> Column:
    """What needs no model: blank text is empty, one language is the text itself; else null."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").when(source == target, text)


def without_special(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: (x != "") & ~x.rlike(r"^<.*>$"))


def detected(guess: Column, source: Column, second: Column, visible: list[str]) -> Column:
    """The guessed language if users see it, it differs, and the second pass found text."""
    return F.when(guess.isin(*visible) & (guess != source) & (F.coalesce(second, F.lit("")) != ""), guess).otherwise(source)


def looked_up(key: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def roles(rows: DataFrame, source: str, target: str, noisy: bool) -> DataFrame:
    return rows.select(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(noisy).alias("noisy"))


def encoded(pieces: Column, ids: dict[str, int], unknown: int, end: int) -> Column:
    """Ids of pieces, the end id after them."""
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    return F.array_append(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), F.lit(unknown))), F.lit(end))


def round_to_32(x: Column) -> Column:
    return F.greatest(F.lit(32), (F.floor(x / 32 + 0.5) * 32).cast("int"))


def clamped(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def decode_limit(n: Column, most: Column) -> Column:
    return F.least(most, F.greatest(F.lit(16), F.floor(3.0 * n).cast("int") + 8))


def sample_size(longest: Column, goal: int) -> Column:
    """The largest power of two by which the longest side stays at goal or more; 1 at least."""
    return F.when(longest >= 2 * goal, F.pow(F.lit(2.0), F.floor(F.log2(longest / goal)))).otherwise(1.0).cast("int")


def luminance(argb: Column) -> Column:
    part = lambda n: F.shiftright(argb, n).bitwiseAND(F.lit(255))
    return F.floor((part(16) * 299 + part(8) * 587 + part(0) * 114) / 1000).cast("int")


def two_colours(pixels: DataFrame) -> DataFrame:
    """Pixels (image_id, argb): mean RGB of the ink and of the ground. The classes part at the middle of the luminance range; the smaller is ink, the darker one of equals."""
    lum = pixels.withColumn("_l", luminance(F.col("argb")))
    span = lum.groupBy("image_id").agg(((F.min("_l") + F.max("_l")) / 2).alias("_mid"))
    rows = lum.join(span, "image_id").withColumn("_dark", F.col("_l") <= F.col("_mid"))
    part = lambda n: F.shiftright(F.col("argb"), n).bitwiseAND(F.lit(255))
    mean = lambda n, dark: F.floor(F.avg(F.when(F.col("_dark") == dark, part(n)))).cast("int")
    rgb = lambda dark: F.array(mean(16, dark), mean(8, dark), mean(0, dark))
    n = rows.groupBy("image_id").agg(rgb(True).alias("d"), rgb(False).alias("b"), F.sum(F.col("_dark").cast("int")).alias("nd"), F.count(F.lit(1)).alias("n"))
    dark_ink = F.col("nd") <= F.col("n") - F.col("nd")
    return n.select("image_id", F.when(dark_ink, F.col("d")).otherwise(F.col("b")).alias("ink"), F.when(dark_ink, F.col("b")).otherwise(F.col("d")).alias("ground"))


def missing_summary(paths: DataFrame, shown: int = 12) -> DataFrame:
    """One text: the first paths, and how many more there are. Only `shown` rows are gathered."""
    n = paths.agg(F.count(F.lit(1)).alias("n"))
    first = paths.orderBy("path").limit(shown).agg(F.array_sort(F.collect_list("path")).alias("first"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n… and "), F.col("n") - shown, F.lit(" more"))).otherwise("")
    return first.crossJoin(n).select(F.concat(F.array_join("first", "\n"), more).alias("summary"))  # one row each


def tree_size(spark, path: str) -> DataFrame:
    """Files and bytes under a folder, from metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def mock_pairs(spark, templates: list[tuple[str, str]], items: list[tuple[str, str]], size: int, seed: int) -> DataFrame:
    """Distinct pairs of templates with {item} and {n} filled in, `size` of them by hash order. The lists are fixed and small."""
    from corpusloom.functions.text import h60

    t = spark.createDataFrame(templates, "t_source string, t_target string")
    i = spark.createDataFrame(items, "i_source string, i_target string")
    every = t.crossJoin(i).withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(99))))
    fill = lambda x: F.replace(F.replace(f"t_{x}", F.lit("{item}"), F.col(f"i_{x}")), F.lit("{n}"), F.col("n").cast("string"))
    pairs = every.select(fill("source").alias("source"), fill("target").alias("target")).distinct()
    return pairs.orderBy(h60(F.concat(F.lit(f"{seed}:"), "source")), "source", "target").limit(size)


def ordered_corners(quad: Column) -> Column:
    """Corners as top left, top right, bottom right, bottom left, by x + y and x - y; as given where two would be one."""
    corner = [F.struct(quad[2 * k].alias("x"), quad[2 * k + 1].alias("y"), F.lit(k).alias("k")) for k in range(4)]
    every = F.array(*corner)
    by = lambda f, least: F.get(F.array_sort(F.transform(every, lambda c: F.struct((f(c) if least else -f(c)).alias("v"), c["k"].alias("k")))), F.lit(0))["k"]
    add, less = (lambda c: c["x"] + c["y"]), (lambda c: c["x"] - c["y"])
    at = F.array(by(add, True), by(less, False), by(add, False), by(less, True))
    flat = F.flatten(F.transform(at, lambda k: F.array(F.get(every, k)["x"], F.get(every, k)["y"])))
    one = lambda i, j: F.get(at, F.lit(i)) == F.get(at, F.lit(j))
    return F.when(one(0, 2) | one(1, 3) | one(0, 1) | one(3, 2), quad).otherwise(flat)


def scaled_corners(quad: Column, sx: float, sy: float) -> Column:
    return F.transform(quad, lambda x, i: x * F.when(i % 2 == 0, F.lit(sx)).otherwise(F.lit(sy)))


def clamped_corners(quad: Column, width: float, height: float) -> Column:
    """Every corner within [0, width] x [0, height]."""
    return F.transform(quad, lambda x, i: F.greatest(F.lit(0.0), F.least(F.when(i % 2 == 0, F.lit(width)).otherwise(F.lit(height)), x)))


def translated_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose translation is not blank."""
    return blocks.where(F.trim(F.coalesce("translation", F.lit(""))) != "")


def sample_table(rows: DataFrame, models: list[str]) -> DataFrame:
    """rows (source, reference, model, hypothesis, at) to one row for each source, in the first one's place, with a column for each model's last hypothesis."""
    of = lambda m: F.max_by("hypothesis", F.when(F.col("model") == m, F.col("at"))).alias(m)
    return rows.groupBy("source").agg(F.min_by("reference", "at").alias("reference"), F.min("at").alias("at"), *[of(m) for m in models])


def ordered_union(first: DataFrame, more: DataFrame, column: str) -> DataFrame:
    """Different values of column with their place (side, at): those of first before those of more, each where it came first. Both have `at`."""
    both = first.select(column, F.lit(0).alias("side"), "at").unionAll(more.select(column, F.lit(1).alias("side"), "at"))
    return both.groupBy(column).agg(F.min(F.struct("side", "at")).alias("first")).select(column, "first.side", "first.at")


def report_json(scores: DataFrame, samples: DataFrame, models: list[str], most: int = 15) -> str:
    """As report, as JSON: scores by key and model, and the first samples; both are small."""
    import json

    table = {r.key: {m: r[m] for m in models if r[m] is not None} for r in scores.orderBy("key").collect()}
    first = [{"source": r.source, "reference": r.reference} for r in samples.orderBy("source").limit(most).collect()]
    return json.dumps({"models": models, "scores": table, "samples": first}, ensure_ascii=False, indent=2)


def report(scores: DataFrame, samples: DataFrame, models: list[str], most: int = 15) -> str:
    """Markdown of a pivoted score table (key, one column a model) and of the first samples (source, reference); both are small."""
    cell = lambda x: "-" if x is None else str(x).replace("|", "\\|")
    lines = ["| set | " + " | ".join(models) + " |", "|-" * (len(models) + 1) + "|"]
    lines += ["| " + " | ".join([cell(r.key), *[cell(r[m]) for m in models]]) + " |" for r in scores.orderBy("key").collect()]
    lines += ["", "| source | reference |", "|-|-|"]
    lines += [f"| {cell(r.source)} | {cell(r.reference)} |" for r in samples.orderBy("source").limit(most).collect()]
    return "\n".join(lines) + "\n"
