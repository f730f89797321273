"""Layout of text lines: geometry, paragraphs, reading order, joining and redistribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions import values as v
from corpusloom.session import durable


def quad_metrics(q: Column) -> dict[str, Column]:
    """Of eight numbers, clockwise from the top left: width, height, angle, bounds."""
    x, y = [q[2 * i] for i in range(4)], [q[2 * i + 1] for i in range(4)]
    edge = lambda a, b: F.hypot(x[a] - x[b], y[a] - y[b])
    return {
        "width": (edge(0, 1) + edge(3, 2)) / 2,
        "height": (edge(0, 3) + edge(1, 2)) / 2,
        "angle": F.degrees(F.atan2(y[1] - y[0], x[1] - x[0])),
        "left": F.least(*x), "right": F.greatest(*x), "top": F.least(*y), "bottom": F.greatest(*y),
        "center_x": sum(x[1:], x[0]) / 4, "center_y": sum(y[1:], y[0]) / 4,
    }


def unclip_distance(area: Column, perimeter: Column, ratio: float = 1.6) -> Column:
    return F.when(perimeter > 0, area * ratio / perimeter).otherwise(F.lit(0.0))


def ranked(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their rank from 1 by order: a range sort, then each partition's count before it. No task holds all rows."""
    rows = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def islands(rows: DataFrame, by: list[str], order: list[Column], new: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 1; new (an expression over lag) starts a run."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = rows.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1)))
    return flagged.withColumn(name, F.sum("_new").over(w).cast("long")).drop("_new")


def paragraphs(lines: DataFrame) -> DataFrame:
    """lines (page_id, line_no, quad) with para: lines continue one while size, angle, gap and columns agree."""
    for k, c in quad_metrics(F.col("quad")).items():
        lines = lines.withColumn(f"_{k}", c)
    w = Window.partitionBy("page_id").orderBy("line_no")
    was = lambda k: F.lag(f"_{k}").over(w)
    for k in ("height", "angle", "left", "right", "top", "bottom"):
        lines = lines.withColumn(f"_p_{k}", was(k))
    here, prev = (lambda k: F.col(f"_{k}")), (lambda k: F.col(f"_p_{k}"))
    tall, low = F.greatest(here("height"), prev("height")), F.least(here("height"), prev("height"))
    mid = lambda side: (side("top") + side("bottom")) / 2
    overlap = F.least(here("right"), prev("right")) - F.greatest(here("left"), prev("left"))
    narrow = F.least(here("right") - here("left"), prev("right") - prev("left"))
    goes_on = (low > 0) & (tall <= low * v.MAX_HEIGHT_RATIO) & (F.abs(here("angle") - prev("angle")) <= v.MAX_ANGLE_DELTA) & (here("top") - prev("bottom") <= tall * v.MAX_LINE_GAP) & (mid(here) >= mid(prev)) & (narrow > 0) & (overlap >= narrow * v.MIN_OVERLAP)
    out = islands(lines.withColumn("_on", goes_on), ["page_id"], [F.col("line_no")], ~F.col("_on"), "para")
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def reading_order(lines: DataFrame) -> DataFrame:
    """lines (page_id, line_no, quad) with pos from 1: rows of lines by centre, then left to right.

    A line opens a row where its centre is beyond the tolerance of the line before
    (by centre), so that the order is total.
    """
    m = quad_metrics(F.col("quad"))
    rows = lines.withColumn("_c", (m["top"] + m["bottom"]) / 2).withColumn("_h", m["bottom"] - m["top"]).withColumn("_l", m["left"])
    w = Window.partitionBy("page_id").orderBy("_c", "_l", "line_no")
    new = F.col("_c") - F.lag("_c").over(w) > F.least("_h", F.lag("_h").over(w)) * v.ROW_TOLERANCE
    banded = islands(rows.withColumn("_n", new), ["page_id"], [F.col("_c"), F.col("_l"), F.col("line_no")], F.col("_n"), "band")
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("band", "_l", "line_no"))
    return banded.withColumn("pos", pos).drop("_c", "_h", "_l", "_n")


def upper_median(rows: DataFrame, by: str, x: str) -> DataFrame:
    """by and upper_median, the upper of x's two middle values. Equal values are counted first, so that a group's window is over its different ones."""
    counts = rows.groupBy(by, x).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by)
    ranked = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(x))).withColumn("_all", F.sum("_n").over(w))
    return ranked.where("_upto > _all div 2").groupBy(by).agg(F.min(x).alias("upper_median"))


def line_widths(lines: DataFrame, by: list[str]) -> DataFrame:
    """by and width: the widest line, along its own base line."""
    return lines.groupBy(*by).agg(F.max(quad_metrics(F.col("quad"))["width"]).alias("width"))


def join_lines(lines: Column) -> Column:
    """Lines as one text: no space where the text so far ends in a CJK character and the next line begins with one."""
    glue = lambda s, x: F.when(s == "", x).when(t.is_cjk(F.right(s, F.lit(1))) & t.is_cjk(F.left(x, F.lit(1))), F.concat(s, x)).otherwise(F.concat(s, F.lit(" "), x))
    return F.trim(F.aggregate(lines, F.lit(""), glue))


def page_text(paras: Column) -> Column:
    """Paragraphs joined by line feeds, none before the first that has text."""
    return F.aggregate(paras, F.lit(""), lambda s, x: F.when(s == "", x).otherwise(F.concat(s, F.lit("\n"), x)))


def redistribute(text: Column, lengths: Column, strict: bool = False) -> Column:
    """text dealt to lines in proportion to lengths, cut at spaces; strict drops the character at every cut."""
    total = F.aggregate(lengths, F.lit(0), lambda s, x: s + F.greatest(F.lit(1), x))
    n, last = F.length(text), F.size(lengths)

    def step(s: Column, i: Column) -> Column:
        at = s["at"]
        take = F.floor(n * F.greatest(F.lit(1), F.get(lengths, i)) / total + 0.5).cast("int")
        end = F.least(n, at + take)
        back = F.instr(F.reverse(F.substr(text, at + 1, F.greatest(F.lit(0), end - at + 1))), " ")
        space = end + 1 - back
        cut = F.when((end < n) & (back > 0) & (space > at), space).otherwise(end)
        piece = F.when(i == last - 1, F.substr(text, at + 1, n)).otherwise(F.substr(text, at + 1, F.greatest(F.lit(0), cut - at)))
        skip = F.lit(1) if strict else F.when(F.substr(text, cut + 1, F.lit(1)) == " ", 1).otherwise(0)
        return F.struct(F.least(n, cut + skip).alias("at"), F.concat(s["out"], F.array(F.trim(piece))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), last - 1), start, step, lambda s: s["out"])


def batches(rows: DataFrame, size: int, *order: Column) -> DataFrame:
    """rows with batch from 0: consecutive slices of `size` by order."""
    return ranked(rows, "batch", *order).withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("long"))


def aspect_batches(rows: DataFrame, by: list[str], ratio: str, *order: Column, size: int = 6) -> DataFrame:
    """rows with batch (from 0, within by, by ascending ratio) and the width that its widest is padded to."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("batch", F.floor((F.row_number().over(w.orderBy(ratio, *order)) - 1) / size).cast("long"))
    return out.withColumn("padded", padded_width(F.max(ratio).over(Window.partitionBy(*by, "batch"))))


def padded_width(most: Column) -> Column:
    return F.greatest(F.lit(16), F.least(F.lit(1200), (F.ceil(most * 48 / 8) * 8).cast("int")))


def chunks(pieces: Column, cost, most: int = 192) -> Column:
    """Sentences packed greedily to at most `most` tokens by cost; one that is too long stays whole."""

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] > 0) & (s["n"] + cost(x) <= most)
        head = F.slice(s["out"], F.lit(1), F.greatest(F.lit(0), F.size(s["out"]) - 1))
        grown = F.concat(head, F.array(F.concat_ws(" ", F.element_at(s["out"], F.greatest(F.lit(1), F.size(s["out"]))), x)))
        return F.when(fits, F.struct((s["n"] + cost(x)).alias("n"), grown.alias("out"))).otherwise(F.struct(cost(x).alias("n"), F.concat(s["out"], F.array(x)).alias("out")))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")), step, lambda s: s["out"])
