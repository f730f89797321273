"""Array kernels: argmax, CTC decoding, vocabulary lookups, components of maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax_first(values: Column) -> Column:
    """The first index, from 0, of the largest number that is not NaN; -1 if there is none."""
    real = F.filter(values, lambda x: ~F.isnan(x))
    return F.when(F.size(real) > 0, F.array_position(values, F.array_max(real)) - 1).otherwise(F.lit(-1)).cast("int")


def ctc_kept(labels: Column) -> Column:
    """Steps, from 0, whose label differs from the step before and is not the blank 0."""
    return F.filter(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: (F.get(labels, i) != 0) & ((i == 0) | (F.get(labels, i) != F.get(labels, i - 1))))


def ctc_text(labels: Column, glyphs: Column) -> Column:
    """Kept labels as glyphs; glyph i belongs to label i + 1, the label beyond them is a space."""
    return F.array_join(F.transform(ctc_kept(labels), lambda i: F.coalesce(F.get(glyphs, F.get(labels, i) - 1), F.lit(" "))), "")


def ctc_confidence(labels: Column, maxima: Column) -> Column:
    """The mean of the kept steps' maxima; 0 if none."""
    kept = ctc_kept(labels)
    total = F.aggregate(kept, F.lit(0.0), lambda s, i: s + F.get(maxima, i))
    return F.coalesce(F.try_divide(total, F.size(kept).cast("double")), F.lit(0.0))


def steps_of(logits: Column, classes: int) -> Column:
    """A flat array as one array for each step."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(logits) / classes).cast("int") - 1), lambda i: F.slice(logits, i * classes + 1, F.lit(classes)))


def components(flat: list[float], width: int, height: int, threshold: float = 0.3, least: int = 12, score: float = 0.6) -> list[tuple[float, list[tuple[int, int]]]]:
    """8-connected regions of a probability map over the threshold: (mean, pixels), in raster order of their first pixel."""
    grid = np.asarray(flat, float).reshape(height, width)
    open_, out = grid > threshold, []
    for y, x in zip(*np.nonzero(open_), strict=True):
        if open_[y, x]:
            todo, got = [(y, x)], []
            open_[y, x] = False
            while todo:
                a, b = todo.pop()
                got.append((int(b), int(a)))
                for c in range(max(0, a - 1), min(height, a + 2)):
                    for d in range(max(0, b - 1), min(width, b + 2)):
                        if open_[c, d]:
                            open_[c, d] = False
                            todo.append((c, d))
            mean = float(np.mean([grid[q, p] for p, q in got]))
            if len(got) >= least and mean >= score:
                out.append((mean, got))
    return out


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise from the leftmost point."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def least_rectangle(points: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Area and corners of the smallest rectangle on an edge of the hull; the first of equals."""
    h, best = np.array(hull(points), float), (np.inf, [])
    for i in range(len(h)):
        edge = h[(i + 1) % len(h)] - h[i]
        if not (size := np.hypot(*edge)):
            continue
        u = edge / size
        turn = np.array([u, [-u[1], u[0]]])
        r = h @ turn.T
        (a, b), (c, d) = r.min(0), r.max(0)
        if (c - a) * (d - b) < best[0]:
            best = ((c - a) * (d - b), [tuple(map(float, p @ turn)) for p in np.array([[a, b], [c, b], [c, d], [a, d]])])
    return best


BOXES = "map_id long, seed int, size int, score double, area double, corners array<double>"


def map_boxes(maps: DataFrame, threshold: float = 0.3, least: int = 12, score: float = 0.6) -> DataFrame:
    """maps (map_id, width, height, cells: flat probabilities) to a row for each region that passes: its first cell, cells, mean, and smallest rectangle.

    A map is one row and is read in one task. A region's hull is taken over the ends of its rows of cells.
    """

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                for mean, cells in components(r["cells"], r["width"], r["height"], threshold, least, score):
                    ends = {}
                    for x, y in cells:
                        low, high = ends.get(y, (x, x))
                        ends[y] = min(low, x), max(high, x)
                    area, corners = least_rectangle([(x, y) for y, both in ends.items() for x in both])
                    seed = min(y * r["width"] + x for x, y in cells)
                    out.append({"map_id": r["map_id"], "seed": seed, "size": len(cells), "score": mean, "area": float(area) if corners else 0.0, "corners": [c for p in corners for c in p]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("map_id", pa.int64()), ("seed", pa.int32()), ("size", pa.int32()), ("score", pa.float64()), ("area", pa.float64()), ("corners", pa.list_(pa.float64()))]))

    rows = maps.select(F.col("map_id").cast("long").alias("map_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("cells").cast("array<double>").alias("cells"))
    return rows.mapInArrow(run, BOXES)
