"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage is encoded by the
shares of word shapes (marks, digits, case, length, hashed to SHAPES bins),
by repetition and by lengths; a layer embeds it; gated attention weighs the
passages; the weighted sum is scored. Only documents have labels: the
attention is learnt from those, by full-batch Adam on numpy arrays.

The fit uses at most FIT_ROWS documents a class, whole, weighted to the classes'
true shares. Scores come from the text alone.

Cases: a null or empty text is one passage without words; texts are read whole;
labels of one class only give scores near that class; without labels every score
is 0.5; an empty table gives an empty result; repeated rows score alike; other
columns are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.batches import lean
from corpusloom.llm.labels import fold, sample
from corpusloom.session import table

FIT_ROWS = 2000
PASSAGE = 64
SHAPES, WIDTH, GATES = 48, 16, 8
EXTRA = 7
ROUNDS, RATE, DECAY = 250, 0.02, 1e-4
#: Words whose shapes a task keeps.
CACHE = 100_000


def shape(word: str) -> int:
    """The bin of a word's shape."""
    core = word.strip(".,;:!?")
    tail = word[len(word.rstrip(".,;:!?")) :]
    kind = "a" if core.isalpha() else "n" if core.isdigit() else "s" if not any(c.isalnum() for c in core) else "m"
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l"
    return zlib.crc32(f"{kind}{case}{min(len(core), 24) // 4}{tail[:2]}".encode()) % SHAPES


class _Shapes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = s = shape(word)
        return s


def encoded(text: str | None, shapes: _Shapes) -> np.ndarray:
    """A row of SHAPES + EXTRA numbers for each passage."""
    words = (text or "").split()
    n = max(1, -(-len(words) // PASSAGE))
    x = np.zeros((n, SHAPES + EXTRA))
    size = np.full(n, PASSAGE)
    size[-1] = len(words) - (n - 1) * PASSAGE
    if words:
        at = np.arange(len(words)) // PASSAGE
        ids = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
        x[:, :SHAPES] = np.bincount(at * (SHAPES + EXTRA) + ids, minlength=x.size).reshape(x.shape)[:, :SHAPES]
        same = np.fromiter(map(str.__eq__, words, islice(words, 1, None)), bool, len(words) - 1)
        x[:, SHAPES] = np.bincount(at[1:], same, n)
        x[:, SHAPES + 1] = np.bincount(at, np.fromiter(map(len, words), np.int64, len(words)), n) / 8
        x /= np.maximum(size, 1)[:, None]
        x[:, SHAPES + 2] = [len(set(words[i : i + PASSAGE])) for i in range(0, len(words), PASSAGE)] / np.maximum(size, 1)
    x[:, SHAPES + 3] = np.log1p(size) / 5
    x[:, SHAPES + 4] = np.log1p(len(words)) / 8
    x[:, SHAPES + 5] = min(1.0, (text or "").count("\n") * 10 / max(1, len(words)))
    x[:, SHAPES + 6] = 1.0
    return x


class Model:
    """tanh embedding, gated attention, linear score."""

    def __init__(self, parameters: list[np.ndarray]):
        self.p = parameters

    @staticmethod
    def start(seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        sizes = ((SHAPES + EXTRA, WIDTH), (WIDTH, GATES), (WIDTH, GATES), (GATES,), (WIDTH,), (1,))
        return Model([r.normal(0, 1 / np.sqrt(s[0]), s) for s in sizes])

    def forward(self, x: np.ndarray, starts: np.ndarray):
        w, v, u, g, c, b = self.p
        h = np.tanh(x @ w)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = np.exp(np.clip((t * s) @ g, -30, 30))
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, s, a, bag, z, 1 / (1 + np.exp(-np.clip(z @ c + b[0], -30, 30)))

    def gradients(self, x, starts, y, weight):
        w, v, u, g, c, _ = self.p
        h, t, s, a, bag, z, p = self.forward(x, starts)
        d = (p - y) * weight
        dz = (d[:, None] * c)[bag]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dts = de[:, None] * g
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = a[:, None] * dz + dt @ v.T + ds @ u.T
        return [x.T @ (dh * (1 - h * h)), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, np.array([d.sum()])]


def fitted(texts: list[str], marks: list[int], counts: dict[int, int]) -> list[np.ndarray]:
    model = Model.start()
    if not texts:
        model.p[4][:] = 0
        model.p[5][:] = 0
        return model.p
    shapes = _Shapes()
    bags = [encoded(t, shapes) for t in texts]
    x, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1]
    y = np.array(marks, float)
    share = {k: counts[k] / sum(counts.values()) / max(1, marks.count(k)) for k in counts}
    weight = np.array([share[k] for k in marks])
    first, second = [np.zeros_like(p) for p in model.p], [np.zeros_like(p) for p in model.p]
    for i in range(1, ROUNDS + 1):
        for k, (p, d) in enumerate(zip(model.p, model.gradients(x, starts, y, weight), strict=True)):
            d = d + DECAY * p
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            p -= RATE * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)
    return model.p


class Scorer:
    def __init__(self, *parameters: np.ndarray):
        self.model, self.shapes = Model(list(parameters)), _Shapes()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        bags = [encoded(t, self.shapes) for t in texts]
        # The last bits depend on what else is in the product.
        return np.round(self.model.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1])[-1], 12)


def _scored(parameters: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*parameters)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                score = pa.array(scorer.scores(part.column("text").to_pylist()))
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], score], names=[*names, "score"])

    return run


def _model(docs: DataFrame, labels: DataFrame, fit_rows: int) -> list[np.ndarray]:
    return fitted(*sample(docs, labels, "quality", fold(F.col("doc_id"), 3) != 1, fit_rows))


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score; ids whose crc32 mod 3 is 1 are held out of the fit."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(lean(_scored(_model(docs, labels, fit_rows))), "doc_id long, held_out boolean, score double")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose score is at least `least`, with their columns, of any name."""
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(row.alias("row"), docs["text"].alias("text"))
    found = rows.mapInArrow(lean(_scored(_model(docs, labels, fit_rows))), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return found.where(F.col("score") >= least).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_quality(spark, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
