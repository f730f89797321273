"""Toxicity by compression distance with zstandard dictionaries.

PAIRS pairs of dictionaries of equal size are trained by zstandard, one of each
pair on windows of toxic texts, the other on windows of ordinary texts, each pair
on texts of its own. All stand behind one dictionary of common content, trained
on ordinary texts, so that what both classes share costs the same with each. A
text's windows of WINDOW words are compressed with both of every pair; the
difference of the lengths, averaged over the pairs, tells how toxic a window is:
what a single pair takes from its texts by chance does not recur in the others. A
logistic model on a text's differences (mean, spread, shares beyond thresholds,
greatest) gives the score. It is calibrated on labelled documents that the
dictionaries have not seen, weighted to the classes' true shares; the threshold
is where a share of FALSE_ALARMS of the ordinary ones is reached, and scores are
shifted (as log odds) so that it lies at 0.5.

The fit uses at most FIT_ROWS documents a class. Scores come from the text alone.

Cases: a null or empty text has no windows and scores as a text without any
difference; texts are read whole; labels of one class only give that class's
share as every score; an empty table gives an empty result; repeated rows score
alike; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import lean
from corpusloom.llm.labels import fold, sample
from corpusloom.session import table

FIT_ROWS = 3000
PAIRS = 2
#: Words in a window that is scored, in one that a pair is trained on, and in one of the common content.
WINDOW, SAMPLE, COMMON = 24, 2, 32
COMMON_BYTES, OWN_BYTES = 65_536, 4_096
DROPPED = str.maketrans("", "", ".,;:!?()\"")
STEPS = (1, 2, 3, 4, 6, 8, 12)
#: Share of the ordinary calibration documents that may score 0.5 or more, and the log odds between which the threshold for it is sought.
FALSE_ALARMS, THRESHOLDS = 0.008, (-2.2, 2.2)
FEATURES = 2 * len(STEPS) + 5


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().translate(DROPPED).encode("utf-8", "surrogatepass").split()


def windows(ws: list[bytes], size: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(ws[i : i + size]) + b" " for i in range(0, len(ws), size)]


def _content(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """What a dictionary trained on samples holds after its tables; the samples themselves where they are too few to train on."""
    import zstandard

    try:
        data = zstandard.train_dictionary(size, samples, k=k, d=d, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]
    # The tables end with three repeat offsets: 1, 4, 8.
    at = data.find(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0")
    if at < 0:
        raise ValueError("a trained dictionary without the usual repeat offsets")
    return data[at + 12 :]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """The common content, and the toxic and ordinary content of each pair."""
    common = _content([w for ws in ordinary[::2] for w in windows(ws, COMMON)], COMMON_BYTES, 50, 8)
    own = lambda docs, i: _content([w for ws in docs[i::PAIRS] for w in windows(ws, SAMPLE)], OWN_BYTES, 16, 6)
    return common, [(own(toxic, i), own(ordinary[: len(toxic)], i)) for i in range(PAIRS)]


def compressor(data: bytes):
    """A compressor behind raw content."""
    import zstandard

    how = zstandard.ZstdCompressionParameters(compression_level=6, window_log=17, min_match=4, strategy=zstandard.STRATEGY_LAZY2, search_log=6, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    made = zstandard.ZstdCompressionDict(data.ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=how)


class Scorer:
    def __init__(self, common: bytes, pairs: list[tuple[bytes, bytes]], weights: np.ndarray | None = None):
        self.pairs, self.weights = [tuple(compressor(x + common).compress for x in p) for p in pairs], weights

    def differences(self, text: str | None) -> np.ndarray:
        """Of each window, the bytes that the toxic dictionaries save on the ordinary ones: a column for each pair."""
        ws = windows(words(text))
        return np.array([[len(ordinary(w)) - len(toxic(w)) for toxic, ordinary in self.pairs] for w in ws]).reshape(len(ws), len(self.pairs))

    def features(self, text: str | None) -> list[float]:
        d = self.differences(text)
        if not len(d):
            d = np.zeros((1, len(self.pairs)))
        m, least = d.mean(1), d.min(1)
        return [1.0, m.mean(), m.std(), *[(m >= s).mean() for s in STEPS], *[(m <= -s).mean() for s in STEPS[:4]], *[(least >= s).mean() for s in STEPS[:3]], min(m.max(), 30) / 30, np.log1p(len(d)) / 10]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.features(t) for t in texts]).reshape(-1, FEATURES) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def threshold(ordinary: np.ndarray) -> float:
    """The log odds that FALSE_ALARMS of the ordinary documents' pass; 0 without any."""
    z = np.sort(ordinary)[::-1]
    return float(np.clip(z[int(FALSE_ALARMS * len(z))] + 1e-9, *THRESHOLDS)) if len(z) else 0.0


def fitted(texts: list[str], marks: list[int], counts: dict[int, int]) -> tuple[bytes, list[tuple[bytes, bytes]], np.ndarray]:
    """The common content, the pairs' contents and the weights."""
    own = [words(t) for t in texts]
    learn = [i for i in range(len(own)) if i % 3]
    common, pairs = dictionaries([own[i] for i in learn if marks[i]], [own[i] for i in learn if not marks[i]])
    if len(counts) < 2:
        share = 0.5 if not counts else (1 - 1e-6 if 1 in counts else 1e-6)
        return common, pairs, np.array([np.log(share / (1 - share)), *[0.0] * (FEATURES - 1)])
    scorer = Scorer(common, pairs)
    rest = [i for i in range(len(own)) if i % 3 == 0] or list(range(len(own)))
    x, y = np.array([scorer.features(texts[i]) for i in rest]), np.array([marks[i] for i in rest])
    share = {k: counts[k] / sum(counts.values()) / max(1, int((y == k).sum())) for k in counts}
    weights = logistic(x, y, np.array([share[k] for k in y.tolist()]) * len(y))
    weights[0] -= threshold((x @ weights)[y == 0])
    return common, pairs, weights


def _scored(*model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scorer.scores(part.column("text").to_pylist()))], names=["doc_id", "held_out", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score; ids whose crc32 mod 5 is 0 are held out of the fit."""
    model = fitted(*sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, fit_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(lean(_scored(*model)), "doc_id long, held_out boolean, score double")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
