"""Language-model scores from a probabilistic suffix tree.

A text is its lower-cased (A-Z) words, a space after each but the last, and an
end symbol; symbols are bytes. Contexts are the last 0 to DEPTH symbols. Counts
of all training texts are gathered; a context is kept where it was seen LEAST
times and its next-symbol distribution diverges from that of its suffix: n times
the Kullback-Leibler divergence of at least MIN_GAIN nats. Its distribution is
smoothed with its suffix's.

The tree grows with the corpus and stays a table. A context's suffixes share its
last TAIL symbols, so each tail's contexts are tested in one task; only shorter
contexts (at most 257) are with the driver. The table holds the log10 probability
of each symbol that was seen after a kept context, and for the others a weight on
the suffix's. Texts are scored by the tails' tables, which are broadcast in pieces
of at most PIECE entries (or one tail), with a pass over the texts for each piece.
Word counts (for the base score) stay distributed: the most frequent HOT_WORDS
words are broadcast, the others' counts are joined.

Cases: a null or empty text is the end symbol alone; rows with a null doc_id are
training rows; no training rows give uniform symbols and a base of c = N = V = 0;
repeated rows count as often as they are there; an empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import lean, parts
from corpusloom.session import durable, table

DEPTH = 6
LEAST = 2
MIN_GAIN = 10.0
SMOOTH = 4.0
HOT_WORDS = 200_000
END = "\n"
#: Symbols whose grams are sorted at once, and words a task counts before it hands them on.
CHUNK, WORDS = 1 << 22, 400_000
#: Symbols that the automaton reads in one lane.
LANE = 256
#: Last symbols of a context that name its part of the tree, and entries of the tree that are broadcast at once.
TAIL, PIECE = 2, 4_000_000
#: Grams of whole tails that are tested at once, and symbols that are scored at once.
BLOCK, SCORED = 1 << 20, 1 << 20


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def symbols(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def _codes(stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code of (up to DEPTH symbols, next symbol) with its length below, by position; contexts do not cross starts."""
    n = len(stream)
    # Each position's last eight bytes as a number, by reading at every byte.
    padded = np.concatenate([np.zeros(7, np.uint8), stream])
    code = np.ndarray((n,), ">u8", padded.data, strides=(1,)).astype(np.uint64)
    code &= np.uint64((1 << 8 * (DEPTH + 1)) - 1)
    code <<= np.uint64(3)
    code |= np.uint64(DEPTH)
    ends = np.append(starts[1:], n)
    for depth in range(DEPTH):
        at = starts + depth
        at = at[at < ends]
        code[at] = (code[at] >> np.uint64(3) & np.uint64((1 << 8 * (depth + 1)) - 1)) << np.uint64(3) | np.uint64(depth)
    return code


def _grams(stream: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes and their counts."""
    return np.unique(_codes(stream, starts), return_counts=True)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])
    words: Counter[bytes] = Counter()
    grams: dict[str, list[np.ndarray]] = {"code": [], "n": []}
    held, held_size = [], 0

    def flush_words() -> Iterator[pa.RecordBatch]:
        keys = list(words)
        for i in range(0, len(keys), 50_000):
            k = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.nulls(len(k), pa.int64()), pa.array([words[x] for x in k], pa.int64())], schema=schema)
        words.clear()

    def count() -> None:
        nonlocal held, held_size
        if held:
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            code, n = _grams(np.frombuffer(b"".join(held), np.uint8), np.cumsum(lengths) - lengths)
            grams["code"].append(code)
            grams["n"].append(n)
            held, held_size = [], 0
        if sum(map(len, grams["code"])) > 1 << 21 or not held:
            fold()

    def fold() -> None:
        if len(grams["code"]) > 1:
            code, inverse = np.unique(np.concatenate(grams["code"]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(grams["n"]).astype(np.float64), len(code)).astype(np.int64)
            grams["code"], grams["n"] = [code], [n]

    for b in (x for whole in batches for x in parts(whole)):
        for t in b.column("text").to_pylist():
            w = tokens(t)
            words.update(w)
            words[END.encode()] += 1
            held.append(symbols(w))
            held_size += len(held[-1])
            if held_size >= CHUNK:
                count()
        if len(words) > WORDS:
            yield from flush_words()
    yield from flush_words()
    count()
    for code, n in zip(grams["code"], grams["n"], strict=True):
        for i in range(0, len(code), 100_000):
            c = code[i : i + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.binary()), pa.array(c), pa.array(n[i : i + 100_000], pa.int64())], schema=schema)


def gathered(train: DataFrame) -> DataFrame:
    """word or gram, and n: partial counts of each task."""
    return durable(train.select("text").mapInArrow(lean(_gathered), "word binary, gram long, n long"), "pst-counts")


class Tree:
    """A tree in memory as an automaton: next state and log10 probability by state and symbol class."""

    def __init__(self, contexts: dict[bytes, dict[int, int]], smooth: float = SMOOTH, min_gain: float = MIN_GAIN):
        root = contexts.get(b"", {})
        used = sorted(root)
        self.classes = np.full(256, len(used), np.uint8 if len(used) < 256 else np.int64)
        self.classes[used] = np.arange(len(used))
        width, rare = len(used) + 1, 256 - len(used)
        total = sum(root.values())
        top = np.array([*(root[x] + 0.5 for x in used), 0.5 * max(rare, 0)]) / (total + 128)
        kept: dict[bytes, np.ndarray] = {b"": top}

        def nearest(c: bytes) -> np.ndarray:
            while c not in kept:
                c = c[1:]
            return kept[c]

        for c in sorted((c for c in contexts if c), key=lambda c: (len(c), c)):
            n = np.zeros(width)
            for x, k in contexts[c].items():
                n[self.classes[x]] += k
            parent, size = nearest(c[1:]), n.sum()
            seen = n > 0
            if (n[seen] * np.log(n[seen] / size / parent[seen])).sum() >= min_gain:
                kept[c] = (n + smooth * parent) / (size + smooth)
        self.kept = len(kept)
        states = set(kept)
        for c in list(kept):  # every state's prefixes and suffixes are states
            states |= {c[i:j] for i in range(len(c)) for j in range(i, len(c) + 1)}
        order = sorted(states, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(order)}
        step = np.zeros((len(order), width), np.int32)
        logs = np.empty((len(order), width), np.float32)
        if rare:
            spread = np.append(np.ones(len(used)), rare)
        else:
            spread = np.ones(width)
        for i, c in enumerate(order):
            if c:
                step[i] = step[number[c[1:]]]
                step[number[c[:-1]], self.classes[c[-1]]] = i
            logs[i] = np.log10(np.maximum(nearest(c), 1e-300) / spread)
        # Shorter states were extended while longer ones were met: copy once more, in order.
        for i, c in enumerate(order):
            if c:
                own = step[number[c[1:]]].copy()
                for x in np.flatnonzero([c + bytes([b]) in number for b in used]):
                    own[x] = number[c + bytes([used[x]])]
                step[i] = own
        self.width, self.step, self.logs = width, step.ravel(), logs.ravel()

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each of the symbol strings."""
        if not texts:
            return np.zeros(0)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        begins = ends - lengths
        stream = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        lanes = -(-lengths // LANE)
        doc = np.repeat(np.arange(len(texts)), lanes)
        at = begins[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop, first = np.minimum(at + LANE, ends[doc]), begins[doc]
        state, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
        for t in range(-DEPTH, LANE):
            i = at + t
            on = (i >= first) & (i < stop) if t < 0 else i < stop
            if not on.all():
                live = np.flatnonzero(on)
                if not len(live):
                    continue
                cell = state[live] * self.width + stream[i[live]]
                if t >= 0:
                    total[live] += self.logs[cell]
                state[live] = self.step[cell]
            else:
                cell = state * self.width + stream[i]
                if t >= 0:
                    total += self.logs[cell]
                state = self.step[cell].astype(np.int64)
        return np.bincount(doc, total, len(texts))


def contexts_of(counts: DataFrame, p_min: float = 0.0) -> dict[bytes, dict[int, int]]:
    """Next-symbol counts of the contexts seen LEAST times whose share is at least p_min, for a Tree in memory."""
    grams = counts.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    have = F.col("gram").bitwiseAND(F.lit(7)).cast("int")
    code = F.shiftrightunsigned("gram", 3)
    mask = F.element_at(F.array(*[F.lit((1 << 8 * (d + 1)) - 1) for d in range(DEPTH + 1)]), F.col("d") + 1)
    each = grams.select("n", code.alias("code"), F.explode(F.sequence(F.lit(0), have)).alias("d"))
    each = durable(each.groupBy("d", F.col("code").bitwiseAND(mask).alias("code")).agg(F.sum("n").alias("n")), "pst-grams")
    context = F.shiftrightunsigned("code", 8)
    total = each.where("d = 0").agg(F.sum("n")).first()[0] or 0
    large = each.groupBy("d", context.alias("context")).agg(F.sum("n").alias("of")).where(F.col("of") >= max(LEAST, p_min * total))
    rows = each.withColumn("context", context).join(large, ["d", "context"]).select("d", "code", "n").toArrow()
    out: dict[bytes, dict[int, int]] = {}
    for d, c, n in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
        out.setdefault((c >> 8).to_bytes(d, "big"), {})[c & 255] = n
    return out


def _level(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sums of n."""
    code, inverse = np.unique(code, return_inverse=True)
    return code, np.bincount(inverse, n, len(code))


def _tested(code: np.ndarray, n: np.ndarray, upper: tuple[np.ndarray, np.ndarray]) -> tuple:
    """A level's divergence test, from its grams and the level above (grams, p).

    Gives the level (grams, p), with p the probability at the nearest kept context, and of
    the kept contexts grams, log10 p, contexts, log10 of the weight on the suffix's distribution.
    """
    context = code >> 8
    new = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(code) else np.zeros(0, np.int64)
    size = np.add.reduceat(n, new) if len(new) else np.zeros(0)
    often = np.repeat(size >= LEAST, np.diff(np.append(new, len(code))))
    code, n = code[often], n[often]
    if not len(code):
        return (code, n), (code, n, code, n)
    context, size = context[new][size >= LEAST], size[size >= LEAST]
    new = np.flatnonzero(np.append(True, code[1:] >> 8 != code[:-1] >> 8))
    runs = np.diff(np.append(new, len(code)))
    # A context's grams are also its suffix's, which was seen as often at least.
    bits = upper[2]
    p = upper[1][np.searchsorted(upper[0], code & ((1 << bits) - 1))]
    each = np.repeat(size, runs)
    keep = np.add.reduceat(n * np.log(n / each / p), new) >= MIN_GAIN
    own = np.repeat(keep, runs)
    p = np.where(own, (n + SMOOTH * p) / (each + SMOOTH), p)
    return (code, p), (code[own], np.log10(p[own]), context[keep], np.log10(SMOOTH / (size[keep] + SMOOTH)))


def _root(n: np.ndarray) -> np.ndarray:
    """Probabilities of the 256 symbols from their counts."""
    return (n + 0.5) / (n.sum() + 128)


def _shallow(grams: DataFrame) -> tuple[np.ndarray, list, tuple]:
    """log10 probabilities of the symbols, entries of the contexts shorter than TAIL by length, and the last level."""
    have = F.col("gram").bitwiseAND(F.lit(7)).cast("int")
    code = F.shiftrightunsigned("gram", 3)
    rows = grams.groupBy(F.least(have, F.lit(TAIL - 1)).alias("d"), code.bitwiseAND(F.lit((1 << 8 * TAIL) - 1)).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    d, code, n = (rows.column(i).to_numpy() for i in range(3))
    root = _root(np.bincount(code & 255, n, 256) if len(n) else np.zeros(256))
    level, out = (np.arange(256), root), []
    for length in range(1, TAIL):
        on = d >= length
        c, k = _level(code[on] & ((1 << 8 * (length + 1)) - 1), n[on])
        level, entries = _tested(c, k, (*level, 8 * length))
        out.append(entries)
    return np.log10(root), out, level


def _grown(upper):
    """Grams sorted by tail: entries of the kept contexts."""

    def block(tail: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        have, code = gram & 7, gram >> 3
        levels, c, k = [], np.zeros(0, np.int64), np.zeros(0)
        for d in range(DEPTH, TAIL - 1, -1):
            mask, on = (1 << 8 * (d + 1)) - 1, have == d
            c, k = _level(np.concatenate([c & mask, code[on]]), np.concatenate([k, n[on]]))
            levels.append((d, c, k))
        above = upper.value
        for d, c, k in reversed(levels):
            above, (grams, logs, contexts, weights) = _tested(c, k, (*above, 8 * d))
            for key, value, kind in ((grams, logs, False), (contexts, weights, True)):
                t = (key if kind else key >> 8) & ((1 << 8 * TAIL) - 1)
                for i in range(0, len(key), 100_000):
                    m = len(key[i : i + 100_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t[i : i + m].astype(np.int32)), pa.array(np.full(m, d, np.int32)), pa.array(np.full(m, kind)), pa.array(key[i : i + m]), pa.array(value[i : i + m].astype(np.float32))],
                        names=["tail", "d", "weight", "code", "value"],
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            got = [b.column(i).to_numpy() for i in range(3)]
            cut = np.flatnonzero(np.diff(got[0], prepend=held[-1][0][-1] if held else got[0][:1]))
            if size + len(got[0]) > BLOCK and len(cut):
                held.append([x[: cut[-1]] for x in got])
                yield from block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size, got = [], 0, [x[cut[-1] :] for x in got]
            held.append(got)
            size += len(got[0])
        if held:
            yield from block(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


class Kept:
    """A piece of the tree: of contexts of each length, sorted grams with log10 p, and sorted contexts with weights."""

    def __init__(self, root: np.ndarray, shallow: list, rows: pa.Table, number: int, piece_of: np.ndarray):
        self.root, self.number, self.piece_of = root, number, piece_of
        self.levels = [(g, p.astype(np.float32), c, w.astype(np.float32)) for g, p, c, w in shallow]
        d, weight, code, value = (rows.column(x).to_numpy() for x in ("d", "weight", "code", "value"))
        for length in range(TAIL, DEPTH + 1):
            level = []
            for on in ((d == length) & ~weight, (d == length) & weight):
                order = np.argsort(code[on])
                level += [code[on][order], value[on][order]]
            self.levels.append(tuple(level))

    def logs(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram."""
        have, code = gram & 7, gram >> 3
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for d in range(DEPTH, 0, -1):
            grams, p, contexts, weights = self.levels[d - 1]
            deep = have[left] >= d
            if not len(contexts) or not deep.any():
                continue
            at = left[deep]
            key = code[at] & ((1 << 8 * (d + 1)) - 1)
            i = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
            hit = grams[i] == key
            out[at[hit]] += p[i[hit]]
            missed, key = at[~hit], key[~hit] >> 8
            i = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
            kept = contexts[i] == key
            out[missed[kept]] += weights[i[kept]]
            left = np.concatenate([left[~deep], missed])
        out[left] += self.root[code[left] & 255]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each of the symbol strings, as far as its symbols fall to this piece."""
        if not texts:
            return np.zeros(0)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        gram = _codes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths).view(np.int64)
        doc = np.repeat(np.arange(len(texts)), lengths)
        if self.piece_of.any():
            piece = np.where(gram & 7 >= TAIL, self.piece_of[gram >> 11 & ((1 << 8 * TAIL) - 1)], 0)
            mine = piece == self.number
            gram, doc = gram[mine], doc[mine]
        gram, inverse = np.unique(gram, return_inverse=True)
        return np.bincount(doc, self.logs(gram)[inverse], len(texts))


def kept_pieces(counts: DataFrame, most: int = PIECE) -> tuple[int, Iterator[Kept]]:
    """Number of pieces of the tree, and the pieces, each gathered when it is asked for."""
    spark = counts.sparkSession
    # A task's grams differ already: dealing them first spares an aggregate before the shuffle that merges nothing.
    grams = durable(counts.where("gram is not null").select("gram", "n").repartition("gram").groupBy("gram").agg(F.sum("n").alias("n")), "pst-grams")
    root, shallow, last = _shallow(grams)
    deep = grams.where(F.col("gram").bitwiseAND(F.lit(7)) >= TAIL)
    tail = F.shiftrightunsigned("gram", 11).bitwiseAND(F.lit((1 << 8 * TAIL) - 1)).cast("int")
    dealt = deep.select(tail.alias("tail"), "gram", "n").repartition("tail").sortWithinPartitions("tail")
    tree = durable(dealt.mapInArrow(lean(_grown(spark.sparkContext.broadcast(last))), "tail int, d int, weight boolean, code long, value float"), "pst-tree")
    piece_of, number, size = np.zeros(1 << 8 * TAIL, np.int32), 0, 0
    for r in tree.groupBy("tail").count().orderBy("tail").collect():  # at most 65,536
        if size and size + r["count"] > most:
            number, size = number + 1, 0
        piece_of[r.tail] = number
        size += r["count"]
    firsts = [int(np.flatnonzero(piece_of == i)[0]) for i in range(1, number + 1)]

    def pieces() -> Iterator[Kept]:
        for i, (low, high) in enumerate(zip([0, *firsts], [*firsts, 1 << 8 * TAIL], strict=True)):
            part = tree if not firsts else tree.where((F.col("tail") >= low) & (F.col("tail") < high))
            yield Kept(root, shallow, part.select("d", "weight", "code", "value").toArrow(), i, piece_of)

    return number + 1, pieces()


def _hot(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """Words above a count so chosen that there are at most `most`, with their counts, and that count."""
    bins = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("bin")).count().collect()  # at most 8 * 63 rows
    least, n = None, 0
    for r in sorted(bins, key=lambda r: -r.bin):
        if n + r["count"] > most:
            break
        n, least = n + r["count"], r.bin
    if least is None:
        return {}, 0
    rows = counts.where(F.floor(F.log2("c") * 8) >= least).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("c").to_pylist(), strict=True)), n


def _part_scored(model):
    """row and score of a further piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, SCORED):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.value.scores([symbols(tokens(t)) for t in texts]), pa.float64())], names=["row", "score"])

    return run


def _scored(model, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, hot = model.value, words.value
        logs = {w: math.log10(c + 0.5) for w, c in hot.items()}
        for b in batches:
            for part in parts(b, SCORED):
                texts = part.column("text").to_pylist()
                n, known, base, cold, streams = [], [], [], [], []
                for t in texts:
                    w = tokens(t)
                    streams.append(symbols(w))
                    w.append(b"\n")
                    found = list(map(logs.get, w))
                    rest = [x for x, v in zip(w, found, strict=True) if v is None]
                    n.append(len(w))
                    known.append(len(w) - len(rest))
                    base.append(math.fsum([v for v in found if v is not None] if rest else found))
                    cold.append(rest)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(tree.scores(streams), pa.float64()), pa.array(cold, pa.list_(pa.binary()))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "cold"],
                )

    return run


def scored(docs: DataFrame, held_out, hot_words: int = HOT_WORDS, piece: int = PIECE) -> DataFrame:
    """Scores of docs (doc_id, text); rows where held_out (a condition on docs) holds are not learnt from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = gathered(rows.where(~F.col("held_out")))
    n_pieces, pieces = kept_pieces(counts, piece)
    words = durable(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "pst-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    hot, _ = _hot(words, hot_words)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, cold array<binary>"
    numbered = rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id())
    if n_pieces > 1:  # the passes must agree on the numbers
        numbered = durable(numbered, "pst-rows")
    tree = spark.sparkContext.broadcast(next(pieces))
    each = durable(numbered.mapInArrow(lean(_scored(tree, spark.sparkContext.broadcast(hot))), schema), "pst-scores")
    further = None
    for k in pieces:
        tree.destroy()
        tree = spark.sparkContext.broadcast(k)
        part = durable(numbered.select("row", "text").mapInArrow(lean(_part_scored(tree)), "row long, score double"), "pst-scores")
        further = part if further is None else further.unionAll(part)
    if further is not None:
        more = further.groupBy("row").agg(F.sum("score").alias("others"))
        each = each.join(more, "row").withColumn("score", F.col("score") + F.col("others")).drop("others")
    cold = each.select("row", F.explode("cold").alias("word")).join(words, "word", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    per = cold.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("more"), F.sum((F.col("c") > 0).cast("long")).alias("known"))
    floor = F.log10(F.lit(total.n + 0.5 * (total.v + 1)))
    found = each.drop("cold").join(per, "row", "left")
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"), "score",
    )


def op5_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
