"""Near-duplicates by SimHash, for similarities that a fingerprint of 64 bits cannot reach.

Two rows are linked where their sets of shingles (of `words` words; a shorter
text is one shingle) have a Jaccard similarity of `similarity` or more. Pairs are
met by SimHash: a bit is 1 if it is set in over half of the hashes of a set's
shingles. Two sets at 0.8 agree on a bit with a probability of 0.839 or more (by
exact sums over small sets; 0.849 for large ones), too little for distances of
a few bits, so fingerprints have TABLES blocks of BLOCK bits. Rows meet where a
whole block is equal, and stay together where the first CHECKED words differ in
at most DISTANCE bits. By the binomial formula a pair at 0.8 is missed with a
probability of 1.1e-5, and less above. Sets of four and five shingles agree on a
bit with a probability of 0.8125 only: sets of at most FEW have FEW_TABLES blocks,
and 1.4e-5 of such pairs are missed. Every link is verified on the whole sets.

Rows of equal sets are folded before. Within a bucket, the sets of equal block,
those that chains of distances up to DISTANCE connect form a group; a group that
several buckets give counts once. Each set is first compared with the leader of
its largest group, the set nearest to the majority of the group's bits (the leader
with the next one); these links join most of what there is to join. A set may
have more links only if sets of other components hold the share `similarity` of
its shingles; that is counted, and drops most sets. What is left meets again, and
groups that share a set, or a component, are one: each set is in one group, however
many buckets it shares with its copies. Where such a group holds several components, its sets are
compared across them within tasks, so that no pairs are written but links. A group
is cut into chunks, by its share of all shingles and so that no chunk has more than
CHUNK_GRAMS, and each pair of chunks is a task of its own.

Cases: null and empty texts have the empty set and are copies of each other;
null ids take part, but a component bears the smallest id that is not null;
repeated rows share their component; an empty table gives an empty result; other
columns, of any name, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import lean, parts
from corpusloom.llm.components import components
from corpusloom.session import durable, sent

WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: Bits of a block, blocks of a set, and of a set of at most FEW shingles.
BLOCK, TABLES, FEW, FEW_TABLES = 14, 128, 5, 224
#: Words of 64 bits whose Hamming distance is taken, and the most bits in which they may differ.
CHECKED, DISTANCE = 3, 60
#: Parts that a block's values are dealt to, and sets that are dealt at once.
SLOTS, DEALT = 64, 4096
#: Sets of a bucket up to which all pairs are compared at once; beyond, one against those that are left.
ALL_PAIRS = 256
#: Shingles whose bits are added at once (at most 255), and words whose hashes a task keeps.
CHUNK, CACHE = 128, 200_000
#: Shingles in a chunk of a group, and in one that is not worth cutting.
CHUNK_GRAMS, FINE_GRAMS = 1 << 20, 1 << 14
#: Parts that shingles are dealt to, at least, shingles of a part beyond, and shingles that are dealt at once; times that sets without a counterpart are dropped.
GRAM_SLOTS, SLOT_GRAMS, DEALT_GRAMS, ROUNDS = 64, 1 << 20, 1 << 18, 2
#: Documents whose keys (24 bytes) are broadcast; beyond, joins shuffle.
BROADCAST_KEYS = 1_000_000
_random = np.random.RandomState(SEED)
_PLUS, _TIMES = _random.randint(0, 1 << 63, (2, FEW_TABLES * BLOCK // 64), np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_ENTRY = np.dtype([("key", "<u2"), ("set_key", "<i8"), ("bits", "<u8", (CHECKED,))])
_GRAM = np.dtype([("gram", "<u8"), ("root", "<i8"), ("set_key", "<i8")])
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """XXH64 of words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxh64_intdigest(word, SEED)
        return h


def shingles(text: str | None, words: int = WORDS, hashes: _Hashes | None = None) -> np.ndarray:
    """Different 64-bit hashes of the text's shingles, in order."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map((_Hashes() if hashes is None else hashes).__getitem__, ws), np.uint64, len(ws))
    size = min(words, len(ws))
    n = len(ws) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ own[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def fingerprint(grams: np.ndarray) -> bytes:
    """SimHash of a set that is not empty: TABLES blocks of BLOCK bits, or FEW_TABLES, of which the first are the same."""
    plus, times = (x[: (FEW_TABLES if len(grams) <= FEW else TABLES) * BLOCK // 64] for x in (_PLUS, _TIMES))
    ones = np.zeros(64 * len(plus), np.int32)
    for at in range(0, len(grams), CHUNK):
        h = (grams[at : at + CHUNK, None] ^ plus) * times
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(grams)).tobytes()


def blocks(prints: np.ndarray) -> np.ndarray:
    """Values of the blocks of fingerprints of one length (rows of bytes)."""
    bits = np.unpackbits(prints, axis=1).reshape(len(prints), -1, BLOCK)
    out = np.zeros(bits.shape[:2], np.uint16)
    for i in range(BLOCK):
        out |= bits[:, :, i].astype(np.uint16) << np.uint16(i)
    return out


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (set_key, print): for each block and part of its values the entries, packed."""
    for whole in batches:
        for at in range(0, whole.num_rows, DEALT):
            b = whole.slice(at, DEALT)
            keys, prints = b.column("set_key").to_numpy(), b.column("print").to_pylist()
            size = np.fromiter(map(len, prints), np.int64, len(prints))
            for n in np.unique(size[size > 0]).tolist():
                some = np.flatnonzero(size == n)
                flat = np.frombuffer(b"".join([prints[i] for i in some.tolist()]), np.uint8).reshape(-1, n)
                values, entries = blocks(flat), np.empty(len(some), _ENTRY)
                entries["set_key"] = keys[some]
                entries["bits"] = np.ascontiguousarray(flat[:, : 8 * CHECKED]).view("<u8")
                for t in range(values.shape[1]):
                    slot = values[:, t] % SLOTS
                    order = np.argsort(slot, kind="stable")
                    entries["key"] = values[:, t]
                    slot, first = np.unique(slot[order], return_index=True)
                    ends = np.append(first, len(some)).astype(np.int32) * np.int32(_ENTRY.itemsize)
                    packed = pa.Array.from_buffers(pa.binary(), len(slot), [None, pa.py_buffer(ends), pa.py_buffer(entries[order].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), t, np.int32)), pa.array(slot.astype(np.int32)), packed], names=["t", "slot", "entries"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= DISTANCE


def _grouped(entries: np.ndarray, all_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that have another of the same key within DISTANCE, and the group of each, as the number of an entry."""
    n = len(entries)
    key, bits = np.ascontiguousarray(entries["key"]), np.ascontiguousarray(entries["bits"])
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [n]))
    sizes = np.diff(starts)
    ends = np.repeat(starts[1:], sizes)
    left = np.flatnonzero(np.repeat(sizes, sizes) <= all_pairs)
    us, vs, d = [], [], 0
    while True:
        d += 1
        left = left[left + d < ends[left]]
        if not len(left):
            break
        u = left[_close(bits[left], bits[left + d])]
        us.append(u)
        vs.append(u + d)
    for at, size in zip(starts[:-1][sizes > all_pairs].tolist(), sizes[sizes > all_pairs].tolist(), strict=True):
        rest = np.arange(at, at + size)
        todo: list[int] = []
        while len(rest):
            if not todo:
                todo, rest = [int(rest[0])], rest[1:]
            x = todo.pop()
            near = _close(bits[rest], bits[x])
            found, rest = rest[near], rest[~near]
            us.append(np.full(len(found), x))
            vs.append(found)
            todo += found.tolist()
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
    group = np.arange(n)
    while (group[u] != group[v]).any():
        least = np.minimum(group[u], group[v])
        np.minimum.at(group, u, least)
        np.minimum.at(group, v, least)
        group = group[group]
    some = np.unique(np.concatenate((u, v)))
    return some, group[some]


def _central(sets: np.ndarray, bits: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set the one of its group that is nearest to the majority of the group's bits; for that one the next. Groups of n follow each other."""
    far = np.zeros(len(sets), np.int64)
    for word in np.ascontiguousarray(bits.T):
        each = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1)
        most = np.packbits(np.add.reduceat(each, first, axis=0, dtype=np.int32) * 2 > n[:, None], axis=1).view(np.uint64).ravel()
        far += np.bitwise_count(word ^ np.repeat(most, n))
    order = np.lexsort((sets, far, np.repeat(np.arange(len(n)), n)))
    leader, following = (np.repeat(sets[order[x]], n) for x in (first, first + 1))
    return np.where(sets == leader, following, leader)


def _groups(all_pairs: int):
    """Rows (t, slot, entries) sorted by (t, slot): key, set_key, n and other (as _central) for each set of a group of n; the key is of the group's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            entries = np.frombuffer(b"".join(held), _ENTRY)
            held.clear()
            if len(entries) < 2:
                return
            entries = entries[np.argsort(entries["key"], kind="stable")]
            some, group = _grouped(entries, all_pairs)
            if len(some):
                sets = entries["set_key"][some]
                h = sets.view(np.uint64) * _MIX
                h = (h ^ h >> np.uint64(32)) * _MIX
                h ^= h >> np.uint64(29)
                order = np.argsort(group, kind="stable")
                sets, h, group = sets[order], h[order], group[order]
                first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                n = np.diff(np.append(first, len(group)))
                key = np.add.reduceat(h, first).view(np.int64)
                other = _central(sets, entries["bits"][some][order], first, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)), pa.array(sets), pa.array(np.repeat(n, n)), pa.array(other)], names=["key", "set_key", "n", "other"])

        for b in batches:
            ts, slots, packed = b.column("t").to_pylist(), b.column("slot").to_pylist(), b.column("entries")
            for i in range(b.num_rows):
                if (at := (ts[i], slots[i])) != now:
                    yield from flush()
                    now = at
                held.append(packed[i].as_py())
        yield from flush()

    return run


def groups(prints: DataFrame, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """key, set_key, n, other: the groups in which the sets (set_key, print: a fingerprint; other columns are not read) meet, and whom each set meets first."""
    dealt = prints.select("set_key", "print").mapInArrow(lean(_dealt), "t int, slot int, entries binary").repartition("t", "slot").sortWithinPartitions("t", "slot")
    return durable(dealt.mapInArrow(lean(_groups(all_pairs)), "key long, set_key long, n long, other long").distinct(), "similar-met")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *arrays]))


def _keyed(words: int):
    """Key and fingerprint of the set of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        hashes = _Hashes()
        for b in (x for whole in batches for x in parts(whole)):
            sets = (shingles(t, words, hashes) for t in b.column("text").to_pylist())
            found = [(xxh64_intdigest(s.tobytes()), fingerprint(s)) if len(s) else (0, b"") for s in sets]
            keys = np.array([k for k, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(keys), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "text_key", "set_key", "print"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for part in parts(b):
                yield pa.RecordBatch.from_arrays([part.column("set_key"), _lists([shingles(t, words, hashes).view(np.int64) for t in part.column("text").to_pylist()])], names=["set_key", "grams"])

    return run


def _crossed(similarity: float):
    """Rows (key, i, j, chunk, set_key, root, grams) sorted by (key, i, j): links between sets of different roots, of chunks i and j."""

    def links(two: bool, chunk: np.ndarray, keys: np.ndarray, root: np.ndarray, grams: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        _, ids, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        shared = times[ids] > 1
        own = np.repeat(np.arange(len(grams)), size)[shared]
        ids, flag = ids[shared], np.zeros(len(times), bool)
        starts = np.searchsorted(own, np.arange(len(grams) + 1))
        roots, counts = np.unique(root, return_counts=True)
        out = []
        for x in np.flatnonzero(root != roots[counts.argmax()]).tolist():
            mine = ids[starts[x] : starts[x + 1]]
            flag[mine] = True
            common = np.bincount(own[flag[ids]], minlength=len(grams))
            flag[mine] = False
            near = common / (size[x] + size - common) >= similarity
            near &= root != root[x]
            if two:
                near &= chunk != chunk[x]
            hits = np.flatnonzero(near)
            for y in hits[np.unique(root[hits], return_index=True)[1]].tolist():
                out.append((int(keys[x]), int(keys[y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                chunk, keys, root = (np.array([h[i] for h in held], np.int64) for i in range(3))
                found = links(now[1] != now[2], chunk, keys, root, [h[3] for h in held])
                if found:
                    u, v = np.array(found, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])
            held.clear()

        for b in batches:
            key, i, j, chunk, sets, root = (b.column(c).to_pylist() for c in ("key", "i", "j", "chunk", "set_key", "root"))
            ends, flat = b.column("grams").offsets.to_numpy(), b.column("grams").values.to_numpy()
            for r in range(b.num_rows):
                if (at := (key[r], i[r], j[r])) != now:
                    yield from flush()
                    now = at
                held.append((chunk[r], sets[r], root[r], flat[ends[r] : ends[r + 1]]))
        yield from flush()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    both = pairs.join(sets.select(F.col("set_key").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("set_key").alias("v"), F.col("grams").alias("b")), "v")
    common = both.select("u", "v", F.size("a").alias("m"), F.size("b").alias("n"), F.size(F.array_intersect("a", "b")).alias("c"))
    return durable(common.where(F.col("c") / (F.col("m") + F.col("n") - F.col("c")) >= similarity).select("u", "v"), "similar-links")


def _members(docs: DataFrame, some: DataFrame, words: int) -> DataFrame:
    """set_key and grams of some sets (set_key, least: a row of docs that has the set)."""
    key = {"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id"), F.lit(0)), "text_key": F.col("text_key")}
    rows = docs.select(*[c.alias(k) for k, c in key.items()], "text")
    chosen = durable(some.select("set_key", F.col("least.none"), F.coalesce("least.doc_id", F.lit(0)).alias("id"), F.col("least.text_key")), "similar-chosen")
    texts = rows.join(sent(chosen, BROADCAST_KEYS), list(key)).select("set_key", "text")
    return durable(texts.mapInArrow(lean(_sets(words)), "set_key long, grams array<long>").dropDuplicates(["set_key"]), "similar-sets")


def _spread(slots: int):
    """Rows (set_key, root, grams): for each part of the shingles the entries, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, flat = (x.to_numpy() for x in (b.column("grams").offsets, b.column("grams").values))
            size, keys, roots = np.diff(ends), b.column("set_key").to_numpy(), b.column("root").to_numpy()
            for at in range(int(ends[0]), int(ends[-1]), DEALT_GRAMS):
                grams = flat[at : min(at + DEALT_GRAMS, int(ends[-1]))].view(np.uint64)
                own = np.searchsorted(ends, np.arange(at, at + len(grams)), side="right") - 1
                slot = (grams % np.uint64(slots)).astype(np.int32)
                order = np.argsort(slot, kind="stable")
                entries = np.empty(len(grams), _GRAM)
                entries["gram"], entries["root"], entries["set_key"] = grams[order], roots[own[order]], keys[own[order]]
                slot, first = np.unique(slot[order], return_index=True)
                bounds = np.append(first, len(grams)).astype(np.int32) * np.int32(_GRAM.itemsize)
                packed = pa.Array.from_buffers(pa.binary(), len(slot), [None, pa.py_buffer(bounds), pa.py_buffer(entries.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(slot), packed], names=["slot", "entries"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, entries) sorted by slot: for each set its shingles of the part, and those that sets of another root have, too."""
    now, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            entries = np.frombuffer(b"".join(held), _GRAM)
            held.clear()
            entries = entries[np.lexsort((entries["root"], entries["gram"]))]
            first = np.flatnonzero(np.concatenate(([True], entries["gram"][1:] != entries["gram"][:-1])))
            n = np.diff(np.append(first, len(entries)))
            both = np.repeat(entries["root"][first] != entries["root"][first + n - 1], n)
            keys, own = np.unique(entries["set_key"], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(own[both], minlength=len(keys))), pa.array(np.bincount(own))], names=["set_key", "shared", "size"])

    for b in batches:
        slots, packed = b.column("slot").to_pylist(), b.column("entries")
        for i in range(b.num_rows):
            if slots[i] != now:
                yield from flush()
                now = slots[i]
            held.append(packed[i].as_py())
    yield from flush()


def _possible(sets: DataFrame, roots: DataFrame, similarity: float, rounds: int = ROUNDS) -> DataFrame:
    """The sets (set_key) that may be similar to one of another root: sets of other roots have enough of their shingles.

    Two sets are similar only if they share at least `similarity` of either's shingles, all of which are then
    in sets of both roots; the rest cannot have a link. Once these are dropped, others may have too few.
    """
    rooted = sets.join(sent(roots), "set_key", "left").select("set_key", F.coalesce("root", "set_key").alias("root"), "grams")
    slots = max(GRAM_SLOTS, (sets.agg(F.sum(F.size("grams"))).first()[0] or 0) // SLOT_GRAMS)
    left = None
    for _ in range(rounds):
        some = rooted if left is None else rooted.join(sent(left), "set_key", "left_semi")
        dealt = some.mapInArrow(lean(_spread(slots)), "slot int, entries binary").repartition("slot").sortWithinPartitions("slot")
        counts = dealt.mapInArrow(lean(_shared), "set_key long, shared long, size long").groupBy("set_key").agg(F.sum("shared").alias("shared"), F.sum("size").alias("size"))
        left = durable(counts.where(F.col("shared") / F.col("size") >= similarity).select("set_key"), "similar-possible")
    return left


def _united(sets: DataFrame) -> DataFrame:
    """key, set_key: the groups in which sets (set_key, root, print) meet; those that share a set, or a root, are one."""
    met = groups(sets.select(F.col("root").alias("set_key"), "print"))
    keys = components(met.select(F.col("set_key").alias("u"), F.col("other").alias("v")))
    keys = keys.select(F.col("u").alias("root"), F.col("v").alias("key"))
    return durable(sets.select("set_key", "root").join(keys, "root", "left").select(F.coalesce("key", "root").alias("key"), "set_key"), "similar-united")


def _across(met: DataFrame, links: DataFrame, sets: DataFrame, similarity: float, chunk_grams: int, roots: DataFrame | None = None) -> DataFrame:
    """Links between sets of a group (key) that links do not connect (their components are roots, where given)."""
    roots = _roots(links) if roots is None else roots
    rooted = durable(met.select("key", "set_key").join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")).join(sets.select("set_key", F.size("grams").alias("size")), "set_key"), "similar-rooted")
    several = durable(rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.sum("size").alias("grams")).where("least < most").select("key", "grams"), "similar-several")
    # Twice as many pairs of chunks as tasks in all: of them a group gets its share of all shingles, and a set is in as many as the group has chunks.
    tasks, total = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), several.agg(F.sum("grams")).first()[0] or 1
    fair = F.least(F.ceil(F.sqrt(F.col("grams") * (4 * tasks / total))), F.ceil(F.col("grams") / FINE_GRAMS))
    several = several.select("key", F.greatest(F.ceil(F.col("grams") / chunk_grams), fair).cast("int").alias("chunks"))
    each = rooted.join(F.broadcast(several) if several.count() <= BROADCAST_KEYS else several, "key").withColumn("chunk", F.pmod(F.xxhash64("set_key"), F.col("chunks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    each = each.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "set_key", "root")
    dealt = durable(each, "similar-dealt").join(sets, "set_key").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return durable(dealt.mapInArrow(lean(_crossed(similarity)), "u long, v long").distinct(), "similar-links")


def _roots(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("u").alias("set_key"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, chunk_grams: int = CHUNK_GRAMS) -> DataFrame:
    """doc_id, text_key, component_id, keeper for each row of docs, as simhash.near_duplicates."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = durable(docs.mapInArrow(lean(_keyed(words)), "doc_id long, text_key long, set_key long, print binary"), "similar-rows")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    distinct = durable(rows.groupBy("set_key").agg(F.min(row).alias("least"), F.first("print").alias("print")), "similar-distinct")
    met = groups(distinct)
    largest = met.groupBy("set_key").agg(F.max(F.struct("n", "key", "other")).alias("most")).select(F.col("set_key").alias("u"), F.col("most.other").alias("v"))
    largest = durable(largest, "similar-largest")
    sets = _members(docs, distinct.select("set_key", "least").join(largest.select(F.col("u").alias("set_key")), "set_key", "left_semi"), words)
    links = _verified(largest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), sets, similarity)
    roots = durable(_roots(links), "similar-roots")
    possible = _possible(sets, roots, similarity)
    left = distinct.select("set_key", "print").join(sent(possible), "set_key", "left_semi").join(sent(roots), "set_key", "left")
    left = durable(left.select("set_key", F.coalesce("root", "set_key").alias("root"), "print"), "similar-left")
    links = links.unionAll(_across(_united(left), links, sets, similarity, chunk_grams, roots))
    rooted = distinct.select("set_key", "least").join(_roots(links), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    rooted = durable(rooted, "similar-components")
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("first")), "similar-roots")
    per = durable(rooted.select("set_key", "root").join(least, "root").select("set_key", "first"), "similar-firsts")
    keeper = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return rows.select("doc_id", "text_key", "set_key").join(per, "set_key").select("doc_id", "text_key", F.col("first.doc_id").alias("component_id"), keeper.alias("keeper"))
