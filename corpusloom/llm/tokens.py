"""Token ids of documents in a binary file format with static rANS blocks.

Format, under one folder: `table` (id, freq) is the frequency table that all
blocks share; `blocks` has a row for each independent block: shard, block (in
ascending order, ids follow ascending doc_id), doc_ids and doc_lens (a document
lies in one block), words (little-endian 32-bit rANS words), checkpoints (step,
word offset and lane states; decoding can start at each), and crc32 checksums
of the words and of the ids.

Texts are dealt by ranges of doc_id once; the blocks of ids are written, counted
over all blocks, and encoded where they lie. Texts are cut at white space, and
the tokenizer library encodes each different piece when it is first met (letters
and the marks after them apart, where its pre-tokenizer parts them too); this
equals encoding the whole text for tokenizers that split at white space and drop
it, which is tested for the file used here (`split_safe=False` encodes whole texts
instead).

Cases: a null or empty text gives the end id alone; null ids come first; rows
with one id are ordered by a hash of the text and all written; an empty table
gives empty folders that read back as no rows; other columns are ignored; a
document longer than a block makes its block longer.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import lean, parts
from corpusloom.llm.rans import EVERY, LANES, Coder, quantized
from corpusloom.session import durable, shared_path, table

#: Ids in a block, but for its last document.
BLOCK = 1 << 19
END_ID = 1
#: Pieces in one of the two generations that a worker keeps: about 200 bytes each.
CACHE = 700_000
PIECE = 64
#: Bytes of the documents that are encoded in one go (or one document): their different pieces are looked up once.
CHARS = 12 << 20

TEMP = "shard int, block int, doc_ids array<long>, doc_lens array<int>, ids binary, counts array<struct<id:int,n:long>>"
BLOCKS = "shard int, block int, n_ids long, doc_ids array<long>, doc_lens array<int>, words binary, checkpoints array<struct<step:int,offset:int,states:binary>>, words_crc32 long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Pieces(dict):
    """Ids of white-space separated pieces, made when first met; `old` holds the generation before."""

    def __init__(self, encoder: Encoder, old: dict[str, bytes]):
        super().__init__()
        self.encoder, self.old, self.kind, self.merged = encoder, old, encoder.kind, encoder.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        made = self.old.get(piece)
        if made is None:
            if not self.encoder.simple:
                made = self.encoder.whole([piece])[0]
            elif piece.isascii():
                if piece.isalpha():
                    made = array(self.kind, [t.id for t in self.merged(piece.lower())]).tobytes()
                elif piece[:-1].isalpha() and piece[-1] in MARKS:
                    made = self[piece[:-1]] + self[piece[-1]]
            if made is None:
                made = self._made(piece)
        if len(piece) <= PIECE:
            self[piece] = made
        return made

    def _made(self, piece: str) -> bytes:
        if (m := SIMPLE.fullmatch(piece)) and "<|" not in piece:
            letters, marks = m.groups()
            if not marks:
                return array(self.kind, [t.id for t in self.merged("".join([BYTES[b] for b in letters.lower().encode()]))]).tobytes()
            if letters:
                return self[letters] + self[marks]
        return self.encoder.whole([piece])[0]


#: Letters that NFC leaves alone and that are lower-cased one by one, then ASCII marks but the apostrophe: the pre-tokenizer of SIMPLE_FOR parts them.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
MARKS = frozenset(".,;:!?)(|*%$#&")
SIMPLE_FOR = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
#: Byte-level vocabularies write bytes that are not printable Latin-1 as the code points from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN_AS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
BYTES = [chr(_SHOWN_AS.get(b, b)) for b in range(256)]


class Encoder:
    """Texts to little-endian ids of `kind` (array type code H or I)."""

    def __init__(self, path: str, split_safe: bool = True, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.split_safe, self.most = Tokenizer.from_file(path), split_safe, most
        self.model = self.tokenizer.model
        self.vocab = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = "H" if self.vocab <= 1 << 16 else "I"
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.simple = spec["normalizer"] == SIMPLE_FOR["normalizer"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SIMPLE_FOR["split"]} and not steps[1]["add_prefix_space"]
        self.pieces = Pieces(self, {})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.split_safe or not texts:
            return self.whole(texts)
        made = pa.array(texts, pa.large_string())
        if self.simple:  # A-Z only
            lowered = pc.ascii_lower(made)
            made = pc.if_else(pc.match_substring(made, "<|"), made, lowered)
            del lowered
        cut = pc.split_pattern(pc.replace_substring(made, "\n", " "), " ")
        del made
        bounds, words = cut.offsets.to_numpy() - cut.offsets[0].as_py(), cut.flatten().dictionary_encode()
        del cut
        codes = list(map(self.pieces.__getitem__, words.dictionary.to_pylist()))
        width = array(self.kind).itemsize
        sizes = np.fromiter(map(len, codes), np.int32, len(codes)) // width
        ids = np.frombuffer(b"".join(codes), f"<u{width}")
        del codes
        if len(self.pieces) > self.most:
            old, self.pieces = self.pieces, Pieces(self, {})
            old.old = {}
            self.pieces.old = old
        which = words.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n, dtype=np.int64)
        # Of each word's ids the place in ids, less the place in the texts.
        at = np.repeat(((np.cumsum(sizes, dtype=np.int64) - sizes)[which] - (ends - n)).astype(np.int32 if len(ends) and ends[-1] < 1 << 31 and len(ids) < 1 << 31 else np.int64), n)
        at += np.arange(len(at), dtype=at.dtype)
        del words, which, n
        data = ids[at].tobytes()
        del at
        cuts = (np.append(0, ends)[bounds] * width).tolist()
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]


_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}


def encoder_of(path: str, split_safe: bool, most: int) -> Encoder:
    """The worker's own; a worker that is used again keeps its pieces."""
    key = path, split_safe, most
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def _tokenized(path: str, end_id: int, split_safe: bool, block: int, pieces: int, chars: int):
    """Sorted rows (doc_id, text) of a shard to blocks of zstd-compressed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = encoder_of(path, split_safe, pieces)
        end, width = array(encoder.kind, [end_id]).tobytes(), array(encoder.kind).itemsize
        pack = zstandard.ZstdCompressor(level=1)
        shard, number, docs, lens, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(ids), f"<u{width}").astype("<u4")
            n = np.bincount(whole)
            used = np.flatnonzero(n)
            counts = pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), pa.StructArray.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], names=["id", "n"]))
            # Low and high halves apart: zstd finds more in each.
            halves = np.concatenate([(whole & 0xFF).astype(np.uint8), (whole >> 8 & 0xFF).astype(np.uint8), (whole >> 16).astype("<u2").view(np.uint8)])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())), pa.array([pack.compress(halves.tobytes())], pa.binary()), counts],
                names=["shard", "block", "doc_ids", "doc_lens", "ids", "counts"],
            )

        for b in (x for whole in batches for x in parts(whole, chars)):
            texts = [t or "" for t in b.column("text").to_pylist()]
            for name, code in zip(b.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += [code, end]
                docs.append(name)
                lens.append(len(code) // width + 1)
                held += lens[-1]
                if held >= block:
                    yield row()
                    number, docs, lens, ids, held = number + 1, [], [], [], 0
        if docs:
            yield row()

    return run


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 4
    return raw[:n].astype(np.uint32) | raw[n : 2 * n].astype(np.uint32) << 8 | raw[2 * n :].view("<u2").astype(np.uint32) << 16


def _encoded(freq: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq, bits)
        for b in batches:
            for r in b.to_pylist():
                ids = _unpacked(r["ids"])
                words, marks = coder.encode(ids)
                data = words.astype("<u4").tobytes()
                row = {
                    "shard": r["shard"], "block": r["block"], "n_ids": len(ids), "doc_ids": r["doc_ids"], "doc_lens": r["doc_lens"], "words": data,
                    "checkpoints": [{"step": s, "offset": o, "states": x.astype("<u8").tobytes()} for s, o, x in marks],
                    "words_crc32": zlib.crc32(data), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
                }
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS_ARROW)

    return run


_BLOCKS_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())), ("words", pa.binary()),
     ("checkpoints", pa.list_(pa.struct([("step", pa.int32()), ("offset", pa.int32()), ("states", pa.binary())]))), ("words_crc32", pa.int64()), ("ids_crc32", pa.int64())]
)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, split_safe: bool = True, block: int = BLOCK, pieces: int = CACHE, chars: int = CHARS) -> None:
    """Writes the ids of docs (doc_id, text) under path. pieces: how many a worker keeps, chars: what it encodes at once; memory against time."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    temp = durable(dealt.mapInArrow(lean(_tokenized(tokenizer or default_tokenizer(), end_id, split_safe, block, pieces, chars)), TEMP), "token-blocks")
    counts = temp.select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    per = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        per[r.id] = r.n
    freq, bits = quantized(per)
    used = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(used, "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    temp.drop("counts").mapInArrow(lean(_encoded(freq, bits)), BLOCKS).write.parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    rows = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r.id] = r.freq
    return freq, max(int(freq.sum()), 1).bit_length() - 1


def decoded_block(coder: Coder, row: dict, first: int = 0, end: int | None = None) -> np.ndarray:
    """Ids first to end of a block, from the nearest checkpoint; checksums are verified."""
    if zlib.crc32(row["words"]) != row["words_crc32"]:
        raise ValueError(f"words of block {row['shard']}/{row['block']} are damaged")
    end = row["n_ids"] if end is None else end
    words = np.frombuffer(row["words"], "<u4").astype(np.uint64)
    mark = [c for c in row["checkpoints"] if c["step"] * coder.lanes <= first][-1]
    ids = coder.decode(words, (mark["step"], mark["offset"], np.frombuffer(mark["states"], "<u8").astype(np.uint64)), first, end, row["n_ids"])
    if end - first == row["n_ids"] and zlib.crc32(ids.astype("<u4").tobytes()) != row["ids_crc32"]:
        raise ValueError(f"ids of block {row['shard']}/{row['block']} are damaged")
    return ids


def _documents(freq: np.ndarray, bits: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq, bits)
        for b in batches:
            for r in b.to_pylist():
                data = decoded_block(coder, r).astype("<u4")
                ends = np.cumsum(r["doc_lens"])
                starts = ends - r["doc_lens"]
                parts = [data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(parts)
                out = [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(r["doc_lens"], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                names = ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the files."""
    freq, bits = read_table(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row a shard, then one a block: sums of what precedes.
    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "before")
    order = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", "n_ids").withColumn("within", F.sum("n_ids").over(order) - F.col("n_ids")).join(per_shard, "shard").select("shard", "block", (F.col("before") + F.col("within")).alias("first"))
    schema = "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = blocks.mapInArrow(lean(_documents(freq, bits, with_ids)), schema).join(starts, ["shard", "block"])
    return docs.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokenized(docs: DataFrame, pieces: int = CACHE, chars: int = CHARS) -> DataFrame:
    """Writes docs in the shared folder and reads the files back."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, pieces=pieces, chars=chars)
    return read_tokens(spark, path)


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"))


assert LANES * EVERY <= BLOCK
