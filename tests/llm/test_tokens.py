import glob
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import rans, tokens


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=4000), st.integers(0, 10**6))
def test_round_trip(ids, seed):
    more = np.random.default_rng(seed).geometric(0.05, 3000) if seed % 3 == 0 else np.empty(0, int)
    ids = np.array([*ids, *more], np.int64)
    counts = np.bincount(ids, minlength=2) + (np.arange(max(ids.max(initial=1) + 1, 2)) % 7 == 0)
    coder = rans.Coder(*rans.quantized(counts), lanes=16, every=5)
    words, marks = coder.encode(ids)
    wide = words.astype(np.uint64)
    assert coder.decode(wide, marks[0], 0, len(ids), len(ids)).tolist() == ids.tolist()
    for m in marks:  # decoding can start at every checkpoint
        first = m[0] * 16
        assert coder.decode(wide, m, first, len(ids), len(ids)).tolist() == ids[first:].tolist()


def test_quantized_sums():
    for counts in ([1], [10**9, 1, 1, 0, 3], [1] * 70_000, [0, 0]):
        freq, bits = rans.quantized(np.array(counts))
        assert freq.sum() in (1 << bits, 0)
        assert ((freq > 0) == (np.array(counts) > 0)).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcZ'sdÀÿ×÷µªÅß Éé\n\t\r\x0b\x0c \xa0̸́가가Σς<|>éñ.,!0١\U0001f600", "<|endoftext|>", "'ll "]), max_size=40).map("".join))
def test_pieces_equal_whole_texts(text):
    e = _encoder()
    assert e.encode([text]) == e.whole([text])


_E = []


def _encoder():
    if not _E:
        _E.append(tokens.Encoder(tokens.default_tokenizer()))
    return _E[0]


def test_pieces_equal_whole_documents():
    e = _encoder()
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    assert e.encode(texts) == e.whole(texts)


def brute(rows):
    e, start, out = _encoder(), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark, tmp_path):
    rows = [(9, "b a"), (3, None), (4, ""), (-2, "long words " * 50_000), (None, "none"), (7, "x" * 300), (8, "same"), (8, "same")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    for block in (tokens.BLOCK, 4):
        path = f"file://{tmp_path}/t{block}"
        tokens.write_tokens(docs, path, block=block)
        assert sorted(map(tuple, tokens.read_tokens(spark, path).collect()), key=str) == sorted(brute(rows), key=str)
    got = {r.doc_id: r.ids for r in tokens.read_tokens(spark, path, with_ids=True).collect()}
    assert got[3] == [1] and got[9][-1] == 1
    row = next(r.asDict(recursive=True) for r in spark.read.parquet(f"{path}/blocks").collect() if r.n_ids > 100_000)
    coder = rans.Coder(*tokens.read_table(spark, path))
    whole = tokens.decoded_block(coder, row)
    assert tokens.decoded_block(coder, row, 70_001, 70_100).tolist() == whole[70_001:70_100].tolist()
    with pytest.raises(ValueError):
        tokens.decoded_block(coder, row | {"words": b"\0" + row["words"][1:]})


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokens.write_tokens(docs, f"file://{tmp_path}/e")
    assert tokens.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{glob.glob(sf + '/documents.parquet')[0]}'").fetchall()
    assert sorted(map(tuple, tokens.op2_tokens(spark, sf).collect())) == sorted(brute(rows))
