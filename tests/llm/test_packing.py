import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from cadenza.llm import hashing, packing

SF = "/root/testdata/sf0.001"


def encoded(texts):
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    return [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def expected(rows, length):
    out = []
    for doc_id, ids in zip([r[0] for r in rows], encoded([r[1] for r in rows]), strict=True):
        for k, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at : at + length], "<u4")
            out.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check_layout(packed, length):
    """Sequences are gapless from 0 and no longer than `length`."""
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return by


def test_whole_table_against_plain_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.query(spark, SF).collect()
    assert sorted([tuple(r)[:5] for r in packed], key=str) == expected([(r.doc_id, r.text) for r in docs.collect()], packing.LENGTH)
    by = check_layout(packed, packing.LENGTH)
    assert len(by) <= 1.02 * sum(r.length for r in packed) / packing.LENGTH + 2


def test_edge_rows(spark):
    odd = "a,b 5, it's,don't.. x!, \x1cq r s <|endoftext|>foo\tbar\r\nÉTÉ, İs J̌ ß. é, 12.5 #$, ,"
    rows = [(1, None), (2, ""), (2, ""), (3, odd), (4, "word. " * 50), (None, " \n "), (5, odd.lower())]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, length string, piece int")
    packed = packing.pack_documents(docs, length=16, with_ids=True).collect()
    got = sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed], key=str)
    assert got == expected(rows, 16)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed)
    check_layout(packed, 16)


def test_added_tokens_in_another_case_and_long_documents(spark):
    rows = [(1, "a <|ENDOFTEXT|> b"), (2, "A B <|endoftext|> C"), (3, "Some Words, here. " * 3000), (3, "Some Words, here. " * 3000)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed], key=str)
    assert got == expected(rows, packing.LENGTH) and max(r.piece for r in packed) > 3
    check_layout(packed, packing.LENGTH)


def test_bins_close_early_on_a_real_table_at_little_loss(spark):
    """Online packing with few open bins: the bound binds, and costs about a hundredth."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = packing.pieces(docs, packing.vocabulary()).select("length", "doc_id", "piece").orderBy("doc_id", "piece").collect()
    lengths = [r.length for r in rows]
    bins, _, early = packing.best_fit(lengths, packing.LENGTH, packing.OPEN)
    assert early > 100
    assert max(bins) + 1 <= 1.015 * sum(lengths) / packing.LENGTH + 1


def test_a_repeated_row_is_spread_over_groups(spark):
    rows = [(None, "")] * 600 + [(i, "word " * (i % 40)) for i in range(400)]
    found = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), packing.vocabulary(), 64)
    packed = packing.pack(found, 64, group=100).collect()
    assert len(packed) == 1000
    check_layout(packed, 64)
    assert len({r.sequence_id >> 32 for r in packed if r.doc_id is None}) >= 9


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).collect() == []


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    assert packing.best_fit([6, 7, 3, 4], 10, 8) == ([0, 1, 1, 0], [0, 0, 7, 6], 0)
    # two open bins at most: the third piece closes the bin with 7, so the 3 goes beside the 6
    assert packing.best_fit([6, 7, 8, 3], 10, 2) == ([0, 1, 2, 0], [0, 0, 0, 6], 1)
    rng = random.Random(5)
    sizes = [rng.randint(1, 50) for _ in range(3000)]
    bins, places, early = packing.best_fit(sizes, 64, 4)
    assert early
    used = {}
    for size, b, at in zip(sizes, bins, places, strict=True):
        assert used.get(b, 0) == at
        used[b] = at + size
    assert max(used.values()) <= 64


def test_forgetting_words_changes_nothing():
    words = packing._Words(packing.vocabulary())
    texts = ["one two three", "four five one", "six. two, seven"]
    ids = lambda t: [list(x) for x in words.ids(*hashing.buffers(pa.array(t)))]
    before = ids(texts)
    assert before == [e[:-1] for e in encoded(texts)]
    most, packing.WORDS = packing.WORDS, 3
    try:
        assert [ids([t])[0] for t in texts] == before
    finally:
        packing.WORDS = most
