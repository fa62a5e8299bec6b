import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import infill

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
digest = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output), by the plain pattern."""
    text = text or ""
    units = UNIT.findall(text)
    h = digest(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def ours(ids, texts):
    found = infill._transformed([None if i is None else str(i) for i in ids], [None if t is None else t.encode() for t in texts], 42, 50, 80)
    return [(*r[:4], r[4].decode()) for r in found]


TEXTS = st.text(alphabet=st.sampled_from("aé漢😀 \t\n\x0b\x1c\x85 <PSM>"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-5, 500), st.none() | TEXTS), min_size=1, max_size=8), st.sampled_from([1, 2, 3, 5, 64]))
def test_any_text_in_any_block_size(rows, block):
    before, infill.BLOCK = infill.BLOCK, block
    try:
        ids, texts = zip(*rows, strict=True)
        assert ours(ids, texts) == [brute(*r) for r in rows]
    finally:
        infill.BLOCK = before


def test_states_by_three_classes_are_those_of_the_automaton():
    rng = np.random.default_rng(1)
    data = np.frombuffer(b"\xff" + bytes(rng.choice(list(b"<PSM>a \n\xc3\xa9\xff"), 5000).astype(np.uint8)), np.uint8)
    state, marks = infill._START, []
    for byte in data:
        of = infill._CLASS[byte]
        marks.append(infill._MARKS[state, of])
        state = infill._TO[state, of]
    assert infill._marked(data, 0, len(data)).tolist() == marks
    assert infill._marked(data, 1234, 1300).tolist() == marks[1234:1300]


def test_edge_rows_through_spark(spark):
    long = "".join(f" w{i}é" for i in range(400_000)) + " \n"
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (None, "a b c d"), (4, "x <P> y"), (5, "one"), *((i, f"a{i} b\n\nc  d ") for i in range(6, 60)), *((i, long) for i in range(60, 66))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, output string, n int")
    got = sorted(map(tuple, infill.transform(df).collect()), key=str)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=str)
    back = infill.transform(df).select(infill.restored(infill.F.col("output"), infill.F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_other_ids(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = infill.transform(spark.createDataFrame([("k1", "a b c")], "doc_id string, text string")).first()
    assert (got.doc_id, *got[1:]) == ("k1", *brute("k1", "a b c"))


@pytest.mark.parametrize("sf", [SF])
def test_matches_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(infill.SQL).df()
    got = infill.query(spark, sf).toPandas()
    order = lambda d: d[sorted(d.columns)].astype(object).where(lambda x: x.notna(), None).sort_values(["doc_id", "output_sha256"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.restored_sha256 == digest(docs[r.doc_id]) for r in got.itertuples())
