import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest

from cadenza.llm import decontam

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    """(doc_id, n_words, n_hit, items, hit words) by comparing every window with every place."""
    found = [("" if i is None else str(i), words(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item, v in found:
            k = min(size, len(v))
            wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    named.add(item)
                    hit.update(range(i, i + k))
        out.append((doc_id, len(w), len(hit), sorted(named), sorted(hit)))
    return out


def ours(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words int, items string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, pattern string")
    texts = {}
    rows = decontam.contaminations(d, b, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items, [tuple(s) for s in r.spans]) for r in rows), key=str)


def spans(text, hit):
    """Hit words as merged spans of code points."""
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))] if text else []
    out = []
    for i in hit:
        if out and out[-1][2] == i - 1:
            out[-1] = (out[-1][0], at[i][1], i)
        else:
            out.append((*at[i], i))
    return [(a, b) for a, b, _ in out]


def expected(docs, items, size=10):
    return sorted(((i, n, h, named, spans(t, hit)) for (i, t), (_, n, h, named, hit) in zip(docs, brute(docs, items, size), strict=True)), key=str)


def made(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(["a", "b", "A", "é", "7", "漢"]) + rng.choice([" ", ", ", "\n", "_", "\x7f."]) for _ in range(n))
    items = [(i % 7 if i % 5 else None, text(rng.randrange(0, 9))) for i in range(12)] + [(50, "Ab"), (51, None), (52, "--")]
    return [(i if i % 4 else None, text(rng.randrange(0, 60))) for i in range(60)] + [(61, None), (62, ""), (63, " . ")] * 2, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, seed, monkeypatch):
    docs, items = made(seed)
    monkeypatch.setattr(decontam, "PIECE", 64)  # many pieces for each text
    assert ours(spark, docs, items, size=3) == expected(docs, items, 3)


def test_more_groups_than_one(spark):
    docs, items = made(9)
    assert ours(spark, docs, items, size=3, most=30) == expected(docs, items, 3)


def test_pieces_of_any_size():
    rng = random.Random(5)
    patterns = [(b" a b ", 2, ["x"]), (b" b ", 1, ["y"]), (b" a b a b ", 4, ["z"])]
    found = decontam.Automaton(patterns)
    text = decontam.normalised("".join(rng.choice("ab ") for _ in range(3000)).encode())
    whole = [*found.matches(text)]
    for piece in (1, 2, 7, 100):
        before, decontam.PIECE = decontam.PIECE, piece
        try:
            assert [*found.matches(text)] == whole
        finally:
            decontam.PIECE = before


def test_whole_windows_only(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, item.upper()), (2, item.replace(" ", "  -\n")), (3, "x" + item), (4, " ".join(item.split()[:9])), (5, " ".join(item.split()[:10])), (6, item + "x"), (7, ("v " * 300_000) + item)]
    got = {r[0]: r for r in ours(spark, docs, [(1, item), (2, item)])}
    assert {i: r[2] for i, r in got.items()} == {1: 12, 2: 12, 3: 11, 4: 0, 5: 10, 6: 11, 7: 12}
    assert got[1][3] == ["1", "2"] and got[7][4] == [(600_000, 600_000 + len(item))]
    d = spark.createDataFrame([(*r, "x") for r in docs + [(4, item), (None, "ok")]], "doc_id long, text string, bad string")
    assert [r.doc_id for r in decontam.cleaned(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [None]


def test_empty_sides(spark):
    docs = [(1, "a b"), (2, None)]
    assert [r[2] for r in ours(spark, docs, [])] == [0, 0] and ours(spark, [], [(1, "a")]) == []
    assert [r[2] for r in ours(spark, docs, [(1, None), (2, "?")])] == [0, 0]


@pytest.mark.parametrize("sf", [SF])
def test_matches_oracle_and_brute_force(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    order = lambda d: d[sorted(d.columns)].sort_values("doc_id").reset_index(drop=True)
    got = order(decontam.query(spark, sf).toPandas())
    pd.testing.assert_frame_equal(got, order(con.sql(decontam.SQL).df()), check_dtype=False)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    known = {i: (n, h, len(named), hashlib.sha256(",".join(named).encode()).hexdigest()) for i, n, h, named, _ in brute(docs, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.itertuples()} == known
    assert got.contaminated.any()
