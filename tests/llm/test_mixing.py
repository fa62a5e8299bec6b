import math
import re

from cadenza.llm import mixing

SF = "/root/testdata/sf0.001"


def targets(sizes, weights, budget, most):
    """Water filling by repeated resharing."""
    order = sorted(sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    total, fixed = budget * sum(sizes.values()), {}
    while True:
        free = [k for k in order if k not in fixed]
        left = total - sum(fixed.values())
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return fixed | share
        fixed |= {k: most * sizes[k] for k in over}


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda s: (s is None, s or "")
    sizes = {}
    for _, t, s in rows:
        sizes[key(s)] = sizes.get(key(s), 0) + size(t)
    known = targets(sizes, mixing.WEIGHTS, mixing.BUDGET, mixing.MOST)
    taken, source = {}, {r[0]: key(r[2]) for r in rows}
    for doc_id, n, source_size, target, words in got:
        k = source[doc_id]
        assert source_size == sizes[k] and abs(target - known[k]) < 1e-6 * max(1, known[k])
        assert words in ({0} if not n else {n * math.floor(target / source_size), n * math.ceil(target / source_size)}) and words <= 2 * n
        taken[k] = taken.get(k, 0) + words
    return known, taken


def test_whole_table(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in mixing.query(spark, SF).collect()]
    assert len(got) == len(rows)
    check(rows, got)
    assert sorted(got) == sorted(tuple(r) for r in mixing.query(spark, SF).collect())


def test_a_hot_source_comes_near_its_target(spark):
    rows = [(i, "w " * (1 + i % 97), f"s{0 if i % 3 else i % 7}") for i in range(6000)]
    planned = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = [(r.row.doc_id, r.size, r.source_size, r.target, r.copies * r.size) for r in planned.collect()]
    known, taken = check(rows, got)
    for k, target in known.items():
        assert abs(taken[k] - target) < 0.02 * target


def test_ties_of_size_and_id_keep_their_order(spark):
    rows = [(i // 3, f"w{i % 3} " * (i % 5), "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(tuple(r) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "a"), (2, "x " * 10, "a")], "doc_id long, text string, source string")
    assert {r.row.doc_id: r.size for r in mixing.plan_mix(docs).collect()} == {1: 400_000, 2: 10}


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (4, "q", "B"), (5, "z " * 50, "b"), (None, "n n", "b"), (6, "only blank sources", ""), (7, "  ", "zero")]
    docs = spark.createDataFrame([(*r, 1, "c", 2.0) for r in rows], "doc_id long, text string, source string, size int, copies string, target double")
    planned = mixing.plan_mix(docs).collect()
    assert len(planned) == len(rows)
    assert {r.row.doc_id: (r.size, r.copies, r.target) for r in planned if r.row.source in ("a", "zero")} == {1: (0, 0, 0.0), 2: (0, 0, 0.0), 7: (0, 0, 0.0)}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in planned)
    assert mixing.mix(docs.limit(0)).collect() == []


