import math
from fractions import Fraction

import numpy as np
import pytest

from cadenza.llm import whitening

SF = "/root/testdata/sf0.01"


def numbers(v):
    return [max(min(math.floor(max(min(64.0 * c, 2.0**61), -(2.0**61))), 1 << 61), -(1 << 61)) + 1_000_000 for c in v]


def brute(rows, most=16):
    """Exact sums and deviations with Python integers, whitened values by numpy from the exact covariance: {vec_id: [...]}, explained."""
    kept = [(i, numbers([float(np.float32(c)) for c in v])) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, width = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(width)]
    y = [[n * a - b for a, b in zip(x, s, strict=True)] for x in fit]
    exact = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(width)] for i in range(width)]
    values, vectors = np.linalg.eigh(np.array([[float(e) for e in r] for r in exact]))
    order = np.argsort(-values)[:most]
    trace = float(sum(exact[i][i] for i in range(width)))
    centred = lambda x: np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
    out = [(i, n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), centred(x) @ vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300))) for i, x in kept]
    return out, values[order] / trace


def collected(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.vec_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.component) for k, v in by.items()}


def agrees(found, rows, most=16, tolerance=1e-8):
    known, explained = brute(rows, most)
    assert {*found} == {i for i, *_ in known}
    signs = None
    for i, n, deviation, w in known:
        rs = found[i]
        assert [r.component for r in rs] == [*range(1, len(w) + 1)]
        assert all((r.n, r.deviation) == (n, deviation if deviation < 1 << 63 else None) for r in rs)
        got = np.array([r.whitened for r in rs])
        signs = np.sign(got * w) if signs is None else signs
        assert got * signs == pytest.approx(w, abs=tolerance)
        assert [r.explained for r in rs] == pytest.approx(explained, rel=1e-9)
        assert rs[0].identity_error <= 1e-4 and len({r.identity_error for r in rs}) == 1


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    agrees(collected(whitening.query(spark, SF)), rows)


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [9, 5, 3, 1, 0.3]).tolist()) for i in range(80)] + [(900 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(50)]
    bad = [(500, None), (501, [1.0, None, 2.0, 3.0, 4.0]), (502, [math.nan] * 5), (503, [math.inf, 0.0, 0.0, 0.0, 0.0]), (504, []), (505, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, x string, component int")
    agrees(collected(whitening.whitened(df)), rows)
    null = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 5.0])], "vec_id string, embedding array<double>")
    got = whitening.whitened(null).collect()
    assert len(got) == 4 and {r.vec_id for r in got} == {None}
    # Two points lie on a line: the second component has no variance.
    assert sorted((r.component, round(abs(r.whitened), 9)) for r in got) == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.0)]


def test_large_entries_stay_exact(spark):
    """Entries from 1 to 1e17 in one table: several limbs, deviations beyond a long."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=3) * [1e9, 3e8, 1e8]]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    agrees(collected(whitening.whitened(df)), rows)
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [5.0, -7.0])], "vec_id long, embedding array<double>")
    got = collected(whitening.whitened(huge))
    assert {*got} == {1, 2, 3} and got[1][0].deviation is None and got[1][0].identity_error <= 1e-4


def test_limb_products_are_exact():
    rng = np.random.default_rng(7)
    x = rng.integers(-(1 << 61), 1 << 61, size=(300, 4)) >> rng.integers(0, 60, size=(300, 4))
    x[0], x[1] = (1 << 61), -(1 << 61)
    centre = np.array([3, -5, 1 << 60, 0])
    z = [[int(v) for v in r] for r in x - centre]
    assert all(sum(int(p[i, j]) << (whitening.LIMB * k) for k, p in enumerate(whitening.limbs(x - centre))) == z[i][j] for i in range(300) for j in range(4))
    blocks = [x[:100], x[100:130], x[130:]] + [x[:1]] * 70
    z = [r for b in blocks for r in ([int(v) for v in row] for row in b - centre)]
    want = {(i, j): sum(r[i] * r[j] for r in z) for i in range(4) for j in range(i, 4)}
    assert {(i, j): v for i, j, v in whitening.products(iter(blocks), centre)} == want
    assert {i: v for a, i, v in whitening.column_sums(iter(blocks)) if a == 0} == {j: sum(int(r[j]) for b in blocks for r in b) for j in range(4)}
    for v in (0, 1, -1, 1 << 32, -(1 << 95) - 7):
        assert sum(d << (32 * k) if d >= 0 else -(-d << (32 * k)) for k, d in whitening._digits(v)) == v


def test_small_components_are_refined():
    """Variances over twelve powers of ten: the small eigenvalues keep their digits."""
    rng = np.random.default_rng(11)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    values = 10.0 ** -np.arange(0, 12, 1.5)
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    found, vectors = whitening._refined(v, *np.linalg.eigh(v))
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-15
    t = vectors.astype(np.longdouble).T @ v.astype(np.longdouble) @ vectors.astype(np.longdouble)
    assert np.abs(np.diag(t) / found - 1).max() < 1e-4


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        df = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
