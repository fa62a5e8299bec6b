"""Embedding whitening with an exact covariance: integers cut into limbs whose float64 matrix products are exact.

Every entry becomes an integer x. The distinct x vectors are the fit list (one shuffle, with partial aggregation, so a
vector with many copies is one row early). A first pass sums them, a second multiplies: x less the whole part of the mean is
cut into limbs of LIMB bits, and for blocks of at most 2^ROWS rows the products of limb matrices run as float64 matrix
products, in which no sum leaves the 53 bits that are exact. Limb products are recombined as big integers in the task,
travel as digits of 32 bits whose sums Spark adds up, and are merged on the driver, where what the fraction of the mean adds is taken
off exactly. Only this D x D matrix (D entries to a vector) reaches the driver, whatever the number of rows. It is divided and rounded once, and
decomposed; its eigenvectors are refined in extended precision. A last pass projects every row.

A lost executor costs its tasks; the fit list is a table in the shared folder. Tasks hold a block of rows and a few D x D matrices.

Defined results: rows whose vector is null, or holds null, NaN or an infinity, are dropped. A table's vectors have one length, the commonest
(of two the longer); rows of another length (empty ones too) have no place in that space and are dropped as well.
64 * c beyond +-2^61 counts as that. Repeated rows and vectors are separate rows of the result and one of the fit list; a null vec_id stays.
Components are min(COMPONENTS, D). One without variance (less than 1e-18 of all) has whitened 0.0 and takes no part in
identity_error; explained is 0.0 where there is no variance at all. Equal eigenvalues leave their vectors free to turn; the
same are used for all rows. A deviation beyond a long is null. An empty table, or one without usable rows, gives an empty result. Other
columns don't take part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import staged, table

SCALE, OFFSET, MOST = 64.0, 1_000_000, float(1 << 61)
COMPONENTS = 16
#: 2^ROWS products of two limbs of LIMB bits each stay within 53 bits.
LIMB, ROWS = 20, 13
#: Bits of the digits in which big integers travel.
DIGIT = 32


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry c."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-MOST)), F.lit(MOST))) + F.lit(OFFSET).cast("long"))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose entries are all numbers."""
    finite = F.forall(F.col("v"), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite)
    return rows.select("vec_id", whole_numbers(F.col("v")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(k, digit) with the sum of digit * 2^(DIGIT k) = value; the sign is the digits'."""
    sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        yield k, sign * (value & ((1 << DIGIT) - 1))
        value >>= DIGIT
        k += 1


def _summed(rows: DataFrame, width: int, task: Callable[[Iterator[np.ndarray]], Iterator[tuple[int, int, int]]]) -> dict[tuple[int, int], int]:
    """Sums over all tasks of the big integers (i, j, value) that `task` makes of a task's blocks."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (_matrix(b.column("x").slice(lo, 1 << ROWS), width) for b in batches for lo in range(0, len(b), 1 << ROWS))
        found = [(i, j, k, d) for i, j, value in task(blocks) for k, d in _digits(value)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["i", "j", "k", "digit"])

    # A digit has 32 bits, so a long holds the sum of 2^31 tasks.
    sums = rows.select("x").mapInArrow(over, "i bigint, j bigint, k bigint, digit bigint").groupBy("i", "j", "k").agg(F.sum("digit").alias("digit"))
    out: dict[tuple[int, int], int] = defaultdict(int)
    for r in sums.collect():  # D^2 numbers of a few digits each
        out[r.i, r.j] += r.digit << (DIGIT * r.k) if r.digit >= 0 else -(-r.digit << (DIGIT * r.k))
    return out


def column_sums(blocks: Iterator[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(0, j, sum of x_j) and (1, 0, number of rows)."""
    n, high, low = 0, 0, 0
    for x in blocks:
        n += len(x)
        high = high + (x >> 32).sum(axis=0).astype(object)
        low = low + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
    if n:
        yield 1, 0, n
        yield from ((0, j, (int(h) << 32) + int(v)) for j, (h, v) in enumerate(zip(high, low, strict=True)))


def limbs(z: np.ndarray) -> list[np.ndarray]:
    """Float matrices whose sum with weights 2^(LIMB i) is z; as many as its largest entry needs. All but the last aren't negative."""
    out = []
    while True:
        if z.size == 0 or (z.max() < 1 << (LIMB - 1) and z.min() >= -(1 << (LIMB - 1))):
            return [*out, z.astype(np.float64)]
        out.append((z & ((1 << LIMB) - 1)).astype(np.float64))
        z = z >> LIMB


def products(blocks: Iterator[np.ndarray], centre: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, sum of z_i z_j) for i <= j, where z = x - centre, exactly."""
    total: np.ndarray | int = 0
    held: dict[int, np.ndarray] = {}  # sums of limb products by weight, in longs
    blocks_held = 0

    def recombined() -> np.ndarray | int:
        return sum(m.astype(object) * (1 << (LIMB * w)) for w, m in held.items())

    for x in blocks:
        parts = limbs(x - centre)
        for a, left in enumerate(parts):
            for b in range(a, len(parts)):
                product = (left.T @ parts[b]).astype(np.int64)
                held[a + b] = held.get(a + b, 0) + (product if a == b else product + product.T)
        blocks_held += 1
        if blocks_held == 64:  # 64 blocks of 4 * 2 products of 53 bits stay below 63
            total, held, blocks_held = total + recombined(), {}, 0
    total = total + recombined()
    if isinstance(total, np.ndarray):
        width = len(total)
        yield from ((i, j, int(total[i, j])) for i in range(width) for j in range(i, width))


@dataclass
class Model:
    """A fitted whitening: n vectors with sums s; x is centred at `centre` + rest / n; columns of `vectors` are the components."""

    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, as doubles: both parts of the difference are exact before they meet."""
        return (x - self.centre).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        real = self.values > 0
        scale = np.where(real, 1 / np.sqrt(np.where(real, self.values, 1.0)), 0.0)
        return self.centred(x) @ (self.vectors * scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n x - s)^2, exactly; null beyond a long."""
        z, most = x - self.centre, max(map(abs, self.rest), default=0)
        if (int(np.abs(z).max(initial=0)) * self.n + most) ** 2 * x.shape[1] < 1 << 63:
            return ((z * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((z.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _refined(v: np.ndarray, values: np.ndarray, vectors: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of v to double precision: first-order corrections worked out in extended precision.

    Pairs of values too close to tell apart are only made orthonormal.
    """
    a, q = v.astype(np.longdouble), vectors.astype(np.longdouble)
    for _ in range(rounds):
        r = np.eye(len(a), dtype=np.longdouble) - q.T @ q
        s = q.T @ a @ q
        s = (s + s.T) / 2  # else its rounding would undo right angles
        lam = np.diag(s) / (1 - np.diag(r))
        gap = lam[None, :] - lam[:, None]
        noise = 2 * (np.sqrt(((s - np.diag(lam)) ** 2).sum()) + np.abs(lam).max() * np.sqrt((r**2).sum()))
        apart = np.abs(gap) > noise
        q = q + q @ np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return lam.astype(np.float64), q.astype(np.float64)


def decomposed(n: int, sums: list[int], moments: dict[tuple[int, int], int], centre: list[int], most: int = COMPONENTS) -> Model:
    """The model from exact sums: of x, and of (x_i - centre_i)(x_j - centre_j)."""
    width = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((width, width))
    trace = 0
    for i in range(width):
        for j in range(i, width):
            exact = n * moments.get((i, j), 0) - rest[i] * rest[j]
            v[i, j] = v[j, i] = exact / (n * n)  # Python rounds a quotient of integers once
            trace += exact if i == j else 0
    total = float(Fraction(trace, n * n))
    values, vectors = np.linalg.eigh(v)
    if total:
        values, vectors = _refined(v, values, vectors)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    values = np.where(values > 1e-18 * total, values, 0.0)
    return Model(n, np.array(centre, np.int64), rest, values, vectors / np.linalg.norm(vectors, axis=0), values / total if total else values * 0.0)


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """The distinct vectors of the commonest length, and that length (0 if there is none)."""
    distinct = staged(rows.select("x").distinct().withColumn("width", F.size("x")))
    width = rows.groupBy(F.size("x").alias("width")).count().where("width > 0").orderBy(F.desc("count"), F.desc("width")).select("width").first()
    return (distinct.where(F.col("width") == width[0]), width[0]) if width else (distinct.limit(0), 0)


def fit(distinct: DataFrame, width: int, most: int = COMPONENTS) -> Model:
    """The components of a fit list of vectors with `width` entries."""
    found = _summed(distinct, width, column_sums)
    n, sums = found[1, 0], [found[0, j] for j in range(width)]
    centre = [s // n for s in sums]
    at = np.array(centre, np.int64)
    return decomposed(n, sums, _summed(distinct, width, lambda blocks: products(blocks, at)), centre, most)


def identity_error(distinct: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity, from the whitened values themselves."""
    real = np.flatnonzero(model.values > 0)
    k, width = len(real), len(model.centre)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(_matrix(batch.column("x"), width))[:, real]
            sums += w.sum(axis=0)
            squares += w.T @ w
        values = np.concatenate([sums, squares.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], ["i", "v"])

    found = np.zeros(k + k * k)
    for r in distinct.select("x").mapInArrow(over, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # k + k^2 rows
        found[r.i] = r.v
    mean = found[:k] / model.n
    return float(np.abs(found[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component."""
    rows = usable(vectors)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    distinct, width = fit_list(rows)
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    model = fit(distinct, width, most)
    error = identity_error(distinct, model)
    k = len(model.values)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            again = np.repeat(np.arange(len(x)), k)
            constant = lambda v, t: pa.array(np.full(len(again), v), t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), constant(model.n, pa.int64()),
                 pa.array(model.deviations(x), pa.int64()).take(pa.array(again)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, len(x))),
                 constant(error, pa.float64())],
                [f.split()[0] for f in schema.split(", ")],
            )

    return rows.where(F.size("x") == width).mapInArrow(over, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of the embeddings on the first components of their distinct vectors."""
    return whitened(table(spark, sf_dir, "embeddings"))
