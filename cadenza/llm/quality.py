"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

The score's log odds are a sum of lookup tables: one for each feature, and one for each of a few pairs
of features. The tables are learned by cyclic boosting: round after round, each feature in turn gets a
shallow tree on its binned values, fitted to what is still unexplained; then the pairs with the
largest remaining signal get small two-way trees. Scoring bins a text's features and adds up entries.

Features come from the whole text alone (doc_id, labels, lang and source are never inputs), in
vectorised passes over the text's bytes. The model is fitted on the driver from at most SAMPLE
labelled rows, those with the smallest hash of doc_id among labelled rows whose crc32(doc_id as text)
modulo FOLDS is not 0. This sample is the only bounded input; features and scores cover all rows.

Defined results: null text counts as empty; empty texts get the score of their zero features. Labels
that are null don't count; of several labels of a doc_id the largest does, and of its texts the least. Without labelled rows of
both kinds every score is the share of label 1 (0.001 to 0.999), or 0.5. An empty table gives an empty result. Repeated
rows are scored alike. Columns beside text pass through `score` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import hashing
from cadenza.llm.common import table, tidied

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3

FEATURES = (
    "log_words", "bytes_per_word", "upper", "digit", "mark", "point", "line_end", "short_words", "long_words",
    "capital_words", "marked_words", "distinct_words", "distinct_pairs", "words_per_line", "top_byte", "wide",
)


def _mask(spec: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(spec.encode("latin-1"))] = True
    return out


_UPPER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
_POINT, _LINE = _mask(".,;:?'\"()-"), _mask("\n")
_MARK = _mask("!#$%&*+/<=>@[\\]^_`{|}~")


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each owner, by 44 bits of each value."""
    keys = np.sort(owner.astype(np.uint64) << np.uint64(44) | values >> np.uint64(20))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=n).astype(float)


def _statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, size = len(bounds) - 1, np.diff(bounds)
    bytes_of = np.bincount(np.repeat(np.arange(n) * 256, size) + data, minlength=n * 256).reshape(n, 256).astype(float)
    count = lambda m: bytes_of[:, m].sum(1)
    per = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    solid = count(~hashing.IS_SPACE)
    starts, stops, words = hashing.words(data, bounds)
    hashes = hashing.hashes(data, starts, stops)
    owner, many, length = np.repeat(np.arange(n), words), words.astype(float), stops - starts
    by_word = lambda m: np.bincount(owner, weights=m, minlength=n)
    inside = owner[:-1] == owner[1:]
    pairs = hashing.mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[inside]
    lines = count(_LINE) + (size > 0)
    columns = [
        np.log1p(many), per(solid, many), per(count(_UPPER), solid), per(count(_DIGIT), solid),
        per(count(_MARK), solid), per(count(_POINT), solid), per(lines, many),
        per(by_word(length <= 3), many), per(by_word(length >= 12), many),
        per(by_word(_UPPER[data[starts]]), many), per(by_word(_MARK[data[stops - 1]]), many),
        per(_distinct(hashes, owner, n), many), per(_distinct(pairs, owner[:-1][inside], n), np.maximum(many - 1, 0)),
        per(many, lines), per(bytes_of[:, list(b"!#$%&*|")].max(1), solid), per(bytes_of[:, 128:192].sum(1), size.astype(float)),
    ]
    return np.column_stack(columns)


def features(texts: pa.Array) -> np.ndarray:
    data, offsets = hashing.buffers(texts)
    parts = [_statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in hashing.pieces(offsets)]
    return np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Additive:
    """Lookup tables over binned features: log odds = bias + sum of singles + sum of pairs."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    singles: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, lookup in enumerate(self.singles):
            z += lookup[np.searchsorted(self.edges[j], x[:, j], "right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for j in {k for a, b, _ in self.pairs for k in (a, b)}}
        for a, b, lookup in self.pairs:
            z += lookup[bins[a], bins[b]]
        return 1 / (1 + np.exp(-z))


def _step(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree of up to `leaves` leaves over ordered bins, by greedy splits; its value for each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    while len(cuts) <= leaves:
        best = (1e-6, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(a + 1, b)
            at = at[(ch[at] - ch[a] >= least) & (ch[b] - ch[at] >= least)]
            if len(at):
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), int(at[gain.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts each of two features once: its gain and its value for each cell."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    best, value = 0.0, np.zeros(g.shape)
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return best, value
    quarters = []
    for c in (cg, ch):
        a = c[i, j]
        left, up = c[i, -1], c[-1, j]
        quarters.append((a, left - a, up - a, c[-1, -1] - left - up + a))
    gain = sum(qg**2 / (qh + 1) for qg, qh in zip(*quarters, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    at = np.unravel_index(gain.argmax(), gain.shape)
    r, c = at[0] + 1, at[1] + 1
    leaf = [qg[at] / (qh[at] + 1) for qg, qh in zip(*quarters, strict=True)]
    value[:r, :c], value[:r, c:], value[r:, :c], value[r:, c:] = leaf
    return float(gain[at]), value


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.15, most_pairs: int = 8) -> Additive:
    """Fits the tables; `y` is 0 or 1."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Additive(float(np.log(share / (1 - share))))
    model = Additive(float(np.log(share / (1 - share))))
    quantiles = lambda j, n: np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [quantiles(j, 64) for j in range(x.shape[1])]
    model.coarse = [quantiles(j, 12) for j in range(x.shape[1])]
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    model.singles = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.bias)
    gradients = lambda: (y - (p := 1 / (1 + np.exp(-z))), p * (1 - p))
    for _ in range(rounds):
        for j, bins in enumerate(fine):
            g, h = gradients()
            n = len(model.singles[j])
            value = rate * _step(np.bincount(bins, g, n), np.bincount(bins, h, n), 3, 2.0)
            model.singles[j] += value
            z += value[bins]
    flat = {(a, b): rough[a] * (len(model.coarse[b]) + 1) + rough[b] for a, b in combinations(range(x.shape[1]), 2)}

    def grid(a: int, b: int) -> tuple[float, np.ndarray]:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        return _cross(*(np.bincount(flat[a, b], v, shape[0] * shape[1]).reshape(shape) for v in gradients()))

    best = sorted(((grid(a, b)[0], a, b) for a, b in flat), reverse=True)[:most_pairs]
    lookups = {(a, b): np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for _, a, b in best}
    for _ in range(pair_rounds):
        for (a, b), lookup in lookups.items():
            value = rate * grid(a, b)[1]
            lookup += value
            z += value[rough[a], rough[b]]
    model.pairs = [(a, b, lookup) for (a, b), lookup in lookups.items()]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Additive:
    """The model of `label`, from at most `sample` labelled rows outside the held-out fold, one for each doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")

    def run(batches):
        for batch in batches:
            x = features(batch["text"])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch["y"]], names=["x", "y"])

    found = rows.mapInArrow(tidied(run), "x array<double>, y double").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = found["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return train(x[order], y[order])


def score(docs: DataFrame, model: Additive, columns: list[str] | None = None) -> DataFrame:
    """(row, score): `row` holds the columns of `docs`, or those named, whatever their names; the score is from 0 to 1."""

    def run(batches):
        for batch in batches:
            found = model.score(features(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct(*(columns or docs.columns)).alias("row"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidied(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with their columns."""
    model = fit(docs, labels)
    return score(docs, model).where(F.col("score") >= threshold).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
