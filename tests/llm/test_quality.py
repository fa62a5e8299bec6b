import zlib

import numpy as np
import pyarrow as pa

from cadenza.llm import hashing, quality

SF = "/root/testdata/sf0.01"


def area(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in labels if got[i].held_out]
    y, p = np.array([labels[i] for i in held]), np.array([got[i].score for i in held])
    assert area(y, p) > 0.95
    assert (p[y == 1] >= 0.3).mean() > 0.98


def test_scores_use_the_text_alone_and_all_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 9), (2, "", "y", 8), (3, "Some words here.", "x", 7), (3, "Some words here.", "z", 6), (None, "w " * 5000, None, None)], "doc_id long, text string, score string, row int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(None, 1), (5, None)], "doc_id long, quality int")
    scored = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(scored) == 5 and len({r.score for r in scored if r.row.text == "Some words here."}) == 1
    assert scored[0].score == scored[1].score
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= quality.THRESHOLD for r in scored)
    assert quality.keep_good(docs.limit(0), labels).collect() == []
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).select("score").distinct().count() == 1


def test_features_do_not_depend_on_neighbours():
    texts = ["One two, three!", "", "zwei DREI $$ vier\nfünf 5", "a", " ", None, "é"]
    together = quality.features(pa.array(texts, pa.string()))
    apart = np.vstack([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, apart)


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y, rounds=20, pair_rounds=60)
    fresh = rng.random((1000, 3))
    assert area((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5), model.score(fresh)) > 0.97


def test_words_of_texts():
    data, bounds = hashing.buffers(pa.array(["ab cd", "cd", None, " x\ty ", "ab"]))
    starts, stops, count = hashing.words(data, bounds)
    assert count.tolist() == [2, 1, 0, 2, 1]
    found = hashing.hashes(data, starts, stops)
    assert found[0] == found[5] and found[1] == found[2] and len(set(found.tolist())) == 4
    assert bytes(hashing.squeezed(*hashing.buffers(pa.array(["a \n b", " ", " c"])))[0]) == b"a b  c"
