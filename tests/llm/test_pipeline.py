"""The pipeline against plain counterparts of its stages on a small fixture."""

import random
import re

import corpus_pipeline
from cadenza.llm import packing
from test_near import brute as near_brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    junk = lambda n: " ".join(word().upper() + "!!" for _ in range(n))
    rows = [(i, prose(rng.randint(20, 300)) if i % 5 else junk(rng.randint(20, 300))) for i in range(200)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(200)]
    rows += [(300 + i, rows[1][1].replace(" ", "  ")) for i in range(5)]
    rows += [(400 + i, rows[2][1] + f" more{i}") for i in range(5)]
    rows += [(500, None), (501, "")]
    docs = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_in_turn(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    df, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        df.write.parquet(f"{tmp_path}/out{k}")
        df = spark.read.parquet(f"{tmp_path}/out{k}")
        after[name] = [tuple(r) for r in df.collect()]
    texts = {d[0]: d[1] for d in docs}
    good = {r[0] for r in after["quality classifier"]}
    assert {i for i in range(200) if i % 5} <= good and not good & {i for i in range(200) if i % 5 == 0}
    first = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    assert sorted(r[0] for r in after["exact dedup"]) == sorted(first.values())
    kept = [i for i, _, _, keep in near_brute([(i, texts[i]) for i in first.values()]) if keep]
    assert sorted(r[0] for r in after["near dedup"]) == sorted(kept)
    copies = {}
    for r in after["mixing"]:
        copies[r[0]] = copies.get(r[0], 0) + 1
    assert set(copies) <= set(kept) and max(copies.values()) <= 2
    size = {i: len((texts[i] or "").split()) for i in kept}
    assert abs(sum(size[i] * n for i, n in copies.items()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    pieces = after["packing"]
    assert sorted(r[0] for r in pieces if r[1] == 0) == sorted(i for i, n in copies.items() for _ in range(n))
    assert all(r[6] + r[3] <= packing.LENGTH for r in pieces)
    assert sorted(r[:5] for r in map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(r[:5] for r in pieces)
