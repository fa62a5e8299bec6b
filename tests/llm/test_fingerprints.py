import hashlib
import re

import pytest
import xxhash

from cadenza.llm import fingerprints

SF = "/root/testdata/sf0.001"


def lines(text):
    return {p for p in re.split("\n|(?<=[.!?;:。！？])[ \t]+|(?<=[。！？])", text) if p}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows):
    """(doc_id, n, sha, near_edited, near_next), with the next document in descending order of doc_id."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest()), r[1]), reverse=True)
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), sha, round(jaccard(lines(text), lines(edited)), 12), round(jaccard(lines(text), lines(after)), 12)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect()), key=str)


def query_over(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, h string, place int").write.parquet(f"{tmp_path}/documents.parquet")
    return fingerprints.query(spark, str(tmp_path))


def test_whole_table_against_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = fingerprints.query(spark, SF)
    assert run(found) == brute([(r.doc_id, r.text) for r in docs])
    texts, prints = {r.doc_id: r.text for r in docs}, {r.doc_id: r.fingerprint for r in found.collect()}
    by = {}
    for i, t in texts.items():
        assert by.setdefault(t, prints[i]) == prints[i]
    assert len({*by.values()}) == len({frozenset(lines(t)) for t in by})


def test_edge_rows(spark, tmp_path):
    rows = [(5, None), (4, ""), (3, "\n\n"), (2, "é\nü\nß"), (2, "é\nü\nß"), (2, "a\nb"), (None, "x\ny\nz\nx"), (9, "\n".join(map(str, range(700)))), (8, "\n".join(map(str, range(350, 1050))))]
    assert run(query_over(spark, [(*r, "x", 1) for r in rows], tmp_path)) == brute(rows)


def test_very_long_texts(spark, tmp_path):
    rows = [(2, "\n".join(f"line {i}" for i in range(12000))), (1, "\n".join(f"line {i}" for i in range(6000, 15000)))]
    assert run(query_over(spark, [(*r, "x", 1) for r in rows], tmp_path)) == brute(rows)


def test_half_equal_texts_are_nearer_than_the_next(spark):
    found = [r for r in fingerprints.query(spark, "/root/testdata/sf0.01").select("n_chars", "near_edited", "near_next").collect() if r.n_chars]
    assert sum(r.near_edited > r.near_next for r in found) >= 0.95 * len(found)


def test_many_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, f"null {i}. and {i % 7}.") for i in range(3000)] + [(7, f"seven {i}. of") for i in range(2000)] + [(i, f"one {i}") for i in range(500)]
    df = query_over(spark, [(*r, "x", 1) for r in rows], tmp_path)
    assert run(df) == brute(rows)
    places = fingerprints.with_next(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert places.count() == len(rows)


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError):
        fingerprints.with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_single_and_empty_tables(spark, tmp_path):
    assert run(query_over(spark, [(1, "a\nbc", "x", 1)], tmp_path / "one")) == brute([(1, "a\nbc")])
    assert query_over(spark, [], tmp_path / "none").collect() == []


def test_peeling_recovers_both_sides(spark):
    a, b = [*range(100, 140)], [*range(110, 155)]
    pairs = spark.createDataFrame([(1, a, b), (2, [], [7]), (3, [5], [5]), (4, [], [])], "id long, a array<long>, b array<long>")
    found = {r.id: (sorted(r.only_a), sorted(r.only_b)) for r in fingerprints.difference(pairs).collect()}
    assert found == {1: ([*range(100, 110)], [*range(140, 155)]), 2: ([], [7])}  # equal lists have no row
    counts = {r.id: (r.only_a, r.only_b) for r in fingerprints.difference(pairs, listed=False).collect()}
    assert counts == {i: (len(x), len(y)) for i, (x, y) in found.items()}
    tight = pairs.where("id = 1").selectExpr("id", "a", "b", "2L AS blocks", "3L AS width", "CAST(NULL AS array<bigint>) AS only")
    small = fingerprints.tried(tight).first()
    assert small.stuck  # too small: those blocks grow


def test_likeness_of_lists_of_many_sizes(spark):
    pairs = [(i, [*range(i % 7, i % 7 + 3 * i)], [*range(i % 11 * i, i % 11 * i + 2 * i)]) for i in range(300)]
    found = fingerprints.likeness(spark.createDataFrame(pairs, "id long, a array<long>, b array<long>")).collect()
    assert {r.id: round(r.likeness, 12) for r in found} == {i: round(jaccard({*a}, {*b}), 12) for i, a, b in pairs}
