import random
import re

from cadenza.llm import near

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(doc_id, n, component, kept) by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets:
        for v in s:
            by.setdefault(v, []).append(len(by))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 3 * len(x) <= 4 * len(y) and 3 * len(y) <= 4 * len(x):
                common = len(x & y)
                if 100 * common >= 75 * (len(x) + len(y) - common):
                    r, s = sorted((root(i), root(j)))
                    parent[s] = r
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def run(spark, rows):
    return sorted(tuple(r) for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_whole_table_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in near.query(spark, SF).collect()) == brute(rows)


def test_a_large_group_of_edited_copies_and_a_shared_passage(spark):
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(10**6)
    base, passage = [word() for _ in range(150)], [word() for _ in range(120)]
    rows = []
    for i in range(90):  # similarities on both sides of the threshold
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((1000 - i, " ".join(copy)))
    for i in range(60):  # a passage of most of the text, but too little for links
        rows.append((2000 + i, " ".join([word() for _ in range(60)] + passage)))
    for i in range(40):  # pairs that share the passage and are linked
        own = [word() for _ in range(60)]
        rows += [(3000 + i, " ".join(own + passage)), (4000 + i, " ".join([*own[:-3], word(), *own[-2:], *passage]))]
    assert run(spark, rows) == brute(rows)


def test_several_blocks_for_one_pivot(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(10**6)
    core = [word() for _ in range(200)]
    rows = []
    for g in range(3):  # three groups of close copies that share most words, but too few for links between groups
        own = [word() for _ in range(45)]
        for i in range(60):
            copy = [*core, *own]
            copy[rng.randrange(len(copy))] = word()
            rows.append((1000 * g + i, " ".join(copy)))
    rows += [(9000 + i, " ".join(core + [word() for _ in range(200)])) for i in range(80)]  # the passage, unlinked
    assert run(spark, rows) == brute(rows)


def test_ids_with_several_texts_join_their_groups(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(5, words("a")), (5, words("b")), (3, words("a")), (7, words("b") + " x"), (9, words("c")), (9, words("d")), (8, words("d"))]
    got = {(r.doc_id, r.component_id) for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (7, 3), (9, 8), (8, 8)}


def test_long_texts_and_an_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = near.groups(spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 299_996, 1), (2, 299_997, 1), (3, 1, 3)}
    assert near.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (3, "one\ttwo"), (9, "one two three"), (2, "a b c d e"), (1, "A B C D E"), (4, "é b c d e"), (10, "É b c d e")]
    assert run(spark, rows) == brute(rows)
    got = near.groups(spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "x y z")], "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, True)]))
    assert run(spark, []) == []


def test_deduplicate_keeps_other_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (3, "q r", 3, "z")], "doc_id long, text string, n int, rep string")
    assert sorted(tuple(r) for r in near.deduplicate(docs).collect()) == [(1, "a b c d e f", 2, "y"), (3, "q r", 3, "z")]
