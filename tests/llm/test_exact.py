import hashlib
import re

import numpy as np
import pytest

from cadenza.llm import exact

SF = "/root/testdata/sf0.001"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out, seen = [], set()
    for i, t in rows:
        n = norm(t)
        keep = min((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep and (n, i) not in seen, hashlib.sha256(n.encode()).hexdigest()))
        seen.add((n, i))
    return sorted(out, key=str)


LONG = "word of a very long text " * 9000
ROWS = [
    (5, None), (6, ""), (7, " "), (8, "\n\t "), (3, "a  b"), (2, "a\r\nb"), (9, "a b"), (9, "a b"), (9, "a c"), (1, " a b"), (None, "a c"), (None, "q"), (None, "q"),
    (20, LONG), (21, LONG.replace("of", " of")), (22, LONG + "x"), (23, LONG[:-2] + "x "), (30, "é ü"), (31, "é\x0bü"), (32, "é ü"),
]


def run(spark, rows, **parameters):
    return sorted((tuple(r) for r in exact.classes(spark.createDataFrame(rows, "doc_id long, text string"), **parameters).collect()), key=str)


def test_edge_rows(spark):
    assert run(spark, ROWS) == brute(ROWS)
    assert run(spark, []) == []


@pytest.mark.parametrize("chunk", [4, 1000])
def test_colliding_fingerprints_do_not_merge_texts(spark, chunk):
    assert run(spark, ROWS + [(40, "b a"), (41, "b a"), (42, "a\tb")], bases=(1, 1), chunk=chunk) == brute(ROWS + [(40, "b a"), (41, "b a"), (42, "a\tb")])


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in exact.query(spark, SF).collect()), key=str) == brute(rows)


def test_chunks_compose():
    data = np.frombuffer(bytes(range(256)) * 5, np.uint8)
    bounds = np.array([0, 7, 7, 900, len(data)])
    whole = exact._hasher(exact.BASES, 1 << 16)(data, bounds)
    small = exact._hasher(exact.BASES, 16)(data, bounds)
    for one, many in zip(whole, small, strict=True):
        for h, s in (("h1", "s1"), ("h2", "s2")):
            total, shift = 0, 1
            for c in many:
                total, shift = (total + shift * c[h]) % exact.PRIME, shift * c[s] % exact.PRIME
            assert total == sum(c[h] for c in one) and shift == (one[0][s] if one else 1)
    plain = sum(int(b) * pow(exact.BASES[0], i, exact.PRIME) for i, b in enumerate(data[7:900])) % exact.PRIME
    assert whole[2][0]["h1"] == plain


def test_deduplicate_keeps_other_columns(spark):
    docs = spark.createDataFrame([(2, "a b", 1, "x"), (1, "a  b", 2, "y"), (1, "a  b", 2, "y"), (3, None, None, None), (4, "", 5, "z")], "doc_id long, text string, sha int, h1 string")
    assert sorted(map(tuple, exact.deduplicate(docs).collect())) == [(1, "a  b", 2, "y"), (3, None, None, None)]
