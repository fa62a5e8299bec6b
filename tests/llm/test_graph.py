import random

from cadenza.llm import graph


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return sorted((x, root(x)) for x in parent if root(x) != x)


def run(spark, edges):
    return sorted(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect())


def test_shapes(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(40)]
    star = [(500, 501 + i) for i in range(50)] + [(499, 530)]
    mesh = [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)]
    edges = path[::-1] + star + mesh + [(7, 7), (900, 900), (3, 2), (2, 3)]
    assert run(spark, edges) == brute(edges)
    assert run(spark, []) == []
