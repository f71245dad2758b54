"""Connected components against union-find."""

import random

from parallaxis.llm.components import connected


def test_any_edges(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + k) for k in range(1, 60)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    head = {n: n for e in edges for n in e}

    def find(n):
        while head[n] != n:
            n = head[n]
        return n

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        head[q] = p
    alone = {n for n in head if all(a == b for a, b in edges if n in (a, b))}
    rows = edges + [(b, a) for a, b in edges[:40]] + [(None, 7), (7, None), (8, 8)]
    got = {(r["node"], r["component"]) for r in connected(spark.createDataFrame(rows, "a long, b long").repartition(3)).collect()}
    assert got == {(n, find(n)) for n in head if n not in alone}


def test_empty(spark):
    assert connected(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
