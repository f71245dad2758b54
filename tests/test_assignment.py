"""Least-cost assignment against all permutations and a plain solver."""

import itertools

import numpy as np
import pytest

from parallaxis.operators import assignment


def table(spark, scenes):
    rows = [(s, i, j, float(x)) for s, a in scenes.items() for (i, j), x in np.ndenumerate(np.asarray(a, float))]
    return spark.createDataFrame(rows, "scene int, c_idx int, r_idx int, cost double").repartition(3)


def test_all_permutations(spark):
    draw = np.random.default_rng(1)
    scenes = {0: draw.random((6, 6)), 1: draw.integers(0, 3, (6, 6)), 2: np.ones((4, 4)), 3: [[2.0]], 4: -draw.random((5, 5)) * 100, 5: draw.random((6, 6)) + 10 * (1 - np.eye(6)[draw.permutation(6)]), 6: np.add.outer(np.arange(5), np.arange(5)) * 1e6}
    found = {}
    for r in assignment.assign(table(spark, scenes)).collect():
        found.setdefault(r["scene"], []).append((r["c_idx"], r["r_idx"], r["cost"]))
    assert found.keys() == scenes.keys()
    for s, a in scenes.items():
        a = np.asarray(a, float)
        n = len(a)
        assert sorted(c for c, _, _ in found[s]) == sorted(r for _, r, _ in found[s]) == list(range(n))
        assert all(a[c, r] == cost for c, r, cost in found[s])
        assert sum(x[2] for x in found[s]) == pytest.approx(min(sum(a[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))), abs=1e-9)


def test_most_pairs_are_left(spark):
    """Points against moved points: few pairs are left, in many parts; without bids the result is the same."""
    draw = np.random.default_rng(2)
    at = draw.random((60, 2))
    a = np.linalg.norm(at[:, None] - (at[draw.permutation(60)] + draw.normal(0, 0.05, (60, 2)))[None], axis=2)
    costs = table(spark, {0: a})
    want = a[assignment.solve(a), np.arange(60)].sum()
    assert assignment.assign(costs).agg({"cost": "sum"}).first()[0] == pytest.approx(want, abs=1e-9)
    assert assignment.candidates(costs, "scene", assignment.checked(costs, "scene"), 40).count() < 60 * 60 / 6
    assert assignment.assign(costs, rounds=0).agg({"cost": "sum"}).first()[0] == pytest.approx(want, abs=1e-9)


def test_solver_alone():
    draw = np.random.default_rng(3)
    for _ in range(60):
        n = draw.integers(1, 7)
        a = draw.integers(0, 5, (n, n)).astype(float)
        a[draw.random((n, n)) < 0.2] = np.inf
        a[np.arange(n), draw.permutation(n)] = 4
        assert a[assignment.solve(a), np.arange(n)].sum() == min(sum(a[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_incomplete_costs_are_refused(spark):
    whole = table(spark, {0: np.ones((3, 3))})
    for bad in (whole.where("c_idx < 2"), whole.where("c_idx <> 1 or r_idx <> 1"), whole.unionByName(whole), whole.selectExpr("scene", "c_idx", "r_idx", "if(c_idx = 1, null, cost) as cost")):
        with pytest.raises(ValueError):
            assignment.assign(bad)
