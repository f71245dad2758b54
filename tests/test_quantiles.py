"""Order statistics against sorted lists."""

import math
from collections import defaultdict

import numpy as np
import pytest

from parallaxis.operators import quantiles


def groups_of(draw):
    rows = [("even", float(x)) for x in draw.random(700)]
    rows += [("few", 3.0), ("few", -1.0), (None, 4.0), ("tied", 9.0)] + [("tied", 5.0)] * 300 + [("tied", x) for x in (1.0, 2.0)]
    rows += [("wide", float(x)) for x in 10.0 ** draw.uniform(-300, 300, 500)] + [("lost", None), ("lost", math.nan), ("few", math.inf), ("few", None)]
    return rows


@pytest.mark.parametrize("buckets, sorted_rows, lower", [(4096, 2048, True), (4096, 2048, False), (64, 40, False)])
def test_sorted_lists(spark, monkeypatch, buckets, sorted_rows, lower):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "SORTED_ROWS", sorted_rows)
    rows = groups_of(np.random.default_rng(4))
    if buckets == 64:  # few buckets take many rounds where values span many powers of ten
        rows = [r for r in rows if r[0] != "wide"]
    shares = {"least": 0.0, "third": 0.34, "half": 0.5, "most": 1.0}
    found = quantiles.quantiles(spark.createDataFrame(rows, "kind string, v double").repartition(3), ["kind"], "v", shares, lower).collect()
    want = defaultdict(list)
    for g, x in rows:
        if x is not None and math.isfinite(x):
            want[g].append(x)
    assert {r["kind"] for r in found} == set(want)
    for r in found:
        for name, share in shares.items():
            assert math.isclose(r[name], np.quantile(want[r["kind"]], share, method="lower" if lower else "linear"), rel_tol=1e-12), (r, name)


def test_no_group_and_no_rows(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    assert quantiles.quantiles(rows, [], "v", {"half": 0.5}).first()["half"] == 5.0
    assert quantiles.quantiles(rows.limit(0), [], "v", {"half": 0.5}).where("half is not null").count() == 0
    wanted = spark.createDataFrame([(k,) for k in (-1, 0, 3, 11)], "place long")
    assert sorted(map(tuple, quantiles.places(rows, [], "v", wanted).collect())) == [(0, 0.0), (3, 3.0)]
