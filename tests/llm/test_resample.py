import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parallaxis.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_of(text, most):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets, most, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    counts = [Counter(bucket(f) for t in texts for f in features_of(t, most)[1]) for texts in ([t for _, t in docs], target)]
    s, t = (sum(c.values()) for c in counts)
    gain = lambda b: math.floor(1000 * math.log((counts[1][b] + 1) * (s + buckets) / ((counts[0][b] + 1) * (t + buckets))))
    out, fit = [], []
    for i, text in docs:
        words, found = features_of(text, most)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(words) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return Counter(map(tuple, out))


@pytest.fixture(scope="module")
def rows(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return docs, target


@pytest.mark.parametrize("buckets, most, least, percent", [(10_000, 1, 20, 10), (500, 3, 5, 40), (7, 2, 1, 100), (50, 1, 20, 0)])
def test_brute_force(spark, rows, buckets, most, least, percent):
    docs, target = rows
    docs = [*docs, (10**9, None), (10**9 + 1, ""), (10**9 + 2, "?"), (None, "Ab " * 30), (10**9 + 3, "Été İ ß " * 20_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    aim = spark.createDataFrame([(t,) for t in [*target, None]], "text string")
    out = resample.resample(table, aim, buckets=buckets, most=most, least_words=least, percent=percent)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, out.collect())) == brute(docs, [*target, None], buckets, most, least, percent)


def test_draw_with_ties(spark):
    """Few scores, so that all rows tie; slices of one score go on counting where the one before ended."""
    draw = np.random.default_rng(3)
    rows = [(int(i) if i % 7 else None, int(s), bool(s != 2)) for i, s in zip(draw.permutation(500), draw.integers(0, 4, 500), strict=True)]
    table = spark.createDataFrame(rows, "doc_id long, score long, eligible boolean").repartition(3)
    want = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    want = {k: r for k, r in enumerate(want[: 60 * len(want) // 100], 1)}
    for group_rows in (1_000_000, 20, 1):
        out = resample.draw(table, 60, group_rows).collect()
        assert len(out) == len(rows)
        ranked = {r["rank"]: (r["doc_id"], r["score"], r["eligible"]) for r in out if r["rank"]}
        assert ranked == want


def test_repeated_rows_and_copies_of_ids(spark):
    docs = [(1, "a " * 30)] * 3 + [(2, "b " * 30)] * 7
    out = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"), percent=50)
    assert sorted(r["rank"] for r in out.collect() if r["rank"]) == [1, 2, 3, 4, 5]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, score int, rank int")
    aim = spark.createDataFrame([("a",)], "text string")
    assert [r["rank"] for r in resample.resample(docs, aim, least_words=1, percent=100).collect()] == [1]
    assert resample.resample(docs.where("false"), aim).collect() == []
    assert len(resample.resample(docs, aim.where("false")).collect()) == 1
    assert resample.resample(docs.select("doc_id"), aim).first()["n_features"] == 0
