import math
import re
from collections import Counter

import pytest

from parallaxis.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item in plain integers."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


ITEMS = [(1, "the of and a"), (1, "the of and a"), (None, "Über straße 10 x"), (2, None), (3, ""), (4, "?!"), (5, "zzzqqq"), (6, "the the THE")]


@pytest.mark.parametrize("window, postings, blocks", [(16384, 4_000_000, 200_000), (64, 4_000_000, 200_000), (128, 50, 200_000), (64, 300, 3)])
def test_brute_force(spark, rows, monkeypatch, window, postings, blocks):
    """Small windows and blocks of terms give what one window gives; null and repeated ids, ties and empty texts included."""
    monkeypatch.setattr(ranked, "WINDOW", window)
    monkeypatch.setattr(ranked, "WINDOW_POSTINGS", postings)
    docs = [*rows, (7, rows[0][1]), (None, rows[0][1]), (None, rows[1][1]), (8, None), (9, ""), (10, "İ ß éa"), (11, "Über " * 5000)]
    items = [*ITEMS, (7, rows[0][1][:2000]), (8, rows[5][1][:300])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = ranked.search(table, spark.createDataFrame(items, "item_id long, text string"), 10, blocks)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute(docs, items, 10)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, [1])], "doc_id long, text string, key int, terms array<int>")
    items = spark.createDataFrame([("x", "a", 5)], "item_id string, text string, score int")
    assert [tuple(r)[:3] for r in ranked.search(docs, items).collect()] == [("x", 1, 1)]
    assert ranked.search(docs.where("false"), items).collect() == [] == ranked.search(docs, items.where("false")).collect()
    assert ranked.search(docs.select("doc_id"), items).collect() == []
