"""The Jaccard join against all pairs of exact sets."""

import random
import re

from parallaxis.llm import jaccard

DOCS = "doc_id long, text string, n_shingles string, component_id double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                head[q] = p
    return {(i, len(sets[i]), find(i)) for i in ids}


def answer(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], DOCS)
    return {tuple(r) for r in jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()}


def edited(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_of_many_sizes(spark):
    rng = random.Random(5)
    rows = []
    for size in (5, 6, 8, 9, 10, 12, 15, 20, 24, 30, 45, 80, 150, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5):
            rows.append((len(rows), edited(base, edits, rng)))
        rows.append((len(rows), " ".join(base[: size - size // 9 or 1])))
        rows.append((len(rows), " ".join(base + base[: size // 8])))
    assert answer(spark, rows) == brute(rows)


def test_large_group_of_near_copies_with_members_out_of_reach(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, edited(base, rng.randrange(7), rng)) for i in range(150)]
    rows += [(1000 + i, " ".join(base)) for i in range(30)]
    assert answer(spark, rows) == brute(rows)


def test_common_passage_links_only_similar_texts(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"u{i}x{k}" for k in range(rng.randrange(0, 60)))) for i in range(60)]
    assert answer(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "One two three FOUR"), (8, "É a b c d"), (9, "é a b c d"), (10, "x" * 200_000), (11, "a b c d e " * 3000), (12, "a b c d e " * 3000)]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, []) == set()


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    out = sorted(map(str, (tuple(r) for r in jaccard.near_duplicates(df).collect())))
    assert len(out) == 4 and out.count("(1, 2, 1)") == 2


def test_allocation_spends_enough_units():
    """Whatever a smaller set chooses, its units exceed the differences that a link allows."""
    import numpy as np
    import pyarrow as pa

    from parallaxis.llm import textkernel as tk

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in range(8, 300, 7)]
    for b in tk.blocks(pa.array(texts)):
        s = tk.shingle_sets(b)
        key, doc, flags = jaccard.signatures(s)
        own = np.bincount(doc, (flags & 1).astype(float) * ((flags & 2) == 0), len(texts))
        assert (own >= 1).all()
        whole = np.bincount(doc[(flags & 3) == 1], minlength=len(texts))
        pairs = np.bincount(doc[(flags & 3) == 3], minlength=len(texts)) > 0
        assert ((whole >= s.size // 4 + 1) | pairs).all()
