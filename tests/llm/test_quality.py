"""Quality rules against plain Python."""

import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parallaxis.llm import quality
from parallaxis.llm import textkernel as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    keys = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(keys), set()
    for i, k in enumerate(keys):
        if n[k] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute(rows, least_docs, share, left):
    found, hosts = defaultdict(set), Counter(h for _, h in {(t, h) for _, t, h in rows})
    for _, t, h in rows:
        for line in {" ".join(WORD.findall(x.translate(LOWER))) for x in (t or "").split("\n")} - {""}:
            found[h, line].add(t)
    out = {}
    for i, t, h in rows:
        b = base(t)
        gone = 0
        for x in (t or "").split("\n"):
            line = " ".join(WORD.findall(x.translate(LOWER)))
            if line and len(found[h, line]) > max(least_docs, share * hosts[h]):
                gone += len(line.split(" "))
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out[i] = (*b, gone, failed, not failed and 100 * (b[0] - gone) >= left * b[0])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\t\r\x0bé東A", max_size=60), min_size=1, max_size=6))
def test_base_counts(texts):
    import pyarrow as pa

    got = [tuple(map(int, r)) for b in tk.blocks(pa.array(texts)) for r in zip(*quality.base_counts(b)[0], strict=True)]
    assert got == [base(t) for t in texts]


def test_common_lines_and_depleted_documents(spark):
    rng = random.Random(3)
    common = ["All rights RESERVED by the owners of this site and its many partners", "Click  here to read on", "a b c"]
    rows = []
    for i in range(200):
        own = [" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randrange(2, 30))) for _ in range(rng.randrange(0, 8))]
        lines = own + [x.lower() if rng.random() < 0.3 else x for x in common if rng.random() < 0.5] * rng.randrange(1, 9)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["hot", "hot", "cold", None])))
    rows += [(300 + i, "the same text of a whole group of copies " * 3 + "\n" + " ".join(f"k{k}" for k in range(60)), "hot") for i in range(40)]
    rows += [(400 + i, "a long line that many texts of its host have " * 6 + f"\nand {i}", "hot") for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lines int").repartition(3)
    out = {r["doc_id"]: r for r in quality.judge(df, least_docs=15, share=0.1).collect()}
    want = brute(rows, 15, 0.1, 30)
    assert {i: tuple(r[c] for c in (*BASE, "removed_words", "base_failed", "kept")) for i, r in out.items()} == want
    assert all(out[300 + i]["kept"] for i in range(40)), "copies of one text are one document"
    assert not any(out[400 + i]["kept"] for i in range(40)), "texts of a line that many have are depleted"


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, "w " * 60, "a"), (4, "x" * 100_000, "a"), (5, "one two three\n" * 20_000, "a"), (6, "a b", "a"), (6, "a b", "a")], "doc_id long, text string, source string")
    rows = quality.judge(df).collect()
    assert len(rows) == 7 and all(r["base_failed"] and not r["kept"] for r in rows)
    assert quality.judge(df.limit(0)).count() == 0
    many = spark.createDataFrame([(9, "\n".join(f"line {i} of a text" for i in range(30)), "a")] * 2, "doc_id long, text string, source string")
    assert [r["removed_words"] for r in quality.judge(many, least_docs=1, share=0).collect()] == [0, 0]


def cleaned(rows, least_docs, share, left):
    """Texts of the kept rows without the removed lines."""
    norm = lambda x: " ".join(WORD.findall(x.translate(LOWER)))
    found, hosts = defaultdict(set), Counter(h for _, h in {(t, h) for _, t, h in rows})
    for _, t, h in rows:
        for x in (t or "").split("\n"):
            found[h, norm(x)].add(t)
    common = {k for k, v in found.items() if k[1] and len(v) > max(least_docs, share * hosts[k[0]])}
    verdicts = brute(rows, least_docs, share, left)
    return {i: "\n".join(x for x in t.split("\n") if (h, norm(x)) not in common) for i, t, h in rows if verdicts[i][-1]}


def test_common_lines_are_gone_from_kept_texts(spark):
    rng = random.Random(5)
    common = ["All rights RESERVED\tby the owners", "Click  here to read on \r", "é 東 common"]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{rng.randrange(9999)}é" for _ in range(rng.randrange(20, 40))) for _ in range(4)] + ["", " \t"]
        lines = own + [x.lower() if rng.random() < 0.3 else x for x in common if rng.random() < 0.6] * rng.randrange(1, 3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["hot", "hot", "cold", None])))
    rows += [(200 + i, "the same line of a group of copies " * 3 + "\n" + " ".join(f"k{k}" for k in range(60)), "hot") for i in range(20)]
    rows.append((300, None, "hot"))
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, other double").repartition(3)
    got = quality.clean(df, least_docs=10, share=0.1)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == cleaned(rows, 10, 0.1, 30)
    assert 120 <= got.count() < len(rows) and got.where("other <> 1.5").count() == 0
    assert quality.clean(df.limit(0)).count() == 0
    # the same id and text in two hosts: each by its own host's lines; both rows of a repeated one lose the line
    text = "a line of the host\n" + " ".join(f"u{k}" for k in range(60))
    rows = [(i, "a line of the host\nother " + " ".join(f"{i}v{k}" for k in range(60)), "hot") for i in range(4)] + [(9, text, "hot"), (9, text, "hot"), (9, text, "cold"), (9, text, None)]
    got = quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), least_docs=3, share=0).where("doc_id = 9")
    assert sorted((r["source"] or "", len(r["text"].split("\n"))) for r in got.collect()) == [("", 2), ("cold", 2), ("hot", 1), ("hot", 1)]


def test_small_and_middle_hosts_lose_common_lines_at_the_defaults(spark):
    words = lambda *k: " ".join("w" + "_".join(map(str, (*k, n))) for n in range(60))
    line, rows = "All rights reserved by the owners of this site", []
    for h, (size, planted) in enumerate([(6, 6), (12, 5), (40, 40), (300, 20), (1400, 7), (1400, 8)]):
        rows += [(10_000 * h + i, (f"{line}\n" if i < planted else "") + words(h, i), f"host{h}") for i in range(size)]
    passage = words("a", 1)
    rows += [(90_000 + i, f"{passage}\n{words('b', i)[:60]}", "copies") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality.judge(df).where("removed_words > 0").groupBy((F.floor(F.col("doc_id") / 10_000)).alias("h")).count().collect()
    assert {r["h"]: r["count"] for r in out} == {0: 6, 2: 40, 3: 20, 5: 8, 9: 12}
    kept = quality.clean(df).where(F.col("text").contains(line) | (F.col("source") == "copies")).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in kept} == {"host1": 5, "host4": 7}


def test_clean_keeps_columns_of_any_name(spark):
    """Columns named like those that the rebuilding uses stay; tables may lack the host, the id or the text."""
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{body} {i}\nsame line in all", "h", "g", 7 + i, True, "k_") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone string, key int, kept boolean, key_ string")
    out = quality.clean(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted((i, f"{body} {i}", *r) for i, _, *r in rows)
    for lost in (["source"], ["doc_id"], ["source", "doc_id"]):
        less = quality.clean(docs.drop(*lost))
        assert less.columns == [c for c in docs.columns if c not in lost]
        assert sorted(r["text"] for r in less.collect()) == sorted(f"{body} {i}" for i in range(20))
    assert quality.clean(docs.drop("text")).count() == 0
