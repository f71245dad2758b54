"""The toxicity classifier: held-out accuracy, the effect of counterfactual swaps, edges."""

import re
import zlib

import numpy as np
import pytest

from parallaxis.llm import toxicity


def corpus(spark, bias=False, n=600):
    """Toxic texts have an insult; with bias, also a group's name, which clean texts seldom have."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(300)}" for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words.insert(5, "scumbag")
        if bias and rng.random() < (0.8 if toxic else 0.02):
            words.insert(9, "women")
        if bias and rng.random() < 0.05:
            words.insert(3, "men")
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def scores(docs, model):
    return {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    got = scores(docs, model)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == 600 and all((got[i] >= 0.3) == (i % 4 == 0) for i in held)
    # labels of held-out rows change nothing
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) as toxic")
    assert np.allclose(toxicity.train(docs, other).weights, model.weights)


def test_swaps_spare_neutral_mentions(spark):
    docs, labels = corpus(spark, bias=True)
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.hashes.tolist(), model.weights, strict=True))
    change = sum(weight.get(int(h), 0) for h in toxicity.term_features("women")) - sum(weight.get(int(h), 0) for h in toxicity.term_features("men"))
    assert abs(change) < 0.5, "swapping the group hardly moves the logit"
    neutral = spark.createDataFrame([(1, "women w1 w2 w3 w4 w5"), (2, "scumbag w1 w2 w3"), (3, "WOMEN w7")], "doc_id long, text string")
    got = scores(neutral, model)
    assert got[1] < 0.3 and got[3] < 0.3 and got[2] >= 0.3


@pytest.mark.parametrize("group, other", [("women", "men"), ("ausländer", "einheimische"), ("mujeres", "hombres"), ("immigrés", "citoyens")])
def test_fewer_false_positives_on_held_out_mentions(spark, group, other):
    """A corpus whose toxic texts name one group far more often, in each language: without the penalty neutral held-out texts that
    name it are called toxic, with it none is, and toxic texts are found all the same."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(800):
        words = [f"w{rng.integers(300)}" for _ in range(12)]
        toxic = i % 4 == 0
        words += ["scumbag"] * (toxic and rng.random() < 0.7) + ["vermin"] * (toxic and rng.random() < 0.7)
        words += [group] * (rng.random() < (0.9 if toxic else 0.03)) + [other] * (rng.random() < 0.1)
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, " ".join([f"w{(7 * i + k) % 300}" for k in range(12)] + [group])) for i in range(50)], "doc_id long, text string")
    wrong = {w: sum(x >= 0.3 for x in scores(neutral, toxicity.train(docs, labels, swap_weight=w)).values()) for w in (0.0, 10.0)}
    assert wrong[0.0] >= 25 and wrong[10.0] == 0, wrong
    got = scores(docs, toxicity.train(docs, labels))
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2 and i % 4 == 0 and ("scumbag" in rows[i][1] or "vermin" in rows[i][1])]
    assert sum(got[i] >= 0.3 for i in held) >= 0.95 * len(held)


def test_scores_are_those_of_the_model(spark, sf):
    """Every score of the query, from the model's weights of the features that plain Python finds in the text."""
    from parallaxis.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    rows, known = {r["doc_id"]: r["score"] for r in queries.op1_toxicity(spark, sf).collect()}, {}
    for d in docs.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"] or "")
        words = set(re.findall(r"[a-z\x80-\U0010ffff]+", low))
        for w in words - known.keys():
            known[w] = set(map(int, toxicity.term_features(w)))
        logit = model.base + sum(weight.get(h, 0.0) for h in set().union(*(known[w] for w in words)))
        assert np.isclose(rows[d["doc_id"]], 1 / (1 + np.exp(-logit)), atol=1e-9)


def test_the_penalty_is_what_does_it():
    rows, columns = np.array([0, 0, 1, 1, 2, 3]), np.array([0, 1, 0, 1, 2, 2])
    label = np.array([1.0, 1, 0, 0])
    swap = toxicity.Swaps.of([((1,), (2,), 4)])
    free, _ = toxicity.fit(rows, columns, label, toxicity.Swaps.of([]), 3)
    held, _ = toxicity.fit(rows, columns, label, swap, 3)
    assert abs(held[1] - held[2]) < 0.2 * abs(free[1] - free[2])


def test_edges(spark):
    docs, labels = corpus(spark, n=200)
    model = toxicity.train(docs, labels.unionByName(labels.selectExpr("doc_id", "cast(null as int) as toxic")).unionByName(labels))
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "scumbag"), (4, "x" * 100_000), (5, "scumbag " * 50_000), (6, "!!"), (6, "!!")], "doc_id long, text string")
    out = [(r["doc_id"], r["score"]) for r in toxicity.score(rows, model).collect()]
    assert len(out) == 7 and out[0][1] == out[1][1] == out[5][1] == out[6][1] < 0.3 and out[2][1] > 0.3 and out[4][1] > 0.3
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        got = scores(docs, toxicity.train(docs, some))
        assert len(set(got.values())) == 1
    assert toxicity.score(rows.limit(0), model).count() == 0


def test_counterfactual_sentences():
    pairs = toxicity.counterfactuals("Women and men; the woMEN", 3)
    assert ("Women and men; the woMEN", "girls and men; the girls") in pairs and ("Women and men; the woMEN", "Women and boys; the woMEN") in pairs and len(pairs) == 6
    for choice in range(60):
        (a, b), = toxicity.counterfactuals("nobody, womenfolk", choice)
        assert a != b and a.startswith("nobody, womenfolk ") and any({a[18:], b[18:]} <= set(kind) for kind in toxicity.IDENTITIES)
    assert len(toxicity.counterfactuals("", 0)) == 1


def test_changes_are_of_the_whole_sentences():
    """A text that has the other term already, or a word with the same beginning, changes in fewer features."""
    known = np.unique(np.concatenate([toxicity.term_features(t) for t in ("women", "girls", "girlsome")]))
    name = lambda *hs: {int(np.searchsorted(known, h)) for h in hs}
    women, girls = toxicity.term_features("women"), toxicity.term_features("girls")
    (plain, both, head) = toxicity.changes_of([("women x", "girls x"), ("women girls", "girls girls"), ("women girlsome", "girls girlsome")], known)
    assert (set(plain[0]), set(plain[1])) == (name(*girls), name(*women))
    assert (set(both[0]), set(both[1])) == (set(), name(*women))
    assert set(head[0]) == name(girls[0]) and set(head[1]) == name(*women)


def test_held_out_recall_on_the_given_documents(spark):
    from parallaxis.llm.queries import op1_toxicity

    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(labels[r["doc_id"]], r["predicted"]) for r in op1_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in labels]
    toxic = [p for t, p in out if t == 1]
    clean = [p for t, p in out if t == 0]
    assert len(toxic) > 100 and sum(toxic) / len(toxic) >= 0.9 and sum(clean) / len(clean) <= 0.01


def test_every_labelled_text_has_a_counterfactual(spark):
    docs, labels = corpus(spark, bias=True, n=300)
    learned = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(300))
    assert toxicity.train(docs, labels).pairs >= learned
