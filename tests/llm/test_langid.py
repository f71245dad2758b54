"""Language identification: the forward algorithm against enumeration, held-out accuracy, edges."""

import itertools
import math
import zlib

import numpy as np

from parallaxis.llm import langid
from parallaxis.llm.queries import tokenizer_file

PIECES = tokenizer_file("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    vocab = langid.vocabulary(PIECES)
    place = {p: i for i, p in enumerate(vocab.pieces)}
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(len(vocab.pieces)), 2)).T
    for word in ("the", "station", "xqz", "naïve", "東", "a" * 70):
        marked = langid.MARK + word
        if len(word) > 12:
            alpha = [np.ones(2)] + [None] * len(marked)
            for end in range(1, len(marked) + 1):
                alpha[end] = sum((alpha[end - k] * np.exp(logp[place[marked[end - k : end]]]) for k in range(1, end + 1) if marked[end - k : end] in place), np.zeros(2)) + (0 if marked[end - 1] in place else alpha[end - 1] * np.exp(logp[0]))
            want = np.log(alpha[-1])
        else:
            total = np.zeros(2)
            for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
                parts, at = [], 0
                for i, cut in enumerate([*cuts, 1], 1):
                    if cut:
                        parts.append(marked[at:i])
                        at = i
                ids = [place.get(p, 0 if len(p) == 1 else None) for p in parts]
                if None not in ids:
                    total += np.exp(sum(logp[i] for i in ids))
            want = np.log(total)
        assert np.allclose(langid.log_scores(vocab, [word], logp)[0], want)


def test_training_raises_the_likelihood():
    vocab = langid.vocabulary(PIECES)
    words, counts = ["the", "then", "there", "station", "nation"], np.array([50, 10, 10, 5, 5])
    scores = [float(counts @ langid.log_scores(vocab, words, langid.fit(vocab, words, counts, n)[:, None])[:, 0]) for n in (0, 1, 2, 4)]
    assert all(b > a - 0.01 for a, b in zip(scores, scores[1:], strict=False)), "smoothing costs very little"


def test_held_out_accuracy_and_labels_of_others(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, PIECES)
    rows = langid.predict(docs, PIECES, *model, keep=("lang",)).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(rows) == docs.count() and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in rows)
    # labels of held-out rows change nothing
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'xx', lang) as lang")
    again = langid.train(changed, PIECES)
    assert again[0] == model[0] and np.allclose(again[1], model[1])


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, x, "clash") for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)], "doc_id long, text string, lang string, score string")
    model = langid.train(docs, PIECES)
    rows = [(1, None), (2, ""), (3, "123 -- !"), (4, "THE DOG"), (None, "le chien"), (6, "x" * 50_000), (7, "the " * 50_000), (7, "the dog")]
    out = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, *model).collect()
    pred = [(r["doc_id"], r["lang_pred"]) for r in out]
    assert pred[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "fr")] and pred[6:] == [(7, "en"), (7, "en")]
    assert pred[5][1] in ("en", "fr")
    none = langid.train(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"), PIECES)
    assert [r["lang_pred"] for r in langid.predict(docs, PIECES, *none).collect()] == ["und"] * 40
    assert langid.predict(docs.limit(0), PIECES, *model).count() == 0


def plain_score(vocab, word, logp):
    """Log of the sum over all segmentations, place by place in logarithms."""
    place, marked = {p: i for i, p in enumerate(vocab.pieces)}, langid.MARK + word
    sums = [np.zeros(logp.shape[1])]
    for end in range(1, len(marked) + 1):
        ways = []
        for k in range(1, min(end, vocab.longest) + 1):
            i = place.get(marked[end - k : end], 0 if k == 1 else None)
            if i is not None:
                ways.append(sums[end - k] + logp[i])
        sums.append(np.logaddexp.reduce(ways))
    return sums[-1]


def test_words_of_all_lengths_have_one_sum(spark, sf):
    """Also where letters are so rare that their product is no double; places are looked up in blocks."""
    vocab = langid.vocabulary(PIECES)
    langs, logp = langid.train(spark.read.parquet(f"{sf}/documents.parquet"), PIECES)
    words = ["ꙮ" * n for n in range(1, 80)] + ["東" * n for n in (47, 59, 60, 61, 62, 400)] + ["the" * n for n in (19, 20, 21, 300)] + ["xqz" * 25, "д" * 61]
    got = langid.log_scores(vocab, words, logp)
    assert np.isfinite(got).all() and np.allclose(got, [plain_score(vocab, w, logp) for w in words], rtol=1e-9, atol=1e-9)
    for w in ("ꙮ" * 10_000, "a" * 10_000, "the" * 4000):
        assert np.allclose(langid.log_scores(vocab, [w], logp), plain_score(vocab, w, logp), rtol=1e-9)


def test_blocks_of_places(monkeypatch):
    vocab = langid.vocabulary(PIECES)
    words, counts = ["station", "internationalisation", "thethethethethethe", "x" * 700], np.array([5.0, 3, 2, 1])
    logp = langid.fit(vocab, words, counts)
    scores = langid.log_scores(vocab, words, logp[:, None])
    monkeypatch.setattr(langid, "PLACES", 5)
    assert np.allclose(langid.fit(vocab, words, counts), logp) and np.allclose(langid.log_scores(vocab, words, logp[:, None]), scores)
    assert vocab.longest > 8


def test_expected_counts_are_those_of_all_segmentations():
    vocab = langid.vocabulary(PIECES)
    place, p = {x: i for i, x in enumerate(vocab.pieces)}, np.random.default_rng(2).dirichlet(np.ones(len(vocab.pieces)))
    want, got = np.zeros(len(p)), np.zeros(len(p))
    for word, n in (("then", 3.0), ("xꙮa", 2.0)):
        ways = []
        marked = langid.MARK + word
        for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
            edges = [0, *[i for i, cut in enumerate(cuts, 1) if cut], len(marked)]
            parts = [marked[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            ids = [place.get(x, 0 if len(x) == 1 else None) for x in parts]
            if None not in ids:
                ways.append((math.prod(p[i] for i in ids), ids))
        for w, ids in ways:
            np.add.at(want, ids, n * w / sum(x[0] for x in ways))
        for _, points in langid.by_length([word]):
            langid.expect(vocab, points, np.array([n]), p, got)
    assert np.allclose(got, want)


def test_letters_of_no_language_decide_nothing(spark, sf):
    langs, logp = langid.train(spark.read.parquet(f"{sf}/documents.parquet"), PIECES)
    english = "this is a sentence that somebody wrote about the house and the garden"
    strange = ["", "東" * 47 + " ", "ж" * 30 + " " + "щ" * 30 + " ", "ꙮ" * 58 + " ", "ꙮ" * 10_000 + " ", " ".join("語" * n for n in range(1, 30)) + " "]
    docs = spark.createDataFrame([(i, x + english) for i, x in enumerate(strange)], "doc_id long, text string")
    out = langid.predict(docs, PIECES, langs, logp).collect()
    assert {r["lang_pred"] for r in out} == {"en"} and all(r["score"] > 0.5 for r in out)


def test_query_against_plain_sums(spark, sf):
    """Every prediction and score of the query, from the model, one word after the other."""
    from parallaxis.llm import queries

    docs, vocab = spark.read.parquet(f"{sf}/documents.parquet"), langid.vocabulary(PIECES)
    langs, logp = langid.train(docs, PIECES)
    rows, known = {r["doc_id"]: r for r in queries.op2_language_id(spark, sf).collect()}, {}
    for d in docs.collect():
        words, r = langid.WORD.findall((d["text"] or "").lower()), rows.pop(d["doc_id"])
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        for w in set(words) - known.keys():
            known[w] = plain_score(vocab, w, logp)
        total = sum(known[w] for w in words) * min(len(words), langid.SURE_WORDS) / len(words)
        chance = np.exp(total - np.logaddexp.reduce(total))
        assert np.isclose(r["score"], chance.max(), atol=1e-7) and np.isclose(chance[langs.index(r["lang_pred"])], chance.max(), atol=1e-7)
    assert not rows
