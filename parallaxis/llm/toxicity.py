"""A toxicity classifier regularised by counterfactual identity swaps.

Features are the presence of words (runs of letters, A-Z lower-cased) and of words' beginnings, hashed. Those that
stand out between toxic and other labelled texts are selected by their counts, and a logistic model is fitted on them.
Every labelled text gives counterfactual sentences: one that names a group has the identity term swapped for each other
of its kind, the swapped text's features being taken anew; one that names none is given a term, and the next of its kind
instead (which ones, a hash of its id says). The squared change of the logit between the two is penalised: what a text
says about a group may count, which group it names may not.

Labels are learned from at most about `sample` labelled texts (a documented bound, chosen by a hash of their id).

Rows: null or empty text has no features and gets the model's base rate. Labels whose toxic or doc_id is null are
ignored; of several labels of one document the highest counts. With no label of either kind to learn from, the score is
the share of toxic labels (0 without any). Empty tables give no rows; other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import columns_or_null, held_out, materialize, ship

U = np.uint64
#: Kinds of identity terms, in English, German, Spanish and French; terms of one kind are swapped for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("old", "young", "elderly", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("ausländer", "einheimische", "flüchtlinge", "einwanderer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
)
#: Bytes of a word's beginning that are features of their own.
HEADS = (4, 5, 6)
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(b: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of all features of a block, repeats included."""
    w = tk.words(b, lower=True, inside=LETTER)
    out = [(w.doc, w.hash)]
    for n in HEADS:
        live = w.end - w.start >= n
        out.append((w.doc[live], tk.mix(tk.spans_hash(b, w.start[live], w.start[live] + n, lower=True), 50 + n)))
    doc, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return doc, h.view(np.int64)


def term_features(term: str) -> np.ndarray:
    return features(next(tk.blocks(pa.array([term]))))[1]


def pairs_of(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))[: len(doc)]
    return doc[keep], h[keep]


def word_hash(term: str) -> int:
    return int(term_features(term)[0])  # the first feature is the whole word


def counterfactuals(text: str, choice: int) -> list[tuple[str, str]]:
    """Pairs of sentences that differ in the group they name: the text with each of its identity terms swapped (every
    mention of it) for each other of its kind, or, where it names none, with one term and with the next of its kind added;
    choice says which. A null text has none."""
    out = []
    for kind in IDENTITIES:
        for term in kind:
            mention = re.compile(rf"(?<![^\W\d_]){term}(?![^\W\d_])", re.IGNORECASE)
            if mention.search(text):
                out += [(text, mention.sub(other, text)) for other in kind if other != term]
    if not out:
        kind = IDENTITIES[choice % len(IDENTITIES)]
        at = choice // len(IDENTITIES) % len(kind)
        out = [(f"{text} {kind[at]}", f"{text} {kind[(at + 1) % len(kind)]}")]
    return out


def changes_of(pairs: list[tuple[str, str]], known: np.ndarray) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Places among the known features that each pair's second sentence gains and loses."""
    if not pairs:
        return []
    sets: list[np.ndarray] = []
    for b in tk.blocks(pa.array([t for pair in pairs for t in pair])):
        doc, h = pairs_of(*features(b))
        live = np.isin(h, known)
        doc, at = doc[live], np.searchsorted(known, h[live])
        sets += np.split(at, np.searchsorted(doc, np.arange(1, len(b.bounds) - 1)))
    return [(tuple(np.setdiff1d(b, a).tolist()), tuple(np.setdiff1d(a, b).tolist())) for a, b in zip(sets[::2], sets[1::2], strict=True)]


class Swaps(NamedTuple):
    """Distinct changes of the feature vector between counterfactual sentences, as triples (change, feature, 1 or -1), and
    how many pairs have each."""

    change: np.ndarray
    feature: np.ndarray
    sign: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, found: Iterable[tuple[tuple[int, ...], tuple[int, ...], int]]) -> "Swaps":
        cells, pairs = [], []
        for i, (gains, losses, n) in enumerate(found):
            cells += [(i, f, 1) for f in gains] + [(i, f, -1) for f in losses]
            pairs.append(n)
        table = np.array(cells, np.int64).reshape(-1, 3)
        return cls(table[:, 0], table[:, 1], table[:, 2].astype(float), np.array(pairs, float))


class Model:
    """Selected features in order of their hashes, their weights, the base logit, and the number of counterfactual pairs
    that the fit saw."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, base: float, pairs: int = 0):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.base, self.pairs = hashes[order], weights[order], base, pairs

    def logits(self, b: tk.Block) -> np.ndarray:
        doc, h = features(b)
        at = np.searchsorted(self.hashes, h) if len(self.hashes) else np.zeros(0, np.int64)
        known = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h) if len(self.hashes) else at
        key = np.unique(doc[known] * len(self.hashes) + at[known]) if len(known) else np.zeros(0, np.int64)
        size = max(1, len(self.hashes))
        return self.base + np.bincount(key // size, self.weights[key % size] if len(key) else None, len(b.bounds) - 1)


def fit(rows: np.ndarray, columns: np.ndarray, label: np.ndarray, swaps: Swaps, width: int, ridge: float = 0.3, swap_weight: float = 10.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps with conjugate gradients; (rows, columns) are the features present, the last weight
    is the base. The mean squared change of the logit between counterfactual sentences is penalised by swap_weight."""
    n = len(label)
    shares = swaps.pairs / max(swaps.pairs.sum(), 1.0)
    decay = np.full(width + 1, ridge / n)
    decay[-1] = 0

    def forth(w: np.ndarray) -> np.ndarray:
        return w[-1] + np.bincount(rows, w[columns], n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, r[rows], width), r.sum())

    def penalty(w: np.ndarray) -> np.ndarray:
        moved = shares * np.bincount(swaps.change, swaps.sign * w[swaps.feature], len(shares))
        return decay * w + np.append(2 * swap_weight * np.bincount(swaps.feature, swaps.sign * moved[swaps.change], width), 0)

    def loss(w: np.ndarray) -> float:
        z = forth(w)
        return float(np.mean(np.logaddexp(0, z) - label * z) + 0.5 * w @ penalty(w))

    w = np.zeros(width + 1)
    w[-1] = np.log((label.sum() + 1) / (n - label.sum() + 1))
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-forth(w)))
        g = back((p - label) / n) + penalty(w)
        curve = p * (1 - p) / n
        # conjugate gradients on the Newton system
        step, r = np.zeros(width + 1), -g
        d, size = r.copy(), r @ r
        for _ in range(60):
            if size < 1e-16 or size < 1e-4 * (g @ g):
                break
            h = back(curve * forth(d)) + penalty(d)
            alpha = size / (d @ h)
            step, r = step + alpha * d, r - alpha * h
            d, size = r + (r @ r / size) * d, r @ r
        rate = 1.0
        while rate > 1e-4 and loss(w + rate * step) > now + 1e-4 * rate * (g @ step):
            rate /= 2
        w = w + rate * step
        before, now = now, loss(w)
        if before - now < 1e-7:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most_features: int = 3000, least_share: float = 0.0004, swap_weight: float = 10.0) -> Model:
    spark = docs.sparkSession
    ship(spark)
    docs = columns_or_null(docs, doc_id="long", text="string")
    labels = columns_or_null(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    share = int(min(1.0, sample / max(n, 1)) * 1_000_000)
    # at most about `sample` rows of two numbers, so the broadcast's size is bounded
    chosen = materialize(labels.where(F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1_000_000)) < share), "labelled")
    texts = materialize(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")), "labelled-texts")
    terms = np.unique(np.concatenate([term_features(t) for kind in IDENTITIES for t in kind]))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.blocks(batch.column("text")):
                rows = batch.slice(b.first, len(b.bounds) - 1)
                doc, h = pairs_of(*features(b))
                offsets = np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([rows.column("doc_id"), rows.column("toxic"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h))], ["doc_id", "toxic", "features"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a task's rows, so the shuffle has each feature once a task and batch."""
        for b in batches:
            h = b.column("features").flatten().to_numpy()
            sizes = np.diff(np.append(b.column("features").offsets.to_numpy()[: b.num_rows], b.column("features").offsets.to_numpy()[b.num_rows]))
            toxic = np.repeat(b.column("toxic").to_numpy() > 0, sizes)
            names, at = np.unique(h, return_inverse=True)
            yield pa.record_batch([pa.array(names), pa.array(np.bincount(at, minlength=len(names)).astype(np.int64)), pa.array(np.bincount(at, toxic, len(names)).astype(np.int64))], ["feature", "n", "n_toxic"])

    held = materialize(texts.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(present, "doc_id long, toxic int, features array<long>"), "features")
    sizes = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.expr("int(toxic > 0)")), F.lit(0)).alias("n_toxic")).first()
    if not 0 < sizes["n_toxic"] < sizes["n"]:
        rate = (sizes["n_toxic"] / sizes["n"]) if sizes["n"] else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))) if 0 < rate < 1 else (50.0 if rate else -50.0))
    rate = sizes["n_toxic"] / sizes["n"]
    counted = held.select("features", "toxic").mapInArrow(counts, "feature long, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    # how far the toxic share of its texts stands out, in squared deviations
    strength = F.pow(F.col("n_toxic") - rate * F.col("n"), 2) / (rate * (1 - rate) * F.col("n"))
    picked = counted.where(F.col("n") >= max(4, round(least_share * sizes["n"]))).withColumn("strength", strength).where("strength > 15").orderBy(F.desc("strength"), "feature").limit(most_features)
    hashes = np.unique(np.concatenate([np.array([r["feature"] for r in picked.select("feature").collect()], np.int64), terms]))
    known = spark.sparkContext.broadcast(hashes)  # at most most_features and the identity terms

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.flatnonzero(np.isin(known.value, np.asarray(x.values))).tolist() for x in b.column("features")]
            yield pa.record_batch([b.column("toxic"), pa.array(lists, pa.list_(pa.int64()))], ["toxic", "picked"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                pairs = [p for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for p in counterfactuals(t or "", zlib.crc32(str(d).encode()))]
                seen.update(changes_of(pairs, known.value))
            yield pa.record_batch([pa.array([g for g, _ in seen], pa.list_(pa.int64())), pa.array([x for _, x in seen], pa.list_(pa.int64())), pa.array(list(seen.values()), pa.int64())], ["gains", "losses", "n"])

    table = held.select("toxic", "features").mapInArrow(slim, "toxic int, picked array<long>").toArrow()  # `sample` rows of few numbers
    label = (table.column("toxic").to_numpy() > 0).astype(float)
    lists = table.column("picked").to_pylist()
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    columns = np.array([c for x in lists for c in x], np.int64)
    # distinct changes and their numbers: as most texts name no group, few more than there are pairs of terms
    found = texts.select("doc_id", "text").mapInArrow(moved, "gains array<long>, losses array<long>, n long").groupBy("gains", "losses").agg(F.sum("n").alias("n")).collect()
    swaps = Swaps.of(sorted((tuple(r["gains"]), tuple(r["losses"]), r["n"]) for r in found))
    weights, base = fit(rows, columns, label, swaps, len(hashes), swap_weight=swap_weight)
    return Model(hashes, weights, base, int(swaps.pairs.sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # a few thousand features, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = [held.value.logits(b) for b in tk.blocks(batch.column("text"))]
            out = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *logits]), -500, 500)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
