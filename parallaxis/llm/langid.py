"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities of the pieces of one fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces, which a forward algorithm gives; that of a text is the product over its words
(runs of letters, lower-cased, with the vocabulary's mark of a word's beginning). The probabilities are fitted by
expectation-maximisation over word counts of a bounded sample of labelled texts (`sample` per language, a documented
bound; whole texts, chosen by a hash of their id). Distinct words are scored once per task, whole columns at a time, words of
all lengths by the same sums. Letters that no language uses count alike in all.

Rows: null text, or text without a letter, is `und` with score 0, as is everything if no labelled text can be learned
from. A null language or null doc_id is never learned from. Ties go to the alphabetically first language. An empty
table gives no rows; other columns take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import columns_or_null, held_out, materialize, ship

UND = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Places between two rescalings of the sums: products of that many of the smallest probabilities are far above what a double loses.
RESCALE = 16
#: Share of a language's mass that all pieces have alike, so that a piece no language knows says nothing.
EVEN = 1e-3
#: Letters rarer than this in every language count alike in all.
RARE = 1e-5
#: Places of a word whose pieces are looked up at a time.
PLACES = 1 << 16
#: Words whose scores a task keeps at a time.
CACHE_WORDS = 300_000
#: Words of a text that count in full towards its score; more words do not make it surer.
SURE_WORDS = 20
MARK = "▁"
_M = np.uint64(0x9E3779B97F4A7C15)
_vocabularies: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Lower-case pieces of letters, found by the hash of their characters; piece 0 stands for any other letter."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.pieces = ["", *sorted(p for p in pieces if p == p.lower() and WORD.fullmatch(p.removeprefix(MARK) or "a"))]
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self.hash_one(p) for p in self.pieces[1:]], np.uint64)
        order = np.argsort(hashes)
        # an open-addressed table: one or two looks find a piece or its absence
        self.mask = (1 << 18) - 1
        self.slots = np.zeros(self.mask + 2, np.uint64)
        self.ids = np.zeros(self.mask + 2, np.int32)
        for k in order:
            at = int(hashes[k]) >> 40 & self.mask
            while self.ids[at]:
                at = (at + 1) & self.mask
            self.slots[at], self.ids[at] = hashes[k], k + 1

    @staticmethod
    def hash_one(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x5851F42D4C957F2D + ord(c) * 0x9E3779B97F4A7C15) & (2**64 - 1)
        return h ^ (h >> 29)

    def find(self, h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(29))
        at = ((h >> np.uint64(40)) & np.uint64(self.mask)).astype(np.int64)
        out = np.zeros(len(h), np.int32)
        live = np.arange(len(h))
        while len(live):
            spot = at[live]
            ids = self.ids[spot]
            hit = (self.slots[spot] == h[live]) & (ids > 0)
            out[live[hit]] = ids[hit]
            live = live[~hit & (ids > 0)]
            at[live] = (at[live] + 1) & self.mask
        return out

    def lattice(self, words: np.ndarray) -> list[np.ndarray]:
        """Piece ids of words of one length, as code points: of each size an array (word, start), 0 where no such piece is."""
        h = terms = words.astype(np.uint64) * _M
        out = []
        with np.errstate(over="ignore"):
            for k in range(min(self.longest, words.shape[1])):
                h = h[:, :-1] * np.uint64(0x5851F42D4C957F2D) + terms[:, k:] if k else h
                out.append(self.find(h.ravel()).reshape(h.shape))
        return out


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def by_length(words: list[str], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of the marked words of each length, at most so many, and about a million letters, at a time."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, min(most, 1_000_000 // int(size + 1)))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            text = "".join(MARK + words[i] for i in part)
            yield part, np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(part), size + 1)


def _arcs(vocab: Vocabulary, points: np.ndarray) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For every place of words of one length, in order, the pieces that end there: size, words, piece ids. Single letters are
    always there, as piece 0 where the vocabulary lacks them. Long words are looked up in blocks of places."""
    size, every = points.shape[1], np.arange(len(points))
    for lo in range(0, size, PLACES):
        base = max(0, lo - vocab.longest + 1)
        sizes = vocab.lattice(points[:, base : lo + PLACES])
        some = [ids.any(0) for ids in sizes]
        for end in range(lo + 1, min(lo + PLACES, size) + 1):
            arcs = [(1, every, sizes[0][:, end - 1 - base])]
            for k in range(2, min(len(sizes), end - base) + 1):
                if some[k - 1][end - k - base]:
                    ids = sizes[k - 1][:, end - k - base]
                    live = np.flatnonzero(ids)
                    arcs.append((k, live, ids[live]))
            yield arcs


def forward(vocab: Vocabulary, points: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log-probability (word, language) of words of one length, summed over all their segmentations.

    The sums of the last places are kept relative to one of them, whose logarithm is kept apart: no product is lost, however
    long the word and however rare its letters."""
    p = np.exp(logp)
    near, log = [np.ones((len(points), logp.shape[1]))], np.zeros((len(points), logp.shape[1]))
    for end, arcs in enumerate(_arcs(vocab, points), 1):
        here = near[-1] * p[arcs[0][2]]
        for k, live, ids in arcs[1:]:
            here[live] += near[-k][live] * p[ids]
        near = [*near[-vocab.longest :], here]
        if not end % RESCALE:
            near, log = [x / here for x in near], log + np.log(here)
    return log + np.log(near[-1])


def log_scores(vocab: Vocabulary, words: list[str], logp: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, over all segmentations."""
    out = np.zeros((len(words), logp.shape[1]))
    for part, points in by_length(words, max(64, 80_000 // logp.shape[1])):  # bounded whatever the languages' number
        out[part] = forward(vocab, points, logp)
    return out


def expect(vocab: Vocabulary, points: np.ndarray, counts: np.ndarray, p: np.ndarray, expected: np.ndarray) -> None:
    """Add the expected piece counts of words of one length: forward sums, then the same backwards, each place's sums relative
    to its own mean over the words' arcs, in logarithms between places."""
    arcs = list(_arcs(vocab, points))
    alpha, log = [np.ones(len(points))], [np.zeros(len(points))]
    for here in arcs:
        # relative to the sum one place before
        total = alpha[-1] * p[here[0][2]]
        for k, live, ids in here[1:]:
            total[live] += alpha[-k][live] * np.exp(log[-k][live] - log[-1][live]) * p[ids]
        alpha.append(np.ones(len(points)))
        log.append(log[-1] + np.log(total))
    whole = log[-1]
    beta = [np.full(len(points), -np.inf) for _ in range(len(arcs))] + [np.zeros(len(points))]
    for end in range(len(arcs), 0, -1):
        for k, live, ids in arcs[end - 1]:
            way = beta[end][live] + np.log(p[ids])
            beta[end - k][live] = np.logaddexp(beta[end - k][live], way)
            expected += np.bincount(ids, counts[live] * np.exp(log[end - k][live] + way - whole[live]), len(expected))


def fit(vocab: Vocabulary, words: list[str], counts: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Log-probabilities of the pieces by expectation-maximisation; every piece keeps an even share of a little mass."""
    v = len(vocab.pieces)
    p, counts = np.full(v, 1 / v), np.asarray(counts, float)
    groups = list(by_length(words))
    for _ in range(rounds):
        expected = np.zeros(v)
        for part, points in groups:
            expect(vocab, points, counts[part], p, expected)
        p = (1 - EVEN) * expected / expected.sum() + EVEN / v if expected.sum() else p
    return np.log(p)


def same_for_strangers(vocab: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """Letters outside the vocabulary, letters that hardly occur in any language, and the bare mark before them get one
    probability in all languages: their number in a text must not decide between languages of which none uses them."""
    rare = np.array([len(x.removeprefix(MARK)) == 1 for x in vocab.pieces]) & (logp.max(1) < np.log(RARE))
    rare |= np.array([x in ("", MARK) for x in vocab.pieces])
    return np.where(rare[:, None], logp.max(1, keepdims=True), logp)


def count_words(texts: list[str | None]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        if t:
            out.update(WORD.findall(t.lower()))
    return out


def train(docs: DataFrame, vocab_path: str, sample: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities (pieces, languages); from at most about `sample` texts a language."""
    ship(docs.sparkSession)
    docs = columns_or_null(docs, doc_id="long", text="string", lang="string").where("doc_id is not null and lang is not null and text is not null").where(~held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return [], np.zeros((0, 0))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int(min(1.0, sample / n) * 1_000_000))) for x, n in sizes.items()])
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1_000_000)) < share)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for x in dict.fromkeys(langs):
                c = count_words([t for t, own in zip(b.column("text").to_pylist(), langs, strict=True) if own == x])
                yield pa.record_batch([pa.array([x] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        logp = fit(vocabulary(vocab_path), table.column("word").to_pylist(), table.column("n").to_numpy())
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "logp": pa.array([logp.tolist()], pa.list_(pa.float64()))})

    counted = chosen.select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    models = {r["lang"]: r["logp"] for r in counted.groupBy("lang").applyInArrow(learn, "lang string, logp array<double>").collect()}  # languages x vocabulary
    langs = sorted(models)
    return langs, same_for_strangers(vocabulary(vocab_path), np.array([models[x] for x in langs]).T) if langs else np.zeros((0, 0))


def predict(docs: DataFrame, vocab_path: str, langs: list[str], logp: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of every whole text, with the columns named in keep (without those of docs that are named
    like a result's, whose place the result takes)."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast((langs, logp))  # languages x vocabulary, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = model.value
        vocab = vocabulary(vocab_path)
        known: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = [WORD.findall(t.lower()) if t else [] for t in part.column("text").to_pylist()]
                sizes = np.array([len(w) for w in found])
                new = set().union(*found)
                if len(known) + len(new) > CACHE_WORDS:
                    known, scores = {}, scores[:0]
                fresh = [w for w in new if w not in known]
                if fresh and langs:
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    scores = np.concatenate((scores, log_scores(vocab, fresh, logp)))
                pred, score = np.full(len(found), len(langs)), np.zeros(len(found))
                some = np.flatnonzero(sizes) if langs else np.zeros(0, np.int64)
                if len(some):
                    get = known.__getitem__
                    ids = np.fromiter((i for w in found for i in map(get, w)), np.int64, int(sizes.sum()))
                    starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                    total = np.add.reduceat(scores[ids], starts)
                    total *= (np.minimum(sizes[some], SURE_WORDS) / sizes[some])[:, None]
                    total -= total.max(1, keepdims=True)
                    pred[some] = total.argmax(1)
                    score[some] = 1 / np.exp(total).sum(1)
                names = np.array([*langs, UND], object)
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", *keep)), pa.array(names[pred].tolist(), pa.string()), pa.array(score)], ["doc_id", *keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes) | {"doc_id": "long", "text": "string"}
    keep = tuple(c for c in dict.fromkeys(keep) if c in kinds and c not in ("doc_id", "lang_pred", "score"))
    more = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    slim = columns_or_null(docs, **{c: kinds[c] for c in ("doc_id", *keep, "text")})
    return slim.mapInArrow(run, f"doc_id long, {more}lang_pred string, score double")
