"""Importance resampling towards the distribution of target texts, with hashed n-gram features and Gumbel noise.

Both corpora are counted once into one array of hashed features, summed per task before anything is shuffled. A text's weight
is the floored mean of its features' gains, taken from an array; its score adds noise from a hash of its id. Scores are
integers, so an exact histogram of them finds the draw: counts summed from the highest score on give every score's first
rank and the cutoff, and only rows at or above the cutoff are numbered, each score by itself, by doc_id.

The histogram has at most one row an integer between the lowest and the highest score. Gains are logarithms of counts, at most
about 44 * scale either way for 64-bit counts, noise lies between -4 and 23 * scale: some 160,000 rows at the production
scale of 1000, whatever the size of the corpus. Scores with many survivors are numbered in slices of doc_id.

Rows: null text has no word, so no feature, weight 0, and is never drawn, as no text of fewer than `least_words` words is.
A null doc_id hashes as an empty one and comes last among equal scores. Repeated rows each take part; ties of one score and
doc_id are numbered in any order. An empty table gives no rows; without target texts all gains come from counts of 0.
Other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import columns_or_null, materialize, ship

#: Lower-cased UTF-8; A-Z can no longer stand in it.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Features whose bucket a task keeps.
CACHE_FEATURES = 400_000
#: Survivors of one score that one task numbers.
GROUP_ROWS = 1_000_000


class Buckets(dict):
    """The bucket of each feature, computed when first met."""

    def __init__(self, number: int):
        self.number = number

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE_FEATURES:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.number
        return b


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def runs(words: list[bytes], most: int) -> Iterator[bytes]:
    """All runs of 1 to `most` consecutive words."""
    yield from words
    for n in range(2, most + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def feature_counts(texts: DataFrame, buckets: int, most: int) -> np.ndarray:
    """Occurrences of each bucket's features in all texts; a task sends one row a bucket at most."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), Buckets(buckets)
        for b in batches:
            for text in b.column("text"):
                own = words_of(text.as_py())
                total += np.bincount(np.fromiter(map(known.__getitem__, runs(own, most)), np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in columns_or_null(texts, text="string").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int) -> np.ndarray:
    """The floored, scaled logarithm of each bucket's share of the target over its share of the source, both smoothed by one."""
    all_s, all_t, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(scale * math.log(float((t + 1) * (all_s + b)) / float((s + 1) * (all_t + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every whole text; no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for b in batches:
            n_words, n_features, weight = [], [], []
            for text in b.column("text"):
                own = words_of(text.as_py())
                found = gain[np.fromiter(map(known.__getitem__, runs(own, most)), np.int64)]
                n_words.append(len(own))
                n_features.append(len(found))
                weight.append(int(found.sum()) // len(found) if len(found) else 0)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(scored: DataFrame, percent: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """scored (a written table with doc_id, score and eligible) with rank: 1, 2, 3... for the drawn share of the eligible rows
    in order of falling score, then doc_id; null for all others."""
    spark = scored.sparkSession
    counts = sorted(((r["score"], r["n"]) for r in scored.where("eligible").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reached = list(accumulate(n for _, n in counts))
    last = next(k for k, n in enumerate(reached) if n >= wanted)
    cutoff, slices = counts[last][0], 1 + max(n for _, n in counts[: last + 1]) // group_rows
    survives = F.col("eligible") & (F.col("score") >= cutoff)
    low, high = scored.where(survives).agg(F.min("doc_id"), F.max("doc_id")).first()
    low, width = low or 0, ((high or 0) - (low or 0)) // slices + 1
    cut = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(slices))
    sliced = scored.where(survives).withColumn("slice", cut)
    parts_of = sorted(((-r["score"], r["slice"], r["n"]) for r in sliced.groupBy("score", "slice").agg(F.count("*").alias("n")).collect()))
    before, at = [], 0
    for score, part, n in parts_of:
        before.append((-score, part, at))
        at += n
    offsets = F.broadcast(spark.createDataFrame(before, "score long, slice long, before long"))
    place = F.row_number().over(Window.partitionBy("score", "slice").orderBy(F.col("doc_id").asc_nulls_last()))
    numbered = sliced.withColumn("place", place).join(offsets, ["score", "slice"]).withColumn("rank", F.col("before") + F.col("place"))
    drawn = numbered.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    columns = [*scored.columns, "rank"]
    return drawn.select(*columns).unionByName(scored.where(~survives).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, most: int = 1, scale: int = 1000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for rows that are not drawn."""
    gain = gains(feature_counts(docs, buckets, most), feature_counts(target, buckets, most), scale)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-F.lit(float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = weigh(docs, gain, most).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    return draw(materialize(scored, "scored"), percent).drop("eligible")
