"""Ranked lexical search: windowed bucket scoring of integer BM25.

Every text becomes a row of postings (ids of the asked-for terms it holds, with their counts); these rows are written once.
A task then takes its documents in windows of fixed size. A window's postings are laid out by term. For every item its
terms' postings are traversed one after the other and added into an array of one score a document of the window, small
enough for a core's cache; a bitset of blocks of 64 documents says where anything was added, so only these blocks are
harvested into the item's heap of its best, and cleared. The heaps of all tasks meet in one ranking per item.

Items are taken in blocks of about `block_terms` terms, so neither the driver nor a task holds more of them than that, and
the documents are read once a block.

Rows: null or empty text has no term; such a document is not counted and not found, such an item finds nothing. A null
doc_id ranks last among equal scores, repeated rows are each ranked. Each row of the items is an item of its own, also where
item ids repeat or are null. Empty tables give no rows; other columns take no part, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import columns_or_null, materialize, maybe_broadcast, ship

#: Digits, A-Z, a-z and everything beyond ASCII; of lower-cased UTF-8 the same as bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of a window: 128 KiB of scores. Postings of a window, beyond which it ends earlier.
WINDOW, WINDOW_POSTINGS = 16_384, 4_000_000
#: Bits of a document's number inside its block of the occupancy set.
BLOCK = 6
#: Terms of the items that are searched for at a time.
BLOCK_TERMS = 200_000
ROWS = 500


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all terms of the text) and its postings: terms (places in the list) with their counts; no shuffle."""
    ship(docs.sparkSession)
    place = {t.encode(): i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, size = place.get, len(place)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                number, found = [], []
                for text in part.column("text"):
                    t = text.as_py()
                    own = _TERM.findall(t.encode().lower()) if t else []
                    number.append(len(own))
                    ids = np.fromiter((find(w, -1) for w in own), np.int64, len(own))
                    found.append(np.unique(ids[ids >= 0], return_counts=True))
                ends = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[k] for f in found]).astype(np.int32))) for k in (0, 1)]
                yield pa.record_batch([part.column("doc_id"), pa.array(number, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Windows:
    """Scores windows of documents for all items and keeps each item's best in a heap."""

    def __init__(self, items: list[np.ndarray], weight: np.ndarray, documents: int, terms: int, k: int):
        self.items, self.weight, self.documents, self.terms, self.k = items, weight, documents, terms, k
        self.heaps: list[list[tuple]] = [[] for _ in items]
        self.scores = np.zeros(WINDOW, np.int64)
        self.occupied = np.zeros(WINDOW >> BLOCK, bool)

    def score(self, ids: list, lengths: list[int], sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """One window: doc_ids, lengths, numbers of postings, and all postings one document after the other."""
        soft = np.array([100 - 90 + (90 * n * self.documents) // self.terms for n in lengths], np.int64)
        slot = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        slot, tf = slot[order], counts[order].astype(np.int64)
        add = self.weight[terms[order]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * soft[slot]))
        edge = np.searchsorted(terms[order], np.arange(len(self.weight) + 1))
        scores, occupied, blocks = self.scores, self.occupied, self.scores.reshape(-1, 1 << BLOCK)
        for own, heap in zip(self.items, self.heaps, strict=True):
            for t in own:
                a, b = edge[t], edge[t + 1]
                if a < b:
                    at = slot[a:b]
                    scores[at] += add[a:b]
                    occupied[at >> BLOCK] = True
            live = np.flatnonzero(occupied)
            if len(live):
                self.harvest(heap, ids, live, blocks[live].ravel())
                blocks[live] = 0
                occupied[live] = False

    def harvest(self, heap: list[tuple], ids: list, live: np.ndarray, found: np.ndarray) -> None:
        least = max(1, heap[0][0]) if len(heap) == self.k else 1
        at = np.flatnonzero(found >= least)
        if len(at) > self.k:
            at = at[found[at] >= np.partition(found[at], len(at) - self.k)[len(at) - self.k]]
        for i, score in zip(at.tolist(), found[at].tolist(), strict=True):
            doc = ids[(int(live[i >> BLOCK]) << BLOCK) + (i & ((1 << BLOCK) - 1))]
            entry = (score, -math.inf if doc is None else -doc, doc is None)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def best(rows: DataFrame, items: list[tuple[int, list[int]]], weight: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """key, doc_id and score of the best k documents of every task for each item (key, places of its terms)."""
    ship(rows.sparkSession)
    keys, own = [i for i, _ in items], [np.array(sorted(t), np.int64) for _, t in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(own, weight, documents, terms, k)
        ids, lengths, parts, held = [], [], [], 0

        def close() -> None:
            nonlocal held
            windows.score(ids, lengths, *(np.concatenate([p[i] for p in parts]) for i in range(3)))
            ids.clear(), lengths.clear(), parts.clear()
            held = 0

        for b in batches:
            at = 0
            while at < b.num_rows:
                sizes = b.column("terms").slice(at).value_lengths().to_numpy(zero_copy_only=False)
                room = WINDOW - len(ids)
                fits = max(1 if not ids else 0, min(room, int(np.searchsorted(np.cumsum(sizes), WINDOW_POSTINGS - held, side="right"))))
                if fits:
                    part = b.slice(at, fits)
                    ids += part.column("doc_id").to_pylist()
                    lengths += part.column("n").to_pylist()
                    parts.append((sizes[:fits], part.column("terms").flatten().to_numpy(), part.column("counts").flatten().to_numpy()))
                    held += int(sizes[:fits].sum())
                    at += fits
                if at < b.num_rows:
                    close()
        if ids:
            close()
        out = [(keys[i], None if none else int(-minus), score) for i, heap in enumerate(windows.heaps) for score, minus, none in heap]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["key", "doc_id", "score"])

    return rows.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts").mapInArrow(run, "key long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: for every row of items (item_id, text) its k best documents with a score above 0."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kind = dict(items.dtypes)["item_id"] if "item_id" in items.columns else "long"
    asked = columns_or_null(items, item_id=kind, text="string").select(F.monotonically_increasing_id().alias("key"), "item_id", F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("terms"))
    asked = materialize(asked, "items")
    blocks = 1 + (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms
    found = []
    for block in range(blocks):
        own = [(r["key"], r["terms"]) for r in asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect() if r["terms"]]
        terms = sorted({t for _, ts in own for t in ts})
        rows = materialize(postings(docs, terms), "postings")
        documents, length = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not documents or not terms:
            continue
        weight = np.zeros(len(terms), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            weight[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
        place = {t: i for i, t in enumerate(terms)}
        found.append(best(rows, [(key, [place[t] for t in ts]) for key, ts in own], weight, documents, length, k))
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(maybe_broadcast(asked.select("key", "item_id")), "key").select("item_id", "rank", "doc_id", "score")
