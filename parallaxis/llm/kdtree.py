"""Exact top-k inner-product search with a KD-tree per shard of the vectors.

Vectors are dealt to shards by median splits of the space. A shard's tree splits on at medians of the widest side and
keeps a tight bounding box and the smallest id per node. A query first searches its own shard; the score of its k-th hit
then goes with it to the other shards whose box may reach it, whose trees are descended only where a box's bound on the
inner product reaches that score, leaves best first, the score rising as hits are found. Ties go to the smaller id, also
in pruning.

Rows: vectors that are null, empty or hold a null or non-finite component, and null ids, take no part. A query meets the
vectors of its own length. Of several query rows with one id, the smallest vector is searched for; repeated candidate
rows count each. Fewer candidates than k are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import columns_or_null, materialize, maybe_broadcast, ship

LEAF = 256
#: Queries whose scores against a leaf are held at a time.
BLOCK = 2048
HITS = "query_id long, vec_id long, score double"
PLACED = "width int, shard long, vec_id long, vector array<double>"
BOXES = "width int, shard long, lo array<double>, hi array<double>"
#: Sampled vectors that a cell has at least.
LEAST_SAMPLE = 64
#: Shards whose boxes are sent to every task at a time.
BOXES_SENT = 10_000
#: Queries that meet a shard's vectors in one task, about.
CHUNK = 8192


class Tree:
    """Nodes in preorder: boxes lo and hi, smallest id, children (or -1) and the rows of a leaf."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.lo, self.hi, self.least, self.kids, self.rows = [], [], [], [], []
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order], ids[order]
        if len(ids):
            self.grow(np.arange(len(ids)))
        self.low, self.high = np.array(self.lo), np.array(self.hi)
        self.smallest = np.array(self.least)

    def grow(self, rows: np.ndarray) -> int:
        own = self.vectors[rows]
        lo, hi = own.min(0), own.max(0)
        node = len(self.lo)
        self.lo.append(lo), self.hi.append(hi), self.least.append(self.ids[rows].min()), self.kids.append((-1, -1)), self.rows.append(rows)
        axis = int(np.argmax(hi - lo))
        if len(rows) > LEAF and hi[axis] > lo[axis]:
            half = len(rows) // 2
            order = np.argpartition(own[:, axis], half)
            self.rows[node] = None
            self.kids[node] = (self.grow(np.sort(rows[order[:half]])), self.grow(np.sort(rows[order[half:]])))
        return node

    def bounds(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        """No vector of a node's box has a greater inner product with a query."""
        return np.maximum(q, 0) @ self.high[nodes].T + np.minimum(q, 0) @ self.low[nodes].T

    def leaves(self, q: np.ndarray, kth: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Leaves that some query may need, with all queries' bounds on them: from the root down, in order of levels."""
        level, found, limits = [0] if self.lo else [], [], []
        while level:
            b = self.bounds(q, level)
            live = (b >= kth[:, None]).any(0)
            below = []
            for i, node in enumerate(level):
                if live[i]:
                    if self.rows[node] is None:
                        below += self.kids[node]
                    else:
                        found.append(node), limits.append(b[:, i])
            level = below
        return found, np.array(limits).T if found else np.zeros((len(q), 0))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of hits that may be among the k best; kth: a score that k other vectors reach."""
        nodes, limits = self.leaves(q, kth)
        kth = kth.copy()
        # of equal scores the smaller id wins: once k hits are known here, their last id counts as well
        last = np.full(len(q), np.iinfo(np.int64).max)
        hits = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if not nodes:
            return tuple(hits)
        best_first = np.argsort(-limits, axis=1, kind="stable")
        least = self.smallest[nodes]
        for turn in range(len(nodes)):
            leaf = best_first[:, turn]
            limit = limits[np.arange(len(q)), leaf]
            live = np.flatnonzero((limit > kth) | ((limit == kth) & (least[leaf] < last)))
            if not len(live):
                if (limit < kth).all():
                    break
                continue
            live = live[np.argsort(leaf[live], kind="stable")]
            found = [hits]
            for part in np.split(live, np.flatnonzero(np.diff(leaf[live])) + 1):
                rows = self.rows[nodes[leaf[part[0]]]]
                s = q[part] @ self.vectors[rows].T
                i, j = np.nonzero(s >= kth[part][:, None])
                other = self.ids[rows[j]] != own[part[i]]
                i, j = i[other], j[other]
                found.append([part[i], self.ids[rows[j]], s[i, j]])
            who, ids, score = (np.concatenate([f[c] for f in found]) for c in range(3))
            order = np.lexsort((ids, -score, who))
            who, ids, score = who[order], ids[order], score[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            keep = place < k
            hits = [who[keep], ids[keep], score[keep]]
            end = place == k - 1
            kth[who[end]] = score[end]
            last[who[end]] = ids[end]
        return tuple(hits)


class Cells:
    """Median splits of the space down to cells of about equal shares of a sample; a cell has as many shards as its share of all
    rows asks for, its vectors being dealt to them by a hash. So equal vectors, which no split parts, are many shards too."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple] = []
        self.shards = 0
        self.rows, self.want = len(sample), shards
        self.grow(sample)

    def grow(self, x: np.ndarray) -> int:
        node = len(self.nodes)
        self.nodes.append(())
        axis = int(np.argmax(np.ptp(x, axis=0)))
        cut = float(np.median(x[:, axis]))
        left = x[:, axis] < cut
        if len(x) <= max(LEAST_SAMPLE, self.rows / self.want) or not left.any():
            own = max(1, -(-len(x) * self.want // self.rows))
            self.nodes[node] = (self.shards, own)
            self.shards += own
        else:
            self.nodes[node] = (axis, cut, self.grow(x[left]), self.grow(x[~left]))
        return node

    def place(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            n = self.nodes[node]
            if len(n) == 2:
                out[rows] = n[0] + h[rows] % n[1]
            else:
                left = x[rows, n[0]] < n[1]
                todo += [(n[2], rows[left]), (n[3], rows[~left])]
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def by_width(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = b.column("width").to_numpy()
    for w in np.unique(widths):
        yield int(w), b.filter(pa.array(widths == w))


def placed_by(rows: DataFrame, cells: dict[int, Cells], shards: int) -> DataFrame:
    """Adds the shard: of widths that the sample has not seen, by the hash alone."""
    known = rows.sparkSession.sparkContext.broadcast(cells)  # a few hundred splits a width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, own in by_width(b):
                h = own.column("h").to_numpy()
                shard = known.value[w].place(matrix(own.column("vector"), w), h) if w in known.value else h % shards
                yield pa.record_batch([own.column("width"), pa.array(shard.astype(np.int64)), own.column("vec_id"), own.column("vector")], ["width", "shard", "vec_id", "vector"])

    return rows.select(F.size("vector").alias("width"), F.xxhash64("vec_id").bitwiseAND(F.lit((1 << 62) - 1)).alias("h"), "vec_id", "vector").mapInArrow(run, PLACED)


def boxes(placed: DataFrame) -> DataFrame:
    """(width, shard, lo, hi): each shard's tight box; tasks send a box per shard they hold."""

    def reduced(batches: Iterator[pa.RecordBatch], lo: str, hi: str) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for w, own in by_width(b):
                low, high = matrix(own.column(lo), w), matrix(own.column(hi), w)
                shard = own.column("shard").to_numpy()
                order = np.argsort(shard, kind="stable")
                at = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0)))
                for s, x, y in zip(shard[order][at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), strict=True):
                    before = held.get((w, int(s)))
                    held[w, int(s)] = (x, y) if before is None else (np.minimum(x, before[0]), np.maximum(y, before[1]))
        yield pa.record_batch([pa.array([w for w, _ in held], pa.int32()), pa.array([s for _, s in held], pa.int64()), *(pa.array([v[k].tolist() for v in held.values()], pa.list_(pa.float64())) for k in (0, 1))], ["width", "shard", "lo", "hi"])

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(reduced(table.to_batches(), "lo", "hi")))

    some = placed.mapInArrow(lambda batches: reduced(batches, "vector", "vector"), BOXES)
    return some.groupBy("width", "shard").applyInArrow(whole, BOXES)


def box_blocks(known: DataFrame) -> Iterator[list]:
    """The boxes by width and shard, so that neighbours in space come together, in blocks of a bounded size."""
    block: list = []
    for r in known.orderBy("width", "shard").toLocalIterator():
        block.append(r)
        if len(block) == BOXES_SENT:
            yield block
            block = []
    if block:
        yield block


def routed(asked: DataFrame, known: list) -> DataFrame:
    """A row per query and shard of this block, not its own, whose box reaches the query's k-th score. A query that the box around
    the whole block does not reach meets none of its boxes."""
    held: dict[int, tuple] = {}
    for w in {r["width"] for r in known}:
        own = [r for r in known if r["width"] == w]
        held[w] = (np.array([r["shard"] for r in own]), np.array([r["lo"] for r in own]), np.array([r["hi"] for r in own]))
    sent = asked.sparkSession.sparkContext.broadcast(held)  # two vectors a shard, of at most BOXES_SENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, own in by_width(b):
                if w not in sent.value:
                    continue
                shards, lo, hi = sent.value[w]
                q = matrix(own.column("vector"), w)
                most = np.maximum(q, 0) @ hi.max(0) + np.minimum(q, 0) @ lo.min(0)
                own = own.filter(pa.array(most >= own.column("kth").to_numpy()))
                for at in range(0, own.num_rows, 256):
                    part = own.slice(at, 256)
                    q = matrix(part.column("vector"), w)
                    limit = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                    i, j = np.nonzero((limit >= part.column("kth").to_numpy()[:, None]) & (shards[None, :] != part.column("shard").to_numpy()[:, None]))
                    rows = part.take(pa.array(i))
                    yield pa.record_batch([rows.column("width"), pa.array(shards[j]), *(rows.column(c) for c in ("vec_id", "vector", "kth"))], ["width", "shard", "vec_id", "vector", "kth"])

    return asked.mapInArrow(run, f"{PLACED}, kth double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 16384, sample: int = 16384) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors; both inputs have vec_id and vector (array<double>). Only the
    splits of the space are taken from a sample of about so many vectors, chosen by a hash; every vector is placed by them."""
    spark = vectors.sparkSession
    ship(spark)
    fit = "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    vectors = columns_or_null(vectors, vec_id="long", vector="array<double>").where(fit)
    queries = columns_or_null(queries, vec_id="long", vector="array<double>").where(fit).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    cells: dict[int, Cells] = {}
    if shards > 1:
        share = int(min(1.0, sample / n) * 1_000_000)
        some = [np.array(r["vector"]) for r in vectors.where(F.pmod(F.xxhash64(F.lit("split sample"), "vec_id"), F.lit(1_000_000)) < share).select("vector").collect()]
        for w in {len(x) for x in some}:
            own = np.array([x for x in some if len(x) == w])
            cells[w] = Cells(own, max(1, -(-shards * len(own) // len(some))))
    placed = materialize(placed_by(vectors, cells, shards), "placed")
    asked = materialize(placed_by(queries, cells, shards), "asked")

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        width = key[0].as_py()
        table = table.combine_chunks()
        flat = matrix(table.column("vector").combine_chunks(), width)
        ids = table.column("vec_id").to_numpy()
        query = table.column("kth").is_valid().to_numpy(zero_copy_only=False)
        kth = table.column("kth").to_numpy(zero_copy_only=False)[query]
        tree = Tree(flat[~query], ids[~query])
        q, own = flat[query], ids[query]
        out = []
        for at in range(0, len(q), BLOCK):
            who, found, score = tree.search(q[at : at + BLOCK], own[at : at + BLOCK], k, kth[at : at + BLOCK])
            out.append(pa.table({"query_id": own[at : at + BLOCK][who], "vec_id": found, "score": score}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def searched(rows: DataFrame, searches: DataFrame) -> DataFrame:
        """Hits of the queries in their shards. A shard's queries are cut into chunks, and its vectors go to each; shards that
        nobody asks stay where they are."""
        counts = materialize(searches.groupBy("width", "shard").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks")), "chunks")
        theirs = rows.join(maybe_broadcast(counts), ["width", "shard"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        own = searches.join(maybe_broadcast(counts), ["width", "shard"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")))
        columns = ["width", "shard", "chunk", "vec_id", "vector", "kth"]
        both = theirs.withColumn("kth", F.lit(None).cast("double")).select(columns).unionByName(own.select(columns))
        return both.groupBy("width", "shard", "chunk").applyInArrow(answer, HITS)

    near = materialize(searched(placed, asked.withColumn("kth", F.lit(float("-inf")))), "near-hits")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranks = lambda hits: hits.withColumn("rank", F.row_number().over(best))
    if shards > 1:
        reached = ranks(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
        others = asked.join(reached, "vec_id", "left").withColumn("kth", F.coalesce("reached", F.lit(float("-inf")))).drop("reached")
        routes = [routed(others, block) for block in box_blocks(materialize(boxes(placed), "boxes"))]
        far = materialize(reduce(DataFrame.unionByName, routes), "routed")
        near = near.unionByName(searched(placed, far))
    return ranks(near).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
