"""Exact n-gram Jaccard join by a partitioned universe, and near-duplicate components from its links.

Two texts link when 100 * |intersection| >= 80 * |union| of their shingle sets. For a smaller set of size s, such a pair
differs in at most s // 4 elements. The universe of hashed shingles is cut, for each band of set sizes, into m > s // 4
segments: by the pigeonhole principle, of any s // 4 + 1 units that the smaller set spends on its segments at least one
must match - a unit being a segment that is equal, and a second unit on a segment also covering one differing element
through one-deletion neighbourhoods. The smaller set chooses its units by cost: segments with many elements are
selective and cheap, a one-deletion neighbourhood costs a signature per element, an empty segment is the last resort.
Larger sets index all their segments, in their own band and in the one below it.

Equal sets are one class throughout, so copies are never paired. Members of a signature's group are tested against one
leader first; only where that leaves a group in several components, those of its members are tested that are in different
components and agree enough in what they differ in from the leader. Candidates are verified on exact sets rebuilt from
the texts.

Rows: null or empty text has an empty set, links with nothing and is its own component; a null doc_id has a null
component when it is alone. Ties do not arise: a component is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import connected
from .runtime import columns_or_null, materialize, maybe_broadcast, ship

U = np.uint64
WORDS = 5
#: Sets of fewer elements link only if they are equal.
LEAST = 4


def band_bounds(top: int = 1 << 31) -> np.ndarray:
    """Lower ends of the size bands. A set up to 1.25 times as large as another is in its band or the next."""
    out = [LEAST]
    while out[-1] < top:
        out.append(out[-1] * 8 // 5 + 1)
    return np.array(out, np.int64)


LOW = band_bounds()
HIGH = np.append(LOW[1:] - 1, 1 << 40)
#: Differing elements of a pair whose smaller set is in the band, and segments of the band with some to spare.
DIFFER = HIGH // 4
SEGMENTS = DIFFER + 1 + np.maximum(1, DIFFER // 8)
#: Segments with one-deletion neighbourhoods: all for short texts, a few for long ones.
DELETABLE = np.where(HIGH <= 48, SEGMENTS, 2)
PROBE, DELETED = 1, 2


def share_cost(k: np.ndarray) -> np.ndarray:
    """Expected candidates through an equal segment of k elements."""
    return 1000.0 * 0.25**k


def signatures(s: tk.Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and flags of all signatures of a block's sets."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    band = np.searchsorted(LOW, s.size, "right") - 1
    h = tk.mix(s.element, 21)
    place = tk.mix(s.element, 22) >> U(32)
    for below in (0, 1):
        role = band - below
        live = (s.size >= LEAST) & (role >= 0)
        if below:
            live &= 4 * s.size <= 5 * HIGH[np.maximum(role, 0)]
        docs = np.flatnonzero(live)
        if not len(docs):
            continue
        m = np.where(live, SEGMENTS[role], 0)
        base = np.concatenate(([0], np.cumsum(m)))
        own = live[s.doc]
        d, e, at = s.doc[own], h[own], place[own]
        seg = ((at * m[d].astype(U)) >> U(32)).astype(np.int64)
        cell, cells = base[d] + seg, int(base[-1])
        k = np.bincount(cell, minlength=cells)
        total = tk.sum_by(cell, e, cells)
        cell_doc = np.repeat(np.arange(len(m)), m)
        cell_seg = np.arange(cells) - base[cell_doc]
        cell_role = role[cell_doc]
        salt = tk.mix((cell_role.astype(U) << U(40)) | cell_seg.astype(U), 23)
        deletable = (cell_seg < DELETABLE[cell_role]) & (k > 0)
        first, second = np.zeros(cells, bool), np.zeros(cells, bool)
        if not below:
            cost = np.where(k > 0, 1 + share_cost(k), 1e9)
            more = np.flatnonzero(deletable)
            cost = np.concatenate((cost, k[more] * (1 + share_cost(k[more] - 1)) + 1e-3))
            item = np.concatenate((np.arange(cells), more))
            of = cell_doc[item]
            order = np.lexsort((cost, of))
            starts = np.searchsorted(of[order], np.arange(len(m)))
            taken = order[np.arange(len(order)) - starts[of[order]] < s.size[of[order]] // 4 + 1]
            first[taken[taken < cells]] = True
            second[more[taken[taken >= cells] - cells]] = True
        with np.errstate(over="ignore"):
            out.append((tk.mix(total + salt, 24), cell_doc, first.astype(U) * U(PROBE)))
            less = deletable[cell]
            c = cell[less]
            out.append((tk.mix(total[c] - e[less] + salt[c], 24), cell_doc[c], U(DELETED) + second[c].astype(U) * U(PROBE)))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fingerprints(s: tk.Sets) -> tuple[np.ndarray, np.ndarray]:
    n = len(s.size)
    return tuple(tk.sum_by(s.doc, tk.mix(s.element, k), n).view(np.int64) for k in (11, 12))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit fingerprint (f1, f2) of each text's set; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fs, gs = [], [], []
            for b in tk.blocks(batch.column("text")):
                s = tk.shingle_sets(b, WORDS)
                f, g = fingerprints(s)
                sizes.append(s.size), fs.append(f), gs.append(g)
            cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(cat(sizes)), pa.array(cat(fs)), pa.array(cat(gs))], ["doc_id", "n_shingles", "f1", "f2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long")


#: Elements of sets whose signatures one bucket has, about: buckets grow in number with the input, not in size.
BUCKET_ELEMENTS = 8_000_000
#: Fingerprints of sets that a task remembers, to leave out copies early; the signatures' groups see to the rest.
SEEN = 1_000_000


def signature_groups(docs: DataFrame, elements: int) -> DataFrame:
    """Groups of two or more classes with a signature in common: key, f1, flags and the group's size. elements: of all sets."""
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), elements // BUCKET_ELEMENTS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed signatures (48 bits of key, 12 of document, 4 of flags) dealt to buckets, some thousand documents at a time."""
        seen: set[int] = set()
        held: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        docs = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, sets, docs, rows
            if rows:
                key, entry = (np.concatenate([x[k] for x in held]) for k in (0, 1))
                own = ((key >> U(32)) * U(buckets)) >> U(32)
                order = np.argsort(own.astype(np.uint16) if buckets <= 1 << 16 else own, kind="stable")
                own, entry = own[order], entry[order]
                cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
                known = np.concatenate(sets)
                for lo in range(0, len(cut) - 1, 256):
                    part = range(lo, min(lo + 256, len(cut) - 1))
                    found, names = [], []
                    for i in part:  # a bucket's entries number the documents it has
                        e = entry[cut[i] : cut[i + 1]]
                        here, at = np.unique((e >> U(4)) & U(4095), return_inverse=True)
                        found.append(((e & ~U(4095 << 4)) | (at.astype(U) << U(4))).tobytes())
                        names.append(known[here.astype(np.int64)].tobytes())
                    yield pa.record_batch([pa.array([int(own[cut[i]]) for i in part], pa.int64()), pa.array(found, pa.binary()), pa.array(names, pa.binary())], ["bucket", "entries", "sets"])
            held, sets, docs, rows = [], [], 0, 0

        for batch in batches:
            for b in tk.blocks(batch.column("text"), tk.BLOCK_BYTES // 2):
                s = tk.shingle_sets(b, WORDS)
                f, _ = fingerprints(s)
                fresh = np.array([x not in seen and not seen.add(x) for x in f.tolist()], bool) & (s.size >= LEAST)
                key, doc, flags = signatures(tk.Sets(s.doc, s.element, np.where(fresh, s.size, 0)))
                if len(seen) > SEEN:
                    seen.clear()
                if docs + len(f) >= tk.BLOCK_DOCS or rows + len(key) > 1_000_000:
                    yield from flush()
                held.append((key, ((key & U((1 << 48) - 1)) << U(16)) | ((doc + docs).astype(U) << U(4)) | flags))
                sets.append(f)
                docs, rows = docs + len(f), rows + len(key)
        yield from flush()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        entries = [np.frombuffer(x.as_buffer(), U) for x in table.column("entries")]
        ids = [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sets")]
        f = np.concatenate([i[((e >> U(4)) & U(4095)).astype(np.int64)] for e, i in zip(entries, ids, strict=True)])
        e = np.concatenate(entries)
        flags, k = (e & U(15)).astype(np.int64), e >> U(16)
        order = np.argsort(k)
        k = k[order]
        same = k[1:] == k[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        k, f, flags = k[many], f[order][many], flags[order][many]
        order = np.lexsort((f, k))
        k, f, flags = k[order], f[order], flags[order]
        keep = np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])))[: len(k)]
        k, f, flags = k[keep], f[keep], flags[keep]
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[: len(k)])
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
        size = np.bincount(run, minlength=len(start))
        good = (size > 1) & (np.bincount(run, flags & PROBE, len(start)) > 0) & (np.bincount(run, (flags & DELETED) == 0, len(start)) > 0)
        # groups of the same members with the same flags say the same
        with np.errstate(over="ignore"):
            whole = tk.sum_by(run, tk.mix(f.view(U) + flags.astype(U), 31), len(start))
        first = np.zeros(len(start), bool)
        first[np.unique(np.where(good, whole, U(0)), return_index=True)[1]] = True
        live = (good & first)[run]
        k, f, flags, run = k[live], f[live], flags[live], run[live]
        return pa.table({"key": k.view(np.int64), "f1": f, "size": size[run], "flags": flags})

    dealt = docs.select("text").mapInArrow(deal, "bucket long, entries binary, sets binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "key long, f1 long, size long, flags long")


#: Members that are tested against one copy of their leader's text.
CHUNK = 64


def beside_leaders(docs: DataFrame, pairs: DataFrame, act: Callable, schema: str) -> DataFrame:
    """act(a, own, b, lead) of the exact sets of each of the distinct pairs (a, b) of doc_ids; what it returns becomes a row,
    None does not. b's text goes to every CHUNK pairs of b."""
    chunks = F.ceil(F.count(F.lit(1)) / CHUNK).cast("long")
    shares = pairs.groupBy("b").agg(chunks.alias("shares"))
    dealt = pairs.join(shares, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).alias("chunk"))
    roles = materialize(
        dealt.select(F.col("a").alias("doc_id"), "b", "chunk", F.lit(1).alias("member")).unionByName(dealt.select(F.col("b").alias("doc_id"), "b", "chunk", F.lit(0).alias("member")).distinct()),
        "roles",
    )
    texts = docs.select("doc_id", "text").join(maybe_broadcast(roles), "doc_id")
    near = texts.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "member")
    fields = pa.schema([(name, {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[kind]) for name, kind in (x.rsplit(" ", 1) for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, U)
        for batch in batches:
            member, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("member", "doc_id", "b"))
            for block in tk.blocks(batch.column("text")):
                s = tk.shingle_sets(block, WORDS)
                ends = np.concatenate(([0], np.cumsum(s.size)))
                out = []
                for i in range(len(s.size)):
                    own, row = s.element[ends[i] : ends[i + 1]], block.first + i
                    if member[row] == 0:
                        lead = own
                    elif (found := act(a[row], own, b[row], lead)) is not None:
                        out.append(found)
                columns = list(zip(*out, strict=True)) or [()] * len(fields)
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    return near.select("doc_id", "b", "member", "text").mapInArrow(run, schema)


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of doc_ids that link, by their exact sets."""

    def links(a: int, own: np.ndarray, b: int, lead: np.ndarray) -> tuple | None:
        both = np.concatenate((lead, own))
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return (a, b) if 100 * common >= 80 * (len(lead) + len(own) - common) else None

    return beside_leaders(docs, pairs, links, "a long, b long")


def differences(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, linked (1 if so), n_lead, weight and differ: what of leader b's set a lacks (even codes) and what a has besides
    (odd codes)."""

    def apart(a: int, own: np.ndarray, b: int, lead: np.ndarray) -> tuple:
        lacks, more = np.setdiff1d(lead, own, assume_unique=True), np.setdiff1d(own, lead, assume_unique=True)
        linked = 9 * (len(lead) - len(lacks)) >= 4 * (len(lead) + len(own))
        return a, b, int(linked), len(lead), 4 * len(own) + 9 * len(lacks), np.concatenate((2 * lacks, 2 * more + U(1))).view(np.int64)

    return beside_leaders(docs, pairs, apart, "a long, b long, linked long, n_lead long, weight long, differ array<long>")


def hubs(members: DataFrame, links: DataFrame) -> DataFrame:
    """lead and its hub: of the leader and the leaders that link with it, the one with the most members. So a cluster's
    members have few leaders, all much like it."""
    sizes = members.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(sizes.select(F.col("lead").alias("a"), F.col("lead").alias("b")))
    best = near.join(sizes.select(F.col("lead").alias("b"), "n"), "b").groupBy("a").agg(F.max(F.struct("n", "b")).alias("best"))
    return best.select(F.col("a").alias("lead"), F.col("best.b").alias("hub"))


NEED = "greatest(1, ceil((weight + {other} - 9 * n_lead) / 9))"


def within_reach_of_some(rows: DataFrame, own: str, reach: str, low: str) -> DataFrame:
    """Members that may have a partner under their leader: one whose own is within the member's reach, the member's own being
    within the partner's; low is the least own of such partners. Partners are looked up by classes of their reach."""
    own, reach = F.expr(own), F.expr(reach)
    classes = rows.groupBy("b", F.floor(8 * F.log2(F.greatest(reach, F.lit(1)))).alias("class")).agg(F.max(reach).alias("reach"), F.min(own).alias("any"), F.min(F.when(F.col("outside"), own)).alias("out"))
    lists = classes.groupBy("b").agg(F.collect_list(F.struct("reach", "any", "out")).alias("classes"))  # some dozens at most
    least = F.array_min(F.transform(F.filter("classes", lambda c: c["reach"] >= own), lambda c: F.when(F.col("outside"), c["any"]).otherwise(c["out"])))
    return rows.drop(low).join(lists, "b").withColumn(low, least).drop("classes").where(F.col(low).isNotNull() & (F.col(low) <= reach))


def bounded(rows: DataFrame) -> DataFrame:
    """Members that a link may still reach by the number of their differences, d of them and besides of these in addition to
    the leader's elements. A link of x and y asks for 9 |M_x & M_y| + 9 |E_x & E_y| >= 4 |x| + 9 |M_x| + 4 |y| + 9 |M_y| - 9 |L|
    (see agreeing). As M_x & M_y is within M_y, 4 |y| is at most 9 (|L| + |E_x|) - weight_x; and weight_y is at most
    9 (|L| + d_x) - weight_x. Both hold with x and y exchanged."""
    rows = rows.withColumn("d", F.size("differ").cast("long")).withColumn("besides", F.expr("d - (weight - 4 * n_shingles) div 9")).where("d > 0")
    rows = within_reach_of_some(rows, "4 * n_shingles", "9 * (n_lead + besides) - weight", "least_size")
    return materialize(within_reach_of_some(rows, "weight", "9 * (n_lead + d) - weight", "low").drop("least_size"), "bounded")


def agreeing(differing: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of members of one leader and different components, by what they differ in from the leader.

    With M_x = L - x and E_x = x - L, |x & y| = |L| - |M_x| - |M_y| + |M_x & M_y| + |E_x & E_y|. So a link, 9 |x & y| >= 4 (|x| + |y|),
    asks that the differences have at least (weight_x + weight_y) / 9 - |L| elements in common, where weight_x = 4 |x| + 9 |M_x|.
    If that is no more than 0, both link with the leader. Else both have a common element among the rarest of their
    differences (prefix filter): the lighter one among few of them, as its partner is heavier."""
    rows = members.withColumnsRenamed({"rep": "a", "lead": "b"}).join(differing, ["a", "b"]).withColumn("component", F.expr("if(linked = 1, l_component, component)")).withColumn("outside", F.col("component") != F.col("l_component"))
    need = lambda other: F.expr(NEED.format(other=other))
    rows = bounded(rows.select("a", "b", "n_lead", "weight", "n_shingles", "component", "outside", "differ"))
    # elements of one component's members alone are in no common part of a pair; what members have besides goes first, by halves:
    # copies with edits of their own have nothing left in common then, and drop out before their lacks are looked at
    seen = lambda x: x.groupBy("b", "e").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("b", "e", "n")
    for half in (1, 3):
        some = materialize(rows.select("a", "b", "component", F.explode(F.filter("differ", lambda e: e.bitwiseAND(F.lit(3)) == half)).alias("e")), "half")
        common = some.join(seen(some).drop("n"), ["b", "e"]).groupBy("a", "b").agg(F.collect_list("e").alias("common"))  # at most a set
        left = F.concat(F.filter("differ", lambda e: e.bitwiseAND(F.lit(3)) != half), F.coalesce("common", F.array().cast("array<long>")))
        rows = bounded(rows.join(common, ["a", "b"], "left").withColumn("differ", left).drop("common"))
    rows = rows.drop("d", "outside", "besides")
    elements = materialize(rows.select("a", "b", "component", F.explode("differ").alias("e")), "differing")
    counts = seen(elements)
    elements = elements.drop("component")
    own = Window.partitionBy("a", "b")
    ranked = elements.join(counts, ["b", "e"]).withColumn("at", F.row_number().over(own.orderBy("n", "e"))).withColumn("d", F.count(F.lit(1)).over(own))
    placed = ranked.join(maybe_broadcast(rows.drop("differ")), ["a", "b"])
    light = F.col("at") <= F.col("d") - need("greatest(weight, low)") + 1
    heavy = (F.col("low") <= F.col("weight")) & (F.col("at") <= F.col("d") - need("low") + 1)
    placed = materialize(placed.withColumn("light", light).withColumn("heavy", heavy).where("light or heavy").drop("low", "n"), "prefixes")
    x, y = (placed.where(role).select("b", "e", *[F.col(c).alias(f"{p}_{c}") for c in ("a", "component", "n_shingles", "weight", "at", "d")], *(["n_lead"] if p == "x" else [])) for p, role in (("x", "light"), ("y", "heavy")))
    cross = x.join(y, ["b", "e"]).where(
        "x_component <> y_component and (x_weight < y_weight or x_weight = y_weight and x_a < y_a) and 5 * least(x_n_shingles, y_n_shingles) >= 4 * greatest(x_n_shingles, y_n_shingles)"
        " and 9 * (1 + least(x_d - x_at, y_d - y_at)) >= x_weight + y_weight - 9 * n_lead and x_weight + y_weight > 9 * n_lead"
    )
    return cross.select(F.least("x_a", "y_a").alias("a"), F.greatest("x_a", "y_a").alias("b")).distinct()


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, classes (f1, f2, n_shingles, rep: the smallest doc_id) and verified links (a, b) between classes' reps
    that connect all of each component's classes."""
    ship(docs.sparkSession)
    docs = columns_or_null(docs, doc_id="long", text="string")
    known = materialize(profiles(docs), "profiles")
    classes = materialize(known.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    elements = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    groups = materialize(signature_groups(docs.where("doc_id is not null"), elements), "groups")
    side = lambda name: classes.select(F.col("f1").alias(name), F.col("rep").alias(f"{name}_rep"), F.col("n_shingles").alias(f"{name}_n"))
    # first each group's members with its leader, the one with most company in all groups: groups of one cluster have the same
    company = materialize(groups.groupBy("f1").agg(F.sum("size").alias("company")), "company")
    ranked = groups.select("key", "f1").join(maybe_broadcast(company), "f1")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("company", "f1")).alias("leader")).select("key", F.col("leader.f1").alias("leader"))
    near = ranked.join(leaders, "key").where("f1 <> leader").select(F.col("f1").alias("x"), F.col("leader").alias("y")).distinct()
    near = near.join(side("x"), "x").join(side("y"), "y").where("x_rep <> y_rep and 5 * least(x_n, y_n) >= 4 * greatest(x_n, y_n)")
    tested = materialize(near.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).distinct(), "pairs")
    links = materialize(verify(docs, tested), "links")
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    parts = connected(links)
    own = classes.select("f1", "rep", "n_shingles").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    rest = materialize(torn(groups.join(own, "f1").select("key", "rep", "n_shingles", "component", "flags")), "torn")
    # a set's elements that no other of these has are in no intersection: what is left bounds every intersection
    for _ in range(2):
        rest = materialize(torn(within_reach(rest, shared_sizes(docs, rest))), "torn")
    by_leader = leaders.join(side("leader"), "leader").join(own.select(F.col("f1").alias("leader"), F.col("component").alias("l_component")), "leader").select("key", F.col("leader_rep").alias("lead"), "l_component")
    members = materialize(rest.join(by_leader, "key").select("rep", "lead", "n_shingles", "component", "l_component").distinct(), "members")
    members = members.join(hubs(members, links), "lead").drop("lead").withColumnRenamed("hub", "lead").where("rep <> lead").distinct()
    members = materialize(members, "members")
    differing = materialize(differences(docs, members.select(F.col("rep").alias("a"), F.col("lead").alias("b"))), "differences")
    fresh = materialize(agreeing(differing, members).join(done, ["a", "b"], "left_anti"), "pairs")
    more = [differing.where("linked = 1").select("a", "b")] + ([] if fresh.isEmpty() else [verify(docs, fresh)])
    return known, classes, materialize(reduce(DataFrame.unionByName, more, links), "links")


def torn(groups: DataFrame) -> DataFrame:
    """Members of the groups that several components share."""
    keys = groups.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return groups.join(keys, "key", "left_semi")


def shared_sizes(docs: DataFrame, members: DataFrame) -> DataFrame:
    """rep and the number of its set's elements that another of these members has too."""
    reps = materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "members")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for b in tk.blocks(batch.column("text")):
                s = tk.shingle_sets(b, WORDS)
                yield pa.record_batch([pa.array(ids[b.first + s.doc]), pa.array(s.element.view(np.int64))], ["rep", "element"])

    rows = docs.join(maybe_broadcast(reps), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(elements, "rep long, element long")
    alone = rows.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    return reps.select(F.col("doc_id").alias("rep")).join(alone, "rep", "left").select("rep", F.coalesce("alone", F.lit(0)).alias("alone"))


def within_reach(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members that may still link with some member of their group, by the size of the group's smallest set: a link needs
    9 |intersection| >= 4 (|x| + |y|)."""
    known = groups.drop("shared").join(sizes, "rep").withColumn("shared", F.col("n_shingles") - F.col("alone")).drop("alone")
    least = known.groupBy("key").agg(F.min("n_shingles").alias("least"))
    return known.join(least, "key").where("5 * shared >= 4 * n_shingles and 9 * shared >= 4 * (n_shingles + greatest(least, 4 * n_shingles / 5))").drop("least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every document."""
    known, classes, links = jaccard_links(docs)
    parts = connected(links)
    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    full = known.where("n_shingles > 0").join(named, ["f1", "f2", "n_shingles"], "left").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(known.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
