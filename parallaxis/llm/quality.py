"""Cross-document line frequency as a quality rule.

Each text's lines are normalised (A-Z lower-cased, words joined by single blanks) and hashed; every host counts in how
many of its documents of distinct texts a line stands (copies of a text are one document: they are no sign of
boilerplate, and another operator's work). Lines above the limit - more documents than `least_docs`, a few that keep chance
repeats of small hosts, and than `share` of the host's documents, which decides from 1000 documents on - are removed from
all of them, and a document that keeps less than `left` percent of its words is depleted and rejected, as is one that
fails the base rules. `judge` gives the decisions, `clean` the kept texts without the removed lines; line breaks and lines
without a word stay as they are.

Rows: texts are told apart by 64-bit hashes. Null text has no words and fails the base rules. A null host is a host. Rows with a null doc_id are counted and
judged too. Repeated rows are documents of their own. An empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import BROADCAST_ROWS, columns_or_null, materialize, maybe_broadcast, ship

U = np.uint64
SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def worded_lines(b: tk.Block, w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, start and end of all lines that have a word: from the break (or text's start) before it to the next."""
    breaks = np.flatnonzero(b.data == 10)
    edge = np.concatenate((b.bounds, breaks, breaks + 1))
    edge.sort()
    line_of = np.searchsorted(edge, w.start, "right")
    if len(line_of):
        head = np.flatnonzero(np.concatenate(([True], line_of[1:] != line_of[:-1])))
    else:
        head = np.zeros(0, np.int64)
    return head, edge[line_of[head] - 1], edge[np.minimum(line_of[head], len(edge) - 1)]


def line_hash(low: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each normalised line: its lower-cased words in order."""
    with np.errstate(over="ignore"):
        place = np.arange(len(low)) - np.repeat(head, size)
        up, _ = tk.powers(max(len(low), 1))
        line = tk.mix(np.add.reduceat(low * up[place], head) + size.astype(U), 41) if len(head) else np.zeros(0, U)
    return line.view(np.int64)


def base_counts(b: tk.Block) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The base columns of a block's texts, and document, normalised hash and words of all lines that have a word."""
    docs = len(b.bounds) - 1
    w = tk.words(b, lower=False)
    total = lambda mask, at: np.bincount(at, mask, docs).astype(np.int64)
    first_byte = (b.data & 0xC0) != 0x80  # one per code point
    points = np.concatenate(([0], np.cumsum(first_byte)))
    n_words = np.bincount(w.doc, minlength=docs)
    word_chars = total(points[w.end] - points[w.start], w.doc)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[b.data])))
    n_symbols = symbols[b.bounds[1:]] - symbols[b.bounds[:-1]]
    # words in three-word windows that come twice or more in the text
    at, h = tk.windows(w, 3)
    order = np.lexsort((h, w.doc[at]))
    d, h = w.doc[at][order], h[order]
    same = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    again = at[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]] if len(order) else at
    covered = np.zeros(len(w.hash) + 2, bool)
    for k in range(3):
        covered[again + k] = True
    n_repeat = total(covered[: len(w.hash)], w.doc)
    head, start, end = worded_lines(b, w)
    doc, size = w.doc[head], np.diff(np.append(head, len(w.start)))
    raw = tk.spans_hash(b, start, end)
    order = np.lexsort((raw, doc))
    dup = np.concatenate(([False], (raw[order][1:] == raw[order][:-1]) & (doc[order][1:] == doc[order][:-1]))) if len(order) else np.zeros(0, bool)
    n_dup = np.bincount(doc[order], dup, docs).astype(np.int64)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat], doc, line_hash(tk.words(b, lower=True).hash, head, size), size


def count_lines(docs: DataFrame) -> DataFrame:
    """One row per document: base columns, and its distinct normalised lines with their words; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: list[list[np.ndarray]] = [[] for _ in range(5)]
            starts, lines, sizes, at = [], [], [], 0
            for b in tk.blocks(batch.column("text")):
                counts, doc, line, size = base_counts(b)
                for held, c in zip(base, counts, strict=True):
                    held.append(c)
                order = np.lexsort((line, doc))
                doc, line, size = doc[order], line[order], size[order]
                head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]))))[: len(doc)]
                if len(doc):
                    doc, line, size = doc[head], line[head], np.add.reduceat(size, head)
                starts.append(at + np.searchsorted(doc, np.arange(len(counts[0]))))
                at += len(doc)
                lines.append(line), sizes.append(size)
            cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
            offsets = pa.array(np.append(cat(starts), at).astype(np.int32))
            yield pa.record_batch(
                [batch.column(c) for c in ("row", "doc_id", "text_key", "key", "print", "host")] + [*(pa.array(cat(c)) for c in base), pa.ListArray.from_arrays(offsets, pa.array(cat(lines))), pa.ListArray.from_arrays(offsets, pa.array(cat(sizes)))],
                ["row", "doc_id", "text_key", "key", "print", "host", *(x.split()[0] for x in BASE.split(", ")), "lines", "sizes"],
            )

    return docs.select("row", "doc_id", "text_key", "key", "print", "host", "text").mapInArrow(run, f"row long, doc_id long, text_key long, key long, print long, host string, {BASE}, lines array<long>, sizes array<long>")


def row_key(host: str, have: list[str]) -> Column:
    """Rows that agree in it (in doc_id, text and host; null where the table lacks one) get the same decisions and lose the same
    lines."""
    own = lambda c, kind: (F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind)
    return F.xxhash64(own("doc_id", "long"), own("text", "string"), own(host, "string").isNull(), own(host, "string"))


def free_name(name: str, taken: list[str]) -> str:
    """The name, lengthened until the table has no such column."""
    while name in {c.lower() for c in taken}:
        name += "_"
    return name


def decide(docs: DataFrame, host: str = "source", least_docs: int = 5, share: float = 0.005, left: int = 30, least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """`judge`'s columns, and of each row its key and the hashes of the lines it loses (null for none)."""
    ship(docs.sparkSession)
    slim = columns_or_null(docs, doc_id="long", text="string", **{host: "string"}).select("doc_id", "text", F.col(host).alias("host"), F.xxhash64("doc_id", "text").alias("text_key"), row_key(host, ["doc_id", "text", host]).alias("key"), F.xxhash64("text").alias("print"), F.monotonically_increasing_id().alias("row"))
    base = materialize(count_lines(slim), "lines")
    lines = base.select("row", "print", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("row", "print", "host", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    hosts = base.groupBy("host").agg(F.greatest(F.lit(least_docs).cast("double"), F.count_distinct("print") * F.lit(share)).alias("most"))
    counted = lines.groupBy("host", "line").agg(F.count_distinct("print").alias("docs")).where(F.col("docs") > least_docs)
    common = materialize(counted.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where("docs > most").select("host", "line"), "common-lines")
    named = maybe_broadcast(common.withColumnsRenamed({"host": "h", "line": "l"}))
    gone = lines.join(named, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
    removed = gone.groupBy("row").agg(F.sum("size").alias("removed_words"), F.collect_list("line").alias("gone"))
    out = base.drop("lines", "sizes", "print", "host").join(removed, "row", "left").drop("row").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("removed_words")) >= left * F.col("n_words")))


def judge(docs: DataFrame, **rules) -> DataFrame:
    """doc_id, text_key (a hash of doc_id and text), base columns, removed_words, base_failed and kept of every document."""
    return decide(docs, **rules).drop("key", "gone")


def without_lines(texts: pa.Array, gone: list[np.ndarray]) -> list[str]:
    """The texts without the lines whose hashes are given for each."""
    out = []
    for b in tk.blocks(texts):
        w = tk.words(b, lower=True)
        head, start, _ = worded_lines(b, w)
        line = line_hash(w.hash, head, np.diff(np.append(head, len(w.hash))))
        breaks = np.flatnonzero(b.data == 10)
        place = np.searchsorted(breaks, start) - np.searchsorted(breaks, b.bounds[w.doc[head]])
        first = np.searchsorted(w.doc[head], np.arange(len(b.bounds)))
        for k in range(len(b.bounds) - 1):
            at = slice(first[k], first[k + 1])
            drop = set(place[at][np.isin(line[at], gone[b.first + k])].tolist())
            parts = b.data[b.bounds[k] : b.bounds[k + 1]].tobytes().decode().split("\n")
            out.append("\n".join(x for i, x in enumerate(parts) if i not in drop))
    return out


def rebuild(docs: DataFrame, decided: DataFrame, host: str = "source", key: str = "key") -> DataFrame:
    """The kept rows of docs, all columns, with a key of this name (docs has no such column), their texts without the lines that
    `decide` removes. Without a text column no row is kept."""
    if "text" not in docs.columns:
        return docs.withColumn(key, F.lit(None).cast("long")).where("false")
    gone_lines, verdict = free_name("gone", docs.columns), free_name("kept", docs.columns)
    verdicts = decided.where("not kept or gone is not null")
    verdicts = materialize(verdicts.groupBy("key").agg(F.first("kept").alias(verdict), F.first(F.when(F.col("kept"), F.col("gone"))).alias(gone_lines)).withColumnRenamed("key", key), "verdicts")
    longs = verdicts.agg(F.coalesce(F.sum(2 + F.greatest(F.size(gone_lines), F.lit(0))), F.lit(0))).first()[0]
    marked = docs.withColumn("text", F.col("text").cast("string")).withColumn(key, row_key(host, docs.columns))
    marked = marked.join(F.broadcast(verdicts) if longs <= BROADCAST_ROWS else verdicts, key, "left").where(F.coalesce(verdict, F.lit(True)))
    columns = [*docs.columns, key]
    quoted = [f"`{c}`" for c in columns]
    text_at, gone_at = columns.index("text"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(text_at), batch.column(gone_at)
            at = np.flatnonzero(gone.is_valid())
            if len(at):
                held = gone.take(pa.array(at))
                hashes = np.split(held.flatten().to_numpy(zero_copy_only=False), np.cumsum(held.value_lengths())[:-1])
                new = without_lines(texts.take(pa.array(at)), hashes)
                rows = np.arange(len(texts))
                rows[at] = len(texts) + np.arange(len(at))
                texts = pa.concat_arrays([texts, pa.array(new, texts.type)]).take(pa.array(rows))
            yield pa.record_batch([texts if i == text_at else batch.column(i) for i in range(len(columns))], columns)

    return marked.select(*quoted, gone_lines).mapInArrow(run, marked.select(*quoted).schema)


def clean(docs: DataFrame, host: str = "source", **rules) -> DataFrame:
    """The kept rows of docs, all columns whatever their names, their texts without the removed lines. A table without the host
    column is one host."""
    key = free_name("key", docs.columns)
    return rebuild(docs, decide(docs, host, **rules), host, key).drop(key)
