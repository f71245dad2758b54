"""Token-id shards: a concatenated id array with Elias-Fano coded document boundaries.

Documents are range-partitioned and sorted by doc_id; each partition writes one shard, an array of unsigned 16- or
32-bit ids beside an index of two Elias-Fano sequences, the boundaries (n + 1 offsets) and the doc_ids. Shards are
named by task attempt and found through the manifest alone, so a repeated or lost task leaves at most an unused file.

Rows: null text counts as empty and has only the closing id. A row without doc_id has no place in the order and is not
written. Rows of one doc_id stand next to each other, ordered by their text's hash. An empty table has no shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, wordbpe
from .eliasfano import EliasFano
from .runtime import columns_or_null, fresh_path, materialize, ship

#: Bytes of text that a shard is made of, about: shards grow in number, not in size.
SHARD_BYTES = 256 << 20
MANIFEST = "shard long, documents long, ids long, width int, data string, index string"


def write(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Encode every whole text with the vocabulary file, write the shards, return their manifest (one row each) with the
    number of ids before each shard."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "token-shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = wordbpe.encoder(path), TaskContext.get()
        kind = np.dtype("<u2" if max(enc.largest, end_id) < 1 << 16 else "<u4")
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, doc_ids, sizes = None, [], []
        for b in batches:
            for at in range(0, b.num_rows, wordbpe.ROWS):
                part = b.slice(at, wordbpe.ROWS)
                out = out or files.create(f"{name}.ids")
                for ids in enc.encode_docs(part.column("text").fill_null("").to_pylist()):
                    own = np.append(np.frombuffer(ids, "<u4"), end_id).astype(kind)
                    out.write(own.tobytes())
                    sizes.append(len(own))
                doc_ids.append(part.column("doc_id").to_numpy())
        if out is None:
            return
        out.close()
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        with files.create(f"{name}.index") as f:
            f.write(EliasFano.build(bounds).to_bytes() + EliasFano.build(np.concatenate(doc_ids)).to_bytes())
        yield pa.record_batch([pa.array([v], k) for v, k in ((task.partitionId(), pa.int64()), (len(sizes), pa.int64()), (int(bounds[-1]), pa.int64()), (kind.itemsize, pa.int32()), (f"{name}.ids", pa.string()), (f"{name}.index", pa.string()))], [x.split()[0] for x in MANIFEST.split(", ")])

    docs = columns_or_null(docs, doc_id="long", text="string").where("doc_id is not null")
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = materialize(ordered.mapInArrow(run, MANIFEST), "manifest")
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    return shards.withColumn("ids_before", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document of the shards."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                index = files.read(r["index"])
                bounds, at = EliasFano.from_bytes(index)
                names, _ = EliasFano.from_bytes(index, at)
                with files.open_random(r["data"]) as f:
                    for lo in range(0, r["documents"], 1000):
                        hi = min(lo + 1000, r["documents"])
                        ends = bounds.select(lo, hi - lo + 1)
                        cut = ends - ends[0]
                        f.seek(int(ends[0]) * r["width"])
                        ids = np.frombuffer(f.read(int(cut[-1]) * r["width"]), f"<u{r['width']}").astype("<u4")
                        yield pa.record_batch([pa.array(names.select(lo, hi - lo)), pa.array(ends[:-1] + r["ids_before"]), pa.array([ids[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["doc_id", "start", "ids"])

    tasks = max(1, min(manifest.count(), 1 << 16))
    return manifest.repartition(tasks).mapInArrow(run, "doc_id long, start long, ids binary")
