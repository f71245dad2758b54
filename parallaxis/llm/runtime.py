"""Session plumbing shared by the operators: code shipping, shared-folder tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}
_leaving: set[str] = set()


#: Rows of an Arrow batch at most: rows are whole documents, and every task holds a few batches on both sides.
ARROW_ROWS = 2000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so tasks import it wherever they run, and keep the session's
    Arrow batches to ARROW_ROWS rows (smaller ones stay as they are set)."""
    if not 0 < int(spark.conf.get(_ROWS_KEY)) <= ARROW_ROWS:
        spark.conf.set(_ROWS_KEY, ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-code-")) / f"{package.name}_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh local one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A place in this application's part of the shared folder, which is removed when its driver's JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _leaving:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _leaving.add(path)
    return f"{path}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few longs each (some tens of MB) up to which a side is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialised narrow table only if it has at most `limit` rows, else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def held_out(doc_id) -> "F.Column":
    """Rows whose labels no operator may learn from: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def columns_or_null(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types; a missing one is null. Other columns never take part."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
