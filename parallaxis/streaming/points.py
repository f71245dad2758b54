"""Point files as they arrive: voxel counts and newly occupied voxels, kept as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import voxels
from ..operators.filters import in_bounds

POINTS = "x double, y double, z double"


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Points of the JSON lines that are put into a folder."""
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def counts(points: DataFrame, r: int) -> DataFrame:
    """Points per voxel so far; the state is one number per occupied voxel, r**3 at most."""
    return voxels.counts(points, r)


def newly_occupied(points: DataFrame, r: int) -> DataFrame:
    """Each voxel once, when its first point comes; the state is the occupied voxels, r**3 at most."""
    r = voxels.resolution(r)
    at = [voxels.index(F.col(p), r).alias(n) for p, n in zip("xyz", voxels.IJK, strict=True)]
    return in_bounds(points).select(*at).dropDuplicates(list(voxels.IJK))
