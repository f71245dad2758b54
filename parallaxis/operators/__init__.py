from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cameras, transforms and other side tables up to this many rows are broadcast; larger ones are left to a shuffle.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast a side table after a check of its size."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df
