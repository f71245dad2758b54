"""Streams of points against the same points at once."""

import random

from parallaxis.operators import voxels
from parallaxis.streaming import points


def run(query, folder, mode):
    sink = query.writeStream.format("memory").queryName(f"q{random.randrange(10**9)}").outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    sink.awaitTermination(120)
    return query.sparkSession.table(sink.name)


def test_counts_and_new_voxels(spark, tmp_path):
    rng = random.Random(1)
    rows = [tuple(rng.uniform(-0.6, 0.6) for _ in range(3)) for _ in range(300)] + [(None, 0.0, 0.0)]
    whole = spark.createDataFrame(rows, points.POINTS)
    for k in range(3):
        spark.createDataFrame(rows[k::3], points.POINTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    want = {tuple(r) for r in voxels.counts(whole, 4).collect()}
    stream = lambda: points.read(spark, str(tmp_path / "in"), 1)
    counted = run(points.counts(stream(), 4), str(tmp_path / "a"), "complete")
    assert {tuple(r) for r in counted.collect()} == want
    fresh = run(points.newly_occupied(stream(), 4), str(tmp_path / "b"), "append")
    got = [tuple(r) for r in fresh.collect()]
    assert len(got) == len(set(got)) and set(got) == {r[:3] for r in want}
