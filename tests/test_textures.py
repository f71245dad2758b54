"""Textured rendering on a wall seen straight on, where every pixel's colour is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.operators import textures

from .test_scenes import cameras, pose


@pytest.fixture(scope="module")
def wall(spark):
    """A square of two triangles, 4 wide, before a camera 4 away; 64 x 48 pixels."""
    at = {0: (-2, -2), 1: (2, -2), 2: (2, 2), 3: (-2, 2)}
    rows = [(f, *vs, *[float(x) for i in vs for x in (*at[i], 0)]) for f, vs in ((5, (0, 1, 2)), (6, (0, 2, 3)))]
    t = spark.createDataFrame(rows, "face_id long, v0 long, v1 long, v2 long, " + ", ".join(f"{a}{m} double" for m in range(3) for a in "xyz"))
    return t, cameras(spark, [pose((0, 0, 4))]), at


def texture(spark, width=4, height=2):
    return spark.createDataFrame([(r, c, float(c), float(r), 1.0) for r in range(height) for c in range(width)], "row int, col int, r double, g double, b double"), width, height


def places(spark, triangles, at, shift=0.0):
    rows = [(r["face_id"], m, (at[r[f"v{m}"]][0] + 2) / 4 + shift * (r["face_id"] == 6), (at[r[f"v{m}"]][1] + 2) / 4) for r in triangles.collect() for m in range(3)]
    return spark.createDataFrame(rows, "face_id long, corner int, tu double, tv double")


def where_seen(pixels, camera):
    """World x and y of each pixel's centre on the wall."""
    f = camera["width"] / 2 / np.tan(np.radians(camera["fovx_deg"]) / 2)
    return [((p["col"] + 0.5 - camera["cx"]) * 4 / f, -(p["row"] + 0.5 - (camera["height"] - camera["cy"])) * 4 / f) for p in pixels]


def test_texture_over_a_wall_with_a_seam(spark, wall):
    t, cams, at = wall
    for shift in (0.0, 0.5):
        out = textures.render(t, cams, ["rgb"], places=places(spark, t, at, shift), texture=texture(spark), lights=None, wrap=("repeat", "clamp"))["rgb"].collect()
        spots = where_seen(out, cams.first())
        shown = 0
        for p, (x, y) in zip(out, spots, strict=True):
            if max(abs(x), abs(y)) > 1.999 or abs(x - y) < 0.01:
                continue
            shown += 1
            u = ((x + 2) / 4 + (shift if y > x else 0)) % 1 * 4 - 0.5
            w = np.clip((1 - (y + 2) / 4) * 2 - 0.5, 0, 1)
            k = int(np.floor(u))
            assert p["r"] == pytest.approx((k % 4) * (1 - (u - k)) + ((k + 1) % 4) * (u - k), abs=1e-6)
            assert p["g"] == pytest.approx(w, abs=1e-6) and p["b"] == pytest.approx(1)
        assert shown > 500


def test_kinds_from_one_rendering(spark, wall):
    t, cams, at = wall
    colors = spark.createDataFrame([(i, float(x), float(y), 0.5) for i, (x, y) in at.items()], "vid long, r double, g double, b double")
    out = textures.render(t, cams, textures.KINDS, colors=colors, texture=texture(spark), lights=(((0, 0, 1), 0.5),), ambient=0.25, background=0.125)
    assert set(out) == set(textures.KINDS) and all(df.count() == 64 * 48 for df in out.values())
    mask = {(p["row"], p["col"]): p["mask"] for p in out["mask"].collect()}
    for p, (x, y) in zip(rgb := out["rgb"].collect(), where_seen(rgb, cams.first()), strict=True):
        if mask[p["row"], p["col"]]:
            assert (p["r"], p["g"], p["b"]) == pytest.approx((0.75 * x, 0.75 * y, 0.375), abs=1e-6), "corner colours are its places, the wall faces the light"
        else:
            assert p["r"] == 0.125
    assert {(round(p["nx"]), round(p["ny"]), round(p["nz"])) for p in out["normal"].collect() if mask[p["row"], p["col"]]} == {(0, 0, 1)}
    assert {round(p["depth"], 6) for p in out["depth"].collect() if mask[p["row"], p["col"]]} == {4.0}
    assert {(round(p["r"], 6), round(p["g"], 6)) for p in out["matcap"].collect() if mask[p["row"], p["col"]]} == {(1.5, 0.5)}, "a normal at the viewer is the middle of the material"
    assert out["mask"].where("mask").count() == sum(mask.values()) > 0


def test_paint_missing_places_and_refusals(spark, wall):
    t, cams, at = wall
    painted = textures.render(t, cams, ["rgb"], paint=(0.1, 0.2, 0.3), lights=None)["rgb"].where("r < 0.5").select(F.round("g", 6).alias("g")).distinct().collect()
    assert [r["g"] for r in painted] == [0.2]
    some = places(spark, t, at).where("face_id = 5").withColumn("tu", F.when(F.col("corner") == 1, float("nan")).otherwise(F.col("tu")))
    half = textures.render(t, cams, ["rgb"], places=some, texture=texture(spark), lights=None, background=-1.0)["rgb"]
    assert 0 < half.where("r >= 0").count() < half.where("row >= 0").count() / 2 and half.where("r is null or isnan(r)").count() == 0
    with pytest.raises(ValueError):
        textures.render(t, cams, ["rgba"])
    with pytest.raises(ValueError):
        textures.render(t, cams, ["matcap"])
