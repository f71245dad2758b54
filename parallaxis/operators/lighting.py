"""Light from an environment: a raster of all directions, its nine spherical harmonics, and surfaces lit by them."""

from __future__ import annotations

from functools import reduce
from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as v
from . import small
from .raster import sample_bilinear

RGB = ("r", "g", "b")
#: What the cosine lobe leaves of each harmonic, and an approximation of the environment's reflection by
#: roughness and view angle.
LOBE = (pi, 2 * pi / 3, 2 * pi / 3, 2 * pi / 3, pi / 4, pi / 4, pi / 4, pi / 4, pi / 4)
BRDF_SLOPE = (-1.0, -0.0275, -0.572, 0.022)
BRDF_START = (1.0, 0.0425, 1.04, -0.04)


def harmonics(d: v.Vec) -> list[Column]:
    """The nine real spherical harmonics up to the second band in a direction."""
    x, y, z = d
    even, first, second = sqrt(1 / (4 * pi)), sqrt(3 / (4 * pi)), sqrt(15 / (4 * pi))
    band = [second * x * y, second * y * z, second / sqrt(12) * (3 * z * z - 1), second * x * z, second / 2 * (x * x - y * y)]
    return [F.lit(even), *[first * a for a in (y, z, x)], *band]


def direction_of(row: Column, col: Column, width: int, height: int) -> v.Vec:
    """Direction of an environment pixel's centre: row 0 is up, the middle column straight ahead along -z."""
    up = (0.5 - (row + 0.5) / height) * pi
    around = ((col + 0.5) / width - 0.5) * 2 * pi
    return F.cos(up) * F.sin(around), F.sin(up), -F.cos(up) * F.cos(around)


def place_of(d: v.Vec) -> tuple[Column, Column]:
    """Texture place (u, v) of a direction in the environment, v upwards."""
    return 0.5 + F.atan2(d[0], -d[2]) / (2 * pi), 0.5 + F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d[1]))) / pi


def project_sh9(env: DataFrame, width: int, height: int) -> DataFrame:
    """(k, r, g, b): the environment's nine coefficients, sums over its pixels (row, col, r, g, b) by their solid angle; one
    aggregate, whatever its size."""
    d = direction_of(F.col("row"), F.col("col"), width, height)
    solid = (2 * pi / width) * (pi / height) * F.greatest(F.lit(0.0), F.cos((0.5 - (F.col("row") + 0.5) / height) * pi))
    sums = env.agg(*[F.sum(F.col(n) * y * solid).alias(f"{n}{k}") for k, y in enumerate(harmonics(d)) for n in RGB])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"{n}{k}").alias(n) for n in RGB]) for k in range(9)])
    return sums.select(F.explode(rows).alias("c")).select("c.*")


def with_irradiance(df: DataFrame, normal: tuple[str, str, str], coefficients: DataFrame) -> DataFrame:
    """Adds er, eg, eb: the light that falls on a surface with this unit normal, 0 at least."""
    flat = coefficients.groupBy().pivot("k", list(range(9))).agg(*[F.first(n).alias(n) for n in RGB])
    rows = df.join(F.broadcast(flat))  # one row
    y = harmonics(v.cols(*normal))
    light = {f"e{n}": F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, [LOBE[k] * y[k] * F.col(f"`{k}_{n}`") for k in range(9)])) for n in RGB}
    return rows.withColumns(light).select(*df.columns, *light)


def reflection(rough: Column, facing: Column) -> tuple[Column, Column]:
    """Scale and offset of the base reflectance by roughness and the cosine to the viewer."""
    r = [rough * a + b for a, b in zip(BRDF_SLOPE, BRDF_START, strict=True)]
    lobe = F.least(r[0] * r[0], F.pow(F.lit(2.0), -9.28 * facing)) * r[0] + r[1]
    return -1.04 * lobe + r[2], 1.04 * lobe + r[3]


def tone_map(x: Column) -> Column:
    """Filmic curve, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14)))


def shade_environment(pixels: DataFrame, coefficients: DataFrame, levels: list[tuple[DataFrame, int, int]], rough: float, metal: float, base: float | None = 0.3, exposure: float = 1.2) -> DataFrame:
    """Pixels (nx, ny, nz, the unit normal; vx, vy, vz, the unit direction to the viewer; with base None also ar, ag, ab, the linear
    albedo) with their colour r, g, b under an environment: diffuse light by its harmonics, mirrored light from the two of the
    levels, each blurred more than the one before (raster, width, height), that the roughness lies between."""
    keys = pixels.columns
    n, w = v.cols("nx", "ny", "nz"), v.cols("vx", "vy", "vz")
    facing = v.dot(n, w)
    rows = with_irradiance(pixels, ("nx", "ny", "nz"), coefficients)
    mirrored = v.unit(v.sub(v.scale(n, 2 * facing), w))
    rows = rows.withColumns({f"_{a}": x for a, x in zip("xyz", mirrored, strict=True)})
    u, t = place_of(v.cols("_x", "_y", "_z"))
    rows = rows.withColumns({"tu": u, "tv": t})
    at = rough * (len(levels) - 1)
    low = min(int(at), len(levels) - 1)
    high, share = min(low + 1, len(levels) - 1), at - int(at)
    for name, k in (("lo", low), ("hi", high)):
        env, width, height = levels[k]
        rows = sample_bilinear(rows, small(env.select("row", "col", *[F.col(c).alias(f"{name}{c}") for c in RGB])), width, height, [f"{name}{c}" for c in RGB])
    scale, offset = reflection(F.lit(float(rough)), F.greatest(F.lit(1e-4), F.least(F.lit(1.0), facing)))
    out = []
    for c in RGB:
        albedo = F.lit(float(base)) if base is not None else F.col(f"a{c}")
        diffuse = (1 - metal) * albedo * F.col(f"e{c}") / pi
        mirror = (F.col(f"lo{c}") * (1 - share) + F.col(f"hi{c}") * share) * ((0.04 * (1 - metal) + albedo * metal) * scale + offset)
        out.append(F.pow(tone_map((diffuse + mirror) * exposure), 1 / 2.2).alias(c))
    return rows.select(*keys, *out)
