"""Vectors and matrices as tuples of columns, so that every product stays inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def lit3(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def cols(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, s) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda p, q: p + q, [x * y for x, y in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, eps: float = 0.0) -> Vec:
    n = norm(a) + eps
    return tuple(F.when(n > 0, x / F.nullif(n, F.lit(0.0))).otherwise(F.lit(0.0)) for x in a)


def angle_deg(a: Vec, b: Vec) -> Column:
    """Angle between unit vectors, in degrees."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def matrix(column: str, size: int = 4) -> list[list[Column]]:
    """Entries of a row-major matrix kept as an array."""
    return [[F.col(column)[size * i + j] for j in range(size)] for i in range(size)]


def apply(m: list[list[Column]], v: Vec, translate: bool = True) -> Vec:
    return tuple(dot(tuple(m[i][:3]), v) + (m[i][3] if translate else F.lit(0.0)) for i in range(3))


def flat(m: list[list[Column]]) -> Column:
    return F.array(*[x for row in m for x in row])
