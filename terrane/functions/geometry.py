"""Geometry as column expressions: everything stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def triple(*names: str) -> Triple:
    return tuple(F.col(n) for n in names)


def norm(v: Triple) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def distance(a: Triple, b: Triple) -> Column:
    return norm(tuple(x - y for x, y in zip(a, b, strict=True)))


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unsigned_angle(a: Triple, b: Triple) -> Column:
    """Degrees between two directions whatever their sign; 0 if either is zero."""
    size = norm(a) * norm(b)
    cosine = F.least(F.lit(1.0), F.abs(dot(a, b)) / size)
    return F.when(size > 0, F.degrees(F.acos(cosine))).otherwise(0.0)


def signed_score(a: Triple, b: Triple) -> Column:
    """Signed cosine clipped to 0..1; 0.5 if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / size))).otherwise(0.5)


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion of any length."""
    s = F.lit(2.0) / (w * w + x * x + y * y + z * z)
    return [
        [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)],
    ]


def into_frame(point: Triple, turn: Sequence[Sequence[Column]], place: Triple) -> Triple:
    """A point in the frame of a pose: the inverse rotation of what is left after its place."""
    d = [p - q for p, q in zip(point, place, strict=True)]
    return tuple(turn[0][k] * d[0] + turn[1][k] * d[1] + turn[2][k] * d[2] for k in range(3))


def affine(point: Triple, m: Sequence[float]) -> Triple:
    """Twelve numbers, row by row, applied to a point."""
    return tuple(m[4 * r] * point[0] + m[4 * r + 1] * point[1] + m[4 * r + 2] * point[2] + m[4 * r + 3] for r in range(3))


def pinhole(p: Triple, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a point in the camera's frame; null at or behind the camera."""
    ahead = F.when(p[2] > 0, p[2])
    return fx * p[0] / ahead + cx, fy * p[1] / ahead + cy


def fisheye(p: Triple, fx: float, fy: float, cx: float, cy: float, k: Sequence[float]) -> tuple[Column, Column]:
    """Equidistant projection with odd polynomial terms k in the angle off the axis; null behind the camera."""
    flat = F.sqrt(p[0] * p[0] + p[1] * p[1])
    angle = F.atan2(flat, p[2])
    bent = angle
    power = angle
    for c in k:
        power = power * angle * angle
        bent = bent + c * power
    scale = F.when(flat > 1e-12, bent / flat).otherwise(1.0)
    ahead = F.when(p[2] > 0, F.lit(1.0))
    return ahead * (fx * p[0] * scale + cx), ahead * (fy * p[1] * scale + cy)


def in_image(u: Column, v: Column, width: int, height: int) -> Column:
    return F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def box_gap(a: str, b: str) -> Column:
    """Distance between two boxes of columns {prefix}x0 .. {prefix}z1; 0 where they meet."""
    sides = [F.greatest(F.lit(0.0), F.col(f"{a}{c}0") - F.col(f"{b}{c}1"), F.col(f"{b}{c}0") - F.col(f"{a}{c}1")) for c in "xyz"]
    return norm(tuple(sides))


def box_volume(a: str) -> Column:
    return (F.col(f"{a}x1") - F.col(f"{a}x0")) * (F.col(f"{a}y1") - F.col(f"{a}y0")) * (F.col(f"{a}z1") - F.col(f"{a}z0"))


def box_overlap(a: str, b: str) -> Column:
    """Volume that two boxes share."""
    sides = [F.greatest(F.lit(0.0), F.least(F.col(f"{a}{c}1"), F.col(f"{b}{c}1")) - F.greatest(F.col(f"{a}{c}0"), F.col(f"{b}{c}0"))) for c in "xyz"]
    return sides[0] * sides[1] * sides[2]


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Triple:
    """Eigenvalues of a symmetric 3 x 3 matrix, largest first, in closed form."""
    mean = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    spread = F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * off) / 6)
    a, b, c = xx - mean, yy - mean, zz - mean
    half = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / 2
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half / (spread * spread * spread)))) / 3
    first = F.when(spread > 1e-15, mean + 2 * spread * F.cos(turn)).otherwise(mean)
    last = F.when(spread > 1e-15, mean + 2 * spread * F.cos(turn + 2.0943951023931953)).otherwise(mean)
    return first, 3 * mean - first - last, last
