"""Vector and triangle arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    d = [x - y for x, y in zip(a, b, strict=True)]
    return dot(d, d)


def magnitude(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cubic_smooth(x: Column, radius: float) -> Column:
    """A compact falloff, (1 - x/R)^3 within R and 0 beyond."""
    return F.when(x < radius, F.pow(1 - x / F.lit(float(radius)), F.lit(3.0))).otherwise(F.lit(0.0))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def so2(a: Column, b: Column) -> Column:
    """Angle between two rotations of the plane, given as one angle each; never negative."""
    d = F.element_at(b, 1).cast("double") - F.element_at(a, 1).cast("double")
    pi = F.lit(3.141592653589793)
    return F.abs(F.when(d > pi, d - 2 * pi).when(d < -pi, d + 2 * pi).otherwise(d))


def so3(a: Column, b: Column) -> Column:
    """Squared distance of two unit quaternions."""
    return l2_squared(a, b)


METRICS: dict[str, Metric] = {"l1": l1, "l2": l2_squared, "l2_simple": l2_squared, "so2": so2, "so3": so3}


def barycentric(px: Column, py: Column, a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """Weights of a triangle's corners at (px, py) in plan view; null for a triangle without area."""
    det = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    det = F.when(det != 0, det)
    u = ((b[1] - c[1]) * (px - c[0]) + (c[0] - b[0]) * (py - c[1])) / det
    v = ((c[1] - a[1]) * (px - c[0]) + (a[0] - c[0]) * (py - c[1])) / det
    return u, v, 1 - u - v


def azimuth(dx: Column, dy: Column) -> Column:
    """atan(dx/dy) in degrees, 90 or -90 where dy is 0 (0 if dx is, too)."""
    return F.when(dy != 0, F.degrees(F.atan(dx / dy))).when(dx > 0, F.lit(90.0)).when(dx < 0, F.lit(-90.0)).otherwise(F.lit(0.0))


def matches_family(az: Column, families: Sequence[tuple[float, float]]) -> Column:
    """Whether an azimuth is within the tolerance of any (orientation, tolerance); orientations from 90 on are folded by -180, and there is no wrap-around."""
    out = F.lit(False)
    for o, tol in families:
        out = out | (F.abs(az - F.lit(float(o - 180 if o >= 90 else o))) < F.lit(float(tol)))
    return out


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def seeded(c: Column, seed: int | Column) -> Column:
    """A number below 2**31 that depends on an id and a seed; other engines can compute it alike."""
    return F.pmod(F.pmod(c.cast("long"), F.lit(2147483648)) * F.lit(1103515245) + (F.lit(seed) if isinstance(seed, int) else seed), F.lit(2147483648))


def seeded_pair(a: Column, b: Column, seed: int | Column) -> Column:
    """seeded() of 1000003 a + b."""
    return seeded(F.pmod(a.cast("long"), F.lit(2147483648)) * 1000003 + F.pmod(b.cast("long"), F.lit(2147483648)), seed)
