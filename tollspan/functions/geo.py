"""Geometry and kinematics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def km_fraction(km: Column, start: Column, end: Column) -> Column:
    """Where a kilometre lies between two posts, within [0, 1]; equal posts give 0."""
    ratio = F.try_divide(km - start, end - start)
    clipped = F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))
    known = km.isNotNull() & start.isNotNull() & end.isNotNull()
    return F.when(known & _near(start, end), F.lit(0.0)).when(known, clipped)


def great_circle_point(lat1: Column, lon1: Column, lat2: Column, lon2: Column, f: Column) -> tuple[Column, Column]:
    """Point at fraction `f` of the great circle between two coordinates."""
    p1, p2, l1, l2 = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    arc = 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    wa = F.try_divide(F.sin((1 - f) * arc), F.sin(arc))
    wb = F.try_divide(F.sin(f * arc), F.sin(arc))
    x = wa * F.cos(p1) * F.cos(l1) + wb * F.cos(p2) * F.cos(l2)
    y = wa * F.cos(p1) * F.sin(l1) + wb * F.cos(p2) * F.sin(l2)
    z = wa * F.sin(p1) + wb * F.sin(p2)
    at_start = (f <= 0) | (F.abs(arc) <= 1e-8)

    def pick(first: Column, second: Column, middle: Column) -> Column:
        return F.when((f <= 0), first).when(f >= 1, second).when(at_start, first).otherwise(F.degrees(middle))

    return pick(lat1, lat2, F.atan2(z, F.sqrt(x * x + y * y))), pick(lon1, lon2, F.atan2(y, x))


def project_on_segment(
    px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column
) -> tuple[Column, Column]:
    """Nearest point of segment a-b to p."""
    dx, dy = bx - ax, by - ay
    along = F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return ax + t * dx, ay + t * dy


def acceleration(v_in_kmh: Column, v_out_kmh: Column, km: Column) -> Column:
    """Constant acceleration in m/s^2 over a distance; NULL when the distance is not positive."""
    gain = F.pow(v_out_kmh / F.lit(3.6), 2) - F.pow(v_in_kmh / F.lit(3.6), 2)
    return F.when(km > 0, gain / (2 * km * 1000))
