"""Geometry as Column expressions on doubles.

NULL means no result, NaN an undefined one, and both are kept apart. Divisions are
guarded, since ANSI mode raises on a zero divisor. Points and rectangles
are structs ``(x, y)`` and ``(l, t, r, b)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TWO_PI, HALF_PI, QUARTER_PI = math.pi, 2 * math.pi, math.pi / 2, math.pi / 4
_NAN, _INF = float("nan"), float("inf")


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _ratio(a: Column, b: Column, zero: float) -> Column:
    return F.when(b == 0, F.lit(zero)).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def point(x, y) -> Column:
    return F.struct(_d(x).alias("x"), _d(y).alias("y"))


def point_distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def _close(a: Column, b: Column) -> Column:
    """Within 1e-8 plus 1e-5 of the second value."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def vector_angle(v: Column, w: Column) -> Column:
    """Angle in radians; NaN if a vector is about zero, 0 if they are about equal or parallel."""
    zero = F.lit(0.0)
    null = lambda p: _close(p["x"], zero) & _close(p["y"], zero)
    num = v["x"] * w["x"] + v["y"] * w["y"]
    den = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]) * F.sqrt(w["x"] * w["x"] + w["y"] * w["y"])
    same = _close(v["x"], w["x"]) & _close(v["y"], w["y"])
    return F.when(null(v) | null(w), F.lit(_NAN)).when(same | _close(num, den), 0.0).otherwise(F.acos(_ratio(num, den, _NAN)))


def rotate(x: Column, y: Column, theta, about_x=0.0, about_y=0.0) -> Column:
    c, s, ax, ay = F.cos(_d(theta)), F.sin(_d(theta)), _d(about_x), _d(about_y)
    return point(c * x - s * y + ax - c * ax + s * ay, s * x + c * y + ay - s * ax - c * ay)


def ranges_overlap(a1, a2, b1, b2) -> Column:
    """Closed ranges with ends in either order have a common point."""
    a1, a2, b1, b2 = map(_d, (a1, a2, b1, b2))
    return F.greatest(F.least(a1, a2), F.least(b1, b2)) <= F.least(F.greatest(a1, a2), F.greatest(b1, b2))


def line_intersection(p1: Column, p2: Column, p3: Column, p4: Column, in_segment: bool = True) -> Column:
    """Crossing of two lines; (NaN, NaN) for parallel ones that count as coincident, else NULL."""
    dx12, dx34, dy12, dy34 = p1["x"] - p2["x"], p3["x"] - p4["x"], p1["y"] - p2["y"], p3["y"] - p4["y"]
    d12, d34 = p1["x"] * p2["y"] - p1["y"] * p2["x"], p3["x"] * p4["y"] - p3["y"] * p4["x"]
    den = dx12 * dy34 - dy12 * dx34
    x = _ratio(d12 * dx34 - dx12 * d34, den, _NAN)
    y = _ratio(d12 * dy34 - dy12 * d34, den, _NAN)
    crossing = point(x, y)
    if not in_segment:
        return crossing
    near = ranges_overlap(p1["x"], p2["x"], p3["x"], p4["x"]) & ranges_overlap(p1["y"], p2["y"], p3["y"], p4["y"])
    inside = F.lit(True)
    for c, v in (("x", x), ("y", y)):
        for a, b in ((p1, p2), (p3, p4)):
            inside &= v.between(F.least(a[c], b[c]), F.greatest(a[c], b[c]))
    return F.when(F.when(den == 0, near).otherwise(inside), crossing)


def rect(l, t, r, b) -> Column:  # noqa: E741
    """A rectangle; the query fails if its area is not positive."""
    l, t, r, b = map(_d, (l, t, r, b))  # noqa: E741
    value = F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"))
    return F.when((l < r) & (t < b), value).otherwise(F.raise_error(F.lit("a rectangle needs l < r and t < b")).cast(value_type()))


def value_type() -> str:
    return "struct<l:double,t:double,r:double,b:double>"


def box_rect() -> Column:
    """The rectangle of a text box row."""
    return rect(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"))


def whole_point(p: Column) -> Column:
    """A point with coordinates rounded half to even."""
    return F.struct(F.bround(p["x"]).cast("int").alias("x"), F.bround(p["y"]).cast("int").alias("y"))


def rect_center(a: Column) -> Column:
    return point(a["l"] + (a["r"] - a["l"]) / 2, a["t"] + (a["b"] - a["t"]) / 2)


def rect_center_distance(a: Column, b: Column) -> Column:
    return point_distance(rect_center(a), rect_center(b))


def rect_area(a: Column) -> Column:
    return (a["r"] - a["l"]) * (a["b"] - a["t"])


def rect_intersection(a: Column, b: Column, norm: str | None = None, true_overlap: bool = False) -> Column:
    """Intersection measure, by the area of ``norm`` ('a' or 'b') on wish; NULL if apart, 0 if touching.

    By default the product of the smaller edge distances, at most the smaller area: it
    exceeds the true area when one rectangle contains the other on an axis. ``true_overlap`` gives the true area.
    """
    if norm not in (None, "a", "b"):
        raise ValueError("norm must be None, 'a' or 'b'")
    d = [b["r"] - a["l"], a["r"] - b["l"], b["b"] - a["t"], a["b"] - b["t"]]
    touch = (d[0] >= 0) & (d[1] >= 0) & (d[2] >= 0) & (d[3] >= 0)
    if true_overlap:
        area = (F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])) * (F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]))
    else:
        area = F.least(F.least(rect_area(a), rect_area(b)), F.least(d[0], d[1]) * F.least(d[2], d[3]))
    return F.when(touch, area if norm is None else area / rect_area(a if norm == "a" else b))


def normalize_angle(theta) -> Column:
    """Angle in [0, 2 pi); small negative angles are reflected (-0.1 becomes 0.1), not wrapped."""
    theta = _d(theta)
    turns = theta / TWO_PI
    up, down = F.floor(turns).cast("double"), F.ceil(turns).cast("double")
    up = F.when(turns - up > 0.99999, up + 1).otherwise(up)
    down = F.when(turns - down < -0.99999, down - 1).otherwise(down)
    return F.when(theta >= TWO_PI, theta - up * TWO_PI).when(theta < 0, F.abs(theta - down * TWO_PI)).otherwise(theta)


def normalize_angle_half(theta) -> Column:
    n = normalize_angle(theta)
    return F.when(n < PI, n).otherwise(n - PI)


def line_direction(theta_norm: Column) -> Column:
    """'v' for lines nearer to the vertical, else 'h'."""
    return F.when(F.abs(F.lit(HALF_PI) - theta_norm) > QUARTER_PI, "v").otherwise("h")


def project_line(rho: Column, theta: Column, width: Column, height: Column, fixed: bool = False) -> Column:
    """Two points ``(ax, ay, bx, by)`` of a polar line on the canvas borders.

    The default uses the width for the point at the lower border and the height for that at the right
    border, as existing results do; ``fixed`` uses them the right way round. Points outside are replaced by
    the nearest ones, moved onto the border.
    """
    w, h = _d(width), _d(height)
    ok = (w > 0) & (h > 0)
    cos, sin = F.cos(theta), F.sin(theta)
    below, beside = (h, w) if fixed else (w, h)
    x0, y0 = _ratio(rho, cos, _INF), _ratio(rho, sin, _INF)
    x1, y1 = _ratio(rho - below * sin, cos, _INF), _ratio(rho - beside * cos, sin, _INF)
    zero = F.lit(0.0)

    def candidate(k: int, x: Column, y: Column, free: str) -> Column:
        v, border = (x, w) if free == "x" else (y, h)
        dist = F.when(v <= 0, v).otherwise(v - border)
        valid = (x >= 0) & (x <= w) & (y >= 0) & (y <= h)
        moved = v - dist
        return F.struct(
            F.when(valid, 0).otherwise(1).alias("late"), F.when(valid, 0.0).otherwise(F.abs(dist)).alias("far"),
            F.when(valid, k).otherwise(-k).alias("k"), F.when(valid | F.lit(free == "y"), x).otherwise(moved).alias("x"),
            F.when(valid | F.lit(free == "x"), y).otherwise(moved).alias("y"),
        )

    ranked = F.sort_array(F.array(candidate(0, x0, zero, "x"), candidate(1, zero, y0, "y"), candidate(2, x1, h, "x"), candidate(3, w, y1, "y")))
    out = F.struct(ranked[0]["x"].alias("ax"), ranked[0]["y"].alias("ay"), ranked[1]["x"].alias("bx"), ranked[1]["y"].alias("by"))
    return F.when(ok, out).otherwise(F.raise_error(F.lit("width and height must be > 0")).cast("struct<ax:double,ay:double,bx:double,by:double>"))
