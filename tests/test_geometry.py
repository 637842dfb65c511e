import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.functions import arrays as A
from folioframe.functions import geometry as G
from folioframe.functions import text as X
from folioframe.functions.stats import chi2_tail


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def rect(*v):
    return G.rect(*map(float, v))


def test_points_and_angles(spark):
    p = G.point
    row = one(
        spark, G.point_distance(p(0, 0), p(1, 1)), G.vector_angle(p(0, 0), p(1, 1)), G.vector_angle(p(1, 0), p(2, 0)), G.vector_angle(p(1, 0), p(0, 1)),
        G.vector_angle(p(2, 0), p(0, -1)), G.rotate(F.lit(1.0), F.lit(0.0), math.pi / 2, 1.0, 1.0),
    )
    assert row[0] == pytest.approx(math.sqrt(2)) and math.isnan(row[1]) and row[2] == 0
    assert row[3] == pytest.approx(math.pi / 2) and row[4] == pytest.approx(math.pi / 2)
    assert tuple(row[5]) == pytest.approx((2, 1))


def test_overlap_and_intersection(spark):
    p = G.point
    row = one(
        spark, G.ranges_overlap(-10, 10, -20, -10), G.ranges_overlap(-9, 10, -20, -10), G.line_intersection(p(0, 0), p(2, 2), p(0, 0), p(2, 2)),
        G.line_intersection(p(0, 0), p(1, 0), p(0, 2), p(1, 2)), G.line_intersection(p(0, 0), p(2, 2), p(0, 2), p(2, 0)), G.line_intersection(p(0, 0), p(0, 1), p(1, 1), p(2, 2), False),
    )
    assert row[0] and not row[1] and math.isnan(row[2].x) and row[3] is None
    assert tuple(row[4]) == (1, 1) and tuple(row[5]) == (0, 0)


def test_rectangles(spark):
    unit = rect(0, 0, 1, 1)
    row = one(
        spark, G.rect_area(rect(-3, -1, 2, 5)), G.rect_center(rect(-3, -1, 2, 5)), G.rect_intersection(unit, rect(0.5, 0.5, 1.5, 1.5)), G.rect_intersection(unit, rect(0.75, 0.5, 1.5, 1.5)),
        G.rect_intersection(unit, rect(1, 1, 2, 2)), G.rect_intersection(unit, rect(1.1, 0, 2, 2)), G.rect_intersection(rect(0, 0, 10, 1), rect(4, 0.5, 5, 1.5)), G.rect_intersection(rect(0, 0, 10, 1), rect(4, 0.5, 5, 1.5), true_overlap=True),
    )
    assert row[0] == 30 and tuple(row[1]) == (-0.5, 2) and row[2] == 0.25 and row[3] == 0.125
    assert row[4] == 0 and row[5] is None and row[6] == 1.0 and row[7] == 0.5
    with pytest.raises(Exception, match="rectangle"):
        one(spark, rect(0, 0, 0, 1))
    with pytest.raises(ValueError):
        G.rect_intersection(unit, unit, "c")


def test_normalised_angles(spark):
    rows = spark.range(-10, 10).select("id", G.normalize_angle(F.col("id") * math.pi).alias("n"), G.normalize_angle_half(F.col("id") * math.pi / 2).alias("h")).collect()
    for r in rows:
        assert r.n == pytest.approx(r.id % 2 * math.pi, abs=1e-9) and r.h == pytest.approx(r.id % 2 * math.pi / 2, abs=1e-9)
    row = one(spark, G.normalize_angle(-0.1), G.normalize_angle(-7.0))
    assert row[0] == pytest.approx(0.1) and row[1] == pytest.approx(7 - 2 * math.pi)


def test_projection(spark):
    lit = lambda v: F.lit(float(v))
    row = one(spark, G.project_line(lit(120), lit(math.radians(20)), lit(100), lit(200)), G.project_line(lit(120), lit(math.radians(20)), lit(100), lit(200), fixed=True), G.project_line(lit(50), lit(0), lit(100), lit(200)))
    assert 91.3 in (round(row[0].ax, 1), round(row[0].bx, 1)) and 54.9 in (round(row[1].ax, 1), round(row[1].bx, 1))
    assert (row[2].ax, row[2].bx) == (50, 50)
    with pytest.raises(Exception, match="width and height"):
        one(spark, G.project_line(lit(1), lit(1), lit(0), lit(5)))


def test_text_and_arrays(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    row = one(
        spark, X.strip(F.lit("\x1c\t  a b \n ")), X.rel_levenshtein(F.lit(""), F.lit("")), X.rel_levenshtein(F.lit("äö"), F.lit("ao")), A.any_in(arr("a"), F.lit("cat"), True),
        A.all_in(F.array().cast("array<string>"), arr("x")), A.match_difference(arr(1.0, 5.0), arr(2.0, 3.0)), A.fill_from(arr(1.0, 4.0), arr(9.0, 8.0, 7.0, 6.0), arr(1, 2)),
        X.matches_start(F.lit("٣x"), r"\d"), X.label_equals(F.lit("B e w"), "Bew"),
    )
    assert row[0] == "a b" and row[1] == 0 and row[2] == 1.0 and row[3] and row[4] and row[5] == 3 and row[6] == [1, 8, 7, 4] and row[7] and row[8]
    with pytest.raises(Exception, match="same length"):
        one(spark, A.match_difference(arr(1.0), arr(1.0, 2.0)))


@pytest.mark.parametrize("df,x", [(1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (5, 11.070498), (10, 18.307038)])
def test_chi2_tail(df, x):
    assert chi2_tail(x, df) == pytest.approx(0.05, abs=1e-6)


def test_chi2_edges():
    assert math.isnan(chi2_tail(1.0, 0)) and chi2_tail(math.inf, 3) == 0 and chi2_tail(0, 3) == 1


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(st.tuples(st.floats(-300, 300), st.floats(0, 6.28)), min_size=1, max_size=20))
def test_projected_points_are_on_the_canvas(spark, lines):
    df = spark.createDataFrame(lines, "rho double, theta double").select(G.project_line(F.col("rho"), F.col("theta"), F.lit(300.0), F.lit(200.0)).alias("p"))
    for (p,) in df.collect():
        for x, y in ((p.ax, p.ay), (p.bx, p.by)):
            assert not math.isfinite(x + y) or (-1e-6 <= x <= 300 + 1e-6 and -1e-6 <= y <= 200 + 1e-6)
