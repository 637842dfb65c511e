"""Ruling lines in polar form: directions, rotation and skew, projection, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schema import KEYS, ROTATION, SKEW_X, SKEW_Y, VERTICAL, borders, check_direction
from ..sources.staging import staged
from .boxes import below, marks_of
from .clusters import Center, break_clusters, center_of, cluster_centers, custom_clusters, nearest_center, steady_clusters


def with_direction(lines: DataFrame) -> DataFrame:
    """Lines (rho, theta) with theta_norm and dir."""
    return lines.withColumn("theta_norm", G.normalize_angle(F.col("theta"))).withColumn("dir", G.line_direction(F.col("theta_norm")))


def deviation() -> Column:
    """Angle between a line and the exact vertical or horizontal of its direction."""
    n = F.col("theta_norm")
    return F.when(F.col("dir") == VERTICAL, F.when(n > G.HALF_PI, n - G.PI).otherwise(n)).otherwise(n - G.HALF_PI)


def _measured(lines: DataFrame, only: str | None) -> DataFrame:
    if only is not None:
        lines = lines.where(F.col("dir") == check_direction(only))
    return lines.withColumn("_dev", deviation())


def estimate_rotation(lines: DataFrame, least: float, same: float, only: str | None = None) -> DataFrame:
    """(keys, kind, radians) of every page with lines: 'r' if both medians exceed ``least`` and agree within
    ``same``, 'sy' or 'sx' if only that of horizontal or vertical lines does, else nulls."""
    med = lambda d: F.median(F.when(F.col("dir") == d, F.col("_dev")))
    pages = _measured(lines, only).groupBy(*KEYS).agg(med("h").alias("h"), med("v").alias("v"))
    h, v = F.coalesce(F.abs("h") > least, F.lit(False)), F.coalesce(F.abs("v") > least, F.lit(False))
    agree = F.abs(F.col("h") - F.col("v")) < same
    kind = F.when(h & v, F.when(agree, ROTATION)).when(h, SKEW_Y).when(v, SKEW_X)
    radians = F.when(h & v, F.when(agree, (F.col("h") + F.col("v")) / 2)).when(h, F.col("h")).when(v, F.col("v"))
    return pages.select(*KEYS, kind.alias("kind"), radians.alias("radians"))


def without_strays(lines: DataFrame, most: float, only: str | None = None) -> DataFrame:
    """Lines whose deviation is about as large as their direction's median on the page; with ``only``, no others.

    The query fails for a deviation of over pi/4."""
    rows = _measured(lines, only)
    rows = rows.withColumn("_dev", F.when(F.abs("_dev") <= G.QUARTER_PI, F.col("_dev")).otherwise(F.raise_error(F.lit("a line deviates by more than pi/4")).cast("double")))
    median = F.median("_dev").over(Window.partitionBy(*KEYS, "dir"))
    return rows.withColumn("_med", median).where(F.abs(F.abs("_med") - F.abs("_dev")) < most).drop("_med", "_dev")


def apply_rotation(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Add each page's angle (keys, kind, radians) to the lines it concerns; rho and dir stay."""
    joined = lines.join(corrections.select(*KEYS, "kind", "radians"), list(KEYS), "left")
    turn = (F.col("kind") == ROTATION) | ((F.col("kind") == SKEW_Y) & (F.col("dir") == "h")) | ((F.col("kind") == SKEW_X) & (F.col("dir") == "v"))
    turn = F.coalesce(turn & F.col("radians").isNotNull(), F.lit(False))
    theta = F.when(turn, F.col("theta") + F.col("radians")).otherwise(F.col("theta"))
    norm = F.when(turn, G.normalize_angle(F.col("theta"))).otherwise(F.col("theta_norm"))
    return joined.withColumn("theta", theta).withColumn("theta_norm", norm).select(*lines.columns)


def projected(lines: DataFrame, pages: DataFrame, fixed: bool = False) -> DataFrame:
    """Lines with end points ax, ay, bx, by on the page image (pages: img_width, img_height)."""
    joined = lines.join(pages.select(*KEYS, "img_width", "img_height"), list(KEYS))
    ab = joined.withColumn("_ab", G.project_line(F.col("rho"), F.col("theta"), F.col("img_width"), F.col("img_height"), fixed))
    return ab.select(*lines.columns, "img_width", "img_height", *(F.col(f"_ab.{c}").alias(c) for c in ("ax", "ay", "bx", "by")))


def line_clusters(lines: DataFrame, pages: DataFrame, direction: str, gap: float, most_std: float | None = None, fixed: bool = False, method=None) -> DataFrame:
    """Lines of a direction with ``pos`` (the middle of their end points' coordinate) and ``cluster_id``: by ``gap``, or
    by ``method`` from sorted positions to cluster numbers."""
    axis = "x" if check_direction(direction) == VERTICAL else "y"
    own = projected(lines.where(F.col("dir") == direction), pages, fixed)
    own = own.withColumn("pos", (F.col(f"a{axis}") + F.col(f"b{axis}")) / 2)
    found = break_clusters(own, "pos", gap, KEYS, ("line_seq",)) if method is None else custom_clusters(own, "pos", method, KEYS, ("line_seq",))
    return found if most_std is None else steady_clusters(found, "pos", most_std)


def drop_empty_sections(clustered: DataFrame, boxes: DataFrame, scales: DataFrame, direction: str, ratio: float, center: Center = "median") -> DataFrame:
    """Clusters before which enough boxes lie, and the one just before the first of them.

    A box counts for the section up to a centre (divided by the page's ``scale``) if either edge is in it;
    enough is the median count times ``ratio``, rounded half to even.
    """
    low, high, _ = borders("h" if check_direction(direction) == VERTICAL else "v")
    centers = clustered.groupBy(*KEYS, "cluster_id").agg(center_of(center, "pos").alias("_c")).join(scales.select(*KEYS, "scale"), list(KEYS))
    centers = staged(centers, "centers")  # a row a cluster, asked for three times
    w = Window.partitionBy(*KEYS).orderBy("_c", "cluster_id")
    secs = centers.withColumn("_c", F.col("_c") / F.col("scale")).withColumn("_i", F.row_number().over(w) - 1)
    # an edge finds its section among the page's sorted centres; a box counts once for each section that has an edge of it
    marks = secs.select(*KEYS, F.col("_c").alias("pos"))
    place = lambda c: F.when(F.col(c) > -1, below(F.col("_marks"), F.col(c)))
    hits = boxes.join(marks_of(marks), list(KEYS)).select(*KEYS, F.explode(F.array_distinct(F.array_compact(F.array(place(low), place(high))))).alias("_i"))
    counts = hits.groupBy(*KEYS, "_i").agg(F.count("*").alias("_n"))
    met = secs.select(*KEYS, "cluster_id", "_c", "_i").join(counts, [*KEYS, "_i"], "left").withColumn("_n", F.coalesce("_n", F.lit(0))).drop("_i")
    enough = F.bround(F.median("_n").over(Window.partitionBy(*KEYS)) * ratio)
    kept = met.withColumn("_keep", F.col("_n") >= enough)
    after = F.lead("_keep").over(w)
    earlier = F.coalesce(F.max("_keep").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    chosen = kept.withColumn("_use", F.col("_keep") | (F.coalesce(after, F.lit(False)) & ~earlier)).where("_use").select(*KEYS, "cluster_id")
    return clustered.join(chosen, [*KEYS, "cluster_id"]).select(*clustered.columns)


def separator_line(clustered: DataFrame, pages: DataFrame, direction: str = VERTICAL, around: float = 0.5) -> DataFrame:
    """(keys, separator): the cluster centre nearest to a relative position; pages without clusters have no row."""
    if not 0 <= around <= 1:
        raise ValueError("around must be in [0, 1]")
    size = "img_width" if check_direction(direction) == VERTICAL else "img_height"
    centers = cluster_centers(clustered, "pos").join(pages.select(*KEYS, F.col(size).alias("_size")), list(KEYS))
    return nearest_center(centers, F.col("_size") * around).withColumnRenamed("center", "separator")
