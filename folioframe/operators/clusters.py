"""One-dimensional clusters of positions, and their repair within and across pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_p
from ..schema import KEYS, borders
from .boxes import below, marks_of
from .matching import best_matches

#: Names of aggregates that may give a cluster its centre.
CENTERS: dict[str, Callable[[str], Column]] = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max}
#: A centre is one of these names, or a function from a column's name to an aggregate.
Center = str | Callable[[str], Column]


def center_of(method: Center, value: str) -> Column:
    return method(value) if callable(method) else CENTERS[method](value)


def break_clusters(values: DataFrame, value: str, gap: float, keys: Sequence[str] = KEYS, order: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Rows with ``cluster_id`` (0-based, by value): a new cluster where the gap is ``gap`` or more (``strict``: more)."""
    if gap < 0:
        raise ValueError("gap must not be negative")
    w = Window.partitionBy(*keys).orderBy(value, *order)
    step = F.col(value) - F.lag(value).over(w)
    apart = F.when((step > gap) if strict else (step >= gap), 1).otherwise(0)
    marked = values.withColumn("_apart", apart)
    return marked.withColumn("cluster_id", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_apart")


def linkage_clusters(values: DataFrame, value: str, threshold: float, keys: Sequence[str] = KEYS, order: Sequence[str] = (), criterion: str = "distance", method: str = "single", depth: int = 2) -> DataFrame:
    """Hierarchical clusters of the values of each key.

    Single linkage by distance is a gap rule and stays a window; other modes (the methods of ``linkage.METHODS``
    by 'distance', 'inconsistent' or 'maxclust') build the tree of each key's values in numpy.
    """
    if criterion == "distance" and method == "single":
        return break_clusters(values, value, threshold, keys, order, strict=True)
    from .linkage import cut_tree, tree

    schema = values.withColumn("cluster_id", F.lit(0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, *order], kind="stable")
        return pdf.assign(cluster_id=cut_tree(tree(pdf[value].to_numpy(float), method), threshold, criterion, depth).astype(np.int32))

    return values.groupBy(*keys).applyInPandas(run, schema)


def custom_clusters(values: DataFrame, value: str, method: Callable[[np.ndarray], np.ndarray], keys: Sequence[str] = KEYS, order: Sequence[str] = ()) -> DataFrame:
    """Rows with the ``cluster_id`` that ``method`` gives the sorted values of each key, in Arrow batches."""
    schema = values.withColumn("cluster_id", F.lit(0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, *order], kind="stable")
        return pdf.assign(cluster_id=np.asarray(method(pdf[value].to_numpy(float))).astype(np.int32))

    return values.groupBy(*keys).applyInPandas(run, schema)


def cluster_centers(clustered: DataFrame, value: str, method: Center = "median", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per cluster: keys, cluster_id, center, n."""
    return clustered.groupBy(*keys, "cluster_id").agg(center_of(method, value).alias("center"), F.count("*").alias("n"))


def steady_clusters(clustered: DataFrame, value: str, most_std: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of clusters whose population standard deviation is below ``most_std``."""
    spread = F.stddev_pop(value).over(Window.partitionBy(*keys, "cluster_id"))
    return clustered.withColumn("_std", spread).where(F.col("_std") < most_std).drop("_std")


def smallest_mode(values: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The most frequent value of each key, of several the smallest."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))


def largest_clusters(centers: DataFrame, most: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``most`` largest clusters of each key, ties by cluster_id."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "cluster_id"))
    return centers.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def nearest_center(centers: DataFrame, target: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """The centre nearest to ``target`` for each key; ties by cluster_id."""
    return centers.groupBy(*keys).agg(F.min_by("center", F.struct(F.abs(F.col("center") - target), F.col("cluster_id"))).alias("center"))


def row_positions(clustered: DataFrame) -> DataFrame:
    """(keys, pos_idx, pos): the first row's top, then midways between a row's top and the bottom of the one before."""
    rows = clustered.groupBy(*KEYS, "cluster_id").agg(F.min("top").alias("_top"), F.max("bottom").alias("_bottom"))
    before = F.lag("_bottom").over(Window.partitionBy(*KEYS).orderBy("cluster_id"))
    pos = F.when(before.isNull(), F.col("_top")).otherwise(F.col("_top") - (F.col("_top") - before) / 2)
    return rows.select(*KEYS, F.col("cluster_id").alias("pos_idx"), pos.alias("pos"))


def column_borders(boxes: DataFrame, positions: DataFrame, least: Column | int) -> DataFrame:
    """(keys, pos): left borders of columns with ``least`` centres or more, then the rightmost right edge of the last
    kept column's start midway, and that edge."""
    center = F.col("left") + F.col("width") / 2
    placed = boxes.join(marks_of(positions), list(KEYS)).withColumn("_i", below(F.col("_marks"), center)).where("_i > 0 and _i < size(_marks)")
    counted = placed.groupBy(*KEYS, F.element_at("_marks", F.col("_i")).alias("_lo")).agg(F.count("*").alias("_n"))
    kept = counted.where(F.col("_n") >= least)
    edge = boxes.groupBy(*KEYS).agg(F.max("right").alias("_edge"))
    last = kept.groupBy(*KEYS).agg(F.max("_lo").alias("_last")).join(edge, list(KEYS))
    tail = last.select(*KEYS, F.explode(F.array((F.col("_last") + F.col("_edge")) / 2, F.col("_edge"))).alias("pos"))
    return kept.select(*KEYS, F.col("_lo").alias("pos")).unionByName(tail)


def last_border(boxes: DataFrame, last: DataFrame, pages: DataFrame) -> DataFrame:
    """(keys, pos): the largest right edge of boxes that begin at or after the last column (column ``pos``) and on the page."""
    joined = boxes.join(last.select(*KEYS, F.col("pos").alias("_last")), list(KEYS)).join(pages.select(*KEYS, F.col("width").alias("_page")), list(KEYS))
    return joined.where("`left` >= _last and `left` < _page").groupBy(*KEYS).agg(F.max("right").alias("pos"))


def header_top(centers: DataFrame, pages: DataFrame, share: float = 0.25) -> DataFrame:
    """(keys, table_top): the lowest line centre in the upper part; pages with fewer than two are left out."""
    joined = centers.join(pages.select(*KEYS, F.col("height").alias("_page")), list(KEYS)).where(F.col("center") < share * F.col("_page"))
    return joined.groupBy(*KEYS).agg(F.max("center").alias("table_top"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")


def match_arrays(arrays: DataFrame, models: DataFrame, most_difference: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each key's array (column ``base``) fitted to its ``model``: keys, positions, difference.

    ``models`` has a model for each value of the key columns it shares with ``arrays``; it must share some.
    """
    shared = [c for c in models.columns if c in keys]
    if not shared:
        raise ValueError("models must have a key column of the arrays")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrays.schema if f.name in keys) + ", positions array<double>, difference double"

    def run(batches):
        for pdf in batches:
            got = best_matches([np.asarray(b, float) for b in pdf["base"]], [np.asarray(m, float) for m in pdf["model"]], most_difference)
            yield pdf[list(keys)].assign(positions=[list(p) for p, _ in got], difference=[d for _, d in got])

    return arrays.join(models.select(*shared, "model"), shared).select(*keys, "base", "model").mapInPandas(run, schema)


def adjust_centers(clustered: DataFrame, value: str, n_required: int, gap: float, scaling: DataFrame | None = None, most_difference: float | None = None, doc: Sequence[str] = ("doc_id",), center: Center = "median", method: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Column centres of every page fitted to a model of the document: keys, positions, difference.

    Page centres less the page's first are pooled and clustered again by ``gap``; the largest
    clusters with distinct medians (ties: lower ones) are the model, or all if they are fewer than
    ``n_required``. ``scaling`` (keys, scale) divides the results. ``center`` gives the page centres and ``method``,
    from sorted values to cluster numbers, may replace the clustering by ``gap``.
    """
    centers = cluster_centers(clustered, value, center)
    pages = centers.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "center"))), lambda x: x["center"]).alias("base"))
    pooled = pages.select(*KEYS, F.posexplode("base").alias("_i", "_c"), "base").withColumn("norm", F.col("_c") - F.element_at("base", 1))
    pooled = pooled.select(*doc, "page_num", "_i", "norm")
    again = break_clusters(pooled, "norm", gap, doc, ("page_num", "_i")) if method is None else custom_clusters(pooled, "norm", method, doc, ("page_num", "_i"))
    found = again.groupBy(*doc, "cluster_id").agg(F.median("norm").alias("m"), F.count("*").alias("n"))
    first = found.groupBy(*doc, "m").agg(F.min(F.struct(-F.col("n"), F.col("cluster_id"))).alias("rank"))
    model = first.groupBy(*doc).agg(F.array_sort(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "m"))), 1, n_required), lambda x: x["m"])).alias("model"))
    fitted = match_arrays(pages, model, most_difference)
    if scaling is not None:
        fitted = fitted.join(scaling.select(*KEYS, "scale"), list(KEYS)).withColumn("positions", F.transform("positions", lambda x: x / F.col("scale"))).drop("scale")
    return fitted


def adjust_bad_positions(positions: DataFrame, level: float = 0.05, doc: Sequence[str] = ("doc_id",), good: DataFrame | None = None) -> DataFrame:
    """Page positions (keys, positions array) with outliers replaced by the mean widths of good pages.

    A page is bad if it has not the median number of positions, has a negative width, or a
    chi-square test of its widths against the means gives a probability below ``level``. Documents without
    good pages stay as they are; negative mean widths fail the query. ``good`` may give the good pages.
    """
    if not 0 < level <= 1:
        raise ValueError("level must be in (0, 1]")
    counts = positions.groupBy(*doc).agg(F.median(F.size("positions")).cast("int").alias("expected"))
    if good is None:
        good = positions.join(counts, list(doc)).where(F.size("positions") == F.col("expected")).select(*doc, "positions")
    shortest = good.groupBy(*doc).agg(F.min(F.size("positions")).alias("_shortest"))
    means = good.select(*doc, F.posexplode("positions").alias("i", "p")).groupBy(*doc, "i").agg(F.avg("p").alias("mean")).join(shortest, list(doc)).where("i < _shortest")
    means = means.groupBy(*doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("means"))
    joined = positions.join(counts, list(doc)).join(means, list(doc), "left")
    schema = positions.withColumn("adjusted", F.lit(False)).schema
    names, order = list(positions.columns), list(schema.names)

    def run(batches):
        for pdf in batches:
            out, flags = [], []
            for p, n, m in zip(pdf["positions"], pdf["expected"], pdf["means"]):
                p = np.asarray(p, float)
                if m is None:
                    out.append(p)
                    flags.append(False)
                    continue
                widths = np.diff(np.asarray(m, float))
                if len(widths) and widths.min() < 0:
                    raise ValueError("mean widths must not be negative")
                own = np.diff(p)
                bad = len(p) != n or own.min() < 0 or chi2_p(own, widths) < level
                out.append(np.concatenate([p[:1], p[0] + np.cumsum(widths)]) if bad else p)
                flags.append(bad)
            yield pdf[names].assign(positions=[list(x) for x in out], adjusted=flags)[order]

    return joined.select(*positions.columns, "expected", "means").mapInPandas(run, schema)


def merge_nearby(boxes: DataFrame, direction: str, most_gap: float, most_axis_gap: float, axis_align: str = "center", on_overlap: bool = False, glue: str | None = None) -> DataFrame:
    """Merge neighbours along an axis: boxes are clustered on the other axis by their centres, or by the edge ``axis_align``
    names, then joined while the gap to the box before is at most ``most_gap`` (and not negative, unless ``on_overlap``).

    A merged box keeps the first one's cross extent and ends where the last one ends. ``out_seq`` gives
    the order: by axis cluster, then near edge.
    """
    low, high, extent = borders(direction)
    cross, cross_high, cross_extent = borders("v" if direction == "h" else "h")
    if axis_align not in ("center", cross, cross_high):
        raise ValueError(f"axis_align must be 'center', '{cross}' or '{cross_high}'")
    aligned = F.col(cross) + F.col(cross_extent) / 2 if axis_align == "center" else F.col(axis_align)
    if most_axis_gap < 0:
        raise ValueError("most_axis_gap must not be negative")
    glue = glue if glue is not None else (" " if direction == "h" else "\n")
    axis = break_clusters(boxes.withColumn("_c", aligned), "_c", most_axis_gap, KEYS, (cross, "box_seq")).withColumnRenamed("cluster_id", "_axis")
    # ties of the near edge keep the order the axis clusters have
    w = Window.partitionBy(*KEYS, "_axis").orderBy(low, "_c", cross, "box_seq")
    gap = F.col(low) - F.lag(high).over(w)
    joins = (gap <= most_gap) if on_overlap else (gap <= most_gap) & (gap >= 0)
    marked = axis.withColumns({"_new": F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1), "_place": F.row_number().over(w)})
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in boxes.columns if c not in (*KEYS, "value")]
    first = F.min_by(F.struct(*rest), "_place").alias("_first")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"]), glue).alias("value")
    merged = island.groupBy(*KEYS, "_axis", "_island").agg(first, F.max_by(high, "_place").alias("_end"), text, F.count("*").cast("int").alias("n_merged"))
    flat = merged.select(*KEYS, *(F.col(f"_first.{c}").alias(c) for c in rest), "value", "_end", "_axis", "_island", "n_merged")
    flat = flat.withColumns({extent: F.col("_end") - F.col(low), high: F.col("_end")})
    order = F.row_number().over(Window.partitionBy(*KEYS).orderBy("_axis", "_island"))
    return flat.withColumn("out_seq", (order - 1).cast("int")).select(*boxes.columns, "n_merged", "out_seq")


def merge_overlapping_sections(sectioned: DataFrame, direction: str, least_gap: float) -> DataFrame:
    """Rows with ``merged_idx``: a section joins the one before if the distance of its largest low edge
    to that one's largest high edge is below ``least_gap``; ``merged_order`` puts later sections first."""
    low, high, _ = borders(direction)
    secs = sectioned.groupBy(*KEYS, "section_idx").agg(F.max(low).alias("_a"), F.max(high).alias("_b"))
    w = Window.partitionBy(*KEYS).orderBy("section_idx")
    dist = F.coalesce(F.col("_a") - F.lag("_b").over(w), F.lit(0.0))
    new = F.when((dist < least_gap) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return _merged(sectioned, secs.withColumn("_new", new), w)


def merge_small_sections(sectioned: DataFrame, most_texts: int) -> DataFrame:
    """Rows with ``merged_idx``: a section of ``most_texts`` boxes or fewer joins the one before, unless none before has boxes."""
    secs = sectioned.groupBy(*KEYS, "section_idx").agg(F.count("box_seq").alias("_n"))
    w = Window.partitionBy(*KEYS).orderBy("section_idx")
    filled = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    return _merged(sectioned, secs.withColumn("_new", F.when(filled & (F.col("_n") <= most_texts), 0).otherwise(1)), w)


def _merged(sectioned: DataFrame, secs: DataFrame, w) -> DataFrame:
    index = (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")
    joined = sectioned.join(secs.select(*KEYS, "section_idx", index.alias("merged_idx")), [*KEYS, "section_idx"])
    order = F.row_number().over(Window.partitionBy(*KEYS, "merged_idx").orderBy(F.desc("section_idx"), "box_seq"))
    return joined.withColumn("merged_order", (order - 1).cast("int"))


def correct_columns(positions: DataFrame, n_required: int, most_difference: float, doc: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Page columns (keys, pos_idx, pos) replaced, where they are not ``n_required`` or differ by more than
    ``most_difference`` in sum, by the page's first position plus the document's medians."""
    page = Window.partitionBy(*KEYS)
    start = F.min_by("pos", "pos_idx").over(page)
    norm = positions.withColumns({"_n": F.count("*").over(page), "_start": start}).withColumn("_norm", F.col("pos") - F.col("_start"))
    medians = norm.where(F.col("_n") == n_required).groupBy(*doc, "pos_idx").agg(F.median("_norm").alias("_median"))
    pages = norm.select(*KEYS, "_n", "_start").distinct()
    model = pages.join(medians, list(doc))
    own = norm.select(*KEYS, "pos_idx", "pos", "_norm")
    both = model.join(own, [*KEYS, "pos_idx"], "left")
    diff = F.sum(F.abs(F.col("_norm") - F.col("_median"))).over(page)
    bad = (F.col("_n") != n_required) | (diff > most_difference)
    return both.select(*KEYS, "pos_idx", F.when(bad, F.col("_start") + F.col("_median")).otherwise(F.col("pos")).alias("pos"))


def table_rows(boundaries: DataFrame, boxes: DataFrame, pattern: str) -> DataFrame:
    """Sections of consecutive row boundaries whose boxes match, as (keys, row_start, row_end).

    A section holds the boxes whose bottom is in (last boundary that closed a non-empty section, boundary]."""
    placed = boxes.select(*KEYS, "bottom", F.col("value").rlike(pattern).alias("_hit")).join(marks_of(boundaries), list(KEYS)).where("bottom > 0")
    placed = placed.withColumn("_i", below(F.col("_marks"), F.col("bottom"))).where("_i < size(_marks)")
    held = placed.groupBy(*KEYS, F.element_at("_marks", F.col("_i") + 1).alias("_hi")).agg(F.max("_hit").alias("_hit"))
    start = F.coalesce(F.lag("_hi").over(Window.partitionBy(*KEYS).orderBy("_hi")), F.lit(0.0))
    return held.withColumn("row_start", start).where("_hit").select(*KEYS, "row_start", F.col("_hi").alias("row_end"))


def row_borders(rows: DataFrame) -> DataFrame:
    """(keys, pos): where the table's rows begin and end, each position once: the table begins at the first row's start and
    goes on from row to row until a section does not match."""
    return rows.select(*KEYS, F.explode(F.array("row_start", "row_end")).alias("pos")).distinct()
