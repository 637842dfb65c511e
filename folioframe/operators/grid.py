"""Page grids: spans, cells, assignment of boxes to cells, and output tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rect_center_distance, rect_intersection
from ..schema import KEYS
from .boxes import join_texts, lines_to_text, put_in_lines

#: Height of the bands by which boxes and cells meet.
BAND = 64


def subsequent_pairs(positions: DataFrame, keys: Sequence[str] = KEYS, order: str = "pos_idx") -> DataFrame:
    """(keys, span_idx, lo, hi): each position with the next one."""
    w = Window.partitionBy(*keys).orderBy(order)
    spans = positions.select(*keys, (F.row_number().over(w) - 1).alias("span_idx"), F.col("pos").alias("lo"), F.lead("pos").over(w).alias("hi"))
    return spans.where("hi is not null")


def make_grid(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(keys, row_idx, col_idx, l, t, r, b) from positions (keys, pos_idx, pos); spans must have positive length."""
    across = subsequent_pairs(columns).select(*KEYS, F.col("span_idx").alias("col_idx"), F.col("lo").alias("l"), F.col("hi").alias("r"))
    down = subsequent_pairs(rows).select(*KEYS, F.col("span_idx").alias("row_idx"), F.col("lo").alias("t"), F.col("hi").alias("b"))
    cells = down.join(across, list(KEYS))
    sound = F.when((F.col("l") < F.col("r")) & (F.col("t") < F.col("b")), F.col("l")).otherwise(F.raise_error(F.lit("positions must increase")).cast("double"))
    return cells.select(*KEYS, "row_idx", "col_idx", sound.alias("l"), "t", "r", "b")


def fit_to_grid(boxes: DataFrame, grid: DataFrame, true_overlap: bool = False, band: float = BAND) -> DataFrame:
    """Boxes with the cell (row_idx, col_idx) they share most with; no cell: no row.

    The best share counts by exact equality, then the nearest centre, then row and column order. Boxes
    and cells meet in horizontal bands of a page, each pair in the first band both have, so that a pair
    of distant ones is never compared.
    """
    bands = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / band), F.floor(F.col(hi) / band)))
    b = boxes.withColumn("_first", F.floor(F.col("top") / band)).withColumn("_band", bands("top", "bottom"))
    c = grid.withColumn("_cell_first", F.floor(F.col("t") / band)).withColumn("_band", bands("t", "b"))
    met = b.join(c, [*KEYS, "_band"]).where("`left` < r and `right` > l and top < b and bottom > t and _band = greatest(_first, _cell_first)")
    cell = F.struct("l", "t", "r", "b")
    own = F.struct(F.col("left").alias("l"), F.col("top").alias("t"), F.col("right").alias("r"), F.col("bottom").alias("b"))
    scored = met.withColumns({"isect": rect_intersection(cell, own, "b", true_overlap), "center_dist": rect_center_distance(own, cell)}).where("isect > 0")
    best = F.row_number().over(Window.partitionBy(*KEYS, "box_seq").orderBy(F.desc("isect"), "center_dist", "row_idx", "col_idx"))
    return scored.withColumn("_rank", best).where("_rank = 1").select(*boxes.columns, "row_idx", "col_idx", "isect", "center_dist")


def unmatched(boxes: DataFrame, fitted: DataFrame) -> DataFrame:
    """Boxes of no cell."""
    return boxes.join(fitted.select(*KEYS, "box_seq"), [*KEYS, "box_seq"], "left_anti").select(*boxes.columns)


def cell_counts(fitted: DataFrame, grid: DataFrame) -> DataFrame:
    """(keys, row_idx, col_idx, n) of every cell, empty ones included."""
    counts = fitted.groupBy(*KEYS, "row_idx", "col_idx").agg(F.count("*").alias("n"))
    return grid.select(*KEYS, "row_idx", "col_idx").join(counts, [*KEYS, "row_idx", "col_idx"], "left").na.fill(0, ["n"])


def column_names(n: int) -> list[str]:
    """col1, col2, ...: zero-filled to the digits of n + 1."""
    return [f"col{str(i + 1).zfill(len(str(n + 1)))}" for i in range(n)]


def to_table(fitted: DataFrame, grid: DataFrame, n_columns: int, in_lines: bool = False, glue: str = " ") -> DataFrame:
    """One row per grid row, a text column for each of ``n_columns``; empty cells and missing columns give ''."""
    if n_columns < 1:
        raise ValueError("a table needs columns")
    cell = [*KEYS, "row_idx", "col_idx"]
    texts = lines_to_text(put_in_lines(fitted, cell), cell) if in_lines else join_texts(fitted, cell, glue=glue)
    whole = grid.select(*cell).join(texts, cell, "left")
    wide = whole.groupBy(*KEYS, "row_idx").pivot("col_idx", list(range(n_columns))).agg(F.first("text"))
    return wide.select(*KEYS, "row_idx", *(F.coalesce(F.col(f"`{i}`"), F.lit("")).alias(n) for i, n in enumerate(column_names(n_columns))))


def grid_json(grid: DataFrame) -> DataFrame:
    """(keys, grid): each page's cells as JSON text, rows of [[l, t], [r, b]]."""
    cell = F.array(F.array("l", "t"), F.array("r", "b"))
    rows = grid.groupBy(*KEYS, "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    pages = rows.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda x: x["cells"]).alias("g"))
    return pages.select(*KEYS, F.to_json("g").alias("grid"))


def document_json(grid: DataFrame) -> DataFrame:
    """(doc_id, grids): one JSON object per document, page number to grid."""
    pages = grid_json(grid).withColumn("_entry", F.concat(F.lit('"'), "page_num", F.lit('":'), "grid"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "_entry"))), lambda x: x["_entry"]), ",")
    return pages.groupBy("doc_id").agg(F.concat(F.lit("{"), parts, F.lit("}")).alias("grids"))
