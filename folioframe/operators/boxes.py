"""Text boxes: moves, sections, lines of text, double pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rotate
from ..functions.text import strip
from ..schema import HORIZONTAL, KEYS, SKEW_X, SKEW_Y, VERTICAL, borders, check_direction


def with_edges(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height")})


def in_order(boxes: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Boxes with ``rank`` (0-based) on their page by a column; ties keep document order either way."""
    by = F.col(column).desc() if descending else F.col(column).asc()
    return boxes.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(by, "box_seq")) - 1)


def without_empty(boxes: DataFrame) -> DataFrame:
    """Boxes of positive width and height."""
    return boxes.where((F.col("width") > 0) & (F.col("height") > 0))


def on_pages(boxes: DataFrame, page_nums: Sequence[int]) -> DataFrame:
    return boxes.where(F.col("page_num").isin(list(page_nums)))


def move(boxes: DataFrame, left: Column, top: Column) -> DataFrame:
    """New top-left corners; extents stay."""
    return with_edges(boxes.withColumns({"left": left, "top": top}))


def resize(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """New extents from the same top-left corner."""
    return with_edges(boxes.withColumns({"width": width, "height": height}))


def rotate_boxes(boxes: DataFrame, radians, about_x=0.0, about_y=0.0) -> DataFrame:
    """Rotate the top-left corners only; boxes keep their extents."""
    corner = rotate(F.col("left"), F.col("top"), radians, about_x, about_y)
    return move(boxes.withColumn("_corner", corner), F.col("_corner.x"), F.col("_corner.y")).drop("_corner")


def deskew_boxes(boxes: DataFrame, radians, direction: str, about_x=0.0, about_y=0.0) -> DataFrame:
    """Shift each box by its distance from a point on the other axis, times the sine."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    s = F.sin(as_col(radians))
    if direction == SKEW_X:
        return move(boxes, F.col("left") + -s * (F.col("top") + F.col("height") / 2 - as_col(about_y)), F.col("top"))
    if direction == SKEW_Y:
        return move(boxes, F.col("left"), F.col("top") + s * (F.col("left") + F.col("width") / 2 - as_col(about_x)))
    raise ValueError("direction must be 'sx' or 'sy'")


def repair_boxes(boxes: DataFrame, corrections: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Undo each page's estimated rotation or skew: ``corrections`` has keys, kind and radians."""
    joined = boxes.join(corrections.select(*keys, "kind", "radians"), list(keys), "left")
    angle = -F.col("radians")
    corner = rotate(F.col("left"), F.col("top"), angle)
    left = F.when(F.col("kind") == "r", corner["x"]).when(F.col("kind") == SKEW_X, F.col("left") - F.sin(angle) * (F.col("top") + F.col("height") / 2)).otherwise(F.col("left"))
    top = F.when(F.col("kind") == "r", corner["y"]).when(F.col("kind") == SKEW_Y, F.col("top") + F.sin(angle) * (F.col("left") + F.col("width") / 2)).otherwise(F.col("top"))
    return move(joined.withColumns({"_left": left, "_top": top}), F.col("_left"), F.col("_top")).select(*boxes.columns)


def border_positions(boxes: DataFrame, direction: str, only: str | None = None) -> DataFrame:
    """(doc_id, page_num, pos): both edges of every box along the axis, or the 'low' or 'high' one."""
    low, high, _ = borders(direction)
    if only not in (None, "low", "high"):
        raise ValueError("only must be 'low', 'high' or None")
    cols = [F.col(c) for c, k in ((low, "low"), (high, "high")) if only in (None, k)]
    return boxes.select(*KEYS, F.explode(F.array(*cols)).alias("pos"))


def sections_of(positions: DataFrame, start: float = -1.0) -> DataFrame:
    """(doc_id, page_num, section_idx, sec_lo, sec_hi]: half-open sections from ordered positions."""
    w = Window.partitionBy(*KEYS).orderBy("pos", "pos_idx")
    return positions.select(*KEYS, (F.row_number().over(w) - 1).alias("section_idx"), F.lag("pos", 1, start).over(w).alias("sec_lo"), F.col("pos").alias("sec_hi"))


def marks_of(positions: DataFrame) -> DataFrame:
    """(keys, _marks): each page's positions as a sorted array, a row a page."""
    return positions.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.col("pos").cast("double"))).alias("_marks"))


def below(marks: Column, at: Column) -> Column:
    """How many of the sorted ``marks`` lie below ``at``: the index of the section (mark before, mark] that holds it."""
    return F.size(F.filter(marks, lambda m: m < at))


def split_by_positions(boxes: DataFrame, positions: DataFrame, direction: str, alignment: str = "high", keep_empty: bool = False, check: bool = True) -> DataFrame:
    """Boxes with the section that holds their edge ('high', 'low') or centre ('middle').

    ``keep_empty`` gives sections without boxes a row of null box columns. ``check`` fails the query if
    a box of a page with positions is in no section. A box finds its section among the page's sorted positions, so
    no box meets every section.
    """
    low, high, extent = borders(direction)
    if alignment not in ("low", "middle", "high"):
        raise ValueError("alignment must be 'low', 'middle' or 'high'")
    at = {"low": F.col(low), "high": F.col(high), "middle": F.col(low) + F.col(extent) / 2}[alignment]
    rest = [c for c in boxes.columns if c not in KEYS]
    placed = boxes.withColumn("_at", at).join(marks_of(positions), list(KEYS)).withColumn("section_idx", below(F.col("_marks"), F.col("_at")))
    inside = (F.col("_at") > -1) & (F.col("section_idx") < F.size("_marks"))
    if check:
        placed = placed.withColumn("section_idx", F.when(inside | F.col("_at").isNull(), F.col("section_idx")).otherwise(F.raise_error(F.lit("a text box is in no section")).cast("int")))
    placed = placed.where(inside)
    if not keep_empty:
        lower = F.when(F.col("section_idx") == 0, F.lit(-1.0)).otherwise(F.get("_marks", F.col("section_idx") - 1))
        return placed.select(*KEYS, *rest, "section_idx", lower.alias("sec_lo"), F.get("_marks", F.col("section_idx")).alias("sec_hi"))
    held = placed.select(*KEYS, "section_idx", *rest)
    return sections_of(positions).join(held, [*KEYS, "section_idx"], "left").select(*KEYS, *rest, "section_idx", "sec_lo", "sec_hi")


def put_in_lines(boxes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Boxes with ``line_no`` and ``in_line`` (0-based): lines from the top, boxes from the left.

    A line ends after a box if the next one begins less than half the mean height above its lower
    edge. Lines are never empty.
    """
    by = Window.partitionBy(*keys).orderBy("top", "box_seq")
    gap = F.coalesce(F.lead("top").over(by) - F.col("bottom"), F.lit(0.0))
    mean = F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy(*keys))
    marked = boxes.withColumn("_break", (gap >= -mean / 2).cast("int"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    lined = marked.withColumn("line_no", F.coalesce(F.sum("_break").over(before), F.lit(0)).cast("int"))
    place = Window.partitionBy(*keys, "line_no").orderBy("left", "top", "box_seq")
    return lined.withColumn("in_line", F.row_number().over(place) - 1).drop("_break")


def _joined(order: list[Column], value: Column, glue: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.coalesce(value, F.lit("")).alias("v"))))
    return F.array_join(F.transform(items, lambda x: x["v"]), glue)


def join_texts(boxes: DataFrame, keys: Sequence[str] = KEYS, sorted_by: str | None = "left", glue: str = " ", strip_text: bool = True) -> DataFrame:
    """One text per key from its boxes, in the order of a column (ties and None: document order)."""
    order = [F.col(sorted_by)] * bool(sorted_by) + [F.col("box_seq")]
    text = _joined(order, F.col("value"), glue)
    return boxes.groupBy(*keys).agg((strip(text) if strip_text else text).alias("text"))


def lines_to_text(lined: DataFrame, keys: Sequence[str] = KEYS, linebreak: str = "\n", linejoin: str = " ", strip_text: bool = True) -> DataFrame:
    """One text per key from boxes with line_no: each line joined and stripped, then the whole."""
    lines = lined.groupBy(*keys, "line_no").agg(_joined([F.col("in_line")], F.col("value"), linejoin).alias("line"))
    if strip_text:
        lines = lines.withColumn("line", strip(F.col("line")))
    text = F.concat(_joined([F.col("line_no")], F.col("line"), linebreak), F.lit(linebreak))
    return lines.groupBy(*keys).agg((strip(text) if strip_text else text).alias("text"))


def split_double_pages(boxes: DataFrame, splits: DataFrame, direction: str = VERTICAL) -> DataFrame:
    """Boxes with ``side`` 0 or 1 by their centre, those of side 1 shifted by the split position (column split_pos)."""
    low, _, extent = borders(HORIZONTAL if check_direction(direction) == VERTICAL else VERTICAL)
    joined = boxes.join(splits.select(*KEYS, "split_pos"), list(KEYS))
    side = F.when(F.col(low) + F.col(extent) / 2 < F.col("split_pos"), 0).otherwise(1)
    shifted = F.col(low) - F.when(F.col("side") == 1, F.col("split_pos")).otherwise(0.0)
    return with_edges(joined.withColumn("side", side).withColumn(low, shifted)).drop("split_pos")


def renumber_split_pages(pages: DataFrame, splits: DataFrame, direction: str = VERTICAL) -> DataFrame:
    """Two pages for each: page_num counts from 1 by page and side; extents are rounded half to even."""
    check_direction(direction)
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_num"))
    cut, full = F.col("split_pos"), F.col("width" if direction == VERTICAL else "height")
    size = F.bround(F.when(F.col("side") == 0, cut).otherwise(full - cut)).cast("int")
    both = pages.join(splits.select(*KEYS, "split_pos"), list(KEYS)).withColumn("_rank", rank).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    width, height = (size, F.bround("height").cast("int")) if direction == VERTICAL else (F.bround("width").cast("int"), size)
    return both.select("doc_id", F.col("page_num").alias("from_page"), "side", (2 * (F.col("_rank") - 1) + F.col("side") + 1).cast("int").alias("page_num"), width.alias("width"), height.alias("height"))


def robust_height(boxes: DataFrame, most_right: Column | None = None) -> DataFrame:
    """Boxes whose height is within half the page's median of it, and whose right edge is low enough."""
    median = F.median("height").over(Window.partitionBy(*KEYS))
    kept = boxes.withColumn("_median", median).where(F.abs(F.col("height") - F.col("_median")) <= F.col("_median") / 2).drop("_median")
    return kept if most_right is None else kept.where(F.col("right") <= most_right)


def footer_boxes(boxes: DataFrame, pages: DataFrame, from_top: float = 0.7, taller: float = 1.5) -> DataFrame:
    """Tall boxes in the lower part of their page."""
    median = F.median("height").over(Window.partitionBy(*KEYS))
    joined = boxes.withColumn("_median", median).join(pages.select(*KEYS, F.col("height").alias("_page")), list(KEYS))
    return joined.where((F.col("top") >= from_top * F.col("_page")) & (F.col("height") >= taller * F.col("_median"))).select(*boxes.columns)


def wide_enough(boxes: DataFrame, least_width: float = 15) -> DataFrame:
    """Boxes of ``least_width`` or more: specks left out."""
    return boxes.where(F.col("width") >= least_width)


def between(positions: DataFrame, bounds: DataFrame) -> DataFrame:
    """Positions from each page's ``top_y`` to its ``bottom_y``, both included; pages without bounds have none."""
    joined = positions.join(bounds.select(*KEYS, "top_y", "bottom_y"), list(KEYS))
    return joined.where("pos >= top_y and pos <= bottom_y").select(*positions.columns)


def line_heights(positions: DataFrame) -> DataFrame:
    """(keys, n_lines, median_line, min_line, max_line): distances of neighbouring line positions; nulls for a single line."""
    step = F.col("pos") - F.lag("pos").over(Window.partitionBy(*KEYS).orderBy("pos"))
    each = positions.withColumn("_step", step).groupBy(*KEYS)
    return each.agg(F.count("*").alias("n_lines"), F.median("_step").alias("median_line"), F.min("_step").alias("min_line"), F.max("_step").alias("max_line"))


def page_medians(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(*KEYS).agg(F.median("height").alias("median_height"), F.min("height").alias("min_height"), F.max("height").alias("max_height"))


def next_boundaries(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """Marks (rows with top) with the next mark's top, or the page height, as ``top_end``."""
    joined = marks.join(pages.select(*KEYS, F.col("height").cast("double").alias("_page")), list(KEYS))
    return joined.withColumn("top_end", F.coalesce(F.lead("top").over(Window.partitionBy(*KEYS).orderBy("top", "box_seq")), F.col("_page"))).drop("_page")
