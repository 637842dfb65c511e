"""Whole extraction plans over document tables; nothing runs on the driver page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import all_in
from ..functions.text import label_equals, matches_start
from ..operators import boxes as B
from ..operators import clusters as C
from ..operators import grid as R
from ..operators import lines as L
from ..schema import KEYS, ROTATION
from ..sources.staging import staged


def _long(fitted: DataFrame) -> DataFrame:
    return fitted.select(*KEYS, F.posexplode("positions").alias("pos_idx", "pos"))


def _indexed(positions: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("pos")) - 1
    return positions.select(*KEYS, "pos").distinct().withColumn("pos_idx", rank)


def line_guided(boxes: DataFrame, pages: DataFrame, lines: DataFrame, n_columns: int, cluster_gap: float, model_gap: float, rows_gap: float, row_pattern: str | None = None, footer_words: list[str] | None = None, least_angle: float = 0.0087, same_angle: float = 0.0175, empty_ratio: float = 0.1, most_difference: float | None = None) -> DataFrame:
    """Tables whose columns follow ruling lines.

    Rotation is estimated and undone, vertical lines are clustered and fitted to the document's column
    model, rows come from boxes of ordinary height; the first row that matches ``row_pattern`` begins the table and
    tall boxes of ``footer_words`` end it. ``pages`` has width, height, img_width and img_height.
    """
    found = staged(L.estimate_rotation(lines, least_angle, same_angle), "rotation")
    undo = found.withColumn("radians", -F.col("radians"))
    lines, boxes = L.apply_rotation(lines, undo), staged(B.repair_boxes(boxes, found), "boxes")
    scales = pages.select(*KEYS, (F.col("img_width") / F.col("width")).alias("scale"))
    clusters = staged(L.line_clusters(lines, pages, "v", cluster_gap), "clusters")
    clusters = staged(L.drop_empty_sections(clusters, boxes, scales, "v", empty_ratio), "clusters")
    columns = _long(C.adjust_centers(clusters, "pos", n_columns + 1, model_gap, scales, most_difference))
    ordinary = B.robust_height(boxes)
    centers = C.cluster_centers(C.break_clusters(B.border_positions(ordinary, "v"), "pos", rows_gap), "pos").select(*KEYS, F.col("center").alias("pos"))
    edge = pages.select(*KEYS, F.col("height").cast("double").alias("pos"))
    rows = centers.unionByName(edge)
    if row_pattern:
        starts = boxes.where(matches_start(F.col("value"), row_pattern)).groupBy(*KEYS).agg(F.min("top").alias("_start"))
        rows = rows.join(starts, list(KEYS)).where(F.col("pos") >= F.col("_start") - rows_gap).drop("_start")
    if footer_words:
        known = F.array(*map(F.lit, footer_words))
        ends = B.footer_boxes(boxes, pages).where(all_in(F.split("value", " "), known)).groupBy(*KEYS).agg(F.min("top").alias("_end"))
        rows = rows.join(ends, list(KEYS), "left").where(F.col("_end").isNull() | (F.col("pos") <= F.col("_end"))).drop("_end")
    grid = staged(R.make_grid(columns, _indexed(rows)), "grid")
    return R.to_table(R.fit_to_grid(boxes, grid), grid, n_columns)


def double_pages(boxes: DataFrame, pages: DataFrame, lines: DataFrame, separator_gap: float, column_gap: float, row_pattern: str, n_columns: int) -> DataFrame:
    """Scanned double pages: split at the separator line, renumber, then rows from a pattern and columns from left edges."""
    found = L.separator_line(L.line_clusters(lines, pages, "v", separator_gap), pages)
    scale = pages.select(*KEYS, (F.col("img_width") / F.col("width")).alias("scale"))
    splits = staged(found.join(scale, list(KEYS)).select(*KEYS, (F.col("separator") / F.col("scale")).alias("split_pos")), "splits")
    numbers = B.renumber_split_pages(pages, splits)
    halves = B.split_double_pages(boxes, splits).withColumnRenamed("page_num", "from_page")
    own = staged(halves.join(numbers.select("doc_id", "from_page", "side", "page_num"), ["doc_id", "from_page", "side"]).drop("from_page", "side"), "halves")
    tops = C.cluster_centers(C.break_clusters(own, "bottom", 1, order=("box_seq",)), "bottom", "max").select(*KEYS, F.col("center").alias("pos"))
    table = staged(C.table_rows(tops, own, row_pattern), "rows")
    rows = _indexed(table.select(*KEYS, F.col("row_start").alias("pos")).unionByName(table.select(*KEYS, F.col("row_end").alias("pos"))))
    inside = own.join(table.groupBy(*KEYS).agg(F.min("row_start").alias("_a"), F.max("row_end").alias("_b"), F.count("*").alias("_rows")), list(KEYS)).where("bottom > _a and bottom <= _b")
    inside = staged(inside, "inside")
    lefts = C.cluster_centers(C.break_clusters(inside, "left", column_gap, order=("box_seq",)), "left")
    columns = _indexed(C.largest_clusters(lefts, n_columns).select(*KEYS, F.col("center").alias("pos")).unionByName(inside.groupBy(*KEYS).agg(F.max("right").alias("pos"))))
    grid = staged(R.make_grid(columns, rows), "grid")
    return R.to_table(R.fit_to_grid(own, grid), grid, n_columns, in_lines=True)


def position_only(boxes: DataFrame, pages: DataFrame, rows_gap: float, columns_gap: float, n_columns: int, most_difference: float) -> DataFrame:
    """Columns and rows from box positions alone.

    Rows are clusters of tops, bordered midway; columns are the largest clusters of left edges and the
    rightmost right edge, corrected by the document's medians.
    """
    rows = C.row_positions(C.break_clusters(boxes, "top", rows_gap, order=("box_seq",)))
    bottom = boxes.groupBy(*KEYS).agg(F.max("bottom").alias("pos"))
    rows = _indexed(rows.select(*KEYS, "pos").unionByName(bottom))
    lefts = C.cluster_centers(C.break_clusters(boxes, "left", columns_gap, order=("box_seq",)), "left", "min")
    chosen = staged(C.largest_clusters(lefts, n_columns).select(*KEYS, F.col("center").alias("pos")), "columns")
    edge = C.last_border(boxes, chosen.groupBy(*KEYS).agg(F.max("pos").alias("pos")), pages)
    columns = C.correct_columns(_indexed(chosen.unionByName(edge)), n_columns + 1, most_difference)
    grid = staged(R.make_grid(columns, rows), "grid")
    return R.to_table(R.fit_to_grid(boxes, grid), grid, n_columns)


def graded_items(boxes: DataFrame, pages: DataFrame, images: DataFrame, section_label: str, item_pattern: str, letters: list[str]) -> DataFrame:
    """(keys, section_seq, item_seq, num, descr, grade): items of labelled sections and the fullest of their tick boxes.

    Sections run from their label to the next; items begin at boxes that match ``item_pattern``; their
    description is the text to the right, up to the grade columns, whose header boxes hold ``letters``.
    """
    from .images_lookup import grades

    labels = boxes.where(label_equals(F.col("value"), section_label))
    sections = B.next_boundaries(labels, pages).select(*KEYS, F.col("box_seq").alias("section_seq"), F.col("top").alias("_from"), F.col("top_end").alias("_to"))
    inside = boxes.join(sections, list(KEYS)).where("top >= _from and top < _to")
    header = inside.where(F.col("value").isin(letters)).groupBy(*KEYS, "section_seq").agg(F.min("left").alias("_grade_left"), F.max("right").alias("_grade_right"))
    hit = inside.where(matches_start(F.col("value"), item_pattern))
    w = Window.partitionBy(*KEYS, "section_seq").orderBy("top", "box_seq")
    items = hit.withColumn("_end", F.coalesce(F.lead("top").over(w), F.col("_to"))).select(*KEYS, "section_seq", F.col("box_seq").alias("item_seq"), F.col("value").alias("num"), F.col("left").alias("_l"), F.col("right").alias("_r"), F.col("top").alias("_y"), "_end").join(header, [*KEYS, "section_seq"])
    near = boxes.select(*KEYS, "box_seq", "left", "top", "right", "bottom", "value").join(items, list(KEYS)).where("top >= _y - 2 and top < _end - 2")
    texts = near.where(r"box_seq <> item_seq and `left` > _r - 5 and `left` >= _l and `left` < _grade_left and value rlike '\\S'")
    descr = B.join_texts(texts.withColumn("_order", F.col("top") * 100000 + F.col("left")), (*KEYS, "section_seq", "item_seq"), "_order").withColumnRenamed("text", "descr")
    ticks = near.where(r"not value rlike '\\S' and `left` >= _grade_left and `left` <= _grade_right")
    found = grades(ticks, images, pages, letters)
    keys = [*KEYS, "section_seq", "item_seq"]
    return items.select(*keys, "num").join(descr, keys, "left").join(found, keys, "left")


def straighten(boxes: DataFrame, lines: DataFrame, least: float, same: float, always_rotate: bool = False) -> tuple[DataFrame, DataFrame]:
    """Boxes and lines with the estimated rotation undone; ``always_rotate`` treats skew as rotation."""
    found = L.estimate_rotation(lines, least, same)
    if always_rotate:
        found = found.withColumn("kind", F.when(F.col("radians").isNotNull(), ROTATION))
    return B.repair_boxes(boxes, found), L.apply_rotation(lines, found.withColumn("radians", -F.col("radians")))
