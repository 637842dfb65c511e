"""Grades from tick boxes: positions paired with header letters, and the fullest box."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.images import fill_ratios, fullest
from ..schema import KEYS


def grades(ticks: DataFrame, images: DataFrame, pages: DataFrame, letters: list[str]) -> DataFrame:
    """(keys, section_seq, item_seq, grade): items with exactly one empty box per letter, paired from the left."""
    item = [*KEYS, "section_seq", "item_seq"]
    place = F.row_number().over(Window.partitionBy(*item).orderBy("left", "box_seq"))
    many = F.count("*").over(Window.partitionBy(*item))
    paired = ticks.withColumns({"_i": place, "_n": many}).where(F.col("_n") == len(letters))
    paired = paired.withColumn("choice", F.element_at(F.array(*map(F.lit, letters)), F.col("_i")))
    sized = paired.join(pages.select(*KEYS, F.col("width").alias("page_width"), F.col("height").alias("page_height")), list(KEYS))
    regions = sized.select(*item, F.col("box_seq").cast("long").alias("region_id"), "choice", F.col("left").alias("l"), F.col("top").alias("t"), F.col("right").alias("r"), F.col("bottom").alias("b"), "page_width", "page_height")
    grouped = regions.withColumn("group_id", F.struct("section_seq", "item_seq"))
    best = fullest(fill_ratios(images, regions), grouped.select(*KEYS, "group_id", "region_id", "choice"))
    return best.select(*KEYS, "group_id.section_seq", "group_id.item_seq", F.col("choice").alias("grade"))
