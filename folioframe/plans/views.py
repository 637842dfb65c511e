"""Document tables derived from the driver's tables: boxes, lines, positions, word boxes.

A page has 500 boxes, so pages stay small whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import with_direction
from ..schema import KEYS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('d', event_id div 10000) doc_id", "cast((event_id div 500) % 20 + 1 as int) page_num", "cast(event_id % 500 as int) box_seq",
        "cast(event_id * 37 % 800 as double) `left`", "cast(event_id * 53 % 1100 as double) top", "cast(20 + event_id % 60 as double) width",
        "cast(8 + event_id % 9 as double) height", "cast(event_id * 37 % 800 + 20 + event_id % 60 as double) `right`",
        "cast(event_id * 53 % 1100 + 8 + event_id % 9 as double) bottom", "event_type value",
    )


BOXES = """boxes AS (SELECT 'd' || CAST(event_id // 10000 AS VARCHAR) AS doc_id, CAST((event_id // 500) % 20 + 1 AS INTEGER) AS page_num,
 CAST(event_id % 500 AS INTEGER) AS box_seq, CAST(event_id * 37 % 800 AS DOUBLE) AS "left", CAST(event_id * 53 % 1100 AS DOUBLE) AS top,
 CAST(20 + event_id % 60 AS DOUBLE) AS width, CAST(8 + event_id % 9 AS DOUBLE) AS height,
 CAST(event_id * 37 % 800 + 20 + event_id % 60 AS DOUBLE) AS "right", CAST(event_id * 53 % 1100 + 8 + event_id % 9 AS DOUBLE) AS bottom,
 event_type AS value FROM events)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select(*KEYS).distinct().selectExpr("*", "880 width", "1120 height", "1000 img_width", "1400 img_height")


PAGES = """pages_v AS (SELECT DISTINCT doc_id, page_num, 880 AS width, 1120 AS height, 1000 AS img_width, 1400 AS img_height FROM boxes)"""


def steps(spark: SparkSession, sf_dir: str, start: int, stop: int, step: int) -> DataFrame:
    """The same positions on every page."""
    return pages(spark, sf_dir).select(*KEYS, F.posexplode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))).alias("pos_idx", "_p")).select(*KEYS, "pos_idx", F.col("_p").cast("double").alias("pos"))


def steps_sql(name: str, start: int, stop: int, step: int) -> str:
    return f"{name} AS (SELECT doc_id, page_num, CAST((p - {start}) // {step} AS INTEGER) AS pos_idx, CAST(p AS DOUBLE) AS pos FROM pages_v, range({start}, {stop + 1}, {step}) r(p))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('d', o_orderkey div 800) doc_id", "cast((o_orderkey div 40) % 20 + 1 as int) page_num", "cast(o_orderkey % 40 as int) line_seq",
        "cast(o_custkey * 7 % 900 as double) rho",
        "case when o_orderkey % 3 = 0 then 0d else cast(1.5707963267948966 as double) end + ((o_orderkey div 40) % 5 - 1) / 100d + (o_orderkey % 11) / 1000d theta",
    )
    return with_direction(rows)


NORMAL = """(CASE WHEN {0} >= 6.283185307179586 THEN {0} - (CASE WHEN {0} / 6.283185307179586 - floor({0} / 6.283185307179586) > 0.99999
 THEN floor({0} / 6.283185307179586) + 1 ELSE floor({0} / 6.283185307179586) END) * 6.283185307179586
 WHEN {0} < 0 THEN abs({0} - (CASE WHEN {0} / 6.283185307179586 - ceil({0} / 6.283185307179586) < -0.99999
 THEN ceil({0} / 6.283185307179586) - 1 ELSE ceil({0} / 6.283185307179586) END) * 6.283185307179586) ELSE {0} END)"""
DIRECTION = "(CASE WHEN abs(1.5707963267948966 - {0}) > 0.7853981633974483 THEN 'v' ELSE 'h' END)"

LINES = f"""lines0 AS (SELECT 'd' || CAST(o_orderkey // 800 AS VARCHAR) AS doc_id, CAST((o_orderkey // 40) % 20 + 1 AS INTEGER) AS page_num,
 CAST(o_orderkey % 40 AS INTEGER) AS line_seq, CAST(o_custkey * 7 % 900 AS DOUBLE) AS rho,
 CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE 1.5707963267948966::DOUBLE END + ((o_orderkey // 40) % 5 - 1) / 100.0::DOUBLE + (o_orderkey % 11) / 1000.0::DOUBLE AS theta FROM orders),
 lines1 AS (SELECT *, {NORMAL.format('theta')} AS theta_norm FROM lines0), lines AS (SELECT *, {DIRECTION.format('theta_norm')} AS dir FROM lines1)"""


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(*KEYS).distinct().selectExpr("*", "1000 img_width", "1400 img_height")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each blank-separated word of ``documents``: one page per document, lines at line ends."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("t"), F.col("doc_id")).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("_line", "_text"))
    each = docs.select("doc_id", "_line", F.posexplode(F.split("_text", " ")).alias("_i", "value"))
    return each.selectExpr(
        "doc_id", "1 page_num", "_line * 100000 + _i box_seq", "cast(_i * 10 as double) `left`", "cast(_line * 12 as double) top", "8d width", "10d height",
        "cast(_i * 10 + 8 as double) `right`", "cast(_line * 12 + 10 as double) bottom", "value",
    )


WORDS = """text_lines AS (SELECT 't' || CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
 words AS (SELECT doc_id, line, unnest(string_split(txt, ' ')) AS value, generate_subscripts(string_split(txt, ' '), 1) - 1 AS i FROM text_lines)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and rectangles from ``lineitem`` rows, with a unique id."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_orderkey % 97 as double) x1", "cast(l_partkey % 89 as double) y1", "cast(l_suppkey % 83 as double) x2", "cast(l_linenumber * 11 as double) y2",
        "cast(l_partkey % 71 as double) x3", "cast(l_orderkey % 61 as double) y3", "cast(l_quantity as double) x4", "cast(l_suppkey % 53 as double) y4",
    )


SEGMENTS = """segments AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_orderkey % 97 AS DOUBLE) x1, CAST(l_partkey % 89 AS DOUBLE) y1, CAST(l_suppkey % 83 AS DOUBLE) x2,
 CAST(l_linenumber * 11 AS DOUBLE) y2, CAST(l_partkey % 71 AS DOUBLE) x3, CAST(l_orderkey % 61 AS DOUBLE) y3, CAST(l_quantity AS DOUBLE) x4, CAST(l_suppkey % 53 AS DOUBLE) y4 FROM lineitem)"""
