import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.operators import boxes as B
from folioframe.operators import grid as R
from folioframe.operators.images import detect_lines, draw_line_clusters, draw_lines, draw_positions, edges, fill_ratios, hough, number_segments, split_images, to_grey
from folioframe.operators.lines import projected, with_direction
from folioframe.plans.pipelines import graded_items, straighten
from folioframe.schema import BOXES, PAGES
from folioframe.sources import images as I
from folioframe.sources import pdfxml as P
from folioframe.sources import tables as T
from folioframe.sources.staging import arrow_files
from folioframe.streaming.pages import run_documents, stream_documents

XML = """<?xml version="1.0" encoding="UTF-8"?>
<pdf2xml><page number="1" position="absolute" top="0" left="0" height="120.5" width="200">
<image left="5" top="5" width="9" height="9" src="a.png"/><image left="0" top="0" width="200" height="120" src="b.png"/>
<text top="10" left="20" width="30.9" height="10" font="0">a<b>x</b>c</text>
<text top="10" left="20" width="0" height="10" font="0">gone</text>
<text top="40" left="20" width="10" height="8" font="1"> </text></page>
<page number="2" top="0" left="0" height="50" width="60"><text top="1" left="2" width="3" height="4" font="2">&lt;&amp;é</text></page></pdf2xml>"""


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([("d", XML)], "doc_id string, xml string")


def test_parse(spark, docs):
    pages = P.parse_pages(docs, select_image="topleft").orderBy("page_num").collect()
    assert [(p.page_num, p.image, p.width, p.height) for p in pages] == [(1, "b.png", 200, 120), (2, None, 60, 50)]
    boxes = P.parse_boxes(docs).orderBy("page_num", "box_seq").collect()
    assert [(b.value, b.width, b.right, b.box_seq) for b in boxes] == [("a x c", 30.0, 50.0, 0), (" ", 10.0, 30.0, 2), ("<&é", 3.0, 5.0, 0)]
    assert P.parse_boxes(docs, [2]).count() == 1
    assert P.parse_pages(docs, use_images={1: "o.png", 2: "p.png"}).where("image = 'o.png'").count() == 1
    with pytest.raises(Exception, match="has no image"):
        P.parse_pages(docs, require_image=True).collect()
    with pytest.raises(Exception, match="select_image"):
        P.parse_pages(docs, select_image="other").collect()


def test_xml_and_image_tags(spark, docs, tmp_path):
    again = P.to_xml(P.parse_pages(docs), P.parse_boxes(docs))
    T.write_xml(again, str(tmp_path / "x"))
    assert [r.value for r in P.parse_boxes(again).orderBy("page_num", "box_seq").collect()] == ["a x c", " ", "<&é"]
    tagged = P.parse_pages(P.inject_images(docs, "p-{page}.png")).orderBy("page_num").collect()
    assert [t.image for t in tagged] == ["p-1.png", "p-2.png"]


def boxes_of(spark, rows):
    full = [("d", p, i, l, t, w, h, l + w, t + h, v, None) for i, (p, l, t, w, h, v) in enumerate(rows)]
    return spark.createDataFrame(full, BOXES)


def test_grid_and_tables(spark, tmp_path):
    boxes = boxes_of(spark, [(1, 1.0, 1.0, 8.0, 4.0, "a"), (1, 12.0, 1.0, 4.0, 4.0, "b\nc"), (1, 8.0, 12.0, 4.0, 4.0, "tie"), (1, 90.0, 90.0, 4.0, 4.0, "out")])
    pos = lambda *v: spark.createDataFrame([("d", 1, i, float(x)) for i, x in enumerate(v)], "doc_id string, page_num int, pos_idx int, pos double")
    grid = R.make_grid(pos(0, 10, 20), pos(0, 10, 20))
    fitted = R.fit_to_grid(boxes, grid)
    assert {(r.value, r.row_idx, r.col_idx) for r in fitted.collect()} == {("a", 0, 0), ("b\nc", 0, 1), ("tie", 1, 0)}
    assert [r.value for r in R.unmatched(boxes, fitted).collect()] == ["out"]
    table = R.to_table(fitted, grid, 2)
    assert [tuple(r)[2:] for r in table.orderBy("row_idx").collect()] == [(0, "a", "b\nc"), (1, "tie", "")]
    assert R.column_names(9)[0] == "col01" and R.column_names(4)[0] == "col1" and R.column_names(99)[0] == "col001"
    assert json.loads(R.document_json(grid).first().grids)["1"][0][1] == [[10.0, 0.0], [20.0, 10.0]]
    T.write_csv(table, str(tmp_path / "csv"))
    assert T.read_csv(spark, str(tmp_path / "csv"), table.schema).where("col2 = 'b\nc'").count() == 1
    T.write_grids(grid, str(tmp_path / "grids"))
    with pytest.raises(Exception, match="increase"):
        R.make_grid(pos(0, 10, 5), pos(0, 1)).collect()


def test_lines_of_text(spark):
    boxes = boxes_of(spark, [(1, 30.0, 10.0, 5.0, 10.0, "b"), (1, 10.0, 11.0, 5.0, 10.0, " a"), (1, 10.0, 30.0, 5.0, 10.0, "c ")])
    assert B.lines_to_text(B.put_in_lines(boxes)).first().text == "a b\nc"
    with pytest.raises(Exception, match="no section"):
        B.split_by_positions(boxes, spark.createDataFrame([("d", 1, 0, 15.0)], "doc_id string, page_num int, pos_idx int, pos double"), "v").collect()
    with pytest.raises(ValueError):
        B.deskew_boxes(boxes, 0.1, "r")


def test_image_headers(spark, tmp_path):
    png = I.encode_png(np.zeros((3, 7), np.uint8))
    assert I.image_size(png) == (7, 3) and I.image_size(b"x") is None and I.image_size(b"x" * 30) is None
    assert I.image_size(b"GIF89a" + (9).to_bytes(2, "little") + (4).to_bytes(2, "little") + bytes(20)) == (9, 4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x06" + bytes(10)
    assert I.image_size(jpeg) == (6, 5)
    far = b"\xff\xd8" + (b"\xff\xe1\xea\x60" + bytes(59998)) * 3 + jpeg[8:]
    assert I.image_size(far) == (6, 5)
    sizes = I.sizes_of(spark.createDataFrame([(1, bytearray(far)), (2, None), (3, bytearray(b"no image"))], "k int, content binary")).orderBy("k").collect()
    assert [(r.img_width, r.img_height) for r in sizes] == [(6, 5), (None, None), (None, None)]
    (tmp_path / "a.png").write_bytes(png)
    assert I.image_sizes(spark, str(tmp_path / "*.png")).first().img_width == 7
    row = I.read_images(spark, str(tmp_path)).first()
    assert (row.width, row.height, bytes(row.data)) == (7, 3, bytes(21))


def test_pixels(spark, tmp_path):
    a = np.full((120, 160, 3), 255, np.uint8)
    a[:, 60] = 0
    a[40] = 0
    images = spark.createDataFrame([("d", 1, 160, 120, 3, bytearray(a.tobytes()))], "doc_id string, page_num int, width int, height int, channels int, data binary")
    lines = detect_lines(images, least_votes=60)
    near = {(r.dir, round(r.rho / 2)) for r in lines.collect()}
    assert ("v", 30) in near and ("h", 20) in near
    pages = images.select("doc_id", "page_num", F.col("width").alias("img_width"), F.col("height").alias("img_height"))
    ends = projected(lines, pages)
    drawn = I.pixels_of(bytes(draw_lines(images, ends, background=False).first().data), 160, 120, 3)
    assert tuple(drawn[5, 61]) in ((0, 0, 255), (0, 0, 0)) and drawn.any()
    plain, numbered = (I.pixels_of(bytes(draw_lines(images, ends, background=False, numbers=n).first().data), 160, 120, 3) for n in (False, True))
    assert (numbered > 0).sum() > (plain > 0).sum() and ((plain > 0) <= (numbered > 0)).all()
    assert len(number_segments(80, 0, 0)) == 13 + 12 and number_segments(1, 5, 7)[0] == (7, 7, 7, 8)
    assert draw_line_clusters(images, ends.withColumn("cluster_id", F.lit(0)).limit(0)).count() == 1
    assert draw_positions(images, lines.select("doc_id", "page_num", F.lit(9.0).alias("pos")).distinct(), "v").count() == 1
    halves = split_images(images, spark.createDataFrame([("d", 1, 59.5)], "doc_id string, page_num int, split_pos double")).orderBy("side").collect()
    assert [h.width for h in halves] == [60, 100]
    regions = spark.createDataFrame([("d", 1, 5, 50.0, 0.0, 70.0, 40.0)], "doc_id string, page_num int, region_id long, l double, t double, r double, b double")
    assert fill_ratios(images, regions).first().ratio == pytest.approx(1 / 20)
    assert I.with_png(images).first().png[:4] == b"\x89PNG"
    path = I.write_png(images, f"file://{tmp_path}").first().path
    assert I.image_size(open(path, "rb").read()) == (160, 120)


def test_graded_items(spark):
    a = np.full((200, 200, 3), 255, np.uint8)
    a[52:58, 122:128] = 0
    rows = [(1, 10.0, 10.0, 40.0, 8.0, "Be wertung"), (1, 100.0, 20.0, 8.0, 8.0, "A"), (1, 120.0, 20.0, 8.0, 8.0, "B"), (1, 10.0, 50.0, 10.0, 8.0, "1.1"), (1, 30.0, 50.0, 30.0, 8.0, "good work"), (1, 100.0, 50.0, 10.0, 10.0, " "), (1, 120.0, 50.0, 10.0, 10.0, " ")]
    pages = spark.createDataFrame([("d", 1, 0, None, 200, 200)], PAGES)
    images = spark.createDataFrame([("d", 1, 200, 200, 3, bytearray(a.tobytes()))], "doc_id string, page_num int, width int, height int, channels int, data binary")
    got = graded_items(boxes_of(spark, rows), pages, images, "Bewertung", r"\d\.\d", ["A", "B"]).collect()
    assert [(r.num, r.descr, r.grade) for r in got] == [("1.1", "good work", "B")]


def test_straighten(spark):
    lines = spark.createDataFrame([("d", 1, i, 50.0, t) for i, t in enumerate([0.1, 0.1, np.pi / 2 + 0.1])], "doc_id string, page_num int, line_seq int, rho double, theta double")
    boxes, upright = straighten(boxes_of(spark, [(1, 10.0, 20.0, 5.0, 5.0, "a")]), with_direction(lines), 0.01, 0.01)
    assert sorted(round(r.theta, 6) for r in upright.collect()) == [0, 0, round(np.pi / 2, 6)]
    b, c, s = boxes.first(), np.cos(0.1), np.sin(0.1)
    assert (b.left, b.top) == pytest.approx((10 * c + 20 * s, 20 * c - 10 * s))
    assert straighten(boxes_of(spark, [(1, 10.0, 20.0, 5.0, 5.0, "a")]), with_direction(lines.where("line_seq < 2")), 0.01, 0.01, always_rotate=True)[0].first().left == pytest.approx(b.left)


def test_folders_without_a_file_system():
    with pytest.raises(ValueError, match="abfs"):
        arrow_files("nothere-abfs://x/y")


def test_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/a.xml").write_text(XML)
    query = run_documents(stream_documents(spark, f"{tmp_path}/in"), P.parse_boxes, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_weak_edges():
    """Weak pixels count where a chain of them leads to a strong one, through turns and over any length."""
    grey = np.zeros((40, 60), np.uint8)
    grey[10:, 5:50] = np.linspace(100, 20, 45).astype(np.uint8)
    grey[30:, 40:] = 12
    found = edges(grey, 50, 300)
    assert found[10, 5:49].any() and found.sum() > (edges(grey, 300, 300)).sum() > 0 and not edges(grey, 1000, 1000).any()
    assert to_grey(np.array([[[10, 20, 200]]], np.uint8))[0, 0] == round(1.14 + 11.74 + 59.8)
    colour = np.repeat(grey[:, :, None], 3, 2)
    assert (edges(to_grey(colour), 50, 300) == found).all() and hough(found, 1.0, np.pi / 180, 20) == hough(edges(grey.astype(float), 50, 300), 1.0, np.pi / 180, 20)
