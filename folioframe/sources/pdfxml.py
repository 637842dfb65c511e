"""Positioned-text XML: pages and boxes from files, page images, and writing back."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BOXES, KEYS, PAGES


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, xml): one row per file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("xml"))


def _whole(value: str) -> int:
    return int(float(value))


def choose_image(images: list[dict], page_num: int, required: bool, select: str, use: dict[int, str] | None) -> str | None:
    """The image path of a page: an override, the only image, or by ``select`` ('first', 'topleft').

    Overrides are ignored for pages without images; an unknown ``select`` matters only for several.
    """
    if not images:
        if required:
            raise ValueError(f"page {page_num} has no image")
        return None
    if use and page_num in use:
        return use[page_num]
    if len(images) == 1:
        return images[0]["src"]
    if select == "first":
        return images[0]["src"]
    if select != "topleft":
        raise ValueError("select_image must be 'first' or 'topleft'")
    for image in images:
        if _whole(image["top"]) == 0 and _whole(image["left"]) == 0:
            return image["src"]
    raise ValueError(f"page {page_num} has no image at its top left corner")


def _pages_of(xml: str, wanted: set[int] | None) -> list[tuple[int, int, ET.Element]]:
    """(number, place, element) of a document's direct pages; of equal numbers the last, at the first one's place."""
    found: dict[int, tuple[int, int, ET.Element]] = {}
    for page in ET.fromstring(xml).findall("page"):
        number = _whole(page.attrib["number"])
        if wanted is None or number in wanted:
            place = found[number][1] if number in found else len(found)
            found[number] = (number, place, page)
    return list(found.values())


def parse_pages(docs: DataFrame, page_nums: Sequence[int] | None = None, require_image: bool = False, select_image: str = "first", use_images: dict[int, str] | None = None) -> DataFrame:
    """The page rows of (doc_id, xml)."""
    wanted = set(page_nums) if page_nums is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, xml in zip(pdf["doc_id"], pdf["xml"]):
                for number, place, page in _pages_of(xml, wanted):
                    image = choose_image([i.attrib for i in page.findall("image")], number, require_image, select_image, use_images)
                    rows.append((doc, number, place, image, _whole(page.attrib["width"]), _whole(page.attrib["height"])))
            yield pd.DataFrame(rows, columns=PAGES.names)

    return docs.select("doc_id", "xml").mapInPandas(run, PAGES)


def parse_boxes(docs: DataFrame, page_nums: Sequence[int] | None = None) -> DataFrame:
    """The box rows of (doc_id, xml): fragments of a text joined by blanks, boxes without area left out."""
    wanted = set(page_nums) if page_nums is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, xml in zip(pdf["doc_id"], pdf["xml"]):
                for number, _, page in _pages_of(xml, wanted):
                    for seq, t in enumerate(page.findall("text")):
                        left, top, width, height = (float(_whole(t.attrib[a])) for a in ("left", "top", "width", "height"))
                        rows.append((doc, number, seq, left, top, width, height, left + width, top + height, " ".join(t.itertext()), t.attrib.get("font")))
            yield pd.DataFrame(rows, columns=BOXES.names)

    return docs.select("doc_id", "xml").mapInPandas(run, BOXES).where("width > 0 and height > 0")


def parse_fonts(docs: DataFrame, page_nums: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, page_num, font_seq, font, size, family, color): the font specifications of every page, as text."""
    wanted = set(page_nums) if page_nums is not None else None
    schema = "doc_id string, page_num int, font_seq int, font string, size string, family string, color string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (doc, number, seq, *(f.attrib.get(a) for a in ("id", "size", "family", "color")))
                for doc, xml in zip(pdf["doc_id"], pdf["xml"]) for number, _, page in _pages_of(xml, wanted) for seq, f in enumerate(page.findall("fontspec"))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "font_seq", "font", "size", "family", "color"])

    return docs.select("doc_id", "xml").mapInPandas(run, schema)


def split_fonts(fonts: DataFrame, numbers: DataFrame) -> DataFrame:
    """The font specifications of each page on both of its halves: ``numbers`` has doc_id, from_page, side and page_num."""
    halves = numbers.select("doc_id", F.col("from_page").alias("_from"), F.col("page_num").alias("_to"))
    joined = fonts.join(halves, (fonts["doc_id"] == halves["doc_id"]) & (fonts["page_num"] == halves["_from"]))
    return joined.select(fonts["doc_id"], F.col("_to").alias("page_num"), *(fonts[c] for c in fonts.columns if c not in KEYS))


def _escape(text: F.Column | str):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def to_xml(pages: DataFrame, boxes: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """(doc_id, xml): documents built from page, box and, on wish, font rows; coordinates are rounded half to even."""
    whole = lambda c: F.bround(F.col(c)).cast("long").cast("string")
    attrs = [x for a in ("top", "left", "width", "height") for x in (F.lit(f' {a}="'), whole(a), F.lit('"'))]
    font = F.concat(F.lit(' font="'), _escape(F.col("font")), F.lit('"')) if "font" in boxes.columns else F.lit("")
    node = F.concat(F.lit("<text"), *attrs, F.coalesce(font, F.lit("")), F.lit(">"), _escape(F.coalesce("value", F.lit(""))), F.lit("</text>"))
    texts = boxes.select(*KEYS, "box_seq", node.alias("node")).groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_seq", "node"))), lambda x: x["node"]), "\n").alias("nodes"))
    image = F.coalesce(F.concat(F.lit('<image top="0" left="0" width="'), F.col("width").cast("string"), F.lit('" height="'), F.col("height").cast("string"), F.lit('" src="'), _escape(F.col("image")), F.lit('"/>\n')), F.lit("")) if "image" in pages.columns else F.lit("")
    head = F.concat(F.lit('<page number="'), F.col("page_num").cast("string"), F.lit('" width="'), F.col("width").cast("string"), F.lit('" height="'), F.col("height").cast("string"), F.lit('">\n'), image)
    if fonts is None:
        pages = pages.withColumn("_fonts", F.lit(""))
    else:
        spec = F.concat(F.lit("<fontspec"), *(F.coalesce(F.concat(F.lit(f' {a}="'), _escape(F.col(c)), F.lit('"')), F.lit("")) for a, c in (("id", "font"), ("size", "size"), ("family", "family"), ("color", "color"))), F.lit("/>\n"))
        listed = fonts.select(*KEYS, "font_seq", spec.alias("spec")).groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("font_seq", "spec"))), lambda x: x["spec"]), "").alias("_fonts"))
        pages = pages.join(listed, list(KEYS), "left")
    whole_pages = pages.join(texts, list(KEYS), "left").select("doc_id", "page_num", F.concat(head, F.coalesce("_fonts", F.lit("")), F.coalesce("nodes", F.lit("")), F.lit("\n</page>")).alias("page"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "page"))), lambda x: x["page"]), "\n")
    return whole_pages.groupBy("doc_id").agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<pdf2xml>\n'), body, F.lit("\n</pdf2xml>")).alias("xml"))


def set_page_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with the image paths and sizes of ``images`` (keys, path, img_width, img_height); an unknown size fails the query."""
    joined = pages.drop("image", "img_width", "img_height").join(images.select(*KEYS, F.col("path").alias("image"), "img_width", "img_height"), list(KEYS), "left")
    known = F.when(F.col("image").isNotNull() & F.col("img_width").isNull(), F.raise_error(F.lit("an image size is unknown")).cast("int")).otherwise(F.col("img_width"))
    return joined.withColumn("img_width", known)


def inject_images(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, xml) with an image element after every page's start tag.

    ``pattern`` names the file, with {page} for the page number; the size is the page's own.
    """
    tag = r'(?m)(<page\b(?=[^>]*\bnumber="(\d+)")(?=[^>]*\bheight="([^"]*)")(?=[^>]*\bwidth="([^"]*)")[^>]*>)'
    source = re.sub(r"([\\$])", r"\\\1", pattern).replace("{page}", "$2")
    return docs.withColumn("xml", F.regexp_replace("xml", F.lit(tag), F.lit(f'$1\n<image top="0" left="0" width="$4" height="$3" src="{source}"/>')))
