"""Pixel operators in numpy over image rows: line detection, splitting, drawing, fill ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEYS, VERTICAL, check_direction
from ..sources.images import pixels_of
from ..sources.staging import bounded_batches, spread
from .lines import with_direction

#: Weights of blue, green and red in grey.
GREY = (0.114, 0.587, 0.299)


def to_grey(bgr: np.ndarray) -> np.ndarray:
    if bgr.strides[2] == 0:  # a widened grey image: the weights sum to one
        return bgr[:, :, 0]
    return np.rint(bgr.astype(float) @ np.array(GREY)).astype(np.uint8)


def edges(grey: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny edges: Sobel gradients, thinning across the edge, hysteresis between two thresholds.

    Only gradients are computed for all pixels, the rest for those above a threshold.
    """
    p = np.pad(grey.astype(np.int16) if grey.dtype == np.uint8 else grey, 1, mode="edge")
    across, over = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    dx = across[:-2] + 2 * across[1:-1] + across[2:]
    dy = over[:, :-2] + 2 * over[:, 1:-1] + over[:, 2:]
    m = np.pad(np.abs(dx) + np.abs(dy), 1).ravel()
    width = grey.shape[1] + 2
    at = np.flatnonzero(m > min(low, high))
    at = at[(at // width % (grey.shape[0] + 1) > 0) & (at % width % (width - 1) > 0)]  # with a threshold below 0, not the margin
    inner = (at // width - 1) * (width - 2) + at % width - 1
    gx, gy, own = dx.ravel()[inner].astype(float), dy.ravel()[inner].astype(float), m[at]
    flat, steep = np.abs(gy) < np.abs(gx) * math.tan(math.pi / 8), np.abs(gy) > np.abs(gx) * math.tan(3 * math.pi / 8)
    step = np.where(flat, 1, np.where(steep, width, np.where(gx * gy >= 0, width + 1, width - 1)))
    thin = (own > m[at - step]) & (own >= m[at + step])
    out, waiting = np.zeros(m.shape, bool), np.zeros(m.shape, bool)
    found = at[thin & (own > high)]
    waiting[at[thin & (own > low)]] = True
    around = np.array([i * width + j for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while len(found):  # from pixel to pixel, each once
        out[found], waiting[found] = True, False
        near = (found[:, None] + around).ravel()
        found = np.unique(near[waiting[near]])
    return out.reshape(-1, width)[1:-1, 1:-1]


def hough(edge: np.ndarray, rho_step: float, theta_step: float, least_votes: int) -> list[tuple[float, float, int]]:
    """(rho, theta, votes) of local maxima of the line accumulator, most votes first."""
    y, x = (v.astype(float) for v in np.divmod(np.flatnonzero(edge), edge.shape[1]))
    angles = np.arange(0, math.pi - 1e-12, theta_step)
    half = int(round((edge.shape[0] + edge.shape[1]) / rho_step))
    width = 2 * half + 3
    votes = np.zeros((len(angles) + 2, width), np.int64)
    block = max((1 << 16) // max(len(x), 1), 1)  # angles at a time
    for k in range(0, len(angles), block):
        cos, sin = (np.array([[f(a)] for a in angles[k : k + block]]) for f in (math.cos, math.sin))
        r = x * cos
        r += y * sin
        r /= rho_step
        r = np.rint(r, out=r).astype(np.int64)
        r += (half + 1 + width * np.arange(len(cos)))[:, None]
        votes[k + 1 : k + 1 + len(cos)] = np.bincount(r.ravel(), minlength=width * len(cos)).reshape(-1, width)
    k, r = np.nonzero(votes[1:-1, 1:-1] > least_votes)
    k, r = k + 1, r + 1
    own = votes[k, r]
    top = (own > votes[k, r - 1]) & (own >= votes[k, r + 1]) & (own > votes[k - 1, r]) & (own >= votes[k + 1, r])
    found = [((r - 1 - half) * rho_step, float(angles[k - 1]), int(n)) for k, r, n in zip(k[top], r[top], own[top])]
    return sorted(found, key=lambda f: (-f[2], f[1], f[0]))


def detect_lines(images: DataFrame, low: float = 50, high: float = 150, rho_step: float = 1.0, theta_step: float = math.pi / 180, least_votes: int = 100) -> DataFrame:
    """Lines (keys, line_seq, rho, theta, theta_norm, dir) of image rows (keys, width, height, channels, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, w, h, c, data in pdf.itertuples(index=False):
                found = hough(edges(to_grey(pixels_of(bytes(data), w, h, c)), low, high), rho_step, theta_step, least_votes)
                rows += [(doc, page, i, r, t) for i, (r, t, _) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "line_seq", "rho", "theta"])

    bounded_batches(images.sparkSession)
    found = images.select(*KEYS, "width", "height", "channels", "data").mapInPandas(run, "doc_id string, page_num int, line_seq int, rho double, theta double")
    return with_direction(found)


def split_images(images: DataFrame, splits: DataFrame, direction: str = VERTICAL) -> DataFrame:
    """Two BGR image rows (side 0 and 1) for each, cut at split_pos rounded half to even; a position off the image fails."""
    across = check_direction(direction) == VERTICAL

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, w, h, c, data, at in pdf.itertuples(index=False):
                at = round(at)
                if not 0 <= at <= (w if across else h):
                    raise ValueError("the split position is not on the image")
                a = pixels_of(bytes(data), w, h, c)
                for side, part in enumerate((a[:, :at], a[:, at:]) if across else (a[:at], a[at:])):
                    rows.append((doc, page, side, part.shape[1], part.shape[0], 3, part.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "side", "width", "height", "channels", "data"])

    joined = with_images(images, spread(splits.select(*KEYS, "split_pos"), *KEYS)).select(*KEYS, "width", "height", "channels", "data", "split_pos")
    return joined.mapInPandas(run, "doc_id string, page_num int, side int, width int, height int, channels int, data binary")


def cluster_colour(i: int) -> tuple[int, int, int]:
    """The BGR colour of the i-th cluster (from 0) of several."""
    return (i, i * i, i**3)


def draw_segments(canvas: np.ndarray, segments: list[tuple[float, float, float, float]], colours: list[tuple[int, int, int]], width: int = 2) -> np.ndarray:
    """Draw lines on a copy of a BGR array; points outside are left out."""
    out = canvas.copy()
    h, w = out.shape[:2]
    for (ax, ay, bx, by), colour in zip(segments, colours):
        if not all(map(math.isfinite, (ax, ay, bx, by))):
            continue
        n = int(max(abs(bx - ax), abs(by - ay))) + 1
        x, y = np.rint(np.linspace(ax, bx, n)).astype(int), np.rint(np.linspace(ay, by, n)).astype(int)
        for k in range(width):
            dx, dy = (k, 0) if abs(by - ay) >= abs(bx - ax) else (0, k)
            ok = (x + dx >= 0) & (x + dx < w) & (y + dy >= 0) & (y + dy < h)
            out[y[ok] + dy, x[ok] + dx] = colour
    return out


#: The digits 0 to 9, three dots wide and five high.
DIGITS = ("### #.# #.# #.# ###", ".#. ##. .#. .#. ###", "### ..# ### #.. ###", "### ..# ### ..# ###", "#.# #.# ### ..# ..#", "### #.. ### ..# ###", "### #.. ### #.# ###", "### ..# ..# ..# ..#", "### #.# ### #.# ###", "### #.# ### ..# ###")


def number_segments(number: int, x: float, y: float) -> list[tuple[float, float, float, float]]:
    """The dots of a number as segments, from (x, y) to the right and down, each dot two pixels wide and high."""
    out = []
    for k, digit in enumerate(str(number)):
        for j, row in enumerate(DIGITS[int(digit)].split()):
            out += [(x + 8 * k + 2 * i, y + 2 * j, x + 8 * k + 2 * i, y + 2 * j + 1) for i, dot in enumerate(row) if dot == "#"]
    return out


def with_images(images: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Image rows joined with ``small``, rows of the same pages: by a hash join on ``small``, page by page.

    Spark knows the size of neither side before they are made: left to itself it may send all pixels to the driver as
    a broadcast, sort them, or give them, as they compress well, to a few tasks.
    """
    return spread(images, *KEYS).join(small.hint("shuffle_hash"), list(KEYS), how)


def _drawn(images: DataFrame, marks: DataFrame, background: bool, across: str | None = None) -> DataFrame:
    """Images with the segments of ``marks`` (keys, ax, ay, bx, by, b, g, r) drawn; images without any are copied.

    With a direction ``across`` marks have ``pos`` in place of ends and go over the whole image.
    Pixels that the drawing does not show are not read."""
    listed = spread(marks, *KEYS).groupBy(*KEYS).agg(F.collect_list(F.array(*(("pos",) if across else ("ax", "ay", "bx", "by")), F.col("b").cast("double"), F.col("g").cast("double"), F.col("r").cast("double"))).alias("marks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, w, h, marks_of, *pixels in pdf.itertuples(index=False):
                base = pixels_of(bytes(pixels[1]), w, h, pixels[0]) if background else np.zeros((h, w, 3), np.uint8)
                all_marks = [] if marks_of is None else [tuple(m) for m in marks_of]
                ends = [m[:4] if across is None else (m[0], 0.0, m[0], float(h)) if across == VERTICAL else (0.0, m[0], float(w), m[0]) for m in all_marks]
                out = draw_segments(base, ends, [tuple(int(v) for v in m[-3:]) for m in all_marks])
                rows.append((doc, page, w, h, 3, out.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "width", "height", "channels", "data"])

    shown = ("channels", "data") if background else ()
    joined = with_images(images.select(*KEYS, "width", "height", *shown), listed, "left").select(*KEYS, "width", "height", "marks", *shown)
    return joined.mapInPandas(run, "doc_id string, page_num int, width int, height int, channels int, data binary")


def draw_lines(images: DataFrame, projected: DataFrame, background: bool = True, numbers: bool = False) -> DataFrame:
    """Horizontal lines in green, vertical ones in red, from end points ax, ay, bx, by; with ``numbers`` each
    line's line_seq stands at its middle in the line's colour."""
    if numbers:
        @F.pandas_udf("array<struct<ax:double,ay:double,bx:double,by:double>>")
        def dots(seq: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([[dict(zip(("ax", "ay", "bx", "by"), map(float, d))) for d in number_segments(int(n), a, b)] for n, a, b in zip(seq, x, y)])

        middle = projected.where("not isnan(ax + ay + bx + by)").withColumn("_dot", F.explode(dots("line_seq", F.rint((F.col("ax") + F.col("bx")) / 2), F.rint((F.col("ay") + F.col("by")) / 2))))
        projected = projected.select(*KEYS, "dir", "ax", "ay", "bx", "by").unionByName(middle.select(*KEYS, "dir", "_dot.*"))
    own = projected.select(*KEYS, "ax", "ay", "bx", "by", F.lit(0).alias("b"), F.when(F.col("dir") == "h", 255).otherwise(0).alias("g"), F.when(F.col("dir") == "h", 0).otherwise(255).alias("r"))
    return _drawn(images, own, background)


def draw_line_clusters(images: DataFrame, clustered: DataFrame, background: bool = True) -> DataFrame:
    """Each cluster's lines in a colour of its own; pages without clusters keep the base image."""
    page = Window.partitionBy(*KEYS)
    n = (F.max("cluster_id").over(page) + 1).cast("double")
    step = F.floor(F.lit(255.0) / n)
    i = (F.col("cluster_id") + 2).cast("double")
    shade = lambda p: F.pmod(step * F.pow(i, F.lit(p)), F.lit(256)).cast("int")
    return _drawn(images, clustered.select(*KEYS, "ax", "ay", "bx", "by", shade(1).alias("b"), shade(2).alias("g"), shade(3).alias("r")), background)


def draw_positions(images: DataFrame, positions: DataFrame, direction: str, background: bool = True) -> DataFrame:
    """Lines over the whole image at ``pos``, in green (horizontal) or red."""
    vertical = check_direction(direction) == VERTICAL
    own = positions.select(*KEYS, F.col("pos").cast("double").alias("pos"), F.lit(0).alias("b"), F.lit(0 if vertical else 255).alias("g"), F.lit(255 if vertical else 0).alias("r"))
    return _drawn(images, own, background, direction)


def fill_ratios(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(keys, region_id, ratio): the share of black values in each region (keys, region_id, l, t, r, b) of the page image.

    Where regions have page_width and page_height they are in the page's units and scaled to its image.
    """
    page_size = [c for c in ("page_width", "page_height") if c in regions.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, w, h, c, data, regions_of in pdf.itertuples(index=False):
                a = pixels_of(bytes(data), w, h, c)
                for k, left, t, r, b, *size in (tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in regions_of):
                    if size:
                        sx, sy = w / size[0], h / size[1]
                        left, t, r, b = left * sx, t * sy, r * sx, b * sy
                    part = a[int(t) : int(b), int(left) : int(r)]
                    rows.append((doc, page, int(k), float((part == 0).mean()) if part.size else None))
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "region_id", "ratio"])

    listed = spread(regions, *KEYS).groupBy(*KEYS).agg(F.collect_list(F.struct("region_id", "l", "t", "r", "b", *page_size)).alias("regions"))
    joined = with_images(images, listed).select(*KEYS, "width", "height", "channels", "data", "regions")
    return joined.mapInPandas(run, "doc_id string, page_num int, region_id long, ratio double")


def fullest(ratios: DataFrame, choices: DataFrame) -> DataFrame:
    """(keys, group_id, choice): of each group's regions (keys, group_id, region_id, choice) the fullest, ties by region_id."""
    joined = choices.join(ratios, [*KEYS, "region_id"])
    return joined.groupBy(*KEYS, "group_id").agg(F.min_by("choice", F.struct(-F.col("ratio"), F.col("region_id"))).alias("choice"))
