"""Registered queries of sources, sinks, images and the parts of extraction plans, over tables made from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import geometry as G
from .functions.stats import chi2_tail_of
from .operators import boxes as B
from .operators import clusters as C
from .operators import images as M
from .plans import views as V
from .queries import _COLS, _FIT, _ID, _IDS, _K, _PIVOT, _ROWS, _arrays, _fits_steps, _grid, _xml, query
from .schema import KEYS
from .sources import images as I
from .sources import pdfxml as P
from .sources import tables as T
from .sources.staging import BATCH_BYTES, shared_dir, spread


# ---- clusters and positions ---------------------------------------------------------------------
@query(f'SELECT {_K}, box_seq, CAST(dense_rank() OVER (PARTITION BY {_K} ORDER BY floor("left" / 100)) - 1 AS INTEGER) AS cluster_id FROM boxes', V.BOXES)
def custom_clusters(spark, d):
    """A clustering method of the caller's own."""
    import numpy as np

    return C.custom_clusters(V.boxes(spark, d), "left", lambda v: np.unique(v // 100, return_inverse=True)[1], order=("box_seq",)).select(*KEYS, "box_seq", "cluster_id")


@query(f'SELECT {_K}, cluster_id, (min("left") + max("left")) / 2 AS center, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN gap >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY "left", box_seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster_id FROM (SELECT *, "left" - lag("left") OVER (PARTITION BY {_K} ORDER BY "left", box_seq) AS gap FROM boxes)) GROUP BY ALL', V.BOXES)
def custom_centers(spark, d):
    """A centre of the caller's own."""
    return C.cluster_centers(C.break_clusters(V.boxes(spark, d), "left", 3, order=("box_seq",)), "left", lambda c: (F.min(c) + F.max(c)) / 2)


@query(f"SELECT {_K}, pos FROM (SELECT {_K}, top AS pos FROM boxes UNION ALL SELECT {_K}, bottom FROM boxes) WHERE pos >= 100 + page_num AND pos <= 600", V.BOXES)
def positions_between(spark, d):
    b = V.boxes(spark, d)
    return B.between(B.border_positions(b, "v"), V.pages(spark, d).selectExpr(*KEYS, "100d + page_num top_y", "600d bottom_y"))


@query(f"SELECT {_K}, box_seq FROM boxes WHERE width >= 35", V.BOXES)
def wide_boxes(spark, d):
    return B.wide_enough(V.boxes(spark, d), 35).select(*KEYS, "box_seq")


@query(f"SELECT {_K}, count(*) AS n_lines, median(pos - p) AS median_line, min(pos - p) AS min_line, max(pos - p) AS max_line FROM (SELECT {_K}, t AS pos, lag(t) OVER (PARTITION BY {_K} ORDER BY t) AS p FROM tr) GROUP BY ALL", V.BOXES, _ROWS)
def page_line_heights(spark, d):
    clustered = C.break_clusters(V.boxes(spark, d), "top", 3, order=("box_seq",))
    return B.line_heights(C.cluster_centers(clustered, "top", "min").select(*KEYS, F.col("center").alias("pos")))


@query(
    f"""SELECT DISTINCT {_K}, unnest(pos) AS pos FROM (SELECT {_K}, list_filter([CASE WHEN hit AND NOT before THEN prev END, CASE WHEN hit THEN hi END], lambda x: x IS NOT NULL) AS pos FROM (SELECT *, coalesce(lag(hi) OVER w, 0) AS prev, coalesce(lag(hit) OVER w, false) AS before FROM held WINDOW w AS (PARTITION BY {_K} ORDER BY hi)))""",
    V.BOXES, V.PAGES, V.steps_sql("p", 0, 1200, 5),
    f"""spans AS (SELECT {_K}, coalesce(lag(pos) OVER (PARTITION BY {_K} ORDER BY pos), 0) AS lo, pos AS hi FROM p),
    held AS (SELECT s.doc_id, s.page_num, lo, hi, bool_or(regexp_matches(value, '^c')) AS hit FROM spans s JOIN boxes b ON s.doc_id = b.doc_id AND s.page_num = b.page_num AND bottom > lo AND bottom <= hi GROUP BY ALL)""",
)
def table_row_borders(spark, d):
    """Where a table begins and ends: the states of going through a page's sections."""
    return C.row_borders(C.table_rows(V.steps(spark, d, 0, 1200, 5), V.boxes(spark, d), "^c"))


# ---- scalar functions ---------------------------------------------------------------------------
@query("SELECT p_partkey, array_to_string(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')), '|') AS flat FROM part")
def flatten_list(spark, d):
    lists = F.array(F.split("p_name", " "), F.lit(None).cast("array<string>"), F.array().cast("array<string>"), F.split("p_type", " "))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(A.flattened(lists), "|").alias("flat"))


@query(f"SELECT {_K}, array_to_string(list_transform(range(0, len(a) + 1), lambda k: CAST(5.0::DOUBLE + coalesce(list_sum(a[1:k]), 0) AS VARCHAR)), ',') AS offsets FROM (SELECT {_K}, list(pos ORDER BY pos_idx) AS a FROM per GROUP BY ALL)", _COLS)
def running_offsets(spark, d):
    return _arrays(spark, d).select(*KEYS, F.array_join(F.transform(A.offsets(F.lit(5.0), F.col("base")), lambda x: x.cast("string")), ",").alias("offsets"))


@query(f'SELECT {_K}, box_seq, "left" AS l, top AS t, "right" AS r, bottom AS b FROM boxes', V.BOXES)
def box_rects(spark, d):
    return V.boxes(spark, d).withColumn("rect", G.box_rect()).select(*KEYS, "box_seq", *(F.col(f"rect.{c}").alias(c) for c in "ltrb"))


@query(f"SELECT {_ID}, CAST(round_even(x1 / 4, 0) AS INTEGER) AS x, CAST(round_even(-y1 / 4, 0) AS INTEGER) AS y FROM segments", V.SEGMENTS)
def whole_points(spark, d):
    p = G.whole_point(G.point(F.col("x1") / 4, -F.col("y1") / 4))
    return V.segments(spark, d).withColumn("p", p).select(*_IDS, "p.x", "p.y")


@query(f"""SELECT {_ID}, round(exp(-s / 2) * list_sum(list_transform(range(h), lambda k: pow(s / 2, k) / CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END)), 9) AS p FROM (SELECT {_ID}, CAST(l_quantity AS DOUBLE) / 3 AS s, l_linenumber % 4 + 1 AS h FROM lineitem)""")
def chi2_tails(spark, d):
    """For even degrees of freedom the tail is a finite sum."""
    rows = V.table(spark, d, "lineitem")
    return rows.select(*_IDS, F.round(chi2_tail_of(F.col("l_quantity").cast("double") / 3, (2 * (F.col("l_linenumber") % 4 + 1)).cast("int")), 9).alias("p"))


# ---- sources and sinks --------------------------------------------------------------------------
@query("""SELECT 'n' || n_nationkey AS doc_id, CAST(p AS INTEGER) AS page_num, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN p = 2 THEN 'other.png' WHEN n_nationkey % 3 = 1 THEN 'a.png' ELSE 'b.png' END AS image FROM nation, range(1, 4) r(p)""")
def page_images(spark, d):
    """No image, one, or two of which that at the top left counts; page 2 is given another."""
    image = lambda at, name: F.lit(f'<image top="{at}" left="{at}" width="9" height="9" src="{name}"/>')
    kind = F.col("n_nationkey") % 3
    images = F.when(kind == 0, "").when(kind == 1, image(5, "a.png")).otherwise(F.concat(image(5, "a.png"), image(0, "b.png")))
    page = lambda n: F.concat(F.lit(f'<page number="{n}" top="0" left="0" width="9" height="9">'), images, F.lit("</page>"))
    docs = V.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("doc_id"), F.concat(F.lit("<pdf2xml>"), *(page(n) for n in (1, 2, 3)), F.lit("</pdf2xml>")).alias("xml"))
    return P.parse_pages(docs, select_image="topleft", use_images={2: "other.png"}).select(*KEYS, "image")


@query(f"SELECT {_K}, CASE WHEN page_num % 4 > 0 THEN doc_id || '/' || page_num || '.jpg' END AS image, CASE WHEN page_num % 4 > 0 THEN 1000 + page_num END AS img_width, CASE WHEN page_num % 4 > 0 THEN 1400 END AS img_height FROM pages_v", V.BOXES, V.PAGES)
def pages_with_images(spark, d):
    pages = V.pages(spark, d)
    images = pages.where("page_num % 4 > 0").select(*KEYS, F.concat_ws("", "doc_id", F.lit("/"), "page_num", F.lit(".jpg")).alias("path"), (F.lit(1000) + F.col("page_num")).alias("img_width"), F.lit(1400).alias("img_height"))
    return P.set_page_images(pages, images).select(*KEYS, "image", "img_width", "img_height")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 < 3 THEN CAST(300 + n_nationkey AS INTEGER) END AS img_width, CASE WHEN n_nationkey % 4 < 3 THEN CAST(7 + n_nationkey AS INTEGER) END AS img_height FROM nation")
def image_sizes(spark, d):
    """Headers of three formats; in the third they lie behind 120,000 bytes of other segments."""
    w, h = F.col("n_nationkey") + 300, F.col("n_nationkey") + 7
    big = lambda x, n: F.lpad(F.hex(x.cast("long")), n, "0")
    little = lambda x: F.concat(F.substring(big(x, 4), 3, 2), F.substring(big(x, 4), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 8), big(h, 8), F.lit("0800000000"))
    gif = F.concat(F.lit("474946383961"), little(w), little(h), F.repeat(F.lit("00"), 20))
    segment = F.concat(F.lit("FFE1EA60"), F.repeat(F.lit("00"), 59998))
    jpeg = F.concat(F.lit("FFD8"), segment, segment, F.lit("FFC0000B08"), big(h, 4), big(w, 4), F.repeat(F.lit("00"), 10))
    kind = F.col("n_nationkey") % 4
    text = F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, jpeg).otherwise(F.repeat(F.lit("61"), 40))
    return I.sizes_of(V.table(spark, d, "nation").select("n_nationkey", F.unhex(text).alias("content")))


@query(f"""SELECT {_K}, CAST(row_number() OVER (PARTITION BY {_K} ORDER BY box_seq) - 1 AS INTEGER) AS box_seq, round_even("left" + 0.5, 0) AS "left", round_even(top + 1.5, 0) AS top, round_even(width / 2, 0) AS width, height FROM boxes""", V.BOXES)
def xml_rounding(spark, d):
    half = V.boxes(spark, d).withColumns({"left": F.col("left") + 0.5, "top": F.col("top") + 1.5, "width": F.col("width") / 2})
    return P.parse_boxes(P.to_xml(V.pages(spark, d).select(*KEYS, "width", "height"), half)).select(*KEYS, "box_seq", "left", "top", "width", "height")


@query(f"SELECT {_K}, doc_id || '.pdf-' || page_num || '.png' AS image, width, height FROM pages_v".replace("doc_id ||", "'scan$' ||").replace(".pdf-", "-"), V.BOXES, V.PAGES)
def image_tags(spark, d):
    docs = P.to_xml(V.pages(spark, d).select(*KEYS, "width", "height"), V.boxes(spark, d))
    return P.parse_pages(P.inject_images(docs, "scan$-{page}.png")).select(*KEYS, "image", "width", "height")


@query(f"""SELECT doc_id, CAST(2 * (dense_rank() OVER (PARTITION BY doc_id ORDER BY page_num) - 1) + side + 1 AS INTEGER) AS page_num, CAST(k AS INTEGER) AS font_seq, 'f' || k AS font, CAST(10 + k AS VARCHAR) AS size, 'A&B "' || page_num || '"' AS family, NULL::VARCHAR AS color FROM pages_v, range(0, 3) r(k), (VALUES (0), (1)) s(side)""", V.BOXES, V.PAGES)
def split_fontspecs(spark, d):
    """Font specifications written, read, and copied to both halves of split pages."""
    pages = V.pages(spark, d)
    fonts = pages.select(*KEYS, F.explode(F.array(*map(F.lit, range(3)))).alias("font_seq")).withColumns({"font": F.concat(F.lit("f"), "font_seq"), "size": (F.col("font_seq") + 10).cast("string"), "family": F.concat(F.lit('A&B "'), "page_num", F.lit('"')), "color": F.lit(None).cast("string")})
    docs = P.to_xml(pages.select(*KEYS, "width", "height"), V.boxes(spark, d), fonts)
    numbers = B.renumber_split_pages(pages, pages.select(*KEYS, F.lit(400.0).alias("split_pos")))
    return P.split_fonts(P.parse_fonts(docs), numbers)


@query(f"SELECT {_K}, count(*) AS n_boxes, CAST(sum(length(value)) AS BIGINT) AS n_chars FROM boxes GROUP BY ALL", V.BOXES)
def xml_files(spark, d):
    """Documents written as files and read from them."""
    folder = shared_dir(spark, "xml")
    T.write_xml(_xml(spark, d), folder)
    boxes = P.parse_boxes(P.read_xml(spark, f"{folder}/*/*.txt"))
    doc = F.regexp_extract("doc_id", "doc_id=([^/]*)/", 1)
    return boxes.groupBy(doc.alias("doc_id"), "page_num").agg(F.count("*").alias("n_boxes"), F.sum(F.length("value")).alias("n_chars"))


@query(f"SELECT {_K}, row_idx, {_PIVOT} FROM grid LEFT JOIN (SELECT {_K}, row_idx, col_idx, string_agg(value, ' ' ORDER BY \"left\", box_seq) AS txt FROM fitted GROUP BY ALL) USING ({_K}, row_idx, col_idx) GROUP BY {_K}, row_idx", *_FIT)
def csv_files(spark, d):
    """Tables written as CSV and read again."""
    from .operators import grid as R

    g, folder = _grid(spark, d), shared_dir(spark, "csv")
    table = R.to_table(R.fit_to_grid(V.boxes(spark, d), g), g, 9)
    T.write_csv(table, folder)
    return T.read_csv(spark, folder, table.schema).na.fill("")


@query(f"""SELECT {_K}, row_idx, {_PIVOT.split(", coalesce(max(CASE WHEN col_idx = 4")[0].replace("col01", "col1").replace("col02", "col2").replace("col03", "col3").replace("col04", "col4")}, CASE WHEN page_num % 2 = 0 THEN 'wide' END AS col5 FROM grid LEFT JOIN (SELECT {_K}, row_idx, col_idx, string_agg(value, ' ' ORDER BY "left", box_seq) AS txt FROM fitted GROUP BY ALL) USING ({_K}, row_idx, col_idx) GROUP BY {_K}, row_idx""", *_fits_steps(400))
def union_of_tables(spark, d):
    """Tables of four columns and of five in one, what is missing null."""
    from .operators import grid as R

    g = R.make_grid(V.steps(spark, d, 0, 400, 100), V.steps(spark, d, 0, 1008, 48))
    table = R.to_table(R.fit_to_grid(V.boxes(spark, d), g), g, 4)
    return T.union_tables(table.where("page_num % 2 = 1"), table.where("page_num % 2 = 0").withColumn("col5", F.lit("wide")))


# ---- images -------------------------------------------------------------------------------------
def _listed(spark, d):
    """The keys of the pages of lines, dealt to all tasks: each stands for an image."""
    return spread(V.line_pages(spark, d).select(*KEYS), *KEYS)


def _ruled(spark, d, width: int = 100, height: int = 140, vertical: bool = True, horizontal: bool = True):
    """A white image for each page of lines, with a vertical rule at 20 + page_num and a horizontal one at 30 + page_num."""
    import numpy as np
    import pandas as pd

    step = max(BATCH_BYTES // (width * height), 1)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), step):
                rows = []
                for doc, page in pdf[at : at + step].itertuples(index=False):
                    a = np.full((height, width), 255, np.uint8)
                    if vertical:
                        a[:, 20 + page] = 0
                    if horizontal:
                        a[30 + page] = 0
                    rows.append((doc, page, width, height, 1, a.tobytes()))
                yield pd.DataFrame(rows, columns=["doc_id", "page_num", "width", "height", "channels", "data"])

    return _listed(spark, d).mapInPandas(run, "doc_id string, page_num int, width int, height int, channels int, data binary")


def _colours(images):
    """(keys[, side], width, height, colour, n): pixels of each colour but white, as blue-green-red text."""
    import numpy as np
    import pandas as pd

    keys = [c for c in (*KEYS, "side") if c in images.columns]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                a = I.pixels_of(bytes(row["data"]), row["width"], row["height"], row["channels"])
                packed = (a[:, :, 0].astype(np.uint32) << 16 | a[:, :, 1].astype(np.uint32) << 8 | a[:, :, 2]).ravel()
                for c, n in zip(*np.unique(packed[packed != 0xFFFFFF], return_counts=True)):
                    rows.append((*(row[k] for k in keys), row["width"], row["height"], f"{c >> 16}-{c >> 8 & 255}-{c & 255}", n))
            yield pd.DataFrame(rows, columns=[*keys, "width", "height", "colour", "n"])

    kinds = dict(images.dtypes)
    return images.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", width int, height int, colour string, n long")


_IMAGES = f"imgs AS (SELECT DISTINCT {_K} FROM lines)"


@query(f"SELECT {_K}, dir, rho, round(theta, 9) AS theta FROM (SELECT {_K}, unnest(['v', 'v', 'h', 'h']) AS dir, unnest([19.0::DOUBLE + page_num, 21 + page_num, 29 + page_num, 31 + page_num]) AS rho, unnest([0.0::DOUBLE, 0, pi() / 2, pi() / 2]) AS theta FROM imgs)", V.LINES, _IMAGES)
def image_lines(spark, d):
    """All lines found: the two edges of each rule, however many votes above the least."""
    return M.detect_lines(_ruled(spark, d, 400, 400), least_votes=300).select(*KEYS, "dir", "rho", F.round("theta", 9).alias("theta"))


@query(f"SELECT {_K}, 0 AS region_id, round(140.0 / (140 * 40), 6) AS ratio FROM imgs UNION ALL SELECT {_K}, 1, 0.0 FROM imgs", V.LINES, _IMAGES)
def image_fill_ratio(spark, d):
    images = _ruled(spark, d, horizontal=False)
    regions = _listed(spark, d).select(*KEYS, F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("region_id"), F.lit(a).alias("l"), F.lit(t).alias("t"), F.lit(b).alias("r"), F.lit(u).alias("b")) for k, a, t, b, u in ((0, 10, 0, 50, 140), (1, 0, 0, 10, 20))))).alias("x")).select(*KEYS, "x.*")
    return M.fill_ratios(images, regions).select(*KEYS, F.col("region_id").cast("int").alias("region_id"), F.round("ratio", 6).alias("ratio"))


@query(f"SELECT {_K}, 100 AS width, 140 AS height, '0-0-0' AS colour, 239 AS n FROM imgs", V.LINES, _IMAGES)
def image_files(spark, d):
    """Images written as files and read from them."""
    folder = shared_dir(spark, "images")
    I.write_png(_ruled(spark, d), folder).count()
    images = I.read_images(spark, f"{folder}/*.png")
    name = F.regexp_extract("path", r"([^/]+)-(\d+)\.png$", 1)
    page = F.regexp_extract("path", r"([^/]+)-(\d+)\.png$", 2).cast("int")
    return _colours(images.select(name.alias("doc_id"), page.alias("page_num"), "width", "height", "channels", "data")).withColumn("n", F.col("n").cast("int"))


@query(f"SELECT {_K}, side, CASE side WHEN 0 THEN 40 ELSE 60 END AS width, 140 AS height, '0-0-0' AS colour, CASE side WHEN 0 THEN CASE WHEN page_num < 20 THEN 179 ELSE 40 END ELSE CASE WHEN page_num < 20 THEN 60 ELSE 199 END END AS n FROM imgs, (VALUES (0), (1)) s(side)", V.LINES, _IMAGES)
def image_halves(spark, d):
    return _colours(M.split_images(_ruled(spark, d), _listed(spark, d).select(*KEYS, F.lit(40.5).alias("split_pos")))).withColumn("n", F.col("n").cast("int"))


@query(f"SELECT {_K}, 100 AS width, 140 AS height, '0-0-255' AS colour, 280 AS n FROM imgs UNION ALL SELECT {_K}, 100, 140, '0-0-0', 13720 FROM imgs", V.LINES, _IMAGES)
def image_positions_drawn(spark, d):
    images = _ruled(spark, d)
    return _colours(M.draw_positions(images, _listed(spark, d).select(*KEYS, (F.col("page_num") + 10.0).alias("pos")), "v", background=False)).withColumn("n", F.col("n").cast("int"))


@query(f"SELECT {_K}, 100 AS width, 140 AS height, c AS colour, CAST(n AS INTEGER) AS n FROM (SELECT {_K}, unnest(['0-255-0', '0-0-0']) AS c, unnest([300, 239 - 3]) AS n FROM imgs)", V.LINES, _IMAGES)
def image_lines_drawn(spark, d):
    """Three rows of green over the rules of the page: one horizontal line of two, one of which lies on the page's edge."""
    images = _ruled(spark, d)
    rows = _listed(spark, d).select(*KEYS, F.explode(F.array(F.lit(100.0), F.lit(139.0))).alias("y"))
    ends = rows.select(*KEYS, F.lit(0).alias("line_seq"), F.lit("h").alias("dir"), F.lit(0.0).alias("ax"), F.col("y").alias("ay"), F.lit(99.0).alias("bx"), F.col("y").alias("by"))
    return _colours(M.draw_lines(images, ends)).withColumn("n", F.col("n").cast("int"))


@query(f"SELECT {_K}, 100 AS width, 140 AS height, CAST((85 * i) % 256 AS VARCHAR) || '-' || CAST((85 * i * i) % 256 AS VARCHAR) || '-' || CAST((85 * i * i * i) % 256 AS VARCHAR) AS colour, 200 AS n FROM imgs, range(2, 5) r(i) UNION ALL SELECT {_K}, 100, 140, '0-0-0', 13400 FROM imgs", V.LINES, _IMAGES)
def image_clusters_drawn(spark, d):
    images = _ruled(spark, d)
    rows = _listed(spark, d).select(*KEYS, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cluster_id"))
    y = F.col("cluster_id") * 10.0 + 5
    ends = rows.select(*KEYS, "cluster_id", F.lit(0.0).alias("ax"), y.alias("ay"), F.lit(99.0).alias("bx"), y.alias("by"))
    return _colours(M.draw_line_clusters(images, ends, background=False)).withColumn("n", F.col("n").cast("int"))


@query("""SELECT 's' || s_suppkey AS doc_id, 1 AS page_num, 0 AS section_seq, CAST(3 + k AS INTEGER) AS item_seq, '1.' || k AS num, 'good work ' || k AS descr, CASE WHEN k = 2 AND s_suppkey % 5 = 0 THEN NULL WHEN (s_suppkey // k) % 2 = 0 THEN 'A' ELSE 'B' END AS grade FROM supplier, range(1, 3) r(k)""")
def graded_sections(spark, d):
    """Items of a labelled section, their descriptions, and which of their tick boxes is the fullest."""
    import numpy as np
    import pandas as pd

    from .plans.pipelines import graded_items
    from .schema import BOXES

    docs = V.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("doc_id"), F.col("s_suppkey").cast("long").alias("k"))

    def pixels(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                rows = []
                for doc, k in pdf[at : at + 500].itertuples(index=False):
                    a = np.full((120, 140), 255, np.uint8)
                    for item, top in ((1, 50), (2, 80)):
                        left = 100 + 20 * (k // item % 2)
                        a[top + 2 : top + 8, left + 2 : left + 8] = 0
                    rows.append((doc, 1, 140, 120, 1, a.tobytes()))
                yield pd.DataFrame(rows, columns=["doc_id", "page_num", "width", "height", "channels", "data"])

    def texts(batches):
        for pdf in batches:
            rows = []
            for doc, k in pdf.itertuples(index=False):
                own = [(10, 10, 40, "Be wertung"), (100, 20, 8, "A"), (120, 20, 8, "B"), None, (10, 50, 10, "1.1"), (10, 80, 10, "1.2"), (30, 50, 30, "good work 1"), (30, 80, 30, "good work 2"), (100, 50, 10, " "), (120, 50, 10, " "), (100, 80, 10, " ")]
                if k % 5:
                    own.append((120, 80, 10, " "))
                rows += [(doc, 1, i, float(b[0]), float(b[1]), float(b[2]), 10.0, float(b[0] + b[2]), b[1] + 10.0, b[3], None) for i, b in enumerate(own) if b]
            yield pd.DataFrame(rows, columns=BOXES.names)

    images = spread(docs, "doc_id").mapInPandas(pixels, "doc_id string, page_num int, width int, height int, channels int, data binary")
    pages = docs.select("doc_id", F.lit(1).alias("page_num"), F.lit(140).alias("width"), F.lit(120).alias("height"))
    return graded_items(docs.mapInPandas(texts, BOXES), pages, images, "Bewertung", r"\d\.\d", ["A", "B"])
