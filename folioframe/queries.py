"""Registered queries of the document-table operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import geometry as G
from .functions import text as X
from .operators import boxes as B
from .operators import clusters as C
from .operators import grid as R
from .operators import lines as L
from .plans import views as V
from .schema import KEYS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_K = "doc_id, page_num"


def query(sql: str | None = None, *ctes: str):
    """Register a function under its name, with its SQL after the common table expressions it uses."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


def _r(*names: str):
    """Rounded columns: transcendental results are compared to six digits."""
    return [F.round(F.col(n), 6).alias(n.split(".")[-1]) for n in names]


# ---- clusters -----------------------------------------------------------------------------------
_BREAKS = """gaps AS (SELECT *, "left" - lag("left") OVER (PARTITION BY doc_id, page_num ORDER BY "left", box_seq) AS gap FROM boxes),
 clustered AS (SELECT *, CAST(sum(CASE WHEN gap {op} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num ORDER BY "left", box_seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster_id FROM gaps)"""


@query(f"SELECT {_K}, box_seq, cluster_id FROM clustered", V.BOXES, _BREAKS.format(op=">= 3"))
def break_dist_clusters(spark, d):
    return C.break_clusters(V.boxes(spark, d), "left", 3, order=("box_seq",)).select(*KEYS, "box_seq", "cluster_id")


@query(f"SELECT {_K}, box_seq, cluster_id FROM clustered", V.BOXES, _BREAKS.format(op="> 3"))
def single_link_clusters(spark, d):
    return C.linkage_clusters(V.boxes(spark, d), "left", 3, order=("box_seq",)).select(*KEYS, "box_seq", "cluster_id")


@query(
    f"SELECT v.doc_id, v.page_num, box_seq, CAST(coalesce(sum(CASE WHEN mx > 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY v.doc_id, v.page_num ORDER BY v.i ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS cluster_id FROM v LEFT JOIN mx ON v.doc_id = mx.doc_id AND v.page_num = mx.page_num AND v.i = mx.i + 1",
    V.BOXES,
    # with single linkage in one dimension every gap between neighbours is a merge; its two parts end at the next larger gaps
    f"""v AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY "left", box_seq) AS i FROM boxes),
    g AS (SELECT {_K}, i, lead("left") OVER (PARTITION BY {_K} ORDER BY i) - "left" AS h FROM v QUALIFY h IS NOT NULL),
    pq AS (SELECT a.doc_id, a.page_num, a.i, a.h, coalesce(max(CASE WHEN b.i < a.i AND b.h > a.h THEN b.i END), 0) AS p, coalesce(min(CASE WHEN b.i > a.i AND b.h >= a.h THEN b.i END), 1000000) AS q FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.page_num = b.page_num GROUP BY ALL),
    ch AS (SELECT a.doc_id, a.page_num, a.i, a.p, a.q, a.h, max(CASE WHEN b.i < a.i THEN b.h END) AS hl, max(CASE WHEN b.i > a.i THEN b.h END) AS hr FROM pq a JOIN g b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND b.i > a.p AND b.i < a.q GROUP BY ALL),
    hs AS (SELECT *, list_filter([h, hl, hr], lambda x: x IS NOT NULL) AS l FROM ch), me AS (SELECT *, list_sum(l) / len(l) AS m FROM hs),
    sd AS (SELECT *, CASE WHEN len(l) > 1 THEN sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / (len(l) - 1)) ELSE 0 END AS s FROM me), inc AS (SELECT *, CASE WHEN s > 0 THEN (h - m) / s ELSE 0 END AS c FROM sd),
    mx AS (SELECT a.doc_id, a.page_num, a.i, max(b.c) AS mx FROM inc a JOIN inc b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND b.i > a.p AND b.i < a.q GROUP BY ALL)""",
)
def inconsistent_clusters(spark, d):
    return C.linkage_clusters(V.boxes(spark, d).select(*KEYS, "box_seq", "left"), "left", 1.0, order=("box_seq",), criterion="inconsistent").select(*KEYS, "box_seq", "cluster_id")


@query(f"SELECT {_K}, cluster_id, median(\"left\") AS center, count(*) AS n FROM clustered GROUP BY ALL", V.BOXES, _BREAKS.format(op=">= 3"))
def cluster_centers_median(spark, d):
    return C.cluster_centers(C.break_clusters(V.boxes(spark, d), "left", 3, order=("box_seq",)), "left")


@query(f"SELECT {_K}, cluster_id, center, n FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY n DESC, cluster_id) AS k FROM (SELECT {_K}, cluster_id, min(\"left\") AS center, count(*) AS n FROM clustered GROUP BY ALL)) WHERE k <= 4", V.BOXES, _BREAKS.format(op=">= 3"))
def largest_clusters(spark, d):
    return C.largest_clusters(C.cluster_centers(C.break_clusters(V.boxes(spark, d), "left", 3, order=("box_seq",)), "left", "min"), 4)


@query(f"SELECT {_K}, box_seq, cluster_id FROM (SELECT *, stddev_pop(\"left\") OVER (PARTITION BY {_K}, cluster_id) AS s FROM clustered) WHERE s < 4.3", V.BOXES, _BREAKS.format(op=">= 3"))
def steady_clusters(spark, d):
    return C.steady_clusters(C.break_clusters(V.boxes(spark, d), "left", 3, order=("box_seq",)), "left", 4.3).select(*KEYS, "box_seq", "cluster_id")


@query(f"SELECT {_K}, mode FROM (SELECT {_K}, height AS mode, row_number() OVER (PARTITION BY {_K} ORDER BY count(*) DESC, height) AS k FROM boxes GROUP BY {_K}, height) WHERE k = 1", V.BOXES)
def mode_ties(spark, d):
    return C.smallest_mode(V.boxes(spark, d), "height")


_ROWS = """tg AS (SELECT *, top - lag(top) OVER (PARTITION BY doc_id, page_num ORDER BY top, box_seq) AS gap FROM boxes),
 tc AS (SELECT *, CAST(sum(CASE WHEN gap >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num ORDER BY top, box_seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster_id FROM tg),
 tr AS (SELECT doc_id, page_num, cluster_id, min(top) AS t, max(bottom) AS b FROM tc GROUP BY ALL)"""


@query(f"SELECT {_K}, cluster_id AS pos_idx, CASE WHEN p IS NULL THEN t ELSE t - (t - p) / 2 END AS pos FROM (SELECT *, lag(b) OVER (PARTITION BY {_K} ORDER BY cluster_id) AS p FROM tr)", V.BOXES, _ROWS)
def row_positions(spark, d):
    return C.row_positions(C.break_clusters(V.boxes(spark, d), "top", 3, order=("box_seq",)))


@query(
    f"""SELECT {_K}, lo AS pos FROM kept UNION ALL SELECT {_K}, unnest([(last + edge) / 2, edge]) AS pos FROM (SELECT {_K}, max(lo) AS last FROM kept GROUP BY {_K}) JOIN (SELECT {_K}, max("right") AS edge FROM boxes GROUP BY {_K}) USING ({_K})""",
    V.BOXES, V.PAGES, V.steps_sql("p", 0, 900, 50),
    f"""spans AS (SELECT {_K}, lag(pos) OVER (PARTITION BY {_K} ORDER BY pos) AS lo, pos AS hi FROM p),
    kept AS (SELECT s.doc_id, s.page_num, lo FROM spans s JOIN boxes b ON s.doc_id = b.doc_id AND s.page_num = b.page_num AND b."left" + b.width / 2 > lo AND b."left" + b.width / 2 <= hi WHERE lo IS NOT NULL GROUP BY s.doc_id, s.page_num, lo HAVING count(*) >= 30)""",
)
def column_borders(spark, d):
    return C.column_borders(V.boxes(spark, d), V.steps(spark, d, 0, 900, 50), 30)


@query(f"""SELECT doc_id, page_num, max("right") AS pos FROM boxes WHERE "left" >= 600 AND "left" < 880 GROUP BY ALL""", V.BOXES)
def last_column_border(spark, d):
    pages = V.pages(spark, d)
    return C.last_border(V.boxes(spark, d), pages.select(*KEYS, F.lit(600.0).alias("pos")), pages)


@query(
    f"SELECT {_K}, row_start, row_end FROM (SELECT {_K}, coalesce(lag(hi) OVER (PARTITION BY {_K} ORDER BY hi), 0) AS row_start, hi AS row_end, hit FROM held) WHERE hit",
    V.BOXES, V.PAGES, V.steps_sql("p", 0, 1200, 5),
    f"""spans AS (SELECT {_K}, coalesce(lag(pos) OVER (PARTITION BY {_K} ORDER BY pos), 0) AS lo, pos AS hi FROM p),
    held AS (SELECT s.doc_id, s.page_num, lo, hi, bool_or(regexp_matches(value, '^c')) AS hit FROM spans s JOIN boxes b ON s.doc_id = b.doc_id AND s.page_num = b.page_num AND bottom > lo AND bottom <= hi GROUP BY ALL)""",
)
def table_rows(spark, d):
    return C.table_rows(V.steps(spark, d, 0, 1200, 5), V.boxes(spark, d), "^c")


_COLS = """per AS (SELECT 'o' || CAST(l_orderkey // 50 AS VARCHAR) AS doc_id, CAST(l_orderkey % 50 AS INTEGER) AS page_num, l_linenumber AS pos_idx, min(100.0::DOUBLE * l_linenumber + l_partkey % 9) AS pos FROM lineitem GROUP BY ALL)"""


def _columns(spark, d):
    rows = V.table(spark, d, "lineitem").selectExpr("concat('o', l_orderkey div 50) doc_id", "cast(l_orderkey % 50 as int) page_num", "l_linenumber pos_idx", "100d * l_linenumber + l_partkey % 9 p")
    return rows.groupBy(*KEYS, "pos_idx").agg(F.min("p").alias("pos"))


@query(
    f"""SELECT {_K}, pos_idx, CASE WHEN n <> 4 OR diff > 20 THEN start + med ELSE pos END AS pos FROM (SELECT pg.doc_id, pg.page_num, pg.n, pg.start, m.pos_idx, m.med, o.pos,
     sum(abs(o.norm - m.med)) OVER (PARTITION BY pg.doc_id, pg.page_num) AS diff FROM pg JOIN m ON pg.doc_id = m.doc_id LEFT JOIN o ON o.doc_id = pg.doc_id AND o.page_num = pg.page_num AND o.pos_idx = m.pos_idx)""",
    _COLS, """pg AS (SELECT doc_id, page_num, count(*) AS n, min_by(pos, pos_idx) AS start FROM per GROUP BY ALL), o AS (SELECT per.*, n, start, pos - start AS norm FROM per JOIN pg USING (doc_id, page_num)),
     m AS (SELECT doc_id, pos_idx, median(norm) AS med FROM o WHERE n = 4 GROUP BY ALL)""",
)
def correct_columns(spark, d):
    return C.correct_columns(_columns(spark, d), 4, 20)


def _arrays(spark, d):
    return _columns(spark, d).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos_idx", "pos"))), lambda x: x["pos"]).alias("base"))


#: Arrays as text, six digits a number.
_LIST = "array_to_string(list_transform({}, lambda x: CAST(round(x, 6) AS VARCHAR)), ',')"
#: Every choice of values to leave out, tried for each page's ``base`` and ``model`` of j; of equals the first in order.
_MATCH = f"""masks AS (SELECT n, gone FROM (SELECT n, list_filter(range(n), lambda i: (mask >> i) & 1 = 1) AS gone FROM range(1, 15) t(n), range(16384) u(mask) WHERE mask < (1 << n)) WHERE n IN (SELECT greatest(len(base), len(model)) FROM j)),
 choices AS (SELECT j.*, gone, list_transform(model, lambda x: x + base[1]) AS placed, list_filter(base, lambda x, i: len(base) <= len(model) OR NOT list_contains(gone, i - 1)) AS rest FROM j JOIN masks ON n = greatest(len(base), len(model)) AND len(gone) = abs(len(base) - len(model))),
 cost AS (SELECT *, CASE WHEN len(base) >= len(model) THEN list_sum(list_transform(model, lambda x, i: abs(rest[i] - (x + rest[1])))) ELSE list_sum(list_transform(list_filter(placed, lambda x, i: NOT list_contains(gone, i - 1)), lambda x, i: abs(x - base[i]))) END AS diff FROM choices),
 best AS (SELECT *, CASE WHEN len(base) >= len(model) THEN rest ELSE list_transform(placed, lambda x, i: CASE WHEN list_contains(gone, i - 1) THEN x ELSE base[i - len(list_filter(gone, lambda g: g < i - 1))] END) END AS out FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY diff, gone) AS k FROM cost) WHERE k = 1)"""


#: j: the centres of each page and its document's model, the largest clusters of the centres less their page's first.
_MODEL = f"""po AS (SELECT {_K}, unnest(base) - base[1] AS norm, generate_subscripts(base, 1) AS i FROM b), po0 AS (SELECT *, norm - lag(norm) OVER (PARTITION BY doc_id ORDER BY norm, page_num, i) AS gap FROM po),
 po1 AS (SELECT *, sum(CASE WHEN gap >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY norm, page_num, i ROWS UNBOUNDED PRECEDING) AS c FROM po0), f AS (SELECT doc_id, c, median(norm) AS m, count(*) AS n FROM po1 GROUP BY ALL),
 fm AS (SELECT doc_id, m, max(n) AS n, arg_max(c, (n, -c)) AS c FROM f GROUP BY ALL), md AS (SELECT doc_id, list(m ORDER BY m) AS model FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c) AS k FROM fm) WHERE k <= {{k}} GROUP BY doc_id),
 j AS (SELECT {_K}, base, model FROM b JOIN md USING (doc_id))"""


def _listed(c):
    return F.array_join(F.transform(c, lambda x: F.round(x, 6).cast("string")), ",").alias("positions")


@query(f"SELECT {_K}, {_LIST.format('CASE WHEN diff > 60 THEN placed ELSE out END')} AS positions, CASE WHEN diff > 60 THEN 0 ELSE diff END AS difference FROM best", _COLS, f"j AS (SELECT {_K}, list(pos ORDER BY pos_idx) AS base, [0.0::DOUBLE, 100, 200, 300] AS model FROM per GROUP BY ALL)", _MATCH)
def best_matching_array(spark, d):
    model = F.array(*[F.lit(100.0 * i) for i in range(4)]).alias("model")
    arrays = _arrays(spark, d)
    return C.match_arrays(arrays, arrays.select("doc_id").distinct().select("doc_id", model), 60.0).select(*KEYS, _listed("positions"), "difference")


@query(
    f"SELECT {_K}, {_LIST.format('out')} AS positions, diff AS difference FROM best", _COLS,
    f"""pg0 AS (SELECT *, pos - lag(pos) OVER (PARTITION BY {_K} ORDER BY pos, pos_idx) AS gap FROM per), pg1 AS (SELECT *, sum(CASE WHEN gap >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY pos, pos_idx ROWS UNBOUNDED PRECEDING) AS c FROM pg0),
    pc AS (SELECT {_K}, c, median(pos) AS center FROM pg1 GROUP BY ALL), b AS (SELECT {_K}, list(center ORDER BY c) AS base FROM pc GROUP BY ALL)""", _MODEL.format(k=4), _MATCH,
)
def adjusted_centers(spark, d):
    clustered = C.break_clusters(_columns(spark, d), "pos", 30, order=("pos_idx",))
    return C.adjust_centers(clustered, "pos", 4, 30).select(*KEYS, _listed("positions"), "difference")


@query(
    f"""SELECT {_K}, {_LIST.format("CASE WHEN bad THEN list_transform(means, lambda x, i: p[1] + x - means[1]) ELSE p END")} AS positions, bad AS adjusted FROM (SELECT *, means IS NOT NULL AND (len(p) <> n OR list_min(own) < 0 OR coalesce(stat > crit[len(p) - 2], false)) AS bad FROM (SELECT *,
     list_sum(list_transform(own, lambda x, i: (x - wid[i]) * (x - wid[i]) / wid[i])) AS stat FROM w))""", _COLS,
    # a probability below 0.05 is a statistic above the quantile of its degrees of freedom
    f"""a AS (SELECT {_K}, list(pos ORDER BY pos_idx) AS p FROM per GROUP BY ALL), e AS (SELECT doc_id, CAST(floor(median(len(p))) AS INTEGER) AS n FROM a GROUP BY doc_id),
    gm AS (SELECT doc_id, pos_idx, avg(pos) AS m FROM (SELECT a.doc_id, unnest(p) AS pos, generate_subscripts(p, 1) AS pos_idx FROM a JOIN e ON a.doc_id = e.doc_id AND len(p) = n) GROUP BY ALL), ms AS (SELECT doc_id, list(m ORDER BY pos_idx) AS means FROM gm GROUP BY doc_id),
    w AS (SELECT a.*, n, means, list_transform(range(2, len(p) + 1), lambda i: p[i] - p[i - 1]) AS own, list_transform(range(2, len(means) + 1), lambda i: means[i] - means[i - 1]) AS wid, [3.841458820694124, 5.991464547107979, 7.814727903251179, 9.487729036781154, 11.070497693516351, 12.591587243743977] AS crit FROM a JOIN e USING (doc_id) LEFT JOIN ms USING (doc_id))""",
)
def chi2_adjust_positions(spark, d):
    return C.adjust_bad_positions(_arrays(spark, d).withColumnRenamed("base", "positions")).select(*KEYS, _listed("positions"), "adjusted")


@query(f"SELECT {_K}, list_sum(list_transform(a, lambda x, i: abs(x - a[len(a) + 1 - i]))) AS difference FROM (SELECT {_K}, list(pos ORDER BY pos_idx) AS a FROM per GROUP BY ALL)", _COLS)
def array_match_diff(spark, d):
    return _arrays(spark, d).select(*KEYS, A.match_difference(F.col("base"), F.reverse("base")).alias("difference"))


@query(f"SELECT {_K}, list_concat(list_concat([0.0::DOUBLE], a), [9999.0::DOUBLE]) AS filled FROM (SELECT {_K}, list(pos ORDER BY pos_idx) AS a FROM per GROUP BY ALL)".replace(" AS filled", "::VARCHAR AS filled"), _COLS)
def array_fill(spark, d):
    b = F.concat(F.array(F.lit(0.0)), F.transform("base", lambda x: F.lit(-1.0)), F.array(F.lit(9999.0)))
    filled = A.fill_from(F.col("base"), b, F.array(F.lit(0), F.size("base") + 1))
    return _arrays(spark, d).select(*KEYS, F.concat(F.lit("["), F.array_join(F.transform(filled, lambda x: x.cast("string")), ", "), F.lit("]")).alias("filled"))


# ---- boxes --------------------------------------------------------------------------------------
@query(f'SELECT {_K}, top AS pos FROM boxes UNION ALL SELECT {_K}, bottom FROM boxes', V.BOXES)
def border_positions(spark, d):
    return B.border_positions(V.boxes(spark, d), "v")


@query(f'SELECT {_K}, "left" AS pos FROM boxes', V.BOXES)
def border_positions_low(spark, d):
    return B.border_positions(V.boxes(spark, d), "h", "low")


def _sections(at: str, join: str, stop: int) -> tuple:
    return (
        f"SELECT s.doc_id, s.page_num, box_seq, section_idx, sec_lo, sec_hi FROM secs s {join} JOIN boxes b ON s.doc_id = b.doc_id AND s.page_num = b.page_num AND {at} > sec_lo AND {at} <= sec_hi",
        V.BOXES, V.PAGES, V.steps_sql("p", 40, stop, 40),
        f"secs AS (SELECT {_K}, CAST(row_number() OVER w - 1 AS INTEGER) AS section_idx, lag(pos, 1, -1) OVER w AS sec_lo, pos AS sec_hi FROM p WINDOW w AS (PARTITION BY {_K} ORDER BY pos))",
    )


_SECTION = (*KEYS, "box_seq", "section_idx", "sec_lo", "sec_hi")


@query(*_sections("bottom", "", 1200))
def split_sections_high(spark, d):
    return B.split_by_positions(V.boxes(spark, d), V.steps(spark, d, 40, 1200, 40), "v").select(*_SECTION)


@query(*_sections('"left" + width / 2', "", 1200))
def split_sections_middle(spark, d):
    return B.split_by_positions(V.boxes(spark, d), V.steps(spark, d, 40, 1200, 40), "h", "middle").select(*_SECTION)


@query(*_sections("top", "LEFT", 1600))
def split_sections_keep_empty(spark, d):
    return B.split_by_positions(V.boxes(spark, d), V.steps(spark, d, 40, 1600, 40), "v", "low", keep_empty=True).select(*_SECTION)


@query("SELECT doc_id, 1 AS page_num, CAST(line * 100000 + i AS INTEGER) AS box_seq, CAST(line AS INTEGER) AS line_no, CAST(i AS INTEGER) AS in_line FROM words", V.WORDS)
def put_texts_in_lines(spark, d):
    return B.put_in_lines(V.words(spark, d)).select(*KEYS, "box_seq", "line_no", "in_line")


_STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$', '', 'g')"


@query(f"SELECT doc_id, 1 AS page_num, {_STRIP.format('string_agg(t, chr(10) ORDER BY line)')} AS text FROM (SELECT doc_id, line, {_STRIP.format(chr(39) + chr(39) + ' || string_agg(value, chr(32) ORDER BY i)')} AS t FROM words GROUP BY ALL) GROUP BY doc_id", V.WORDS)
def lines_to_text(spark, d):
    return B.lines_to_text(B.put_in_lines(V.words(spark, d)))


@query(f"SELECT {_K}, string_agg(value, '|' ORDER BY \"left\", box_seq) AS text FROM boxes GROUP BY ALL", V.BOXES)
def join_texts(spark, d):
    return B.join_texts(V.boxes(spark, d), glue="|")


@query(f"""SELECT {_K}, box_seq, round(cos(0.1) * "left" - sin(0.1) * top + 400 - cos(0.1) * 400 + sin(0.1) * 500, 6) AS "left", round(sin(0.1) * "left" + cos(0.1) * top + 500 - sin(0.1) * 400 - cos(0.1) * 500, 6) AS top, width FROM boxes""", V.BOXES)
def rotate_boxes(spark, d):
    return B.rotate_boxes(V.boxes(spark, d), 0.1, 400.0, 500.0).select(*KEYS, "box_seq", *_r("left", "top"), "width")


@query(f"""SELECT {_K}, box_seq, round("left" + -sin(0.05) * (top + height / 2 - 10), 6) AS "left", round("left" + -sin(0.05) * (top + height / 2 - 10) + width, 6) AS "right", top FROM boxes""", V.BOXES)
def deskew_x(spark, d):
    return B.deskew_boxes(V.boxes(spark, d), 0.05, "sx", about_y=10).select(*KEYS, "box_seq", *_r("left", "right"), "top")


@query(f"""SELECT {_K}, box_seq, "left", round(top + sin(0.05) * ("left" + width / 2 - 10), 6) AS top, round(top + sin(0.05) * ("left" + width / 2 - 10) + height, 6) AS bottom FROM boxes""", V.BOXES)
def deskew_y(spark, d):
    return B.deskew_boxes(V.boxes(spark, d), 0.05, "sy", about_x=10).select(*KEYS, "box_seq", "left", *_r("top", "bottom"))


@query(f"""SELECT {_K}, box_seq, "left" + 5 AS "left", top, width * 2 AS width, "left" + 5 + width * 2 AS "right", bottom FROM boxes""", V.BOXES)
def move_and_resize(spark, d):
    moved = B.move(V.boxes(spark, d), F.col("left") + 5, F.col("top"))
    return B.resize(moved, F.col("width") * 2, F.col("height")).select(*KEYS, "box_seq", "left", "top", "width", "right", "bottom")


def _splits(spark, d):
    return V.pages(spark, d).select(*KEYS, (F.col("page_num") * 0.5 + 420).alias("split_pos"))


@query(f"""SELECT {_K}, box_seq, CASE WHEN "left" + width / 2 < sp THEN 0 ELSE 1 END AS side, CASE WHEN "left" + width / 2 < sp THEN "left" ELSE "left" - sp END AS "left", CASE WHEN "left" + width / 2 < sp THEN "right" ELSE "left" - sp + width END AS "right" FROM (SELECT *, CAST(page_num * 0.5 + 420 AS DOUBLE) AS sp FROM boxes)""", V.BOXES)
def split_double_page(spark, d):
    return B.split_double_pages(V.boxes(spark, d), _splits(spark, d)).select(*KEYS, "box_seq", "side", "left", "right")


@query(f"""SELECT doc_id, page_num AS from_page, side, CAST(2 * (dense_rank() OVER (PARTITION BY doc_id ORDER BY page_num) - 1) + side + 1 AS INTEGER) AS page_num, CAST(round_even(CASE WHEN side = 0 THEN page_num * 0.5 + 420 ELSE width - (page_num * 0.5 + 420) END, 0) AS INTEGER) AS width, height FROM pages_v, (VALUES (0), (1)) v(side)""", V.BOXES, V.PAGES)
def renumber_pages(spark, d):
    return B.renumber_split_pages(V.pages(spark, d), _splits(spark, d))


@query(f"SELECT {_K}, median(height) AS median_height, min(height) AS min_height, max(height) AS max_height FROM boxes GROUP BY ALL", V.BOXES)
def page_medians(spark, d):
    return B.page_medians(V.boxes(spark, d))


@query(f"""SELECT {_K}, box_seq FROM (SELECT *, median(height) OVER (PARTITION BY {_K}) AS m FROM boxes) WHERE abs(height - m) <= m / 4 * 2 AND "right" <= 700""", V.BOXES)
def robust_height(spark, d):
    return B.robust_height(V.boxes(spark, d), F.lit(700.0)).select(*KEYS, "box_seq")


@query(f"SELECT {_K}, box_seq FROM (SELECT *, median(height) OVER (PARTITION BY {_K}) AS m FROM boxes) WHERE top >= 0.7 * 1120 AND height >= 1.25 * m", V.BOXES)
def footer_boxes(spark, d):
    return B.footer_boxes(V.boxes(spark, d), V.pages(spark, d), 0.7, 1.25).select(*KEYS, "box_seq")


@query(f"SELECT {_K}, box_seq, top, coalesce(lead(top) OVER (PARTITION BY {_K} ORDER BY top, box_seq), 1120) AS top_end FROM boxes WHERE value = 'click'", V.BOXES)
def next_boundaries(spark, d):
    return B.next_boundaries(V.boxes(spark, d).where("value = 'click'"), V.pages(spark, d)).select(*KEYS, "box_seq", "top", "top_end")


@query(f"SELECT {_K}, box_seq, CAST(row_number() OVER (PARTITION BY {_K} ORDER BY height DESC, box_seq) - 1 AS INTEGER) AS rank FROM boxes", V.BOXES)
def boxes_in_order(spark, d):
    return B.in_order(V.boxes(spark, d), "height", descending=True).select(*KEYS, "box_seq", "rank")


@query(f"SELECT {_K}, box_seq FROM boxes WHERE width - 30 > 0 AND height - 10 > 0 AND page_num IN (1, 2, 5)", V.BOXES)
def page_and_area_filter(spark, d):
    small = V.boxes(spark, d).withColumns({"width": F.col("width") - 30, "height": F.col("height") - 10})
    return B.without_empty(B.on_pages(small, [1, 2, 5])).select(*KEYS, "box_seq")


# ---- merging ------------------------------------------------------------------------------------
def _merge(low: str, high: str, extent: str, cross: str, ext2: str, axis_gap: str, gap: str, glue: str, axis: str | None = None) -> tuple:
    return (
        f"""SELECT {_K}, arg_min(box_seq, k) AS box_seq, arg_min({low}, k) AS {low}, arg_max({high}, k) AS {high}, arg_max({high}, k) - arg_min({low}, k) AS {extent}, arg_min({cross}, k) AS {cross}, string_agg(value, {glue} ORDER BY k) AS value, CAST(count(*) AS INTEGER) AS n_merged, CAST(row_number() OVER (PARTITION BY {_K} ORDER BY ax, island) - 1 AS INTEGER) AS out_seq FROM i GROUP BY {_K}, ax, island""",
        V.BOXES,
        f"""a0 AS (SELECT *, {axis or f'{cross} + {ext2} / 2'} AS c FROM boxes), a1 AS (SELECT *, c - lag(c) OVER (PARTITION BY {_K} ORDER BY c, {cross}, box_seq) AS g FROM a0),
        a AS (SELECT *, sum(CASE WHEN g >= {axis_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY c, {cross}, box_seq ROWS UNBOUNDED PRECEDING) AS ax FROM a1),
        b AS (SELECT *, row_number() OVER w AS k, {low} - lag({high}) OVER w AS gap FROM a WINDOW w AS (PARTITION BY {_K}, ax ORDER BY {low}, c, {cross}, box_seq)),
        i AS (SELECT *, sum(CASE WHEN gap <= {gap} AND gap >= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY {_K}, ax ORDER BY k ROWS UNBOUNDED PRECEDING) AS island FROM b)""",
    )


@query(*_merge('"left"', '"right"', "width", "top", "height", "0.4", "40", "' '"))
def merge_nearby_h(spark, d):
    return C.merge_nearby(V.boxes(spark, d), "h", 40, 0.4).select(*KEYS, "box_seq", "left", "right", "width", "top", "value", "n_merged", "out_seq")


@query(*_merge("top", "bottom", "height", '"left"', "width", "0.4", "60", "chr(10)"))
def merge_nearby_v(spark, d):
    return C.merge_nearby(V.boxes(spark, d), "v", 60, 0.4).select(*KEYS, "box_seq", "top", "bottom", "height", "left", "value", "n_merged", "out_seq")


@query(*_merge('"left"', '"right"', "width", "top", "height", "1", "40", "' '", "bottom"))
def merge_nearby_edges(spark, d):
    return C.merge_nearby(V.boxes(spark, d), "h", 40, 1, axis_align="bottom").select(*KEYS, "box_seq", "left", "right", "width", "top", "value", "n_merged", "out_seq")


def _merged(new: str) -> tuple:
    sections = _sections("bottom", "LEFT", 1200)
    return (
        f"SELECT {_K}, box_seq, section_idx, merged_idx, CAST(row_number() OVER (PARTITION BY {_K}, merged_idx ORDER BY section_idx DESC, box_seq) - 1 AS INTEGER) AS merged_order FROM s JOIN (SELECT {_K}, section_idx, CAST(sum({new}) OVER (PARTITION BY {_K} ORDER BY section_idx ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS merged_idx FROM m) USING ({_K}, section_idx)",
        *sections[1:],
        f"""s AS (SELECT s.doc_id, s.page_num, section_idx, box_seq, top, bottom FROM secs s {{}}JOIN boxes b ON s.doc_id = b.doc_id AND s.page_num = b.page_num AND bottom > sec_lo AND bottom <= sec_hi)""",
    )


_OVER = _merged("CASE WHEN i > 1 AND dist < -20 THEN 0 ELSE 1 END")


@query(_OVER[0], *(c.format("") for c in _OVER[1:]), f"m AS (SELECT {_K}, section_idx, row_number() OVER w AS i, coalesce(max(top) - lag(max(bottom)) OVER w, 0) AS dist FROM s GROUP BY {_K}, section_idx WINDOW w AS (PARTITION BY {_K} ORDER BY section_idx))")
def merge_overlapping_sections(spark, d):
    secs = B.split_by_positions(V.boxes(spark, d), V.steps(spark, d, 40, 1200, 40), "v")
    return C.merge_overlapping_sections(secs, "v", -20).select(*KEYS, "box_seq", "section_idx", "merged_idx", "merged_order")


_SMALL = _merged("CASE WHEN before > 0 AND n <= 17 THEN 0 ELSE 1 END")


@query(_SMALL[0], *(c.format("LEFT ") for c in _SMALL[1:]), f"m0 AS (SELECT {_K}, section_idx, count(box_seq) AS n FROM s GROUP BY ALL), m AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {_K} ORDER BY section_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m0)")
def merge_small_sections(spark, d):
    secs = B.split_by_positions(V.boxes(spark, d), V.steps(spark, d, 40, 1200, 40), "v", keep_empty=True)
    return C.merge_small_sections(secs, 17).select(*KEYS, "box_seq", "section_idx", "merged_idx", "merged_order")


# ---- grids --------------------------------------------------------------------------------------
_GRID = (V.BOXES, V.PAGES, V.steps_sql("cp", 0, 900, 100), V.steps_sql("rp", 0, 1008, 48), f"""cs AS (SELECT {_K}, CAST(pos_idx AS INTEGER) AS col_idx, pos AS l, lead(pos) OVER (PARTITION BY {_K} ORDER BY pos_idx) AS r FROM cp),
 rs AS (SELECT {_K}, CAST(pos_idx AS INTEGER) AS row_idx, pos AS t, lead(pos) OVER (PARTITION BY {_K} ORDER BY pos_idx) AS b FROM rp),
 grid AS (SELECT {_K}, row_idx, col_idx, l, t, r, b FROM rs JOIN cs USING ({_K}) WHERE r IS NOT NULL AND b IS NOT NULL)""")
_FIT = (*_GRID, f"""scored AS (SELECT x.*, row_idx, col_idx, least(least((r - l) * (b - t), width * height), least("right" - l, r - "left") * least(bottom - t, b - top)) / (("right" - "left") * (bottom - top)) AS isect,
 sqrt(pow(("left" + ("right" - "left") / 2) - (l + (r - l) / 2), 2) + pow((top + (bottom - top) / 2) - (t + (b - t) / 2), 2)) AS center_dist
 FROM boxes x JOIN grid g ON x.doc_id = g.doc_id AND x.page_num = g.page_num AND "left" < r AND "right" > l AND top < b AND bottom > t),
 fitted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, box_seq ORDER BY isect DESC, center_dist, row_idx, col_idx) AS k FROM scored) WHERE k = 1)""")


def _fits_steps(stop: int) -> tuple:
    """The fit to a grid whose columns end at ``stop``."""
    return tuple(c.replace("range(0, 901, 100)", f"range(0, {stop + 1}, 100)") for c in _FIT)


def _grid(spark, d):
    return R.make_grid(V.steps(spark, d, 0, 900, 100), V.steps(spark, d, 0, 1008, 48))


@query(f"SELECT {_K}, pos_idx AS span_idx, pos AS lo, hi FROM (SELECT *, lead(pos) OVER (PARTITION BY {_K} ORDER BY pos_idx) AS hi FROM cp) WHERE hi IS NOT NULL", *_GRID)
def subsequent_pairs(spark, d):
    return R.subsequent_pairs(V.steps(spark, d, 0, 900, 100))


@query("SELECT * FROM grid", *_GRID)
def make_grid(spark, d):
    return _grid(spark, d)


@query(f"SELECT {_K}, box_seq, row_idx, col_idx, round(isect, 9) AS isect, round(center_dist, 9) AS center_dist FROM fitted", *_FIT)
def fit_grid(spark, d):
    return R.fit_to_grid(V.boxes(spark, d), _grid(spark, d)).select(*KEYS, "box_seq", "row_idx", "col_idx", F.round("isect", 9).alias("isect"), F.round("center_dist", 9).alias("center_dist"))


@query(f"SELECT {_K}, box_seq FROM boxes ANTI JOIN fitted USING ({_K}, box_seq)", *_FIT)
def fit_grid_unmatched(spark, d):
    b = V.boxes(spark, d)
    return R.unmatched(b, R.fit_to_grid(b, _grid(spark, d))).select(*KEYS, "box_seq")


@query(f"SELECT {_K}, g.row_idx, g.col_idx, count(f.box_seq) AS n FROM grid g LEFT JOIN fitted f USING ({_K}, row_idx, col_idx) GROUP BY ALL", *_FIT)
def fit_grid_counts(spark, d):
    g = _grid(spark, d)
    return R.cell_counts(R.fit_to_grid(V.boxes(spark, d), g), g)


_PIVOT = ", ".join(f"coalesce(max(CASE WHEN col_idx = {i} THEN txt END), '') AS col{i + 1:02d}" for i in range(9))


@query(f"SELECT {_K}, row_idx, {_PIVOT} FROM grid LEFT JOIN (SELECT {_K}, row_idx, col_idx, string_agg(value, ' ' ORDER BY \"left\", box_seq) AS txt FROM fitted GROUP BY ALL) USING ({_K}, row_idx, col_idx) GROUP BY {_K}, row_idx", *_FIT)
def datatable_pivot(spark, d):
    g = _grid(spark, d)
    return R.to_table(R.fit_to_grid(V.boxes(spark, d), g), g, 9)


@query(f"SELECT {_K}, '[' || string_agg(rowtxt, ',' ORDER BY row_idx) || ']' AS grid FROM (SELECT {_K}, row_idx, '[' || string_agg('[[' || l || ',' || t || '],[' || r || ',' || b || ']]', ',' ORDER BY col_idx) || ']' AS rowtxt FROM grid GROUP BY ALL) GROUP BY {_K}", *_GRID)
def page_grid_json(spark, d):
    return R.grid_json(_grid(spark, d))


# ---- lines --------------------------------------------------------------------------------------
_PROJECT = f"""e AS (SELECT *, CASE WHEN cos(theta) <> 0 THEN rho / cos(theta) ELSE 'inf'::DOUBLE END AS x0, CASE WHEN sin(theta) <> 0 THEN rho / sin(theta) ELSE 'inf'::DOUBLE END AS y0,
 CASE WHEN cos(theta) <> 0 THEN (rho - 1000 * sin(theta)) / cos(theta) ELSE 'inf'::DOUBLE END AS x1, CASE WHEN sin(theta) <> 0 THEN (rho - 1400 * cos(theta)) / sin(theta) ELSE 'inf'::DOUBLE END AS y1 FROM lines),
 cand AS (SELECT {_K}, line_seq, 0 AS k, x0 AS x, 0.0::DOUBLE AS y, 'x' AS free FROM e UNION ALL SELECT {_K}, line_seq, 1, 0, y0, 'y' FROM e UNION ALL SELECT {_K}, line_seq, 2, x1, 1400, 'x' FROM e UNION ALL SELECT {_K}, line_seq, 3, 1000, y1, 'y' FROM e),
 v AS (SELECT *, x >= 0 AND x <= 1000 AND y >= 0 AND y <= 1400 AS ok, CASE WHEN free = 'x' THEN (CASE WHEN x <= 0 THEN x ELSE x - 1000 END) ELSE (CASE WHEN y <= 0 THEN y ELSE y - 1400 END) END AS dist FROM cand),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY {_K}, line_seq ORDER BY ok DESC, CASE WHEN ok THEN 0 ELSE abs(dist) END, CASE WHEN ok THEN k ELSE -k END) AS n FROM v),
 ends AS (SELECT {_K}, line_seq, max(CASE WHEN n = 1 THEN CASE WHEN ok OR free = 'y' THEN x ELSE x - dist END END) AS ax, max(CASE WHEN n = 1 THEN CASE WHEN ok OR free = 'x' THEN y ELSE y - dist END END) AS ay,
 max(CASE WHEN n = 2 THEN CASE WHEN ok OR free = 'y' THEN x ELSE x - dist END END) AS bx, max(CASE WHEN n = 2 THEN CASE WHEN ok OR free = 'x' THEN y ELSE y - dist END END) AS "by" FROM ranked GROUP BY ALL)"""
_AXIS = f"""own AS (SELECT l.*, (ax + bx) / 2 AS pos FROM lines l JOIN ends USING ({_K}, line_seq) WHERE dir = 'v'), og AS (SELECT *, pos - lag(pos) OVER (PARTITION BY {_K} ORDER BY pos, line_seq) AS gap FROM own),
 oc AS (SELECT *, CAST(sum(CASE WHEN gap >= 20.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY pos, line_seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster_id FROM og)"""


@query(f"SELECT {_K}, line_seq, round(theta_norm, 6) AS theta_norm, dir FROM lines", V.LINES)
def hough_direction(spark, d):
    return V.lines(spark, d).select(*KEYS, "line_seq", *_r("theta_norm"), "dir")


_ANGLE = "angles AS (SELECT o_orderkey, (o_orderkey % 2000 - 1000) / 37.0::DOUBLE AS theta FROM orders)"


def _angles(spark, d):
    return V.table(spark, d, "orders").selectExpr("o_orderkey", "(o_orderkey % 2000 - 1000) / 37d theta")


@query(f"SELECT o_orderkey, round({V.NORMAL.format('theta')}, 6) AS angle FROM angles", _ANGLE)
def normalize_angle(spark, d):
    return _angles(spark, d).select("o_orderkey", F.round(G.normalize_angle(F.col("theta")), 6).alias("angle"))


@query("SELECT o_orderkey, round(CASE WHEN n < 3.141592653589793 THEN n ELSE n - 3.141592653589793 END, 6) AS angle FROM (SELECT o_orderkey, " + V.NORMAL.format("theta") + " AS n FROM angles)", _ANGLE)
def normalize_angle_half(spark, d):
    return _angles(spark, d).select("o_orderkey", F.round(G.normalize_angle_half(F.col("theta")), 6).alias("angle"))


@query(f"""SELECT {_K}, line_seq, round(ax, 6) AS ax, round(ay, 6) AS ay, round(bx, 6) AS bx, round("by", 6) AS "by" FROM ends""", V.LINES, _PROJECT)
def project_lines(spark, d):
    return L.projected(V.lines(spark, d), V.line_pages(spark, d)).select(*KEYS, "line_seq", *_r("ax", "ay", "bx", "by"))


_ROTATION = f"""dev AS (SELECT *, CASE WHEN dir = 'v' THEN CASE WHEN theta_norm > 1.5707963267948966 THEN theta_norm - 3.141592653589793 ELSE theta_norm END ELSE theta_norm - 1.5707963267948966 END AS dv FROM lines),
 med AS (SELECT {_K}, median(dv) FILTER (WHERE dir = 'h') AS h, median(dv) FILTER (WHERE dir = 'v') AS v FROM dev GROUP BY ALL), fl AS (SELECT *, coalesce(abs(h) > 0.012, false) AS hh, coalesce(abs(v) > 0.012, false) AS vv FROM med),
 rot AS (SELECT {_K}, CASE WHEN hh AND vv THEN CASE WHEN abs(h - v) < 0.008 THEN 'r' END WHEN hh THEN 'sy' WHEN vv THEN 'sx' END AS kind, CASE WHEN hh AND vv THEN CASE WHEN abs(h - v) < 0.008 THEN (h + v) / 2 END WHEN hh THEN h WHEN vv THEN v END AS radians FROM fl)"""


@query(f"SELECT {_K}, kind, round(radians, 6) AS radians FROM rot", V.LINES, _ROTATION)
def find_rotation_or_skew(spark, d):
    return L.estimate_rotation(V.lines(spark, d), 0.012, 0.008).select(*KEYS, "kind", *_r("radians"))


@query(f"SELECT {_K}, line_seq FROM (SELECT *, median(dv) OVER (PARTITION BY {_K}, dir) AS m FROM dev) WHERE abs(abs(m) - abs(dv)) < 0.00312", V.LINES, _ROTATION)
def lines_without_strays(spark, d):
    return L.without_strays(V.lines(spark, d), 0.00312).select(*KEYS, "line_seq")


@query(f"""SELECT {_K}, line_seq, round(theta, 6) AS theta, round({V.NORMAL.format('theta')}, 6) AS theta_norm, dir FROM (SELECT l.doc_id, l.page_num, line_seq, dir, CASE WHEN kind = 'r' OR (kind = 'sy' AND dir = 'h') OR (kind = 'sx' AND dir = 'v') THEN theta + radians ELSE theta END AS theta FROM lines l LEFT JOIN rot USING ({_K}))""", V.LINES, _ROTATION)
def apply_rotation(spark, d):
    rows = V.lines(spark, d)
    return L.apply_rotation(rows, L.estimate_rotation(rows, 0.012, 0.008)).select(*KEYS, "line_seq", *_r("theta", "theta_norm"), "dir")


def _line_clusters(spark, d):
    return L.line_clusters(V.lines(spark, d), V.line_pages(spark, d), "v", 20.5)


@query(f"SELECT {_K}, line_seq, round(pos, 6) AS pos, cluster_id FROM oc", V.LINES, _PROJECT, _AXIS)
def line_clusters(spark, d):
    return _line_clusters(spark, d).select(*KEYS, "line_seq", *_r("pos"), "cluster_id")


@query(f"SELECT {_K}, round(c, 6) AS separator FROM (SELECT {_K}, cluster_id, median(pos) AS c, row_number() OVER (PARTITION BY {_K} ORDER BY abs(median(pos) - 500), cluster_id) AS k FROM oc GROUP BY {_K}, cluster_id) WHERE k = 1", V.LINES, _PROJECT, _AXIS)
def separator_line(spark, d):
    return L.separator_line(_line_clusters(spark, d), V.line_pages(spark, d)).select(*KEYS, *_r("separator"))


@query(
    f"SELECT DISTINCT {_K}, cluster_id FROM (SELECT *, lead(keep) OVER w AS nxt, coalesce(bool_or(keep) OVER (PARTITION BY {_K} ORDER BY c, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM kp WINDOW w AS (PARTITION BY {_K} ORDER BY c, cluster_id)) WHERE keep OR (coalesce(nxt, false) AND NOT earlier)",
    V.LINES, _PROJECT, _AXIS, V.BOXES, f"""cc AS (SELECT {_K}, cluster_id, median(pos) / 1.25 AS c FROM oc GROUP BY ALL), sc AS (SELECT *, lag(c, 1, -1) OVER (PARTITION BY {_K} ORDER BY c, cluster_id) AS lo FROM cc),
    cn AS (SELECT s.doc_id, s.page_num, cluster_id, c, count(CASE WHEN ("left" > lo AND "left" <= c) OR ("right" > lo AND "right" <= c) THEN 1 END) AS n FROM sc s LEFT JOIN boxes b ON s.doc_id = b.doc_id AND s.page_num = b.page_num GROUP BY ALL),
    kp AS (SELECT *, n >= round_even(median(n) OVER (PARTITION BY {_K}) * 0.5, 0) AS keep FROM cn)""",
)
def line_clusters_nonempty(spark, d):
    scales = V.line_pages(spark, d).select(*KEYS, F.lit(1.25).alias("scale"))
    return L.drop_empty_sections(_line_clusters(spark, d), V.boxes(spark, d), scales, "v", 0.5).select(*KEYS, "cluster_id").distinct()


@query(f"SELECT {_K}, max(c) AS table_top FROM (SELECT {_K}, cluster_id, round(median(top), 6) AS c FROM tc GROUP BY ALL) WHERE c < 280 GROUP BY ALL HAVING count(*) >= 2", V.BOXES, _ROWS)
def header_top(spark, d):
    centers = C.cluster_centers(C.break_clusters(V.boxes(spark, d), "top", 3, order=("box_seq",)), "top")
    return C.header_top(centers, V.pages(spark, d))


# ---- geometry -----------------------------------------------------------------------------------
_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_IDS = _ID.split(", ")
_RECTS = "rects AS (SELECT *, least(x1, x2) AS al, least(y1, y2) AS atp, greatest(x1, x2) + 1 AS ar, greatest(y1, y2) + 1 AS ab, least(x3, x4) AS bl, least(y3, y4) AS bt, greatest(x3, x4) + 1 AS br, greatest(y3, y4) + 1 AS bb FROM segments)"


def _rects(spark, d):
    def r(a, b, c, e):
        return G.rect(F.least(a, c), F.least(b, e), F.greatest(a, c) + 1, F.greatest(b, e) + 1)

    return V.segments(spark, d).select(*_IDS, r("x1", "y1", "x2", "y2").alias("a"), r("x3", "y3", "x4", "y4").alias("b"))


def _points(spark, d):
    return V.segments(spark, d).select(*_IDS, *(G.point(F.col(f"x{i}"), F.col(f"y{i}")).alias(f"p{i}") for i in range(1, 5)))


@query(f"SELECT {_ID}, (ar - al) * (ab - atp) AS area, al + (ar - al) / 2 AS cx, atp + (ab - atp) / 2 AS cy, round(sqrt(pow((al + (ar - al) / 2) - (bl + (br - bl) / 2), 2) + pow((atp + (ab - atp) / 2) - (bt + (bb - bt) / 2), 2)), 6) AS dist FROM rects", V.SEGMENTS, _RECTS)
def rect_area_center(spark, d):
    a, b = F.col("a"), F.col("b")
    return _rects(spark, d).select(*_IDS, G.rect_area(a).alias("area"), G.rect_center(a)["x"].alias("cx"), G.rect_center(a)["y"].alias("cy"), F.round(G.rect_center_distance(a, b), 6).alias("dist"))


@query(f"SELECT {_ID}, CASE WHEN ok THEN least(least((ar - al) * (ab - atp), (br - bl) * (bb - bt)), least(br - al, ar - bl) * least(bb - atp, ab - bt)) END AS isect, round(CASE WHEN ok THEN least(least((ar - al) * (ab - atp), (br - bl) * (bb - bt)), least(br - al, ar - bl) * least(bb - atp, ab - bt)) / ((ar - al) * (ab - atp)) END, 9) AS share_a, CASE WHEN ok THEN (least(ar, br) - greatest(al, bl)) * (least(ab, bb) - greatest(atp, bt)) END AS true_area FROM (SELECT *, br >= al AND ar >= bl AND bb >= atp AND ab >= bt AS ok FROM rects)", V.SEGMENTS, _RECTS)
def rect_intersect(spark, d):
    a, b = F.col("a"), F.col("b")
    return _rects(spark, d).select(*_IDS, G.rect_intersection(a, b).alias("isect"), F.round(G.rect_intersection(a, b, "a"), 9).alias("share_a"), G.rect_intersection(a, b, true_overlap=True).alias("true_area"))


@query(f"SELECT {_ID}, greatest(least(x1, x2), least(x3, x4)) <= least(greatest(x1, x2), greatest(x3, x4)) AS overlaps FROM segments", V.SEGMENTS)
def overlap_pred(spark, d):
    return V.segments(spark, d).select(*_IDS, G.ranges_overlap(F.col("x1"), F.col("x2"), F.col("x3"), F.col("x4")).alias("overlaps"))


@query(
    f"""SELECT {_ID}, CASE WHEN den = 0 THEN CASE WHEN ov THEN 'parallel' ELSE 'none' END WHEN inside THEN 'cross' ELSE 'none' END AS kind, CASE WHEN den <> 0 AND inside THEN round(x, 6) END AS x, CASE WHEN den <> 0 AND inside THEN round(y, 6) END AS y FROM i""",
    V.SEGMENTS, """g AS (SELECT *, (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4) AS den FROM segments), h AS (SELECT *, ((x1 * y2 - x2 * y1) * (x3 - x4) - (x1 - x2) * (x3 * y4 - x4 * y3)) / den AS x, ((x1 * y2 - x2 * y1) * (y3 - y4) - (y1 - y2) * (x3 * y4 - x4 * y3)) / den AS y FROM g),
    i AS (SELECT *, x BETWEEN least(x1, x2) AND greatest(x1, x2) AND x BETWEEN least(x3, x4) AND greatest(x3, x4) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) AND y BETWEEN least(y3, y4) AND greatest(y3, y4) AS inside,
    greatest(least(x1, x2), least(x3, x4)) <= least(greatest(x1, x2), greatest(x3, x4)) AND greatest(least(y1, y2), least(y3, y4)) <= least(greatest(y1, y2), greatest(y3, y4)) AS ov FROM h)""",
)
def line_intersect(spark, d):
    p = G.line_intersection(*(F.col(f"p{i}") for i in range(1, 5)))
    rows = _points(spark, d).withColumn("p", p)
    kind = F.when(F.col("p").isNull(), "none").when(F.isnan("p.x"), "parallel").otherwise("cross")
    real = lambda c: F.when(~F.isnan(f"p.{c}"), F.round(F.col(f"p.{c}"), 6)).alias(c)
    return rows.select(*_IDS, kind.alias("kind"), real("x"), real("y"))


@query(f"SELECT {_ID}, CASE WHEN (abs(x1) <= 1e-8 AND abs(y1) <= 1e-8) OR (abs(x3) <= 1e-8 AND abs(y3) <= 1e-8) THEN -1 WHEN (abs(x1 - x3) <= 1e-8 + 1e-5 * abs(x3) AND abs(y1 - y3) <= 1e-8 + 1e-5 * abs(y3)) OR abs(num - den) <= 1e-8 + 1e-5 * abs(den) THEN 0 ELSE round(acos(num / den), 6) END AS angle FROM (SELECT *, x1 * x3 + y1 * y3 AS num, sqrt(x1 * x1 + y1 * y1) * sqrt(x3 * x3 + y3 * y3) AS den FROM segments)", V.SEGMENTS)
def vec_angle(spark, d):
    return _points(spark, d).select(*_IDS, F.round(F.nanvl(G.vector_angle(F.col("p1"), F.col("p3")), F.lit(-1.0)), 6).alias("angle"))


@query(f"SELECT {_ID}, round(cos(x3) * x1 - sin(x3) * y1 + x2 - cos(x3) * x2 + sin(x3) * y2, 6) AS x, round(sin(x3) * x1 + cos(x3) * y1 + y2 - sin(x3) * x2 - cos(x3) * y2, 6) AS y FROM segments", V.SEGMENTS)
def vec_rotate(spark, d):
    p = G.rotate(F.col("x1"), F.col("y1"), F.col("x3"), F.col("x2"), F.col("y2"))
    return V.segments(spark, d).withColumn("p", p).select(*_IDS, *_r("p.x", "p.y"))


@query(f"SELECT {_ID}, round(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)), 6) AS dist FROM segments", V.SEGMENTS)
def point_distance(spark, d):
    return _points(spark, d).select(*_IDS, F.round(G.point_distance(F.col("p1"), F.col("p2")), 6).alias("dist"))


# ---- text, arrays and maps ----------------------------------------------------------------------
@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
def levenshtein(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query("SELECT p_partkey, round(levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand)), 9) AS distance FROM part")
def rel_levenshtein(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.round(X.rel_levenshtein(F.col("p_name"), F.col("p_brand")), 9).alias("distance"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS starts, regexp_matches(p_name, '[0-9]{2}$') AS found, replace(p_name, ' ', '') = 'part1' AS is_label, length(p_name) AS n FROM part")
def text_filters(spark, d):
    name = F.col("p_name")
    return V.table(spark, d, "part").select("p_partkey", X.matches_start(name, "[a-m]").alias("starts"), X.found_in(name, "[0-9]{2}$").alias("found"), X.label_equals(name, "part1").alias("is_label"), F.length(X.strip(F.concat(F.lit("  \t"), name, F.lit("\n\x1c ")))).cast("bigint").alias("n"))


@query("SELECT p_partkey, list_has_any(string_split(p_type, ' '), ['STEEL', 'PROMO']) AS some, list_has_all(['STEEL', 'PROMO', 'SMALL', 'BRASS'], string_split(p_type, ' ')) AS every, len(list_filter(string_split(p_brand, '#'), lambda x: contains(p_name, x))) > 0 AS in_text FROM part")
def membership(spark, d):
    words = lambda *w: F.array(*map(F.lit, w))
    kinds = F.split("p_type", " ")
    return V.table(spark, d, "part").select("p_partkey", A.any_in(kinds, words("STEEL", "PROMO")).alias("some"), A.all_in(kinds, words("STEEL", "PROMO", "SMALL", "BRASS")).alias("every"), A.any_in(F.split("p_brand", "#"), F.col("p_name"), True).alias("in_text"))


@query("SELECT p_partkey, p_name AS name, 'new' AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def updated_map(spark, d):
    m = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    u = A.updated(m, F.create_map(F.lit("brand"), F.lit("new"), F.lit("size"), F.col("p_size").cast("string")))
    return V.table(spark, d, "part").select("p_partkey", u["name"].alias("name"), u["brand"].alias("brand"), u["size"].alias("size"))


@query("SELECT o_custkey, string_agg(coalesce(o_orderstatus, '-'), '' ORDER BY o_orderkey) AS status FROM orders GROUP BY ALL")
def attribute_list(spark, d):
    rows = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    return rows.select("o_custkey", F.array_join(A.attribute(F.col("o"), "o_orderstatus", F.lit("-")), "").alias("status"))


# ---- sources, images and whole plans ------------------------------------------------------------
def _xml(spark, d):
    from .sources import pdfxml as P

    pages = V.pages(spark, d).select(*KEYS, "width", "height", F.format_string("%s-%d.png", "doc_id", "page_num").alias("image"))
    return P.to_xml(pages, V.boxes(spark, d).withColumn("font", F.concat(F.lit("f"), F.col("box_seq") % 3)))


@query(f"""SELECT {_K}, CAST(row_number() OVER (PARTITION BY {_K} ORDER BY box_seq) - 1 AS INTEGER) AS box_seq, "left", top, width, height, "right", bottom, value, 'f' || (box_seq % 3) AS font FROM boxes""", V.BOXES)
def xml_round_trip(spark, d):
    from .sources.pdfxml import parse_boxes

    return parse_boxes(_xml(spark, d))


@query(f"SELECT {_K}, CAST(page_seq AS INTEGER) AS page_seq, image, width, height FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS page_seq, doc_id || '-' || page_num || '.png' AS image FROM pages_v)", V.BOXES, V.PAGES)
def xml_pages(spark, d):
    from .sources.pdfxml import parse_pages

    return parse_pages(_xml(spark, d))


def _clusters_sql(name: str, source: str, value: str, gap: str, order: str = "box_seq") -> str:
    """``name``: rows of ``source`` with the cluster of ``value`` on their page."""
    return f"""{name}0 AS (SELECT *, {value} - lag({value}) OVER (PARTITION BY {_K} ORDER BY {value}, {order}) AS gap FROM {source}),
    {name} AS (SELECT *, sum(CASE WHEN gap >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY {value}, {order} ROWS UNBOUNDED PRECEDING) AS cluster_id FROM {name}0)"""


def _grid_sql(columns: str, rows: str) -> str:
    """grid: from positions (keys, pos) of columns and rows, each counted once."""
    span = lambda name, source, a, b, i: f"{name} AS (SELECT {_K}, CAST(row_number() OVER w - 1 AS INTEGER) AS {i}, pos AS {a}, lead(pos) OVER w AS {b} FROM {source} WINDOW w AS (PARTITION BY {_K} ORDER BY pos))"
    return f"{span('cs', columns, 'l', 'r', 'col_idx')}, {span('rs', rows, 't', 'b', 'row_idx')}, grid AS (SELECT {_K}, row_idx, col_idx, l, t, r, b FROM rs JOIN cs USING ({_K}) WHERE r IS NOT NULL AND b IS NOT NULL)"


def _table_sql(n: int, cells: str = "cells") -> str:
    names = R.column_names(n)
    columns = ", ".join(f"coalesce(max(CASE WHEN col_idx = {i} THEN txt END), '') AS {name}" for i, name in enumerate(names))
    return f"SELECT {_K}, row_idx, {columns} FROM grid LEFT JOIN {cells} USING ({_K}, row_idx, col_idx) GROUP BY {_K}, row_idx"


_CELLS = f"cells AS (SELECT {_K}, row_idx, col_idx, string_agg(value, ' ' ORDER BY \"left\", box_seq) AS txt FROM fitted GROUP BY ALL)"
_LINED = f"""ln AS (SELECT *, CASE WHEN coalesce(lead(top) OVER w - bottom, 0) >= -avg(bottom - top) OVER (PARTITION BY {_K}, row_idx, col_idx) / 2 THEN 1 ELSE 0 END AS brk FROM fitted WINDOW w AS (PARTITION BY {_K}, row_idx, col_idx ORDER BY top, box_seq)),
 li AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY {_K}, row_idx, col_idx ORDER BY top, box_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM ln),
 cells AS (SELECT {_K}, row_idx, col_idx, string_agg(line, chr(10) ORDER BY line_no) AS txt FROM (SELECT {_K}, row_idx, col_idx, line_no, string_agg(value, ' ' ORDER BY "left", top, box_seq) AS line FROM li GROUP BY ALL) GROUP BY ALL)"""


_TURNED = _ROTATION.replace("0.012", "0.0087").replace("0.008)", "0.0175)").replace("< 0.008", "< 0.0175")


@query(
    _table_sql(5), V.BOXES, V.PAGES, V.LINES, _TURNED,
    f"""rlines AS (SELECT l.doc_id, l.page_num, line_seq, rho, dir, CASE WHEN kind = 'r' OR (kind = 'sy' AND dir = 'h') OR (kind = 'sx' AND dir = 'v') THEN theta - radians ELSE theta END AS theta FROM lines l LEFT JOIN rot USING ({_K}) WHERE ({_K}) IN (SELECT ({_K}) FROM pages_v)),
    rboxes AS (SELECT doc_id, page_num, box_seq, nl AS "left", nt AS top, width, height, nl + width AS "right", nt + height AS bottom, value FROM (SELECT b.*, CASE kind WHEN 'r' THEN cos(-radians) * "left" - sin(-radians) * top WHEN 'sx' THEN "left" - sin(-radians) * (top + height / 2) ELSE "left" END AS nl,
     CASE kind WHEN 'r' THEN sin(-radians) * "left" + cos(-radians) * top WHEN 'sy' THEN top + sin(-radians) * ("left" + width / 2) ELSE top END AS nt FROM boxes b LEFT JOIN rot USING ({_K})))""",
    _PROJECT.replace("FROM lines", "FROM rlines"), _AXIS.replace("FROM lines l", "FROM rlines l"),
    f"""cc AS (SELECT {_K}, cluster_id, median(pos) AS center, median(pos) / (1000.0::DOUBLE / 880) AS c FROM oc GROUP BY ALL), sc AS (SELECT *, lag(c, 1, -1) OVER (PARTITION BY {_K} ORDER BY c, cluster_id) AS lo FROM cc),
    cn AS (SELECT s.doc_id, s.page_num, cluster_id, center, c, count(CASE WHEN ("left" > lo AND "left" <= c) OR ("right" > lo AND "right" <= c) THEN 1 END) AS n FROM sc s LEFT JOIN rboxes b ON s.doc_id = b.doc_id AND s.page_num = b.page_num GROUP BY ALL),
    kp AS (SELECT *, n >= round_even(median(n) OVER (PARTITION BY {_K}) * 0.1, 0) AS keep FROM cn),
    ne AS (SELECT *, lead(keep) OVER w AS nxt, coalesce(bool_or(keep) OVER (PARTITION BY {_K} ORDER BY c, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM kp WINDOW w AS (PARTITION BY {_K} ORDER BY c, cluster_id)),
    b AS (SELECT {_K}, list(center ORDER BY cluster_id) AS base FROM ne WHERE keep OR (coalesce(nxt, false) AND NOT earlier) GROUP BY ALL)""",
    _MODEL.format(k=6), _MATCH, f"colp AS (SELECT {_K}, unnest(out) / (1000.0::DOUBLE / 880) AS pos FROM best), ordinary AS (SELECT * FROM (SELECT *, median(height) OVER (PARTITION BY {_K}) AS m FROM rboxes) WHERE abs(height - m) <= m / 2), edge AS (SELECT {_K}, top AS pos FROM ordinary UNION ALL SELECT {_K}, bottom FROM ordinary)",
    _clusters_sql("eg", "edge", "pos", "2.25", "pos"), f"rowp AS (SELECT {_K}, median(pos) AS pos FROM eg GROUP BY {_K}, cluster_id UNION SELECT {_K}, 1120 FROM rlines)",
    _grid_sql("colp", "rowp"), _FIT[-1].replace("FROM boxes x", "FROM rboxes x"), _CELLS,
)
def pipeline_line_guided(spark, d):
    from .plans.pipelines import line_guided

    pages = V.pages(spark, d).join(V.line_pages(spark, d).select(*KEYS), list(KEYS))
    return line_guided(V.boxes(spark, d), pages, V.lines(spark, d), 5, 20.5, 30, 2.25)


@query(
    _table_sql(4), V.BOXES, V.PAGES, V.LINES, _PROJECT, _AXIS,
    f"""sp AS (SELECT {_K}, c / (1000.0::DOUBLE / 880) AS sp FROM (SELECT {_K}, median(pos) AS c, row_number() OVER (PARTITION BY {_K} ORDER BY abs(median(pos) - 500), cluster_id) AS k FROM oc WHERE ({_K}) IN (SELECT ({_K}) FROM pages_v) GROUP BY {_K}, cluster_id) WHERE k = 1),
    nb AS (SELECT doc_id, page_num AS from_page, 2 * (dense_rank() OVER (PARTITION BY doc_id ORDER BY page_num) - 1) AS before, sp FROM sp),
    hv AS (SELECT b.*, sp, before, CASE WHEN "left" + width / 2 < sp THEN 0 ELSE 1 END AS side FROM boxes b JOIN nb ON b.doc_id = nb.doc_id AND b.page_num = from_page),
    half AS (SELECT doc_id, CAST(before + side + 1 AS INTEGER) AS page_num, box_seq, "left" - side * sp AS "left", top, width, height, "left" - side * sp + width AS "right", top + height AS bottom, value FROM hv)""",
    _clusters_sql("bt", "half", "bottom", "1"), f"bn AS (SELECT {_K}, max(bottom) AS pos FROM bt GROUP BY {_K}, cluster_id)",
    f"""sn AS (SELECT {_K}, coalesce(lag(pos) OVER (PARTITION BY {_K} ORDER BY pos), 0) AS lo, pos AS hi FROM bn),
    held AS (SELECT s.doc_id, s.page_num, lo, hi, bool_or(regexp_matches(value, '^c')) AS hit FROM sn s JOIN half b ON s.doc_id = b.doc_id AND s.page_num = b.page_num AND bottom > lo AND bottom <= hi GROUP BY ALL),
    tb AS (SELECT * FROM (SELECT {_K}, coalesce(lag(hi) OVER (PARTITION BY {_K} ORDER BY hi), 0) AS row_start, hi AS row_end, hit FROM held) WHERE hit), rowp AS (SELECT {_K}, row_start AS pos FROM tb UNION SELECT {_K}, row_end FROM tb),
    ins AS (SELECT half.* FROM half JOIN (SELECT {_K}, min(row_start) AS lo, max(row_end) AS hi FROM tb GROUP BY ALL) e ON half.doc_id = e.doc_id AND half.page_num = e.page_num AND bottom > lo AND bottom <= hi)""",
    _clusters_sql("lf", "ins", '"left"', "2.5"), f"""colp AS (SELECT {_K}, c AS pos FROM (SELECT {_K}, median("left") AS c, row_number() OVER (PARTITION BY {_K} ORDER BY count(*) DESC, cluster_id) AS k FROM lf GROUP BY {_K}, cluster_id) WHERE k <= 4 UNION SELECT {_K}, max("right") FROM ins GROUP BY {_K})""",
    _grid_sql("colp", "rowp"), _FIT[-1].replace("FROM boxes x", "FROM half x"), _LINED,
)
def pipeline_double_pages(spark, d):
    from .plans.pipelines import double_pages

    pages = V.pages(spark, d).join(V.line_pages(spark, d).select(*KEYS), list(KEYS))
    return double_pages(V.boxes(spark, d), pages, V.lines(spark, d), 20.5, 2.5, "^c", 4)


@query(
    _table_sql(4), V.BOXES, _ROWS,
    f"""rowp AS (SELECT {_K}, CASE WHEN p IS NULL THEN t ELSE t - (t - p) / 2 END AS pos FROM (SELECT *, lag(b) OVER (PARTITION BY {_K} ORDER BY cluster_id) AS p FROM tr) UNION SELECT {_K}, max(bottom) FROM boxes GROUP BY {_K})""",
    _clusters_sql("lf", "boxes", '"left"', "3"), f"""ch AS (SELECT {_K}, c AS pos FROM (SELECT {_K}, min("left") AS c, row_number() OVER (PARTITION BY {_K} ORDER BY count(*) DESC, cluster_id) AS k FROM lf GROUP BY {_K}, cluster_id) WHERE k <= 4),
    c0 AS (SELECT {_K}, pos FROM ch UNION SELECT {_K}, max("right") FROM boxes JOIN (SELECT {_K}, max(pos) AS last FROM ch GROUP BY {_K}) USING ({_K}) WHERE "left" >= last AND "left" < 880 GROUP BY {_K}),
    c1 AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY pos) AS i, count(*) OVER (PARTITION BY {_K}) AS n, min(pos) OVER (PARTITION BY {_K}) AS start FROM c0), md AS (SELECT doc_id, i, median(pos - start) AS med FROM c1 WHERE n = 5 GROUP BY ALL),
    c2 AS (SELECT p.doc_id, p.page_num, p.n, p.start, md.i, med, pos FROM (SELECT DISTINCT {_K}, n, start FROM c1) p JOIN md ON p.doc_id = md.doc_id LEFT JOIN c1 ON c1.doc_id = p.doc_id AND c1.page_num = p.page_num AND c1.i = md.i),
    colp AS (SELECT {_K}, CASE WHEN n <> 5 OR sum(abs(pos - start - med)) OVER (PARTITION BY {_K}) > 10 THEN start + med ELSE pos END AS pos FROM c2)""",
    _grid_sql("colp", "rowp"), _FIT[-1], _CELLS,
)
def pipeline_position_only(spark, d):
    from .plans.pipelines import position_only

    return position_only(V.boxes(spark, d), V.pages(spark, d), 3, 3, 4, 10)


from . import more_queries  # noqa: E402, F401 - registers its queries
