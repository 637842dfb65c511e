import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from folioframe import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SOME = [
    "break_dist_clusters", "mode_ties", "split_sections_keep_empty", "lines_to_text", "rotate_boxes", "renumber_pages", "merge_nearby_h", "merge_small_sections", "fit_grid", "datatable_pivot",
    "page_grid_json", "project_lines", "find_rotation_or_skew", "line_intersect", "rel_levenshtein", "xml_round_trip", "inconsistent_clusters", "best_matching_array", "adjusted_centers",
    "pipeline_line_guided", "pipeline_double_pages", "pipeline_position_only", "chi2_adjust_positions", "line_clusters_nonempty", "column_borders", "table_row_borders", "page_images", "image_sizes", "image_lines", "graded_sections", "union_of_tables", "chi2_tails",
]


def normal(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf:
        if pdf[c].dtype.kind in "iufb":
            pdf[c] = pdf[c].astype(float)
    return pdf.sort_values(list(pdf.columns), ignore_index=True)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    ours, theirs = normal(Q.QUERIES[name](spark, DATA).toPandas()), normal(con.execute(Q.ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours:
        a, b = ours[c], theirs[c]
        if a.dtype.kind == "f" and b.dtype.kind == "f":
            assert np.array_equal(a, b, equal_nan=True), c
        else:
            assert list(a.astype(object).where(a.notna(), None)) == list(b.astype(object).where(b.notna(), None)), c


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60
    assert entry.entry(spark).columns[:3] == ["doc_id", "page_num", "row_idx"]


#: Queries over page images: these compress to little, so Spark would give all of them to one task.
IMAGES = ["image_clusters_drawn", "image_fill_ratio", "image_halves", "image_lines", "image_lines_drawn", "image_positions_drawn"]


@pytest.mark.parametrize("name", IMAGES)
def test_images_against_sql(spark, name):
    test_against_sql(spark, name)


@pytest.mark.parametrize("name", IMAGES)
def test_images_are_spread(spark, name):
    """All tasks work on images, which are neither broadcast nor sorted."""
    df = Q.QUERIES[name](spark, DATA)
    assert df.rdd.getNumPartitions() >= 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_graded_images_are_made_once(spark):
    """One run over the images, joined without a sort of them."""
    plan = Q.QUERIES["graded_sections"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas pixels") == 1 and "ShuffledHashJoin" in plan
