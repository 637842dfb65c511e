from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioframe.operators import clusters as C
from folioframe.operators.linkage import METHODS, cut_tree, tree
from folioframe.operators.matching import best_match, best_matches, difference

MODEL = np.array([0.0, 10, 30, 40])


# Example rows and their matches (FIXTURES.md)
@pytest.mark.parametrize(
    "base,want,diff",
    [([0, 11, 29, 42], [0, 11, 29, 42], 4), ([10, 21, 25, 39, 52], [10, 21, 39, 52], 4), ([0, 9, 15, 29, 32, 41], [0, 9, 29, 41], 3), ([0, 10, 29, 35, 36, 40], [0, 10, 29, 40], 1), ([0, 9, 41], [0, 9, 30, 41], 2), ([0, 33], [0, 10, 33, 40], 3)],
)
def test_best_match_examples(base, want, diff):
    got, d = best_match(np.array(base, float), MODEL)
    assert got.tolist() == want and d == diff


def test_best_match_errors():
    with pytest.raises(TypeError):
        best_match([1], MODEL)
    with pytest.raises(ValueError):
        best_match(np.array([]), MODEL)
    with pytest.raises(ValueError):
        difference(np.array([1.0]), MODEL)
    assert best_match(np.array([5.0, 900]), MODEL, 50)[0].tolist() == [5, 15, 35, 45]


halves = st.lists(st.integers(-60, 60).map(lambda v: v / 2), min_size=1, max_size=8)


def tried(base, model):
    """The best match by trying every choice of values to leave out, in order."""
    placed = model + base[0]
    if len(base) > len(model):
        rest = min((np.delete(base, gone) for gone in combinations(range(len(base)), len(base) - len(model))), key=lambda r: np.abs(r - (model + r[0])).sum())
        return rest, np.abs(rest - (model + rest[0])).sum()
    gone = min(combinations(range(len(model)), len(model) - len(base)), key=lambda g: np.abs(np.delete(placed, g) - base).sum())
    out = placed.copy()
    out[[i for i in range(len(model)) if i not in gone]] = base
    return out, np.abs(out - placed).sum()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(halves, halves), min_size=1, max_size=6))
def test_best_matches_equal_all_choices(pairs):
    pairs = [(np.array(b), np.array(m)) for b, m in pairs]
    for (base, model), (got, diff) in zip(pairs, best_matches(*zip(*pairs))):
        want, cost = tried(base, model)
        assert got.tolist() == want.tolist() and diff == cost


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1000, 1000), max_size=30), st.integers(0, 200))
def test_break_clusters(spark, values, gap):
    rows = [("d", 1, i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, i int, v double")
    got = C.break_clusters(df, "v", gap, order=("i",)).collect()
    assert sorted(r.i for r in got) == list(range(len(values)))
    got.sort(key=lambda r: (r.v, r.i))
    for a, b in zip(got, got[1:]):
        assert (b.cluster_id == a.cluster_id) == (b.v - a.v < gap)


def test_break_clusters_rejects_negative_gaps(spark):
    with pytest.raises(ValueError):
        C.break_clusters(spark.range(1), "id", -1)


def test_trees():
    values = np.array([0.0, 1, 2, 10, 11, 30])
    assert cut_tree(tree(values), 3, "distance").tolist() == [0, 0, 0, 1, 1, 2]
    assert cut_tree(tree(values, "complete"), 3, "maxclust").tolist() == [0, 0, 0, 1, 1, 2]
    assert cut_tree(tree(np.array([5.0])), 1, "inconsistent").tolist() == [0]
    assert len(set(cut_tree(tree(values, "average"), 1.0, "inconsistent").tolist())) >= 1


@pytest.mark.parametrize("method", METHODS)
def test_trees_equal_all_pairs(method):
    """Heights of merges over the whole distance matrix, updated pair by pair."""
    g = np.random.default_rng(4)
    for _ in range(20):
        v = np.sort(g.uniform(0, 100, g.integers(2, 12)))
        groups = {i: ([x], x) for i, x in enumerate(v)}  # members, place

        def apart(a, b):
            (p, x), (q, y) = a, b
            if method in ("single", "complete"):
                return (min if method == "single" else max)(abs(i - j) for i in p for j in q)
            if method == "average":
                return np.mean([abs(i - j) for i in p for j in q])
            if method == "ward":
                return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * abs(np.mean(p) - np.mean(q))
            return abs(np.mean(p) - np.mean(q)) if method == "centroid" else abs(x - y)

        heights = []
        while len(groups) > 1:
            h, a, b = min((apart(groups[a], groups[b]), a, b) for a in groups for b in groups if a < b)
            heights.append(h)
            (p, x), (q, y) = groups.pop(a), groups.pop(b)
            groups[max(groups, default=0) + 100] = (p + q, (x + y) / 2)
        assert tree(v, method)[:, 2] == pytest.approx(heights)


def test_bad_positions(spark):
    """Pages of three columns, some of which are too narrow, too few, or out of order."""
    pages = {1: [5.0, 45, 105], 2: [7.0, 49, 109], 3: [6.0, 44, 106], 4: [9.0, 51, 111], 5: [4.0, 104], 6: [8.0, 6, 108], 7: [2.0, 92, 102]}
    df = spark.createDataFrame([("d", n, [float(x) for x in p]) for n, p in pages.items()], "doc_id string, page_num int, positions array<double>")
    good = {n: pages[n] for n in (1, 2, 3, 4)}
    widths = [sum(p[k + 1] - p[k] for p in good.values()) / 4 for k in range(2)]
    got = {r.page_num: (list(r.positions), r.adjusted) for r in C.adjust_bad_positions(df, 0.05, good=df.where("page_num < 5")).collect()}
    for n, p in pages.items():
        own = [p[k + 1] - p[k] for k in range(len(p) - 1)]
        stat = sum((o - w) ** 2 / w for o, w in zip(own, widths))
        bad = len(p) != 3 or min(own) < 0 or stat > 3.841458820694124  # Fixed value: the quantile at 0.05 of one degree of freedom
        assert bad == (n > 4) and got[n] == (pytest.approx([p[0], p[0] + widths[0], p[0] + widths[0] + widths[1]] if bad else p), bad)
    assert not any(r.adjusted for r in C.adjust_bad_positions(df.where("page_num = 5")).collect())
    with pytest.raises(ValueError):
        C.adjust_bad_positions(df, 0)


def test_models_need_a_key(spark):
    arrays = spark.createDataFrame([("d", 1, [0.0, 9.0])], "doc_id string, page_num int, base array<double>")
    models = spark.createDataFrame([([0.0, 10.0],), ([0.0, 20.0],)], "model array<double>")
    with pytest.raises(ValueError):
        C.match_arrays(arrays, models)


def test_callables(spark):
    rows = [("d", p, i, float(x)) for p in (1, 2) for i, x in enumerate((10, 12, 50, 90))]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, i int, v double")
    own = C.custom_clusters(df, "v", lambda v: (v > 40).astype(int) + (v > 80), order=("i",))
    assert [r.cluster_id for r in own.where("page_num = 1").orderBy("i").collect()] == [0, 0, 1, 2]
    got = C.adjust_centers(own, "v", 3, 1, center="max", method=lambda v: np.unique(v, return_inverse=True)[1]).collect()
    assert all(r.positions == [12.0, 50.0, 90.0] for r in got)


def test_adjusted_centers(spark):
    rows = [("d", p, c, float(x)) for p, xs in {1: [5, 105, 205], 2: [7, 107, 207], 3: [6, 206], 4: [5, 60, 105, 205]}.items() for c, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, cluster_id int, v double")
    scale = spark.createDataFrame([("d", p, 2.0) for p in (1, 2, 3, 4)], "doc_id string, page_num int, scale double")
    got = {r.page_num: r.positions for r in C.adjust_centers(df, "v", 3, 10, scale).collect()}
    assert got == {1: [2.5, 52.5, 102.5], 2: [3.5, 53.5, 103.5], 3: [3.0, 53.0, 103.0], 4: [2.5, 52.5, 102.5]}


def test_merge_nearby_rejects_other_alignments(spark):
    with pytest.raises(ValueError):
        C.merge_nearby(spark.range(1), "h", 1, 1, axis_align="left")
    with pytest.raises(ValueError):
        C.merge_nearby(spark.range(1), "x", 1, 1)
