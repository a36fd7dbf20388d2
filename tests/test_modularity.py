import math

import pytest

from chronolith.operators import modularity as M

LOC = "repo string, rev int, file string, layer_no int, module_no int"
EDGE = "repo string, rev int, src string, dest string, kind string, weight double"
NODE = "repo string, rev int, node string"


def test_exact_score_of_two_layers(spark):
    files = [(f"a{i}", 0, 0) for i in range(6)] + [("b0", 1, 0), ("b1", 1, 1)]
    loc = spark.createDataFrame([("r", 1, *f) for f in files], LOC)
    links = [("a0", "a1"), ("a1", "a2"), ("a0", "a0"), ("b0", "a0"), ("b1", "a0"), ("a3", "b0")]
    edges = spark.createDataFrame([("r", 1, a, b, "x", 1.0) for a, b in links] + [("r", 1, "b0", "b1", None, 0.0), ("r", 1, "zz", "a0", "x", 1.0)], EDGE)
    rows = {(r.layer_no, r.module_no): r for r in M.module_scores(loc, edges).collect()}
    top = rows[(0, 0)]
    assert (top.cross_penalty, top.internal_penalty) == (pytest.approx(2 / 12), pytest.approx(3 / 30))
    assert top.size_penalty == pytest.approx(math.log(5) / math.log(6))
    assert rows[(1, 0)].cross_penalty == 0 and rows[(1, 1)].contribution == pytest.approx(1 / 8)
    total = M.mscore(M.module_scores(loc, edges)).collect()[0]
    assert total.size_factor_total == pytest.approx(1.0)
    assert total.mscore == pytest.approx(6 / 8 * top.size_penalty * (10 / 12) * 0.9 + 2 / 8)


def test_keys_compare_as_text(spark):
    loc = spark.createDataFrame([("r", 1, f"f{i}", i, 0) for i in range(12)], LOC)
    edges = spark.createDataFrame([("r", 1, "f2", "f10", "x", 1.0), ("r", 1, "f10", "f2", "x", 1.0)], EDGE)
    got = {r.layer_no: r.conforming_deps for r in M.module_edges(loc, edges).collect()}
    assert got == {10: 1, 2: 0}


def test_subset_keeps_numbers(spark):
    loc = spark.createDataFrame([("r", 1, "a", 0, 0), ("r", 1, "b", 1, 0), ("r", 1, "c", 1, 1)], LOC)
    edges = spark.createDataFrame([("r", 1, "c", "a", "x", 1.0)], EDGE)
    subset = spark.createDataFrame([("r", 1, "a"), ("r", 1, "c")], "repo string, rev int, file string")
    rows = {(r.layer_no, r.module_no): (r.size_factor, r.cross_penalty) for r in M.module_scores(loc, edges, subset).collect()}
    assert rows == {(0, 0): (0.5, 1.0), (1, 1): (0.5, 0.0)}


def test_leaves_and_layers_of_names(spark, rows):
    names = ["L0", "L0/M1", "L0/M1/L0", "L1/M2", "plain", "L1/M21"]
    groups = spark.createDataFrame([("r", 1, n, f"f{i}") for i, n in enumerate(names)], "repo string, rev int, name string, file string")
    assert rows(M.leaf_modules(groups), "name", "layer_no") == [("L0/M1/L0", 0), ("L1/M2", 1), ("L1/M21", 1)]


def test_approximation_counts_downward_edges(spark):
    files = [(f"a{i}", "L0/M0") for i in range(5)] + [("b", "L1/M0"), ("gone", "L1/M0")]
    groups = spark.createDataFrame([("r", 1, n, f) for f, n in files], "repo string, rev int, name string, file string")
    nodes = spark.createDataFrame([("r", 1, f) for f, _ in files if f != "gone"], NODE)
    edges = spark.createDataFrame([("r", 1, "a0", "b", "x", 1.0), ("r", 1, "b", "a0", "x", 1.0), ("r", 1, "a0", "a1", "x", 1.0), ("r", 1, "a1", "a1", "x", 1.0)], EDGE)
    got = {r.name: r for r in M.approximate_modules(groups, nodes, edges).collect()}
    top = got["L0/M0"]
    assert (top.clddp, top.imcp, top.sp, top.sf) == (pytest.approx(1 / 5), pytest.approx(1 / 20), pytest.approx(1.0), pytest.approx(5 / 6))
    assert got["L1/M0"].clddp == 0 and got["L1/M0"].module_files == 1
    total = M.approximate_mscore(M.approximate_modules(groups, nodes, edges)).collect()[0]
    assert total.mscore == pytest.approx((5 / 6 * 0.8 * 0.95 + 1 / 6) * 0.6258 * 100)


def test_independence_level(spark):
    layers = spark.createDataFrame([("r", 1, 0, "a"), ("r", 1, 2, "b"), ("r", 1, 2, "b"), ("r", 1, 2, "c")], "repo string, rev int, layer_no int, file string")
    nodes = spark.createDataFrame([("r", 1, x) for x in "abcd"] + [("q", 1, "z")], NODE)
    got = {r.repo: r.independence_level for r in M.independence_level(layers, nodes).collect()}
    assert got == {"r": 0.5, "q": 0.0}
