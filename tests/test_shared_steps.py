"""Steps that several queries share: stored order lines, changes met by their commits once, the fallback for dangerous files."""

import datetime as dt

from pyspark.sql import functions as F

from chronolith.operators import graph as G
from chronolith.operators import history as H
from chronolith.operators import modularity as M
from chronolith.operators import risk as K
from chronolith.plans.bindings import LINE, History

DAY = dt.datetime(1996, 1, 2)


def tables(spark, path):
    frames = {
        "customer": ([(1, "Customer#1", 3, 0.0, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(k, 1, "O", 1.0, DAY, "1-URGENT") for k in (1, 2)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "part": ([(1, "a", "B#1", "PROMO", 5, 1.0), (2, "b", "B#2", None, 6, 1.0), (3, "c", "B#3", "SMALL", 7, 1.0), (3, "c", "B#3", "Small", 7, 1.0)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "lineitem": ([(1, p, 1, n, q, 1.0, 0.05, 0.0, "A", "O", DAY) for n, (p, q) in enumerate([(1, 9.0), (2, 5.0), (3, 5.0)])] + [(2, 2, 1, 1, 8.0, 1.0, 0.0, 0.0, "R", "F", DAY), (2, 1, 1, 2, 3.0, 1.0, 0.0, 0.0, None, "F", DAY)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_stored_lines_hold_only_what_is_read(spark, rows, tmp_path):
    folder = tables(spark, tmp_path)
    plain, stored = History(spark, folder), History(spark, folder).stored("lines")
    assert stored.lines.columns == [*LINE, "path"]
    # the written files hold neither paths nor unread columns
    assert spark.read.parquet(stored.lines.inputFiles()[0].rsplit("/", 1)[0]).columns == LINE
    for name in ("file_changes", "nodes", "edges"):
        assert rows(getattr(stored, name)) == rows(getattr(plain, name))
    # a part without type has no path and the empty name; spellings of one type are one node of an edge
    assert rows(plain.edges, "src", "dest", "kind", "weight") == sorted([
        ("", "org/promo/P1.java", None, 3.0), ("org/promo/P1.java", "", "A", 5.0), ("org/promo/P1.java", "org/small/P3.java", "A", 10.0)], key=str)


def test_changes_meet_their_commits_once(spark, rows):
    placed = spark.createDataFrame(
        [("r", "a", 1, 2, "Fix crash X-1"), ("r", "a", 2, 3, "Fix crash X-1"), ("r", "b", 1, 2, "Add X-2"), ("r", "c", 1, 2, None), (None, "a", 1, 2, "Fix")],
        "repo string, hash string, new_rev int, old_rev int, subject string")
    changes = spark.createDataFrame([("r", "a", "p", 2, 1), ("r", "a", "q", None, 4), ("r", "b", "p", 5, 0), ("r", "c", "p", 1, 1), ("r", "z", "p", 9, 9)],
                                    "repo string, hash string, path string, added long, deleted long")
    issues = spark.createDataFrame([("r", "X-1", "bug", ""), ("r", "X-2", "feature", "")], "repo string, key string, type string, summary string")
    met = K.placed_changes(placed, changes, issues)
    assert met.count() == 4 and met.select("hash").distinct().count() == 3
    spread = met.withColumn("rev", F.explode("revs"))
    assert rows(H.file_churn(spread, ["repo", "rev"], None)) == rows(K.churn_by_revision(placed, changes))
    bugs = H.typed_file_churn(spread.filter(F.col("type").isin(*K.BUG_TYPES)), ["repo", "rev"], None)
    assert rows(K.bug_rows(bugs)) == rows(K.bug_rows(K.typed_churn_by_revision(placed, changes, issues)))
    # a commit of two windows counts once for its bug words
    assert rows(H.normalised_bug_churn(met.filter("fixing"))) == rows(H.keyword_bug_churn(placed, changes)) == [("r", "p", 3), ("r", "q", 4)]


def test_heaviest_of_all_hotspots(spark, rows):
    nodes = spark.createDataFrame([("r", 1, n) for n in "abcd"] + [("r", 2, "a")], "repo string, rev int, node string")
    edges = spark.createDataFrame([("r", 1, "a", "b", "k", 2.0), ("r", 1, "c", "b", "k", 1.0)], "repo string, rev int, src string, dest string, kind string, weight double")
    assert rows(G.heaviest(G.hotspots(nodes, edges, None), 2)) == rows(G.hotspots(nodes, edges, 2))
    assert rows(G.hotspots(nodes, edges, 2), "rev", "node", "rank") == [(1, "a", 2), (1, "b", 1), (2, "a", 1)]


def test_approximate_modules_read_groups_three_times_at_most(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    groups = [("r", 1, n, f) for f, n in [("a", "L0"), ("a", "L0/M0"), ("b", "L0"), ("b", "L0/M0"), ("c", "L1"), ("c", "L1/M0")]]
    schema = "repo string, rev int, name string, file string"
    nodes = spark.createDataFrame([("r", 1, f) for f in "abc"], "repo string, rev int, node string")
    edges = spark.createDataFrame([("r", 1, "a", "b", "k", 1.0), ("r", 1, "a", "c", "k", 1.0)], "repo string, rev int, src string, dest string, kind string, weight double")
    got = rows(M.approximate_modules(spark.createDataFrame(groups, schema).mapInPandas(counted, schema), nodes, edges), "name", "module_files", "clddp", "imcp")
    assert got == [("L0/M0", 2, 0.5, 0.0), ("L1/M0", 1, 0.0, 0.0)]
    assert seen.value <= 3 * len(groups)
