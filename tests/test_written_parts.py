"""Reports and metrics join parts that were written by jobs of their own."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronolith.operators import modularity


def test_revision_metrics_join_written_parts(spark):
    numbers = lambda *names: spark.createDataFrame([("r", 1, *[0.5] * len(names))], ["repo", "rev", *names]).groupBy("repo", "rev").agg(*[F.max(n).alias(n) for n in names])
    exact = numbers("mscore_percentage", "size_factor_total", "avg_clddf", "avg_imcf", "num_modules")
    rows = modularity.revision_metrics(exact, numbers("pc_matrix"), numbers("il"), numbers("balance"), numbers("m_score"))
    # the parts' own aggregates were other jobs
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.repo, r.rev, r.series_mscore, r.pc_matrix) for r in rows.collect()] == [("r", 1, 0.5, 0.5)]


@pytest.fixture(scope="module")
def own_tables(spark, tmp_path_factory):
    """Two years of orders of one segment, as the smallest history with a transition."""
    path = str(tmp_path_factory.mktemp("own"))
    day = lambda y, d: datetime.datetime(y, 3, d)
    put = lambda name, rows, kinds: spark.createDataFrame(rows, kinds).write.parquet(f"{path}/{name}.parquet")
    put("region", [(0, "AFRICA"), (1, "ASIA")], "r_regionkey bigint, r_name string")
    put("nation", [(0, "N0", 0), (1, "N1", 1)], "n_nationkey bigint, n_name string, n_regionkey bigint")
    put("customer", [(1, "Customer#1", 0, "BUILDING"), (2, "Customer#2", 1, "BUILDING")], "c_custkey bigint, c_name string, c_nationkey bigint, c_mktsegment string")
    put("supplier", [(1, 0), (2, 1)], "s_suppkey bigint, s_nationkey bigint")
    put("part", [(k, "PROMO", "B", 10 + k) for k in (1, 2, 3)], "p_partkey bigint, p_type string, p_brand string, p_size bigint")
    put("orders", [(n, 1 + n % 2, "O", day(1995 + n // 3, 1 + n), "1-URGENT") for n in range(6)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string")
    put("lineitem", [(n, 1 + (n + k) % 3, 1 + (n + k) % 2, k, 10.0 * k, 0.05, 0.02, "N", "O") for n in range(6) for k in (1, 2)],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    return path


def test_evidence_joins_written_parts(spark, own_tables):
    rows = entry.queries()["evidence_texts_c4"](spark, own_tables)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # nodes, edges, order lines and places were read by other jobs
    assert not any(f"{c}#" in plan for c in ("l_partkey", "src", "dest", "node", "module_path", "hash"))
    found = rows.collect()
    assert [(r.repo, r.new_rev) for r in found] == [("BUILDING", 1)]
    assert "- nodes: new=3, old=3, delta=0\n" in found[0].text and "### Commit Context" in found[0].text
