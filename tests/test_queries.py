"""A selection of registered queries against their SQL on the smallest tables; tools/check.py runs all of them."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, check  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SELECTED = [
    "normalise_path_f1_f2", "issue_keys_f7", "commit_windows_j9_p2", "sample_even_w10",
    "metric_changes_w2_f20", "typed_churn_totals_a6", "edge_changes_j2_u2",
    "strong_components_g4", "cochange_pairs_bulk_j5", "clustering_move_counts_j4", "mscore_g8", "file_risk_c1_c2", "quantiles_a16", "cosine_search_t4_j18_t10_p3",
    "typed_log_changes_s6", "report_findings_c12",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SELECTED)
def test_query_matches_sql(spark, con, name):
    state, n, *_, note = check(spark, con, name, SMALL)
    assert state == "ok", note
    assert n > 0 or name == "strong_components_g4"


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
