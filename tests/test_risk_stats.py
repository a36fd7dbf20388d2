import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import risk as K
from chronolith.operators import stats as S


def frame(spark, values, repo="r"):
    return spark.createDataFrame([(repo, f"f{i}", float(v)) for i, v in enumerate(values)], "repo string, file string, value double")


def test_normalise_and_score(spark):
    table = spark.createDataFrame(
        [("r", "a", 4.0, 0.0, 1.0, 10.0, 0.0, 2.0, 0.0), ("r", "b", 0.0, 0.0, 1.0, 30.0, 8.0, 1.0, 0.0), ("q", "c", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
        "repo string, file string, " + ", ".join(f"{s} double" for s in K.RAW))
    got = {r.file: r for r in K.ranked(K.scored(table)).collect()}
    assert (got["a"].risk_score, got["b"].risk_score, got["c"].risk_score) == (0.4, 0.3, 0.0)
    assert (got["a"].rank, got["b"].rank, got["c"].rank) == (1, 2, 1) and got["b"].norm_total_churn == 1.0
    heavier = {r.file: r.rank for r in K.ranked(K.scored(table, {"bug_churn": 0.9})).collect()}
    assert heavier == {"a": 2, "b": 1, "c": 1}


def test_presence_and_fallback(spark):
    hot = spark.createDataFrame([("r", 1, "h", 5.0), ("r", 2, "h", 1.0)], "repo string, rev int, node string, fan_in double")
    member = spark.createDataFrame([("r", 1, "cycle", "m"), ("r", 1, "clique", "m"), ("r", 1, "cycle", "m")], "repo string, rev int, type string, file string")
    dangerous = spark.createDataFrame([("r", v, f) for v in (1, 2) for f in ("h", "m", "d", "late")], "repo string, rev int, file string")
    churn = spark.createDataFrame([("r", 1, "src/main/java/c", 7), ("r", 2, "late", 1)], "repo string, rev int, path string, churn long")
    patterns = K.anti_pattern_rows(member, dangerous)
    table = {r.file: r for r in K.signal_table(K.structural_signals(hot, patterns, churn)).collect()}
    assert (table["h"].hotspot_fanin_score, table["h"].rev_count, table["h"].anti_pattern_count) == (6.0, 2.0, 1.0)
    assert (table["m"].anti_pattern_count, table["m"].rev_count) == (3.0, 0.0)
    assert (table["d"].anti_pattern_count, table["d"].rev_count) == (1.0, 1.0) and table["c"].total_churn == 7.0
    assert table["late"].rev_count == 1.0
    assert {r.file: r.anti_patterns_seen for r in K.types_seen(patterns).collect()}["m"] == ["DangerousFile", "clique", "cycle"]


def test_bug_churn_choice(spark, rows):
    schema = "repo string, file string, bug_churn long"
    typed = spark.createDataFrame([("a", "x", 0), ("b", "x", 3), ("b", "y", 0)], schema)
    words = spark.createDataFrame([("a", "z", 9), ("b", "z", 9)], schema)
    assert rows(K.choose_bug_churn(typed, words)) == [("a", "z", 9), ("b", "x", 3), ("b", "y", 0)]
    files = spark.createDataFrame([("r", 1, "fix", "a", 1), ("r", 1, "bugfix", "b", 2), ("r", 2, "fix", "c", 3)], "repo string, rev int, type string, path string, churn long")
    assert rows(K.bug_rows(files), "rev", "path") == [(1, "b"), (2, "c")]


def test_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    values = [rnd.choice([0, 0, 0, 1.5, 2, 7, 9.25]) * rnd.random() for _ in range(211)]
    row = S.describe(frame(spark, values), ["repo"]).collect()[0]
    for name, q in S.QUARTILES.items():
        assert row[name] == pytest.approx(np.percentile(values, q * 100))
    assert row["std"] == pytest.approx(np.std(values)) and row["n"] == 211


def test_histogram_matches_numpy(spark):
    rnd = random.Random(4)
    for values in ([rnd.gauss(0, 1) for _ in range(97)], [2.0] * 7, [i / 10 for i in range(101)]):
        bins = min(40, max(10, len(values) // 5))
        want, edges = np.histogram(values, bins=bins)
        got = S.histogram(frame(spark, values)).orderBy("bin").collect()
        assert [r.n for r in got] == list(want)
        assert [r.bin_from for r in got] == pytest.approx(list(edges[:-1]))


def test_density_matches_formula(spark):
    values = [1.0, 2.0, 2.0, 3.0, 5.0, 8.0, 13.0]
    got = S.density(frame(spark, values), 5).orderBy("point").collect()
    h = statistics.stdev(values) * len(values) ** -0.2
    width = (13.0 - 1.0) / 10
    for i, r in enumerate(got):
        x = 1.0 + i * 12.0 / 4
        assert r.x == pytest.approx(x)
        assert r.height == pytest.approx(sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in values) * width / (h * math.sqrt(2 * math.pi)))
    assert S.density(frame(spark, [1.0] * 9)).count() == 0


def test_rank_correlation(spark):
    rnd = random.Random(5)
    rows = [("r", f"f{i}", rnd.randrange(5) / 10, *[float(rnd.randrange(4)) for _ in range(5)], 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "repo string, file string, risk_score double, " + ", ".join(f"{s} double" for s in K.SIGNALS))
    got = {(r.a, r.b): r for r in S.rank_correlations(df).collect()}

    def ranks(v):
        order = sorted(v)
        return np.array([order.index(x) + (order.count(x) + 1) / 2 for x in v])

    x, y = (ranks([r[i] for r in rows]) for i in (2, 3))
    assert got[("risk_score", list(K.SIGNALS)[0])].rho == pytest.approx(np.corrcoef(x, y)[0, 1])
    flat = list(K.SIGNALS)[-1]
    assert got[(flat, flat)].rho == 1.0 and got[("risk_score", flat)].rho == 0.0 and len(got) == 49


def test_p_values_of_known_points(spark):
    points = spark.createDataFrame([(0.6319, 10), (0.4629, 30), (0.0, 12), (1.0, 12), (0.5, 2), (-0.1, 100000)], "r double, n long")
    five, one, none, full, few, many = [x.p for x in points.select(S.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    # two-sided 5 % and 1 % critical values of the correlation for 8 and 28 degrees of freedom
    assert five == pytest.approx(0.05, abs=2e-4)
    assert one == pytest.approx(0.01, abs=2e-4)
    assert none == 1.0 and full == 0.0 and few is None and many < 1e-12


def test_statistics_by_type_put_plain_files_last(spark):
    rows = [("r", "a", 0.9, ["x"]), ("r", "b", 0.1, ["x", "y"]), ("r", "c", 0.8, ["y"]), ("r", "d", 1.0, [])]
    df = spark.createDataFrame(rows, "repo string, file string, risk_score double, anti_patterns_seen array<string>")
    got = [(r.type, r.n, r.median) for r in S.describe_by_type(df).orderBy("position").collect()]
    assert got == [("x", 2, 0.5), ("y", 2, pytest.approx(0.45)), ("(no anti-pattern)", 1, 1.0)]


def test_scores_stay_within_the_weights(spark):
    rnd = random.Random(6)
    rows = [("r", f"f{i}", *[float(rnd.randrange(50)) for _ in K.RAW]) for i in range(80)]
    table = spark.createDataFrame(rows, "repo string, file string, " + ", ".join(f"{s} double" for s in K.RAW))
    row = K.scored(table).agg(F.min("risk_score").alias("lo"), F.max("risk_score").alias("hi")).collect()[0]
    assert 0 <= row.lo <= row.hi <= sum(K.WEIGHTS.values()) + 1e-9
