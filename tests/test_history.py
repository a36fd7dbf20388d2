import datetime

from pyspark.sql import functions as F

from chronolith.operators import common as Q
from chronolith.operators import history as H

DAY = datetime.datetime(2020, 1, 1)


def commits(spark, days, repo="r"):
    rows = [(repo, f"h{i:03d}", DAY + datetime.timedelta(days=d), f"c{i}") for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "repo string, hash string, ts timestamp_ntz, subject string")


def picked(df):
    return [r.hash for r in df.orderBy("position").collect()]


def test_even_sample(spark):
    c = commits(spark, range(23))
    want = [f"h{22 - i:03d}" for i in (0, *(int(i * 22 / 4) for i in range(1, 4)), 22)]
    assert picked(H.sample_even(c, 5)) == want
    assert len(picked(H.sample_even(c, 30))) == 23
    assert picked(H.sample_even(c, 1)) == ["h022"] and picked(H.sample_even(c, 2)) == ["h022", "h000"]


def test_recent_sample_is_greedy_and_filled_up(spark):
    c = commits(spark, [0, 10, 40, 65, 69, 100])
    assert picked(H.sample_recent(c, 3, 1)) == ["h005", "h004", "h001"]
    assert picked(H.sample_recent(c, 10, 1)) == ["h005", "h004", "h001", "h000"]
    assert picked(H.sample_recent(c, 10, 12)) == ["h005", "h000"]


def test_recent_sample_reads_the_whole_history(spark):
    c = commits(spark, [0, 400, *[800] * 300])
    assert picked(H.sample_recent(c, 3, 1)) == ["h301", "h001", "h000"] and picked(H.sample_recent(c, 3, 1, 300)) == ["h301", "h002"]


def test_bugs_and_tracker_read_all_commits(spark):
    c = commits(spark, range(2100)).withColumn("subject", F.when(F.substring("hash", 2, 9).cast("int") < 100, F.lit("fix AB-1")).otherwise(F.lit("docs")))
    issues = spark.createDataFrame([("r", "AB-1", "bug", "s")], "repo string, key string, type string, summary string")
    assert sorted(b.rank for b in H.bug_commits(c, issues).collect()) == list(range(1, 101)) and H.bug_commits(c, issues, 80).count() == 80
    full, newest = H.detect_tracker(c).collect()[0], H.detect_tracker(c, last=2000).collect()[0]
    assert (full.total, full.jira_hits, full.project) == (2100, 100, "AB") and (newest.total, newest.source) == (2000, "none")


def test_every_nth_sample(spark):
    c = commits(spark, range(10))
    assert picked(H.sample_every(c, 3, 4)) == ["h009", "h005", "h001"]
    assert picked(H.sample_every(c, 5, 4)) == ["h009", "h005", "h001", "h000"]


def test_largest_sample_keeps_time_order(spark):
    c = commits(spark, range(4))
    changes = spark.createDataFrame([("r", "h000", 5, 5), ("r", "h002", 100, 0), ("r", "h001", 1, 0)], "repo string, hash string, added long, deleted long")
    assert picked(H.sample_largest(c, changes, 2)) == ["h002", "h000"]


def test_windows_are_half_open(spark):
    c = commits(spark, [0, 5, 10, 15])
    revs = spark.createDataFrame([("r", 1, DAY + datetime.timedelta(days=10)), ("r", 3, DAY)], "repo string, rev int, commit_ts timestamp_ntz")
    got = H.assign_windows(c, H.revision_windows(revs)).select("hash", "new_rev", "old_rev").collect()
    assert sorted(tuple(r) for r in got) == [("h001", 1, 3), ("h002", 1, 3)]


def test_nearest_revision_prefers_the_newer(spark):
    revs = spark.createDataFrame([("r", 1, DAY + datetime.timedelta(days=10)), ("r", 2, DAY), ("r", 3, DAY)], "repo string, rev int, commit_ts timestamp_ntz")
    targets = spark.createDataFrame([("r", (DAY + datetime.timedelta(days=d)).date()) for d in (-9, 0, 4, 5, 99)], "repo string, target date")
    got = [(r.rev, r.days) for r in H.nearest_revisions(targets, revs).orderBy("target").collect()]
    assert got == [(2, 9), (2, 0), (2, 4), (1, 5), (1, 89)]


def test_metric_changes_round_then_relate(spark):
    m = spark.createDataFrame([("r", 1, "m-score", 50.126), ("r", 2, "m-score", 50.0), ("r", 3, "m-score", 0.0), ("r", 4, "m-score", None)],
                              "repo string, rev int, metric string, value double")
    got = {(r.new_rev): (r.delta, r.relative) for r in H.metric_changes(m).collect()}
    assert got == {1: (0.13, 0.26), 2: (50.0, None), 3: (None, None)}
    assert {r.new_rev: r.relative for r in H.changed_metrics(m).collect()}[2] == 0.0


def test_numbers_skip_empty_revisions(spark):
    rows = [("r", "a", DAY, 0.0, None, None, 0.0), ("r", "b", DAY + datetime.timedelta(days=1), 1.0, None, None, None), ("r", "c", DAY + datetime.timedelta(days=2), None, None, None, None)]
    df = spark.createDataFrame(rows, "repo string, commit_hash string, commit_ts timestamp_ntz, `m-score` double, `propagation-cost` double, `decoupling-level` double, `independence-level` double")
    assert [(r.commit_hash, r.revision_number) for r in H.number_revisions(df).collect()] == [("b", 1)]


def test_first_typed_key_decides(spark, rows):
    c = commits(spark, [0, 1, 2]).withColumn("subject", F.expr("element_at(array('AB-9 AB-2 AB-1', 'x #7', 'none'), cast(substring(hash, 4, 1) as int) + 1)"))
    issues = spark.createDataFrame([("r", "AB-1", "feature", "s"), ("r", "AB-2", "bug", None), ("r", "AB-9", None, "t"), ("r", "GH#7", "test", None)],
                                   "repo string, key string, type string, summary string")
    assert rows(H.classify_commits(c, issues), "hash", "type") == [("h000", "bug"), ("h001", "test"), ("h002", "unknown")]
    bugs = H.bug_commits(c, issues).collect()
    assert [(b.hash, b.title) for b in bugs] == [("h000", "t")]


def test_tracker_detection(spark):
    c = commits(spark, range(6)).withColumn("subject", F.lit("closes #1"))
    remote = spark.createDataFrame([("r", "git@github.com:org/proj.git")], "repo string, url string")
    assert [(r.source, r.slug) for r in H.detect_tracker(c, remote).collect()] == [("github", "org/proj")]
    assert H.detect_tracker(c).collect()[0].source == "none"
    assert H.detect_tracker(c.withColumn("subject", F.lit("XY-1 XY-2"))).collect()[0].project == "XY"


def test_numbering_spreads_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("hot").alias("k"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Q.numbered(df, ["k"], [F.col("id").desc()]).groupBy("k").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.max_by("id", "rank")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(tuple(r) for r in got) == [("b", 1, 500, 500, 0), ("hot", 1, 4500, 4500, 1)]
