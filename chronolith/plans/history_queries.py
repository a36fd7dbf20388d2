"""Queries over commits, churn, issue types, revision sampling and metric series."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import classify as C
from chronolith.functions.text import change_text
from chronolith.operators import history as H
from chronolith.operators import stats as S
from chronolith.plans.oracle import sql
from chronolith.plans.registry import query, uncut
from chronolith.plans.scalar_queries import KEYS_SQL, _contains

NEW = "ORDER BY ts DESC, hash DESC"
ORD = f"ordered AS (SELECT *, row_number() OVER (PARTITION BY repo {NEW}) AS position, count(*) OVER (PARTITION BY repo) AS n FROM commits)"
KEYROWS = f"""keyrows AS (SELECT repo, hash, unnest(keys) AS key, generate_subscripts(keys, 1) AS pos FROM (SELECT repo, hash, {KEYS_SQL} AS keys FROM commits))"""
TYPED = """typed AS (SELECT c.*, coalesce(k.type, 'unknown') AS type FROM commits c LEFT JOIN (
  SELECT r.repo, r.hash, min_by(i.type, r.pos) AS type FROM keyrows r JOIN issues i ON i.repo = r.repo AND i.key = r.key AND i.type IS NOT NULL
  GROUP BY 1, 2) k ON c.repo = k.repo AND c.hash = k.hash)"""


@query("revision_pairs_j10", sql("SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, CAST(old_rev AS BIGINT) AS old_rev FROM pairs"))
def _(h):
    return h.pairs.select("repo", *[F.col(c).cast("bigint").alias(c) for c in ("new_rev", "old_rev")])


@query("commit_windows_j9_p2", sql("SELECT repo, hash, CAST(new_rev AS BIGINT) AS new_rev, CAST(old_rev AS BIGINT) AS old_rev FROM placed"))
def _(h):
    rows = H.assign_windows(h.commits, h.windows)
    return rows.select("repo", "hash", *[F.col(c).cast("bigint").alias(c) for c in ("new_rev", "old_rev")])


@query("commits_between_p2", sql(f"""
    SELECT repo, hash FROM (SELECT *, row_number() OVER (PARTITION BY repo {NEW}) AS k FROM commits
      WHERE CAST(ts AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1998-06-30') WHERE k <= 50"""))
def _(h):
    return H.commits_between(h.commits, "1997-03-01", "1998-06-30", 50).select("repo", "hash")


@query("revision_metadata_j15", sql("""
    SELECT e.repo, CAST(e.rev AS BIGINT) AS rev, commit_hash, author, count(*) AS edges FROM edges e LEFT JOIN revisions r ON e.repo = r.repo AND e.rev = r.rev GROUP BY ALL"""))
def _(h):
    counts = h.edges.groupBy("repo", "rev").agg(F.count(F.lit(1)).alias("edges"))
    return H.attach_revision(counts, h.revisions).select("repo", F.col("rev").cast("bigint").alias("rev"), "commit_hash", "author", "edges")


@query("nearest_revision_j11", sql("""
    SELECT repo, target, CAST(rev AS BIGINT) AS rev, CAST(d AS BIGINT) AS days FROM (
      SELECT t.repo, CAST(t.target AS VARCHAR) AS target, r.rev, abs(CAST(r.commit_ts AS DATE) - t.target) AS d,
        row_number() OVER (PARTITION BY t.repo, t.target ORDER BY abs(CAST(r.commit_ts AS DATE) - t.target), r.rev) AS k
      FROM (SELECT DISTINCT repo, CAST(ts AS DATE) AS target FROM commits) t JOIN revisions r ON r.repo = t.repo) WHERE k = 1"""))
def _(h):
    targets = h.commits.select("repo", F.col("ts").cast("date").alias("target")).distinct()
    rows = H.nearest_revisions(targets, h.revisions)
    return rows.select("repo", F.col("target").cast("string").alias("target"), F.col("rev").cast("bigint").alias("rev"), "days")


# --- sampling ------------------------------------------------------------------


@query("sample_even_w10", sql("""
    SELECT repo, hash, position FROM ordered WHERE n < 10 OR position - 1 = 0 OR position = n OR position - 1 IN (
      SELECT CAST(floor(i * (n - 1) / 9.0::DOUBLE) AS BIGINT) FROM range(1, 9) t(i))""", ORD))
def _(h):
    return H.sample_even(h.commits, 10).select("repo", "hash", "position")


@query("sample_recent_w11", sql("""
    SELECT repo, hash, position FROM picks UNION
    SELECT repo, hash, position FROM ordered o WHERE position = (SELECT max(position) FROM ordered x WHERE x.repo = o.repo AND x.position <= 6000)
      AND (SELECT count(*) FROM picks p WHERE p.repo = o.repo) < 10""", ORD, """
    picks AS (SELECT repo, hash, position, CAST(ts AS DATE) AS day, 1 AS k FROM ordered WHERE position = 1
      UNION ALL SELECT n.repo, n.hash, n.position, CAST(n.ts AS DATE), p.k + 1 FROM picks p JOIN ordered n ON n.repo = p.repo AND p.k < 10
        AND n.position = (SELECT min(x.position) FROM ordered x WHERE x.repo = p.repo AND x.position > p.position AND x.position <= 6000
          AND abs(p.day - CAST(x.ts AS DATE)) >= 180))"""))
def _(h):
    return H.sample_recent(h.commits, 10, 6, 6000).select("repo", "hash", "position")


@query("sample_recent_all_w11", uncut("sample_recent_w11", " AND x.position <= 6000"))
def _(h):
    return H.sample_recent(h.commits, 10, 6).select("repo", "hash", "position")


@query("sample_every_w12", sql("""
    SELECT repo, hash, position FROM (SELECT *, max(position) OVER (PARTITION BY repo) AS seen FROM ordered WHERE position <= 9 * 400 + 1)
    WHERE (position - 1) % 400 = 0 OR (position = seen AND floor((seen - 1) / 400.0::DOUBLE) + 1 < 10)""", ORD))
def _(h):
    return H.sample_every(h.commits, 10, 400).select("repo", "hash", "position")


@query("sample_largest_w13", sql(f"""
    SELECT repo, hash, CAST(lines AS BIGINT) AS lines, row_number() OVER (PARTITION BY repo {NEW}) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY repo ORDER BY lines DESC, ts DESC, hash DESC) AS k FROM (
        SELECT c.*, coalesce(s.lines, 0) AS lines FROM commits c LEFT JOIN (SELECT repo, hash, sum(added + deleted) AS lines FROM file_changes GROUP BY 1, 2) s
        ON c.repo = s.repo AND c.hash = s.hash)) WHERE k <= 12"""))
def _(h):
    return H.sample_largest(h.commits, h.file_changes, 12).select("repo", "hash", "lines", "position")


@query("sample_newest_w14", sql("SELECT repo, hash, position FROM ordered WHERE position <= 15", ORD))
def _(h):
    return H.sample_newest(h.commits, 15).select("repo", "hash", "position")


@query("numbered_revisions_p1_w6", sql("""
    SELECT m.repo, commit_hash, row_number() OVER (PARTITION BY m.repo ORDER BY commit_ts DESC, commit_hash DESC) AS revision_number
    FROM mwide m JOIN revisions r ON m.repo = r.repo AND m.rev = r.rev
    WHERE greatest(abs(coalesce(ms, 0)), abs(coalesce(pc, 0)), abs(coalesce(dl, 0)), abs(coalesce(il, 0))) > 0"""))
def _(h):
    analysed = h.metrics_wide.join(h.revisions.select("repo", "rev", "commit_hash", "commit_ts"), ["repo", "rev"])
    return H.number_revisions(analysed).select("repo", "commit_hash", "revision_number")


@query("newest_revisions_w7", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, commit_hash FROM revisions WHERE rev <= 5"))
def _(h):
    return H.newest_revisions(h.revisions).select("repo", F.col("rev").cast("bigint").alias("rev"), "commit_hash")


# --- metric series -------------------------------------------------------------

# format() rounds the exact value, as Spark does; round() multiplies first
DELTAS = """deltas AS (SELECT *, CAST(format('{:.2f}', raw) AS DOUBLE) AS delta, CASE WHEN old_value <> 0 THEN CAST(format('{:.2f}', CAST(format('{:.2f}', raw) AS DOUBLE) / old_value * 100.0::DOUBLE) AS DOUBLE) END AS relative FROM mchanges)"""


@query("metric_changes_w2_f20", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, CAST(old_rev AS BIGINT) AS old_rev, metric, delta, relative,
      CASE WHEN raw IS NOT NULL THEN concat(metric, ': ', round(old_value, 2), ' → ', round(new_value, 2), ' (Δ=', format('{:+.2f}', delta), ' points',
        CASE WHEN relative IS NULL THEN '' ELSE concat(', ', format('{:+.2f}', relative), '% relative') END, ')') END AS text FROM deltas""", DELTAS))
def _(h):
    rows = H.metric_changes(h.metrics)
    text = change_text(F.col("metric"), F.col("old_value"), F.col("new_value"), F.col("delta"), F.col("relative"))
    return rows.select("repo", F.col("new_rev").cast("bigint").alias("new_rev"), F.col("old_rev").cast("bigint").alias("old_rev"), "metric", "delta", "relative", text.alias("text"))


@query("changed_metrics_p6", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, metric, round(raw, 6) AS delta, round(CASE WHEN old_value = 0 THEN 0 ELSE raw / old_value * 100.0::DOUBLE END, 6) AS relative
    FROM mchanges WHERE raw IS NOT NULL AND raw <> 0"""))
def _(h):
    return H.changed_metrics(h.metrics).select(
        "repo", F.col("new_rev").cast("bigint").alias("new_rev"), "metric", F.round("delta", 6).alias("delta"), F.round("relative", 6).alias("relative"))


@query("significant_changes_p7", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, metric, round(raw, 6) AS delta, round(raw / old_value * 100.0::DOUBLE, 6) AS relative,
      CASE WHEN raw > 0 THEN 'up' ELSE 'down' END AS direction FROM mchanges WHERE abs(raw) >= 1.5"""))
def _(h):
    return S.significant_changes(h.metrics, 1.5).select(
        "repo", F.col("new_rev").cast("bigint").alias("new_rev"), "metric", F.round("delta", 6).alias("delta"), F.round("relative", 6).alias("relative"), "direction")


@query("peak_change_w8", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, CAST(old_rev AS BIGINT) AS old_rev, round(raw, 6) AS delta FROM (
      SELECT *, row_number() OVER (PARTITION BY repo ORDER BY abs(raw) DESC, new_rev) AS k FROM mchanges WHERE metric = 'm-score' AND raw IS NOT NULL) WHERE k = 1"""))
def _(h):
    return H.peak_change(h.metrics).select(
        "repo", F.col("new_rev").cast("bigint").alias("new_rev"), F.col("old_rev").cast("bigint").alias("old_rev"), F.round("delta", 6).alias("delta"))


@query("series_summary_a17_w9_f15", sql("""
    SELECT repo, metric, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(max_by(value, rev), 6) AS first,
      round(min_by(value, rev), 6) AS last, round(min_by(value, rev) - max_by(value, rev), 6) AS change, round(coalesce(stddev_samp(value), 0), 6) AS volatility,
      CASE WHEN metric <> 'propagation-cost' AND min_by(value, rev) > max_by(value, rev) THEN 'improved'
        WHEN metric <> 'propagation-cost' AND min_by(value, rev) < max_by(value, rev) THEN 'degraded' ELSE 'changed' END AS trend
    FROM metrics WHERE value IS NOT NULL GROUP BY repo, metric"""))
def _(h):
    numbers = ("min", "max", "mean", "first", "last", "change", "volatility")
    return S.series_summary(h.metrics).select("repo", "metric", "trend", *[F.round(c, 6).alias(c) for c in numbers])


@query("month_range_a29", sql("SELECT repo, min(strftime(ts, '%Y-%m')) AS start_month, max(strftime(ts, '%Y-%m')) AS end_month FROM commits GROUP BY repo"))
def _(h):
    return H.month_range(h.commits)


# --- churn -----------------------------------------------------------------------


@query("commit_sizes_a8", sql("SELECT repo, hash, CAST(sum(added + deleted) AS BIGINT) AS lines, count(*) AS files FROM file_changes GROUP BY 1, 2"))
def _(h):
    return H.commit_sizes(h.file_changes)


@query("file_churn_a5", sql("SELECT repo, path, CAST(sum(added + deleted) AS BIGINT) AS churn FROM file_changes GROUP BY 1, 2"))
def _(h):
    return H.file_churn(h.file_changes, ["repo"], None)


@query("recent_file_churn_a5", sql("""
    SELECT repo, path, churn, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY churn DESC, path) AS rank FROM (
      SELECT f.repo, f.path, CAST(sum(added + deleted) AS BIGINT) AS churn FROM file_changes f JOIN ordered o ON f.repo = o.repo AND f.hash = o.hash
      WHERE o.position <= 50 GROUP BY 1, 2)) WHERE rank <= 10""", ORD))
def _(h):
    return H.recent_file_churn(h.commits, h.file_changes)


@query("window_file_churn_a5_w5", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, path, churn, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY churn DESC, path) AS rank FROM (
      SELECT f.repo, p.new_rev AS rev, f.path, CAST(sum(added + deleted) AS BIGINT) AS churn FROM file_changes f JOIN placed p ON f.repo = p.repo AND f.hash = p.hash
      GROUP BY ALL)) WHERE rank <= 10"""))
def _(h):
    from chronolith.operators.risk import churn_by_revision

    return churn_by_revision(h.placed, h.file_changes, 10).withColumn("rev", F.col("rev").cast("bigint"))


@query("commit_types_j7", sql("SELECT repo, type, count(*) AS n FROM typed GROUP BY 1, 2", KEYROWS, TYPED))
def _(h):
    return H.classify_commits(h.commits, h.issues).groupBy("repo", "type").agg(F.count(F.lit(1)).alias("n"))


TOTALS = """SELECT h.repo, CAST(h.new_rev AS BIGINT) AS new_rev, h.type, commit_count, coalesce(issue_key_count, 0) AS issue_key_count,
    coalesce(churn_total, 0) AS churn_total, coalesce(freq_total, 0) AS freq_total FROM
  (SELECT repo, new_rev, type, count(*) AS commit_count FROM ptyped GROUP BY ALL) h
  LEFT JOIN (SELECT t.repo, t.new_rev, t.type, count(DISTINCT key) AS issue_key_count FROM ptyped t JOIN keyrows k ON t.repo = k.repo AND t.hash = k.hash GROUP BY ALL) n
    ON h.repo = n.repo AND h.new_rev = n.new_rev AND h.type = n.type
  LEFT JOIN (SELECT t.repo, t.new_rev, t.type, CAST(sum(added + deleted) AS BIGINT) AS churn_total, count(*) AS freq_total FROM ptyped t
    JOIN file_changes f ON t.repo = f.repo AND t.hash = f.hash GROUP BY ALL) c ON h.repo = c.repo AND h.new_rev = c.new_rev AND h.type = c.type"""
PTYPED = "ptyped AS (SELECT t.*, p.new_rev, p.old_rev FROM typed t JOIN placed p ON t.repo = p.repo AND t.hash = p.hash)"


@query("typed_churn_totals_a6", sql(TOTALS, KEYROWS, TYPED, PTYPED))
def _(h):
    placed = H.assign_windows(h.commits, h.windows)
    return H.typed_totals(placed, h.file_changes, h.issues, ["repo", "new_rev"]).withColumn("new_rev", F.col("new_rev").cast("bigint"))


@query("typed_churn_files_a6", sql("""
    SELECT repo, type, measure, rank, path, n FROM (SELECT *, row_number() OVER (PARTITION BY repo, type, measure ORDER BY n DESC, path) AS rank FROM (
      SELECT repo, type, path, unnest(['churn', 'freq']) AS measure, unnest([churn, freq]) AS n FROM (
        SELECT t.repo, t.type, f.path, CAST(sum(added + deleted) AS BIGINT) AS churn, count(*) AS freq FROM typed t
        JOIN file_changes f ON t.repo = f.repo AND t.hash = f.hash GROUP BY ALL))) WHERE rank <= 20""", KEYROWS, TYPED))
def _(h):
    return H.typed_files(h.commits, h.file_changes, h.issues, ["repo"])


@query("keyword_bug_churn_a7", sql(f"""
    SELECT f.repo, f.node AS file, CAST(sum(added + deleted) AS BIGINT) AS bug_churn FROM file_changes f JOIN commits c ON f.repo = c.repo AND f.hash = c.hash
    WHERE regexp_matches(subject, '(?i)\\b({"|".join(C.BUG_WORDS_WIDE)})\\b') GROUP BY 1, 2"""))
def _(h):
    return H.keyword_bug_churn(h.commits, h.file_changes)


# --- period summaries ------------------------------------------------------------

RECENT = "recentw AS (SELECT *, row_number() OVER (PARTITION BY repo, new_rev ORDER BY ts DESC, hash DESC) AS rank FROM placed)"
PERIOD = "period AS (SELECT * FROM recentw)"


@query("period_categories_a9", sql(f"""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, count(*) AS total_commits, {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in C.COMMIT_CLASSES)}
    FROM (SELECT *, {_contains('subject', C.COMMIT_WORDS, 'other')} AS category FROM placed) GROUP BY 1, 2"""))
def _(h):
    rows = H.category_counts(H.assign_windows(h.commits, h.windows))
    return rows.select("repo", F.col("new_rev").cast("bigint").alias("new_rev"), "total_commits", *C.COMMIT_CLASSES)


@query("period_authors_a9", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, author, commits, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, new_rev ORDER BY commits DESC, author) AS rank
      FROM (SELECT repo, new_rev, author, count(*) AS commits FROM placed GROUP BY ALL)) WHERE rank <= 5"""))
def _(h):
    rows = H.top_authors(H.assign_windows(h.commits, h.windows))
    return rows.select("repo", F.col("new_rev").cast("bigint").alias("new_rev"), "author", "commits", "rank")


@query("period_hotspots_a9", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, path, changes, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, new_rev ORDER BY changes DESC, path) AS rank
      FROM (SELECT p.repo, p.new_rev, f.path, count(*) AS changes FROM placed p JOIN file_changes f ON p.repo = f.repo AND p.hash = f.hash GROUP BY ALL)) WHERE rank <= 10"""))
def _(h):
    rows = H.hotspot_files(H.assign_windows(h.commits, h.windows), h.file_changes)
    return rows.select("repo", F.col("new_rev").cast("bigint").alias("new_rev"), "path", "changes", "rank")


@query("period_commits_a9", sql("""
    SELECT r.repo, CAST(r.new_rev AS BIGINT) AS new_rev, r.rank, substring(r.hash, 1, 8) AS hash, substring(subject, 1, 80) AS message, strftime(ts, '%Y-%m-%d') AS date,
      coalesce(files, 0) AS files_changed FROM recentw r LEFT JOIN (SELECT repo, hash, count(*) AS files FROM file_changes GROUP BY 1, 2) f ON r.repo = f.repo AND r.hash = f.hash
    WHERE r.rank <= 5""", RECENT))
def _(h):
    placed = H.window_commits(h.commits, h.windows)
    return H.top_commits(placed, h.file_changes).drop("old_rev").withColumn("new_rev", F.col("new_rev").cast("bigint"))


SUMMARY_SQL = f"""summary AS (SELECT t.repo, t.new_rev, t.old_rev, t.total_commits, {", ".join(f"t.{c}" for c in C.COMMIT_CLASSES)}, top_authors, hotspot_files FROM (
    SELECT repo, new_rev, old_rev, count(*) AS total_commits, {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in C.COMMIT_CLASSES)}
    FROM (SELECT *, {_contains('subject', C.COMMIT_WORDS, 'other')} AS category FROM period) GROUP BY ALL) t
  LEFT JOIN (SELECT repo, new_rev, string_agg(concat(author, '=', n), '; ' ORDER BY k) AS top_authors FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, new_rev ORDER BY n DESC, author) AS k FROM (SELECT repo, new_rev, author, count(*) AS n FROM period GROUP BY ALL))
    WHERE k <= 5 GROUP BY ALL) a ON t.repo = a.repo AND t.new_rev = a.new_rev
  LEFT JOIN (SELECT repo, new_rev, string_agg(concat(path, '=', n), '; ' ORDER BY k) AS hotspot_files FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, new_rev ORDER BY n DESC, path) AS k FROM (
        SELECT p.repo, p.new_rev, f.path, count(*) AS n FROM period p JOIN file_changes f ON p.repo = f.repo AND p.hash = f.hash GROUP BY ALL))
    WHERE k <= 10 GROUP BY ALL) f ON t.repo = f.repo AND t.new_rev = f.new_rev)"""


@query("period_summary_a9", sql(f"SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, total_commits, {', '.join(C.COMMIT_CLASSES)}, top_authors, hotspot_files FROM summary", RECENT, PERIOD, SUMMARY_SQL))
def _(h):
    rows = H.period_summary(h.commits, h.file_changes, h.windows)
    return rows.select("repo", F.col("new_rev").cast("bigint").alias("new_rev"), "total_commits", *C.COMMIT_CLASSES, "top_authors", "hotspot_files")


@query("commit_samples_a9", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, rank, hash, author, email, strftime(ts, '%Y-%m-%d') AS date, subject AS message, substring(subject, 1, 100) AS message_short FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, new_rev ORDER BY ts DESC, hash DESC) AS rank FROM placed) WHERE rank <= 10"""))
def _(h):
    rows = H.period_summary(h.commits, h.file_changes, h.windows).select("repo", F.col("new_rev").cast("bigint").alias("new_rev"), F.explode("commit_samples").alias("c"))
    return rows.select("repo", "new_rev", "c.*")


@query("metric_explanations_c7", sql("""
    SELECT m.repo, CAST(m.new_rev AS BIGINT) AS new_rev, metric, round(raw, 6) AS delta, total_commits, refactoring, bugfix, feature
    FROM mchanges m LEFT JOIN summary s ON m.repo = s.repo AND m.new_rev = s.new_rev WHERE raw IS NOT NULL AND raw <> 0""", RECENT, PERIOD, SUMMARY_SQL))
def _(h):
    from chronolith.operators.reports import metric_explanations

    rows = metric_explanations(H.changed_metrics(h.metrics), H.period_summary(h.commits, h.file_changes, h.windows))
    return rows.select("repo", F.col("new_rev").cast("bigint").alias("new_rev"), "metric", F.round("delta", 6).alias("delta"), "total_commits", "refactoring", "bugfix", "feature")


@query("recent_commits_t8", sql("""
    SELECT repo, position AS rank, substring(hash, 1, 7) AS hash, strftime(ts, '%Y-%m-%d') AS day, subject FROM ordered WHERE position <= 5""", ORD))
def _(h):
    return H.recent_commits(h.commits).select("repo", "rank", "hash", F.date_format("ts", "yyyy-MM-dd").alias("day"), "subject")


@query("bug_commits_j8_c8", sql(f"""
    SELECT repo, rank, hash, line FROM (SELECT repo, hash, row_number() OVER (PARTITION BY repo {NEW}) AS rank,
      concat('- [', strftime(ts, '%Y-%m-%d'), '] ', substring(hash, 1, 8), ' ', subject, CASE WHEN title IS NULL THEN '' ELSE concat(' (', title, ')') END) AS line
      FROM (SELECT c.*, k.bug, k.title FROM commits c LEFT JOIN (SELECT r.repo, r.hash, max(CASE WHEN i.type = 'bug' THEN 1 ELSE 0 END) AS bug,
          min_by(i.summary, r.pos) AS title FROM keyrows r JOIN issues i ON i.repo = r.repo AND i.key = r.key WHERE NOT starts_with(r.key, 'GH#') GROUP BY 1, 2) k
        ON c.repo = k.repo AND c.hash = k.hash)
      WHERE bug = 1 OR regexp_matches(subject, '(?i)\\b({"|".join(C.BUG_WORDS_NARROW)})\\b')) WHERE rank <= 80""", KEYROWS))
def _(h):
    return H.bug_commits(h.commits, h.issues, 80).select("repo", "rank", "hash", "line")


@query("bug_commits_all_j8_c8", uncut("bug_commits_j8_c8", " WHERE rank <= 80"))
def _(h):
    return H.bug_commits(h.commits, h.issues).select("repo", "rank", "hash", "line")


@query("issue_tracker_a23", sql("""
    SELECT t.repo, t.total, coalesce(j.jira_hits, 0) AS jira_hits, t.github_refs, CASE WHEN coalesce(j.jira_hits, 0) >= 5 OR coalesce(j.jira_hits, 0) / t.total >= 0.02 THEN 'jira' ELSE 'none' END AS source,
      j.project FROM (SELECT repo, count(*) AS total, count(*) FILTER (regexp_matches(subject, '(?i)(?:fixes?|closes?|refs?)\\s+#[0-9]+')) AS github_refs
        FROM ordered WHERE position <= 2000 GROUP BY repo) t
    LEFT JOIN (SELECT repo, CAST(sum(n) AS BIGINT) AS jira_hits, arg_min(project, k) AS project FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, project) AS k FROM (SELECT repo, project, count(*) AS n FROM (
          SELECT repo, unnest(regexp_extract_all(subject, '\\b([A-Z][A-Z0-9]{1,10})-[0-9]+\\b', 1)) AS project FROM ordered WHERE position <= 2000) GROUP BY 1, 2)) GROUP BY repo) j
      ON t.repo = j.repo""", ORD))
def _(h):
    return H.detect_tracker(h.commits, last=2000).drop("slug")


@query("issue_tracker_all_a23", uncut("issue_tracker_a23", " WHERE position <= 2000"))
def _(h):
    return H.detect_tracker(h.commits).drop("slug")


@query("issue_counts_a24", sql("""
    SELECT repo, count(type) AS total_classified, count(summary) AS total_summaries, count(*) FILTER (type = 'bug') AS n_bug, count(*) FILTER (type = 'feature') AS n_feature,
      count(*) FILTER (type = 'documentation') AS n_documentation, count(*) FILTER (type = 'test') AS n_test, count(*) FILTER (type = 'refactoring') AS n_refactoring
    FROM issues GROUP BY repo"""))
def _(h):
    return H.issue_type_counts(h.issues)
