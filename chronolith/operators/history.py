"""Commits, churn, issue types, revision sampling and revision series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import classify as C
from chronolith.functions.text import normalise_path
from chronolith.operators.common import PAIR, adjacent_pairs, listed, numbered, top_rows

# Keys of issue trackers, references to hosted issues, addresses of the code host, and the share or number of keys that names a tracker.
TRACKER_KEYS = r"\b([A-Z][A-Z0-9]{1,10})-[0-9]+\b"
HOSTED_REFERENCE = r"(?i)(?:fixes?|closes?|refs?)\s+#[0-9]+"
HOSTED_SLUG = r"github\.com[:/]([^/]+/[^/.]+?)(?:\.git)?$"
LEAST_TRACKER_SHARE, LEAST_TRACKER_KEYS = 0.02, 5


def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("hash").desc()]


# --- revisions, pairs, windows ----------------------------------------------


def revision_windows(revisions: DataFrame) -> DataFrame:
    """Neighbouring revisions with the time window (old_ts, new_ts] between them."""
    stamps = revisions.select("repo", "rev", "commit_ts")
    new = stamps.select("repo", F.col("rev").alias("new_rev"), F.col("commit_ts").alias("new_ts"))
    old = stamps.select("repo", F.col("rev").alias("old_rev"), F.col("commit_ts").alias("old_ts"))
    return adjacent_pairs(revisions).join(new, ["repo", "new_rev"]).join(old, ["repo", "old_rev"]).select(
        *PAIR, "old_ts", "new_ts"
    )


def assign_windows(commits: DataFrame, windows: DataFrame) -> DataFrame:
    """Commits with the window they fall into.

    An equi join on (repo, month) keeps every commit next to the windows touching its month; the exact bounds are
    checked after it.
    """
    month = lambda ts: F.date_trunc("month", ts).cast("date")
    spread = windows.withColumn(
        "_month", F.explode(F.sequence(month(F.col("old_ts")), month(F.col("new_ts")), F.expr("interval 1 month")))
    )
    placed = commits.withColumn("_month", month(F.col("ts"))).join(spread, ["repo", "_month"])
    return placed.filter((F.col("ts") > F.col("old_ts")) & (F.col("ts") <= F.col("new_ts"))).drop(
        "_month", "old_ts", "new_ts"
    )


def commits_between(commits: DataFrame, since: str, until: str, limit: int | None = None) -> DataFrame:
    """Commits of the days ``since`` to ``until``, the newest ``limit`` per repository if a limit is given."""
    day = F.col("ts").cast("date")
    inside = commits.filter((day >= F.lit(since).cast("date")) & (day <= F.lit(until).cast("date")))
    return top_rows(inside, ["repo"], newest_first(), limit).drop("rank") if limit else inside


def attach_revision(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Revision metadata joined by revision number, never by position."""
    return rows.join(revisions.select("repo", "rev", "commit_hash", "commit_ts", "author", "message"), ["repo", "rev"], "left")


def nearest_revisions(targets: DataFrame, revisions: DataFrame) -> DataFrame:
    """For every (repo, target day) the revision with the smallest distance in days, the newer one on ties.

    As-of in both directions over distinct days per repository: one union and one window, no pairing of targets
    with revisions.
    """
    days = targets.select("repo", F.col("target").alias("day")).distinct()
    marks = revisions.groupBy("repo", F.col("commit_ts").cast("date").alias("day")).agg(F.min("rev").alias("rev"))
    mark = F.when(F.col("rev").isNotNull(), F.struct(F.col("day"), F.col("rev")))
    line = days.join(marks, ["repo", "day"], "full").withColumn("mark", mark)
    order = Window.partitionBy("repo").orderBy("day")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    seen = line.select(
        "repo", "day",
        F.last("mark", ignorenulls=True).over(upto).alias("before"),
        F.first("mark", ignorenulls=True).over(onward).alias("after"),
    )
    gap = lambda side: F.abs(F.datediff(F.col(f"{side}.day"), F.col("day")))
    use_before = F.col("after").isNull() | (gap("before") < gap("after"))
    near = F.when(F.col("before").isNotNull() & use_before, F.col("before")).otherwise(F.col("after"))
    picked = seen.select("repo", F.col("day").alias("target"), near.alias("near")).filter(F.col("near").isNotNull())
    picked = picked.select(
        "repo", "target", F.col("near.rev").alias("rev"),
        F.abs(F.datediff(F.col("near.day"), F.col("target"))).cast("bigint").alias("days"),
    )
    return targets.join(picked, ["repo", "target"])


# --- commit sampling ---------------------------------------------------------


def sample_even(commits: DataFrame, count: int) -> DataFrame:
    """``count`` commits evenly spread over the whole history: newest, evenly spaced positions, oldest."""
    placed = numbered(commits, ["repo"], newest_first(), "position")
    sizes = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("_n"))
    at = F.col("position") - 1
    chosen = (at == 0) if count == 1 else (at == 0) | (at == F.col("_n") - 1)
    if count > 2:
        step = (F.col("_n") - 1) / F.lit(count - 1)
        inner = F.transform(F.sequence(F.lit(1), F.lit(count - 2)), lambda i: F.floor(i * step))
        chosen = chosen | F.array_contains(inner, at)
    return placed.join(sizes, "repo").filter((F.col("_n") < count) | chosen).drop("_n")


def sample_recent(commits: DataFrame, count: int, months: int, last: int | None = None) -> DataFrame:
    """Newest-first greedy picks at least ``months`` * 30 days apart; the oldest seen commit fills up a short list.

    All commits are looked at, or the newest ``last`` if given. A pick is the first commit of its day, so the fold runs
    over the days of the history, whatever the number of commits.
    """
    if last is None:
        seen = numbered(commits, ["repo"], newest_first(), "position")
    else:
        seen = top_rows(commits, ["repo"], newest_first(), last, "position")
    days = seen.groupBy("repo", F.col("ts").cast("date").alias("day")).agg(F.min("position").alias("position"), F.max("position").alias("_last"))
    folded = days.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("position", "day"))).alias("line"), F.max("_last").alias("_last"))
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<bigint>").alias("picks"))
    far = lambda acc, x: acc["last"].isNull() | (F.abs(F.datediff(acc["last"], x["day"])) >= months * 30)
    picks = F.aggregate(
        "line", start,
        lambda acc, x: F.when(
            (F.size(acc["picks"]) < count) & far(acc, x),
            F.struct(x["day"].alias("last"), F.array_append(acc["picks"], x["position"]).alias("picks")),
        ).otherwise(acc),
        lambda acc: acc["picks"],
    )
    filled = F.when(F.size("picks") < count, F.array_union("picks", F.array("_last"))).otherwise(F.col("picks"))
    chosen = folded.select("repo", picks.alias("picks"), "_last").select("repo", F.explode(filled).alias("position"))
    return seen.join(chosen, ["repo", "position"])


def sample_every(commits: DataFrame, count: int, gap: int) -> DataFrame:
    """Every ``gap``-th commit from the newest on, ``count`` of them; the oldest seen fills up a short list."""
    gap = max(1, gap)
    seen = top_rows(commits, ["repo"], newest_first(), max((count - 1) * gap + 1, count), "position")
    sizes = seen.groupBy("repo").agg(F.max("position").alias("_n"))
    at = F.col("position") - 1
    on_grid = (at % gap == 0) & (at < count * gap)
    grid_size = F.least(F.lit(count), F.floor((F.col("_n") - 1) / gap) + 1)
    last = (F.col("position") == F.col("_n")) & (grid_size < count)
    return seen.join(sizes, "repo").filter(on_grid | last).drop("_n")


def sample_largest(commits: DataFrame, changes: DataFrame, count: int) -> DataFrame:
    """The ``count`` commits with the most changed lines, listed newest first."""
    sized = commits.join(commit_sizes(changes).select("repo", "hash", "lines"), ["repo", "hash"], "left").fillna(0, ["lines"])
    largest = top_rows(sized, ["repo"], [F.col("lines").desc(), *newest_first()], count).drop("rank")
    return top_rows(largest, ["repo"], newest_first(), count, "position")


def sample_newest(commits: DataFrame, count: int) -> DataFrame:
    return top_rows(commits, ["repo"], newest_first(), count, "position")


def number_revisions(analysed: DataFrame) -> DataFrame:
    """Contiguous numbers from the newest on, after dropping revisions whose metrics are all missing or zero."""
    known = [F.abs(F.coalesce(F.col(f"`{m}`"), F.lit(0.0))) for m in C.METRICS]
    kept = analysed.filter(F.greatest(*known) > 0)
    order = Window.partitionBy("repo").orderBy(F.col("commit_ts").desc(), F.col("commit_hash").desc())
    return kept.withColumn("revision_number", F.row_number().over(order).cast("bigint"))


def newest_revisions(revisions: DataFrame, count: int = 5) -> DataFrame:
    return top_rows(revisions, ["repo"], [F.col("rev")], count).drop("rank")


# --- metric series -----------------------------------------------------------


def metric_changes(metrics: DataFrame, digits: int | None = 2) -> DataFrame:
    """Old value, new value, difference and relative difference per neighbouring pair of a metric series.

    With ``digits`` the difference is rounded first and the relative one is based on it and NULL for an old value
    of 0; without, nothing is rounded and the relative difference to 0 is 0.
    """
    order = Window.partitionBy("repo", "metric").orderBy("rev")
    rows = metrics.select(
        "repo", F.col("rev").alias("new_rev"), F.lead("rev").over(order).alias("old_rev"), "metric",
        F.lead("value").over(order).alias("old_value"), F.col("value").alias("new_value"),
    ).filter(F.col("old_rev").isNotNull())
    raw = F.col("new_value") - F.col("old_value")
    if digits is None:
        share = F.try_divide(F.col("delta"), F.col("old_value")) * 100.0
        return rows.withColumn("delta", raw).withColumn(
            "relative", F.when(F.col("old_value") == 0, 0.0).otherwise(share)
        )
    share = F.try_divide(F.col("delta"), F.when(F.col("old_value") != 0, F.col("old_value"))) * 100.0
    return rows.withColumn("delta", F.round(raw, digits)).withColumn("relative", F.round(share, digits))


def changed_metrics(metrics: DataFrame) -> DataFrame:
    """Unrounded changes without missing, all-zero and unchanged pairs."""
    rows = metric_changes(metrics, None)
    return rows.filter(F.col("delta").isNotNull() & (F.col("delta") != 0))


def peak_change(metrics: DataFrame, metric: str = "m-score") -> DataFrame:
    """The neighbouring pair with the largest change of a metric, the newest pair on ties."""
    rows = metric_changes(metrics.filter(F.col("metric") == metric), None).filter(F.col("delta").isNotNull())
    order = [F.abs(F.col("delta")).desc(), F.col("new_rev")]
    return top_rows(rows, ["repo"], order, 1).drop("rank")


def month_range(commits: DataFrame) -> DataFrame:
    month = F.date_format("ts", "yyyy-MM")
    return commits.groupBy("repo").agg(F.min(month).alias("start_month"), F.max(month).alias("end_month"))


# --- churn -------------------------------------------------------------------

def lines_changed() -> Column:
    return F.coalesce(F.col("added"), F.lit(0)) + F.coalesce(F.col("deleted"), F.lit(0))


def commit_sizes(changes: DataFrame) -> DataFrame:
    """Changed lines and changed files per commit."""
    return changes.groupBy("repo", "hash").agg(
        F.sum(lines_changed()).cast("bigint").alias("lines"), F.count(F.lit(1)).alias("files")
    )


def file_churn(changes: DataFrame, keys: list[str], top_n: int | None = 10) -> DataFrame:
    """Changed lines per file in every group of ``keys``, the ``top_n`` largest if given."""
    churn = changes.groupBy(*keys, "path").agg(F.sum(lines_changed()).cast("bigint").alias("churn"))
    if top_n is None:
        return churn
    return top_rows(churn, keys, [F.col("churn").desc(), F.col("path")], top_n)


def recent_file_churn(commits: DataFrame, changes: DataFrame, last: int = 50, top_n: int = 10) -> DataFrame:
    """Churn over the newest ``last`` commits of each repository."""
    recent = sample_newest(commits, last).select("repo", "hash")
    return file_churn(changes.join(recent, ["repo", "hash"], "left_semi"), ["repo"], top_n)


def classify_commits(commits: DataFrame, issues: DataFrame) -> DataFrame:
    """Commits with ``keys`` and ``type``: the first key in the subject that has a type decides, else 'unknown'."""
    keyed = commits.withColumn("keys", C.issue_keys(F.col("subject")))
    typed = issues.filter(F.col("type").isNotNull()).groupBy("repo", "key").agg(F.min("type").alias("type"))
    hits = (
        keyed.select("repo", "hash", F.posexplode("keys").alias("pos", "key"))
        .join(typed, ["repo", "key"])
        .groupBy("repo", "hash").agg(F.min_by("type", "pos").alias("type"))
    )
    return keyed.join(hits, ["repo", "hash"], "left").fillna("unknown", ["type"])


def typed_totals(commits: DataFrame, changes: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """Per issue type: commits, distinct issue keys, changed lines and file rows.

    ``commits`` carries the grouping columns ``keys`` (repository, or repository and revision pair).
    """
    typed = classify_commits(commits, issues)
    by_type = [*keys, "type"]
    heads = typed.groupBy(*by_type).agg(F.count(F.lit(1)).alias("commit_count"))
    named = (
        typed.select(*by_type, F.explode("keys").alias("key")).distinct()
        .groupBy(*by_type).agg(F.count(F.lit(1)).alias("issue_key_count"))
    )
    touched = typed.select(*dict.fromkeys([*by_type, "repo", "hash"])).join(changes, ["repo", "hash"])
    sums = touched.groupBy(*by_type).agg(
        F.sum(lines_changed()).cast("bigint").alias("churn_total"), F.count(F.lit(1)).alias("freq_total")
    )
    return heads.join(named, by_type, "left").join(sums, by_type, "left").fillna(0)


def typed_files(commits: DataFrame, changes: DataFrame, issues: DataFrame, keys: list[str], top_n: int | None = 20) -> DataFrame:
    """Per issue type and file: changed lines and number of changes, with their ranks among the top files."""
    typed = classify_commits(commits, issues).select(*dict.fromkeys([*keys, "type", "repo", "hash"]))
    return typed_file_churn(typed.join(changes, ["repo", "hash"]), keys, top_n)


def typed_file_churn(rows: DataFrame, keys: list[str], top_n: int | None = 20) -> DataFrame:
    """``typed_files`` of changes that carry their commit's type."""
    by_type = [*keys, "type"]
    files = rows.groupBy(*by_type, "path").agg(
        F.sum(lines_changed()).cast("bigint").alias("churn"), F.count(F.lit(1)).alias("freq")
    )
    if top_n is None:
        return files
    parts = [
        top_rows(files, by_type, [F.col(m).desc(), F.col("path")], top_n)
        .select(*by_type, F.lit(m).alias("measure"), "rank", "path", F.col(m).alias("n"))
        for m in ("churn", "freq")
    ]
    return parts[0].unionByName(parts[1])


def keyword_bug_churn(commits: DataFrame, changes: DataFrame, words=C.BUG_WORDS_WIDE) -> DataFrame:
    """Changed lines per normalised path over commits whose subject names a bug word."""
    fixing = commits.filter(C.mentions_bug(F.col("subject"), words)).select("repo", "hash").distinct()
    return normalised_bug_churn(changes.join(fixing, ["repo", "hash"], "left_semi"))


def normalised_bug_churn(rows: DataFrame) -> DataFrame:
    """Changed lines per normalised path."""
    rows = rows.withColumn("file", normalise_path(F.col("path")))
    return rows.filter(F.col("file") != "").groupBy("repo", "file").agg(F.sum(lines_changed()).cast("bigint").alias("bug_churn"))


# --- period summaries and commit context --------------------------------------


def recent_commits(commits: DataFrame, count: int = 5) -> DataFrame:
    rows = top_rows(commits, ["repo"], newest_first(), count)
    return rows.select("repo", "rank", F.substring("hash", 1, 7).alias("hash"), F.col("ts"), F.trim("subject").alias("subject"))


def window_commits(commits: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """Commits of every revision window, numbered from the newest on, the newest ``limit`` if given."""
    placed = assign_windows(commits, windows)
    if limit is None:
        return numbered(placed, PAIR, newest_first())
    return top_rows(placed, PAIR, newest_first(), limit)


def category_counts(placed: DataFrame) -> DataFrame:
    """One row per window: commits and commits per class."""
    category = C.commit_category(F.col("subject"))
    return placed.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("total_commits"),
        *[F.count_if(category == c).alias(c) for c in C.COMMIT_CLASSES],
    )


def top_authors(placed: DataFrame, count: int = 5) -> DataFrame:
    per = placed.groupBy(*PAIR, "author").agg(F.count(F.lit(1)).alias("commits"))
    return top_rows(per, PAIR, [F.col("commits").desc(), F.col("author")], count)


def hotspot_files(placed: DataFrame, changes: DataFrame, count: int = 10) -> DataFrame:
    """Most often changed files of a window; names need a '/' or a '.'."""
    named = changes.filter(F.contains(F.col("path"), F.lit("/")) | F.contains(F.col("path"), F.lit(".")))
    per = placed.select(*PAIR, "hash").join(named, ["repo", "hash"]).groupBy(*PAIR, "path").agg(F.count(F.lit(1)).alias("changes"))
    return top_rows(per, PAIR, [F.col("changes").desc(), F.col("path")], count)


def top_commits(placed: DataFrame, changes: DataFrame, count: int = 5) -> DataFrame:
    """The first commits of a window with their number of changed files."""
    first = placed.filter(F.col("rank") <= count)
    files = changes.join(first.select("repo", "hash").distinct(), ["repo", "hash"], "left_semi")
    sizes = files.groupBy("repo", "hash").agg(F.count(F.lit(1)).alias("files_changed"))
    return first.join(sizes, ["repo", "hash"], "left").fillna(0, ["files_changed"]).select(
        *PAIR, "rank", F.substring("hash", 1, 8).alias("hash"), F.substring("subject", 1, 80).alias("message"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), "files_changed",
    )


def commit_samples(placed: DataFrame, count: int = 10) -> DataFrame:
    """The first commits of a window with all their fields; ``placed`` is ``window_commits``."""
    first = placed.filter(F.col("rank") <= count)
    return first.select(
        *PAIR, "rank", "hash", "author", "email", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("subject").alias("message"),
        F.substring("subject", 1, 100).alias("message_short"),
    )


def period_summary(commits: DataFrame, changes: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per revision pair: commit counts by class, top authors, first commits and hotspot files as text, ten commits with all fields."""
    placed = window_commits(commits, windows, limit)
    authors = top_authors(placed).withColumn("_t", F.concat("author", F.lit("="), "commits"))
    files = hotspot_files(placed, changes).withColumn("_t", F.concat("path", F.lit("="), "changes"))
    firsts = top_commits(placed, changes).withColumn(
        "_t", F.concat_ws(" ", "hash", "date", "message", F.concat("files_changed", F.lit(" files")))
    )
    out = category_counts(placed)
    for rows, name in ((authors, "top_authors"), (firsts, "top_commits"), (files, "hotspot_files")):
        out = out.join(rows.groupBy(*PAIR).agg(listed(["rank"], "_t", "; ").alias(name)), PAIR, "left")
    fields = F.struct("rank", "hash", "author", "email", "date", "message", "message_short")
    samples = commit_samples(placed).groupBy(*PAIR).agg(F.array_sort(F.collect_list(fields)).alias("commit_samples"))
    return out.join(samples, PAIR, "left")


def bug_commits(commits: DataFrame, issues: DataFrame, limit: int | None = None) -> DataFrame:
    """Bug commits from the newest on, the newest ``limit`` if given: a key typed bug or a bug word; title of the first key that has one.

    Only tracker keys are looked up.
    """
    keys = F.regexp_extract_all("subject", F.lit(r"\b[A-Z][A-Z0-9]+-[0-9]+\b"), 0)
    keyed = commits.select("repo", "hash", "ts", "subject", keys.alias("keys"))
    known = issues.groupBy("repo", "key").agg(F.min(F.struct("type", "summary")).alias("_i")).select("repo", "key", "_i.*")
    hits = (
        keyed.select("repo", "hash", F.posexplode("keys").alias("pos", "key")).join(known, ["repo", "key"])
        .groupBy("repo", "hash").agg(
            F.max((F.col("type") == "bug").cast("int")).alias("_bug"),
            F.min_by("summary", F.when(F.col("summary").isNotNull(), F.col("pos"))).alias("title"),
        )
    )
    joined = keyed.join(hits, ["repo", "hash"], "left")
    bugs = joined.filter((F.col("_bug") == 1) | C.mentions_bug(F.col("subject"), C.BUG_WORDS_NARROW))
    rows = numbered(bugs, ["repo"], newest_first()) if limit is None else top_rows(bugs, ["repo"], newest_first(), limit)
    line = F.concat(
        F.lit("- ["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] "), F.substring("hash", 1, 8), F.lit(" "), F.col("subject"),
        F.when(F.col("title").isNotNull(), F.concat(F.lit(" ("), "title", F.lit(")"))).otherwise(""),
    )
    return rows.select("repo", "rank", "hash", "title", line.alias("line"))


def detect_tracker(commits: DataFrame, remotes: DataFrame | None = None, last: int | None = None) -> DataFrame:
    """Per repository 'jira', 'github' or 'none', decided on all subjects, or on the newest ``last`` if given.

    Every key occurrence counts; ``remotes`` holds (repo, url).
    """
    recent = commits if last is None else top_rows(commits, ["repo"], newest_first(), last)
    projects = F.regexp_extract_all("subject", F.lit(TRACKER_KEYS), 1)
    refs = F.col("subject").rlike(HOSTED_REFERENCE)
    heads = recent.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.count_if(refs).alias("github_refs"))
    hits = recent.select("repo", F.explode(projects).alias("project")).groupBy("repo", "project").agg(F.count(F.lit(1)).alias("n"))
    totals = hits.groupBy("repo").agg(F.sum("n").cast("bigint").alias("jira_hits"))
    best = top_rows(hits, ["repo"], [F.col("n").desc(), F.col("project")], 1).select("repo", "project")
    out = heads.join(totals, "repo", "left").join(best, "repo", "left").fillna(0, ["jira_hits"])
    slug = F.lit(None).cast("string")
    if remotes is not None:
        out = out.join(remotes, "repo", "left")
        slug = F.nullif(F.regexp_extract("url", HOSTED_SLUG, 1), F.lit(""))
    jira = (F.col("jira_hits") > 0) & ((F.col("jira_hits") / F.col("total") >= LEAST_TRACKER_SHARE) | (F.col("jira_hits") >= LEAST_TRACKER_KEYS))
    source = F.when(jira, "jira").when(slug.isNotNull(), "github").otherwise("none")
    return out.select(
        "repo", "total", "jira_hits", "github_refs", source.alias("source"),
        F.when(jira, F.col("project")).alias("project"), slug.alias("slug"),
    )


def issue_type_counts(issues: DataFrame) -> DataFrame:
    """Classified issues per type, and the totals of classified and titled issues."""
    return issues.groupBy("repo").agg(
        F.count("type").alias("total_classified"), F.count("summary").alias("total_summaries"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("bug", "feature", "documentation", "test", "refactoring")],
    )
