"""Composite file risk: raw signals per file, min-max normalisation, weighted score, rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import classify as C
from chronolith.functions.text import basename, normalise_path
from chronolith.operators import graph, history
from chronolith.operators.cochange import cochange_partners
from chronolith.operators.common import adjacent_pairs, numbered, top_rows
from chronolith.session import cut_lineage

# Weights of the normalised signals.
WEIGHTS = {"bug_churn": 0.30, "anti_pattern": 0.25, "hotspot_fanin": 0.20, "scc_membership": 0.15, "co_change": 0.10}

# raw signal -> weight name; total_churn is normalised but carries no weight
SIGNALS = {
    "anti_pattern_count": "anti_pattern",
    "hotspot_fanin_score": "hotspot_fanin",
    "total_churn": None,
    "bug_churn_total": "bug_churn",
    "scc_membership_count": "scc_membership",
    "co_change_without_dep": "co_change",
}
RAW = ("anti_pattern_count", "hotspot_fanin_score", "rev_count", "total_churn", "bug_churn_total", "scc_membership_count", "co_change_without_dep")

# Issue types that hold bug churn, the first present one of a revision is used.
BUG_TYPES = ("bug", "bugfix", "hotfix", "fix")

FALLBACK_TYPE = "DangerousFile"


def _signal(rows: DataFrame, name: str, value: Column, file: str = "file") -> DataFrame:
    return rows.select("repo", normalise_path(F.col(file)).alias("file"), F.lit(name).alias("signal"), value.cast("double").alias("value"))


def bug_rows(typed_files: DataFrame) -> DataFrame:
    """Per revision the top churn rows of the first bug type present.

    ``typed_files`` holds (repo, rev, type, path, churn).
    """
    order = F.array_position(F.array(*[F.lit(t) for t in BUG_TYPES]), F.col("type"))
    bugs = typed_files.filter(F.col("type").isin(*BUG_TYPES)).withColumn("_order", order)
    first = bugs.groupBy("repo", "rev").agg(F.min("_order").alias("_order"))
    return bugs.join(first, ["repo", "rev", "_order"], "left_semi").drop("_order")


def choose_bug_churn(typed: DataFrame, keyword: DataFrame) -> DataFrame:
    """(repo, file, bug_churn): issue-typed churn where a repository has any, else keyword churn."""
    usable = typed.filter(F.col("bug_churn") > 0).select("repo").distinct()
    return typed.join(usable, "repo", "left_semi").unionByName(keyword.join(usable, "repo", "left_anti"))


def anti_pattern_rows(membership: DataFrame, dangerous: DataFrame, fallback_type: str = FALLBACK_TYPE) -> DataFrame:
    """(repo, rev, file, type, sure): memberships, or dangerous-file rows for revisions without any membership."""
    known = membership.select("repo", "rev").distinct()
    spare = dangerous.join(known, ["repo", "rev"], "left_anti")
    sure = membership.select("repo", "rev", normalise_path(F.col("file")).alias("file"), "type").distinct()
    return sure.withColumn("sure", F.lit(True)).unionByName(
        spare.select("repo", "rev", normalise_path(F.col("file")).alias("file"), F.lit(fallback_type).alias("type"), F.lit(False).alias("sure"))
    )


def structural_signals(hotspots: DataFrame, patterns: DataFrame, churn: DataFrame) -> DataFrame:
    """Long (repo, file, signal, value) rows of fan-in, anti-patterns, revision presence and churn.

    hotspots(repo, rev, node, fan_in), patterns as made by ``anti_pattern_rows``, churn(repo, rev, path, churn).
    Presence counts hotspot rows, plus one for a file first seen through the dangerous-file fallback.
    """
    hot = hotspots.withColumn("file", F.col("node"))
    seen = lambda rows, stage, spare: rows.select(
        "repo", normalise_path(F.col("file")).alias("file"),
        F.struct(F.col("rev").alias("rev"), F.lit(stage).alias("stage"), spare.alias("spare")).alias("at"),
    )
    sightings = reduce(DataFrame.unionByName, [
        seen(hot, 0, F.lit(False)), seen(patterns, 1, ~F.col("sure")),
        seen(churn.withColumn("file", F.col("path")), 2, F.lit(False)),
    ])
    first = sightings.groupBy("repo", "file").agg(F.min("at").alias("at"))
    parts = [
        _signal(hot, "hotspot_fanin_score", F.col("fan_in")),
        _signal(hot, "rev_count", F.lit(1)),
        _signal(patterns, "anti_pattern_count", F.lit(1)),
        _signal(churn, "total_churn", F.col("churn"), "path"),
        _signal(first, "rev_count", F.col("at.spare").cast("int")),
    ]
    return reduce(DataFrame.unionByName, parts)


def signal_table(long_rows: DataFrame) -> DataFrame:
    """One row per file with all raw signals, missing ones 0: a single grouped pass instead of outer joins."""
    sums = [F.coalesce(F.sum(F.when(F.col("signal") == s, F.col("value"))), F.lit(0.0)).alias(s) for s in RAW]
    return long_rows.filter(F.col("file") != "").groupBy("repo", "file").agg(*sums)


def normalised(table: DataFrame, signals=tuple(SIGNALS)) -> DataFrame:
    """Adds ``norm_<signal>`` in [0, 1] per repository; a signal without spread becomes 0.

    Extremes come from a partial aggregation and one small row per repository is joined back.
    """
    ends = table.groupBy("repo").agg(
        *[F.min(s).alias(f"_min_{s}") for s in signals], *[F.max(s).alias(f"_max_{s}") for s in signals]
    )
    out = table.join(ends, "repo")
    for s in signals:
        span = F.col(f"_max_{s}") - F.col(f"_min_{s}")
        share = F.try_divide(F.col(s) - F.col(f"_min_{s}"), F.nullif(span, F.lit(0.0)))
        out = out.withColumn(f"norm_{s}", F.coalesce(share, F.lit(0.0)))
    return out.drop(*[c for c in out.columns if c.startswith(("_min_", "_max_"))])


def scored(table: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``risk_score`` rounded to six digits; overrides update the default weights and nothing is rescaled."""
    used = {**WEIGHTS, **(weights or {})}
    order = ["bug_churn_total", "anti_pattern_count", "hotspot_fanin_score", "scc_membership_count", "co_change_without_dep"]
    terms = [F.lit(float(used[SIGNALS[s]])) * F.col(f"norm_{s}") for s in order]
    out = normalised(table).withColumn("risk_score", F.round(reduce(lambda a, b: a + b, terms), 6))
    for s in SIGNALS:
        out = out.withColumn(f"norm_{s}", F.round(f"norm_{s}", 6))
    return out


def ranked(scores: DataFrame, top_n: int | None = None) -> DataFrame:
    """Ranks by score, then file name; only the ``top_n`` best if given."""
    order = [F.col("risk_score").desc(), F.col("file")]
    if top_n:
        return top_rows(scores, ["repo"], order, top_n)
    return numbered(scores, ["repo"], order)


def types_seen(patterns: DataFrame) -> DataFrame:
    """Sorted anti-pattern types per file; as many as there are types."""
    return patterns.groupBy("repo", "file").agg(F.array_sort(F.collect_set("type")).alias("anti_patterns_seen"))


def churn_by_revision(placed: DataFrame, changes: DataFrame, top_n: int | None = None) -> DataFrame:
    """Churn of the files of every window under its newer revision; ``placed`` are window-assigned commits."""
    rows = changes.join(placed.select("repo", "hash", F.col("new_rev").alias("rev")), ["repo", "hash"])
    return history.file_churn(rows, ["repo", "rev"], top_n)


def typed_churn_by_revision(placed: DataFrame, changes: DataFrame, issues: DataFrame, top_n: int | None = None) -> DataFrame:
    return _churn_only(history.typed_files(placed.withColumnRenamed("new_rev", "rev"), changes, issues, ["repo", "rev"], top_n), top_n)


def _churn_only(rows: DataFrame, top_n: int | None) -> DataFrame:
    if top_n is None:
        return rows
    return rows.filter(F.col("measure") == "churn").withColumnRenamed("n", "churn")


def placed_changes(placed: DataFrame, changes: DataFrame, issues: DataFrame) -> DataFrame:
    """The changes of all window-assigned commits, met once: (repo, hash, path, added, deleted, revs, type, fixing).

    ``hash`` is a number per commit, ``revs`` the newer revision of each of its windows, ``type`` its issue type and ``fixing`` whether
    its subject names a bug word.
    """
    fixing = F.coalesce(F.max(C.mentions_bug(F.col("subject"), C.BUG_WORDS_WIDE)), F.lit(False))
    heads = history.classify_commits(placed, issues).groupBy("repo", "hash").agg(
        F.collect_list("new_rev").alias("revs"), F.min("type").alias("type"), fixing.alias("fixing")
    )
    # written, so that commits keep their numbers
    heads = cut_lineage(heads.withColumn("commit", F.monotonically_increasing_id()))
    return changes.join(heads, ["repo", "hash"]).select("repo", F.col("commit").alias("hash"), "path", "added", "deleted", "revs", "type", "fixing")


def risk_signals(
    commits: DataFrame, changes: DataFrame, issues: DataFrame, revisions: DataFrame, nodes: DataFrame, edges: DataFrame,
    membership: DataFrame, dangerous: DataFrame | None = None, hotspot_top_n: int | None = None, churn_top_n: int | None = None,
    typed_top_n: int | None = None, dangerous_top_n: int = 10, threshold: int = 3, count_mode: str = "pair",
) -> tuple[DataFrame, DataFrame]:
    """The raw signal table and the anti-pattern types per file, from canonical tables.

    All files count in every signal unless a top-n argument is given. ``dangerous`` defaults to the ``dangerous_top_n`` heaviest nodes of a revision.
    """
    pairs, windows = adjacent_pairs(revisions), history.revision_windows(revisions)
    # hotspots, churn and typed churn have several readers
    every = cut_lineage(graph.hotspots(nodes, edges, None))
    hot = every if hotspot_top_n is None else cut_lineage(graph.heaviest(every, hotspot_top_n))
    if dangerous is None:
        # only revisions without any membership fall back on their heaviest nodes
        spare = every.join(membership.select("repo", "rev").distinct(), ["repo", "rev"], "left_anti")
        dangerous = graph.heaviest(spare, dangerous_top_n).withColumn("file", F.col("node"))
    # read by two signals, the sightings and the list of types
    patterns = cut_lineage(anti_pattern_rows(membership, dangerous))
    # read by four signals, so written once
    rows = cut_lineage(placed_changes(history.assign_windows(commits, windows), changes, issues))
    placed = rows.withColumn("rev", F.explode("revs"))
    churn = cut_lineage(history.file_churn(placed, ["repo", "rev"], churn_top_n))
    typed_rows = _churn_only(history.typed_file_churn(placed.filter(F.col("type").isin(*BUG_TYPES)), ["repo", "rev"], typed_top_n), typed_top_n)
    typed = cut_lineage(bug_rows(cut_lineage(typed_rows)).groupBy(
        "repo", normalise_path(F.col("path")).alias("file")
    ).agg(F.sum("churn").alias("bug_churn")))
    bugs = choose_bug_churn(typed, history.normalised_bug_churn(rows.filter("fixing")))
    touched = rows.select("repo", "hash", normalise_path(F.col("path")).alias("file"))
    newest = revisions.groupBy("repo").agg(F.min("rev").alias("rev"))
    declared = edges.join(newest, ["repo", "rev"], "left_semi").select(
        "repo", normalise_path(F.col("src")).alias("src"), normalise_path(F.col("dest")).alias("dest")
    )
    partners = cochange_partners(touched, declared, threshold)
    cycles = graph.scc_counts(graph.scc_members(edges), pairs, count_mode)
    rows = reduce(DataFrame.unionByName, [
        structural_signals(hot, patterns, churn),
        _signal(bugs, "bug_churn_total", F.col("bug_churn")),
        _signal(cycles, "scc_membership_count", F.col("scc_count"), "node"),
        _signal(partners, "co_change_without_dep", F.col("partners")),
    ])
    return cut_lineage(signal_table(rows)), types_seen(patterns)


def risk_ranking(table: DataFrame, seen: DataFrame, weights: dict[str, float] | None = None, top_n: int | None = None) -> DataFrame:
    """Ranked risk records: score, raw and normalised signals, anti-pattern types."""
    rows = ranked(scored(table, weights), top_n).join(seen, ["repo", "file"], "left")
    return rows.withColumn("anti_patterns_seen", F.coalesce("anti_patterns_seen", F.array().cast("array<string>")))


def risk_lines(ranking: DataFrame, n: int = 25) -> DataFrame:
    """Formatted rows of the ``n`` riskiest files."""
    types = F.array_join(F.slice("anti_patterns_seen", 1, 3), ", ")
    whole = lambda c: F.col(c).cast("bigint")
    line = F.format_string(
        "#%2d | %-40s | %.3f | bug=%5d | ap=%3d revisions | scc=%2d revisions | co=%2d | [%s]",
        F.col("rank"), basename(F.col("file")), F.col("risk_score"), whole("bug_churn_total"), whole("anti_pattern_count"),
        whole("scc_membership_count"), whole("co_change_without_dep"), types,
    )
    return ranking.filter(F.col("rank") <= n).select("repo", "rank", line.alias("line"))
