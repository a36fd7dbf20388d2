"""Facts and texts per revision and per transition between neighbouring revisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.classify import METRICS
from chronolith.functions.text import basename, change_text, key_values, number_text, signed, strict_int
from chronolith.operators.common import PAIR, by_pair, listed, top_rows, when_side

GRAPH = ["repo", "rev"]
MODULE = [*GRAPH, "layer_no", "module_no"]


# --- ranked rows ---------------------------------------------------------------


def top_dangerous(rows: DataFrame, n: int = 7) -> DataFrame:
    """Rows (repo, rev, ord, file, fan_in, fan_out, churn) by 10 * churn + fan-out + fan-in; missing numbers count 0."""
    number = lambda c: F.coalesce(strict_int(F.col(c)), F.lit(0))
    scored = rows.withColumn("score", number("churn") * 10 + number("fan_out") + number("fan_in"))
    return top_rows(scored, GRAPH, [F.col("score").desc(), F.col("ord")], n)


def top_penalties(scores: DataFrame, n: int = 7) -> DataFrame:
    """Modules with the largest cross-layer and internal penalties of a revision."""
    parts = []
    for kind in ("cross", "internal"):
        rows = top_rows(scores, GRAPH, [F.col(f"{kind}_penalty").desc(), F.col("layer_no"), F.col("module_no")], n)
        parts.append(rows.withColumn("kind", F.lit(kind)).withColumn("penalty", F.col(f"{kind}_penalty")))
    return parts[0].unionByName(parts[1])


def refactoring_hotspot(penalties: DataFrame) -> DataFrame:
    """Among the top cross-penalty modules the one with the largest penalty times size."""
    cross = penalties.filter(F.col("kind") == "cross").withColumn("_rank", F.col("rank")).drop("rank")
    weight = F.col("cross_penalty") * F.col("module_size")
    return top_rows(cross.withColumn("weight", weight), GRAPH, [F.col("weight").desc(), F.col("_rank")], 1).drop("rank", "_rank")


def worst_modules(scores: DataFrame, n: int = 5, revisions: int = 5, rank_by: str = "contribution") -> DataFrame:
    """The first ``n`` modules of the newest revisions, by contribution or by cross penalty times size factor."""
    listed_revs = scores.select(*GRAPH).distinct()
    newest = top_rows(listed_revs, ["repo"], [F.col("rev")], revisions).drop("rank")
    value = F.col("contribution") if rank_by == "contribution" else F.col("cross_penalty") * F.col("size_factor")
    rows = scores.join(newest, GRAPH, "left_semi").withColumn("_by", F.round(value, 9))
    return top_rows(rows, GRAPH, [F.col("_by").desc(), F.col("layer_no"), F.col("module_no")], n).drop("_by")


def fans_by_name(rows: DataFrame) -> DataFrame:
    """(repo, rev, name, fan_in, fan_out): one row per file name, the last one of equal names."""
    named = rows.withColumn("name", basename(F.col("file"))).filter(F.col("name") != "")
    last = named.groupBy(*GRAPH, "name").agg(F.max_by(F.struct("fan_in", "fan_out"), F.struct("ord", "file")).alias("f"))
    return last.select(*GRAPH, "name", "f.fan_in", "f.fan_out")


def module_files_text(module_files: DataFrame, fan_rows: DataFrame, shown: int = 3) -> DataFrame:
    """(module, files_text): the first files of a module with their fans where known, '...' if there are more.

    ``module_files`` holds the first ``shown`` + 1 files as an array.
    """
    exploded = module_files.select(*MODULE, F.posexplode("files").alias("pos", "file"))
    joined = exploded.withColumn("name", basename(F.col("file"))).join(fans_by_name(fan_rows), [*GRAPH, "name"], "left")
    known = F.concat(
        F.col("name"), F.lit("(FanIn="), F.col("fan_in").cast("bigint"), F.lit(",FanOut="), F.col("fan_out").cast("bigint"), F.lit(")")
    )
    text = F.when(F.col("pos") >= shown, "...").otherwise(F.coalesce(known, F.col("name")))
    return joined.withColumn("_t", text).groupBy(*MODULE).agg(listed(["pos"], "_t").alias("files_text"))


def worst_modules_text(worst: DataFrame, files_text: DataFrame) -> DataFrame:
    line = F.concat(
        F.format_string("  - Layer %d / Module %d: contribution=%.4f (cross_penalty=%.3f, size=%d files) | files: ",
                        "layer_no", "module_no", "contribution", "cross_penalty", "module_size"),
        F.coalesce("files_text", F.lit("")),
    )
    return worst.join(files_text, MODULE, "left").select(*GRAPH, "rank", line.alias("line"))


def anti_pattern_counts(patterns: DataFrame) -> DataFrame:
    """Instances per type of (repo, rev, type, instance) summary rows."""
    return patterns.groupBy(*GRAPH, "type").agg(F.count(F.lit(1)).alias("n"))


def anti_pattern_changes(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of both sides for every type either side has, with their difference."""
    sides = by_pair(counts, pairs)
    both = sides.groupBy(*PAIR, "type").agg(
        *[F.coalesce(F.sum(when_side(s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in ("new", "old")]
    )
    return both.withColumn("delta", F.col("n_new") - F.col("n_old"))


def allowed_files(sources: list[DataFrame], cap: int | None = None) -> DataFrame:
    """Distinct names per pair in order of first mention, the first ``cap`` if given; sources rank by their place in the list.

    Every source holds (repo, new_rev, old_rev, ord, file).
    """
    rows = reduce(DataFrame.unionByName, [
        s.select(*PAIR, F.struct(F.lit(i).alias("source"), F.col("ord").cast("bigint").alias("ord")).alias("at"), "file")
        for i, s in enumerate(sources)
    ])
    first = rows.filter(F.col("file").isNotNull()).groupBy(*PAIR, "file").agg(F.min("at").alias("at"))
    order = [F.col("at"), F.col("file")]
    return top_rows(first, PAIR, order, cap).drop("at")


# --- texts per transition --------------------------------------------------------

# Wording of the reports.
MOVE_NOTE = " (note: renames/moves often show up as add+remove)"
METRIC_NOTE = "- note: DV8 metrics are in %; Δ points are absolute (new-old), not percentage points of a 0–1 scale."


def overall_lines(changes: DataFrame, revisions: DataFrame, files: DataFrame) -> DataFrame:
    """Headline, metric line and file-count line of every transition.

    changes: ``metric_changes`` rows; files(repo, new_rev, old_rev, files_old, files_new).
    """
    order = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric"))
    texts = changes.withColumn(
        "_t", change_text(F.col("metric"), F.col("old_value"), F.col("new_value"), F.col("delta"), F.col("relative"))
    ).withColumn("_o", order).filter(F.col("_t").isNotNull() & (F.col("_o") > 0))
    metric_line = texts.groupBy(*PAIR).agg(listed(["_o"], "_t", " | ").alias("metrics"))
    side = lambda s: revisions.select(
        "repo", F.col("rev").alias(f"{s}_rev"), F.date_format("commit_ts", "yyyy-MM-dd").alias(f"{s}_date"),
        F.substring("commit_hash", 1, 7).alias(f"{s}_hash"), F.col("message").alias(f"{s}_message"),
    )
    joined = changes.select(*PAIR).distinct().join(side("new"), ["repo", "new_rev"]).join(side("old"), ["repo", "old_rev"])
    subject = F.substring(F.get(F.split("new_message", "\n"), F.lit(0)), 1, 80)
    place = lambda s: F.concat(
        F.lit(f"{s}=rev"), F.col(f"{s}_rev"), F.lit(" ("), F.col(f"{s}_date"), F.lit(" `"), F.col(f"{s}_hash"), F.lit("`)"))
    headline = F.concat(
        F.lit("- transition "), place("old"), F.lit(" → "), place("new"),
        F.when(F.coalesce("new_message", F.lit("")) != "", F.concat(F.lit(": "), subject)).otherwise(""),
    )
    out = joined.withColumn("headline", headline).join(metric_line, PAIR, "left").join(files, PAIR, "left")
    return out.select(*PAIR, "headline", "metrics", file_change_text().alias("files"))


def file_change_text() -> Column:
    old, new = F.col("files_old"), F.col("files_new")
    return F.concat(old, F.lit(" → "), new, F.lit(" (Δ="), signed(new - old), F.lit(")"))


def overall_text(lines: DataFrame) -> DataFrame:
    """All transitions of a repository, oldest first, as one text."""
    text = F.concat_ws(
        "\n", "headline", F.concat(F.lit("  - metrics: "), "metrics"), F.concat(F.lit("  - DRH file count: "), "files")
    )
    rows = lines.withColumn("_t", text).withColumn("_o", -F.col("new_rev"))
    return rows.groupBy("repo").agg(listed(["_o"], "_t", "\n").alias("overall"))


def structure_text(locations_layers: DataFrame, modules: DataFrame, move_counts: DataFrame, samples: DataFrame) -> DataFrame:
    """The clustering section of a transition: counts, largest modules, movements and examples.

    locations_layers(repo, rev, layer, files), modules: ``largest_modules`` rows of all revisions.
    """
    pairs = move_counts.select(*PAIR)
    layers = by_pair(locations_layers, pairs).withColumn("_t", F.concat("layer", F.lit(": "), "files"))
    layer_text = layers.groupBy(*PAIR).agg(
        *[_sided(s, ["layer"], "_t", ", ").alias(f"layers_{s}") for s in ("old", "new")]
    )
    big = by_pair(modules.filter(F.col("rank") <= 4), pairs).withColumn(
        "_t", key_values(("module_path", F.col("module_path")), ("files", F.col("files")))
    )
    module_text = big.groupBy(*PAIR).agg(*[_sided(s, ["rank"], "_t", " | ").alias(f"modules_{s}") for s in ("old", "new")])
    shown = samples.filter(F.col("rank") <= 12)
    by_layer = F.concat(F.lit("- "), "file", F.lit(": "), "old_layer", F.lit(" → "), "new_layer")
    by_module = F.concat(F.lit("- "), "file", F.lit(": "), "old_module", F.lit(" → "), "new_module")
    shown = shown.withColumn("_t", F.when(F.col("status") == "moved_layer", by_layer).otherwise(by_module))
    sample_text = shown.groupBy(*PAIR).agg(
        *[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("rank", "_t")))),
                                   lambda x: x["_t"]), "\n").alias(s) for s in ("moved_layer", "moved_module")]
    )
    out = move_counts
    for part in (layer_text, module_text, sample_text):
        out = out.join(part, PAIR, "left")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    headed = lambda title, c: F.concat(F.lit(title), filled(c))
    text = F.concat_ws(
        "\n", F.lit("## DRH Differences\n### Structural Summary"),
        F.concat(F.lit("- DRH file count: old="), "files_old", F.lit(" → new="), "files_new", F.lit(" (Δ="),
                 signed(F.col("files_new") - F.col("files_old")), F.lit(")")),
        headed("- Layer file counts (old): ", "layers_old"), headed("- Layer file counts (new): ", "layers_new"),
        headed("- Largest modules by file count (old): ", "modules_old"),
        headed("- Largest modules by file count (new): ", "modules_new"),
        F.lit("### Movement Summary"),
        F.concat(F.lit("- DRH movement (old→new): "), key_values(
            ("moved_layers_count", F.col("moved_layers")), ("moved_modules_count", F.col("moved_modules")),
            ("added_files_count", F.col("added_files")), ("removed_files_count", F.col("removed_files"))), F.lit(MOVE_NOTE)),
        F.lit("### Notable Layer Moves (sample)"), F.coalesce(filled("moved_layer"), F.lit("- (none)")),
        headed("### Notable Module Moves (sample)\n", "moved_module"),
    )
    return out.select(*PAIR, F.concat(text, F.lit("\n")).alias("text"))


def _sided(side: str, order: list[str], text: str, separator: str) -> Column:
    items = F.collect_list(when_side(side, F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["_text"]), separator)


def transition_facts(
    changes: DataFrame, moves: DataFrame, diff: DataFrame, patterns: DataFrame, dangerous: DataFrame, penalties: DataFrame,
    commits: DataFrame, typed: DataFrame | None = None,
) -> DataFrame:
    """One wide row per transition joining the deltas, movements, graph, patterns, dangerous files and commits.

    moves: ``move_counts``; diff: ``graph_diff``; patterns: ``anti_pattern_changes``; dangerous: ``top_dangerous``;
    penalties: ``top_penalties`` with ``files``, the first names of each module; commits: ``period_summary``; typed: ``typed_totals`` of the
    pairs, null columns without.
    """
    wide = changes.groupBy(*PAIR).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(v))).alias(f"{m.replace('-', '_')}_{v}")
          for m in METRICS for v in ("old_value", "new_value", "delta", "relative")]
    )
    pattern_text = patterns.withColumn("_t", F.concat("type", F.lit("="), "n_new")).groupBy(*PAIR).agg(
        listed(["type"], "_t").alias("anti_patterns")
    )
    newer = wide.select(*PAIR)
    on_new = lambda rows: rows.withColumnRenamed("rev", "new_rev").join(newer, ["repo", "new_rev"])
    danger = dangerous.withColumn("_t", key_values(
        ("Filename", F.col("file")), ("FanIn", F.col("fan_in")), ("FanOut", F.col("fan_out")), ("ChangeChurn", F.col("churn"))
    ))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    danger = danger.withColumn("_l", F.concat(
        F.lit("  - "), "file", F.lit(" (FanIn="), shown("fan_in"), F.lit(", FanOut="), shown("fan_out"), F.lit(", ChangeChurn="), shown("churn"), F.lit(")")))
    newer_danger = on_new(danger)
    danger_text = newer_danger.filter(F.col("rank") <= 3).groupBy(*PAIR).agg(listed(["rank"], "_t", " | ").alias("dangerous_files"))
    danger_lines = newer_danger.groupBy(*PAIR).agg(listed(["rank"], "_l", "\n").alias("dangerous_lines"))
    cross = penalties.filter((F.col("kind") == "cross") & (F.col("rank") <= 4)).withColumn("_t", key_values(
        ("module_key", F.col("module_key")), ("layer", F.col("layer_no")), ("module_size", F.col("module_size")),
        ("cross_penalty", number_text(F.round("cross_penalty", 6))), ("clddf", number_text(F.round("clddf", 6))),
    ))
    names = F.array_join(F.transform(F.slice("files", 1, 3), basename), ", ")
    cross = on_new(cross.withColumn("_l", F.concat(F.lit("  - "), "_t")).withColumn("_t", F.concat("_t", F.lit(", files=["), names, F.lit("]"))))
    cross_text = cross.groupBy(*PAIR).agg(listed(["rank"], "_t", " | ").alias("cross_modules"), listed(["rank"], "_l", "\n").alias("cross_lines"))
    hot = refactoring_hotspot(penalties)
    # of equal names the first listed one is shown
    fan_rows = dangerous.select(*GRAPH, "file", *[F.col(c).cast("bigint").alias(c) for c in ("fan_in", "fan_out")], (-F.col("rank")).alias("ord"))
    hot = hot.join(module_files_text(hot.select(*MODULE, F.slice("files", 1, 4).alias("files")), fan_rows), MODULE, "left")
    hot_text = on_new(hot).select(*PAIR, F.concat(
        F.format_string("Layer %s / %s files, cross_penalty=%.3f | files: ", "layer_no", "module_size", "cross_penalty"),
        F.coalesce("files_text", F.lit(""))).alias("refactoring_hotspot"))
    by_type = lambda c: listed(["type"], c).alias(f"typed_{c.removeprefix('_')}")
    if typed is None:
        typed = wide.select(*PAIR, F.lit(None).cast("string").alias("type"), *[F.lit(None).cast("bigint").alias(c) for c in ("commit_count", "churn_total")])
    typed_text = typed.select(*PAIR, "type", *[F.concat("type", F.lit("="), c).alias(f"_{c.split('_')[0]}") for c in ("commit_count", "churn_total")])
    typed_text = typed_text.groupBy(*PAIR).agg(by_type("_commit"), by_type("_churn"))
    out = wide
    for part in (moves, diff, pattern_text, danger_text, danger_lines, cross_text, hot_text, commits, typed_text):
        out = out.join(part, PAIR, "left")
    return out


# The headings and line beginnings in the texts below are fixed values of the report format.


def evidence_text(facts: DataFrame) -> DataFrame:
    """The section of metrics, graph, risk signals and commits of a transition, from ``transition_facts``."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    signed2 = lambda c: F.format_string("%+.2f", c)

    def metric(name: str) -> Column:
        old, new, delta, relative = (F.col(f"{name.replace('-', '_')}_{v}") for v in ("old_value", "new_value", "delta", "relative"))
        share = F.when(relative.isNull(), "").otherwise(F.concat(F.lit(", "), signed2(relative), F.lit("% relative")))
        return F.concat(F.lit(f"- {name}: old="), F.round(old, 2), F.lit(" → new="), F.round(new, 2), F.lit(" (Δ="), signed2(delta), F.lit(" points"), share, F.lit(")"))

    side = lambda s: F.concat(F.lit(f"{s}: total_weight="), F.col(f"weight_{s}"), F.lit(", "), F.col(f"by_kind_{s}"))
    cycles = lambda s: F.concat(F.lit(f"- scc_{s}: scc_count="), F.col(f"scc_count_{s}"), F.lit(", largest_scc_size="), F.col(f"largest_scc_{s}"))
    text = F.concat_ws(
        "\n", F.lit("## Metrics & Evidence\n### DV8 Metric Changes (older→newer)"), *[metric(m) for m in METRICS], F.lit(METRIC_NOTE),
        F.concat(F.lit("- DRH file count (older→newer): "), file_change_text()),
        F.lit("### Evidence Graph (matrix.json derived, if available)"),
        F.concat(F.lit("- nodes: new="), "nodes_new", F.lit(", old="), "nodes_old", F.lit(", delta="), "nodes_delta"),
        F.concat(F.lit("- edges: "), side("new"), F.lit("; "), side("old")),
        F.concat(F.lit("- edges.total_weight delta (new-old): "), signed2(F.round(F.col("weight_new") - F.col("weight_old"), 2))),
        cycles("old"), cycles("new"),
        F.lit("### Risk Signals (newer timestep)"), F.concat(F.lit("- anti-pattern counts: "), filled("anti_patterns")),
        F.concat(F.lit("- dangerous files (top):\n"), filled("dangerous_lines")),
        F.concat(F.lit("- highest cross-layer penalty modules (newer):\n"), filled("cross_lines")),
        F.when(F.col("total_commits").isNotNull(), "### Commit Context (older→newer window)"),
        F.concat(F.lit("- top commits (sample): "), filled("top_commits")), F.concat(F.lit("- hotspot files (sample): "), filled("hotspot_files")),
    )
    return facts.select(*PAIR, F.concat(text, F.lit("\n")).alias("text"))


def summary_text(facts: DataFrame) -> DataFrame:
    """The leading section of a transition report, from ``transition_facts``."""
    deltas = lambda v: key_values(*[(m, F.col(f"{m.replace('-', '_')}_{v}")) for m in METRICS])
    line = lambda title, body: F.concat(F.lit(title), F.nullif(body, F.lit("")))
    text = F.concat_ws(
        "\n", F.lit("## Comprehensive Summary"),
        line("- Metric deltas (new-old, absolute points): ", deltas("delta")),
        line("- Metric deltas (new-old, relative %): ", deltas("relative")),
        line("- Anti-pattern counts (newer): ", F.col("anti_patterns")),
        line("- Most dangerous files (newer, DV8): ", F.col("dangerous_files")),
        F.concat(F.lit("- Issue-typed churn (newer): commit_count=("), F.nullif("typed_commit", F.lit("")), F.lit("), churn_total=("), "typed_churn", F.lit(")")),
        F.concat(F.lit("- DRH file count: old="), "files_old", F.lit(" → new="), "files_new", F.lit(" (Δ="),
                 signed(F.col("files_new") - F.col("files_old")), F.lit(")")),
        F.concat(F.lit("- DRH movement (old→new): "), key_values(
            ("moved_layers", F.col("moved_layers")), ("moved_modules", F.col("moved_modules")),
            ("added_files", F.col("added_files")), ("removed_files", F.col("removed_files"))), F.lit(MOVE_NOTE)),
        line("- Highest cross-layer penalty modules (newer): ", F.col("cross_modules")),
        line("- Refactoring hotspot (top module by cross_penalty×size): ", F.col("refactoring_hotspot")),
    )
    return facts.select(*PAIR, F.concat(text, F.lit("\n")).alias("text"))


# --- rule-based hints ------------------------------------------------------------

# Wording of the hints.
HINT_LAYERED = (
    "DRH layering changed from %d layer(s) (%s) to %d layer(s) (%s), indicating stronger separation of concerns."
)
HINT_LAYERS = (
    "DRH layer distribution changed from (%s) to (%s), suggesting a reorganization of responsibilities across layers."
)
HINT_MORE_FILES = (
    "DRH file count changed from %d to %d (delta=%+d), consistent with decomposing large responsibilities into more files."
)
HINT_FEWER_FILES = "DRH file count changed from %d to %d (delta=%+d), consistent with consolidation into fewer units."
HINT_LESS_WEIGHT = (
    "Evidence graph total dependency weight changed from %.0f to %.0f (delta=%+.0f), aligning with reduced propagation cost."
)
HINT_MORE_WEIGHT = (
    "Evidence graph total dependency weight changed from %.0f to %.0f (delta=%+.0f), suggesting more interconnections."
)
HINT_FEWER_CYCLES = (
    "SCC count changed from %d (largest=%d files%s) to %d, indicating fewer dependency cycles (supports lower propagation cost)."
)
HINT_MORE_CYCLES = "SCC count changed from %d to %d, indicating more dependency cycles."
HINT_REMOVED = "The heaviest removed edge was %s -> %s (%s weight=%.0f), indicating a high-coupling dependency was eliminated."
HINT_OLDER_CYCLES = " The older revision had %d SCC(s) containing %s."
HINT_ADDED = "The heaviest added edge was %s -> %s (%s weight=%.0f), indicating new coupling was introduced."
HINT_PATTERN = "Anti-pattern '%s' count changed from %d to %d (delta=%+d)."
HINT_FILES = "Refer to concrete files that gained architectural importance (e.g., %s)."


def _hint(rows: DataFrame, rule: int, text: Column, sub: Column | None = None) -> DataFrame:
    sub = F.lit("") if sub is None else sub
    return rows.select(*PAIR, F.lit(rule).alias("rule"), sub.alias("sub"), text.alias("hint")).filter(F.col("hint").isNotNull())


def narrative_hints(
    layers: DataFrame, moves: DataFrame, diff: DataFrame, members: DataFrame, heaviest: DataFrame, patterns: DataFrame,
    changes: DataFrame, allowed: DataFrame, cap: int | None = None,
) -> DataFrame:
    """Ordered hints per transition, the first ``cap`` if given; every rule is one projection."""
    pairs = moves.select(*PAIR)
    sided = by_pair(layers, pairs).withColumn("_t", F.concat("layer", F.lit(":"), "files"))
    shape = sided.groupBy(*PAIR).agg(
        *[F.count_if(F.col("side") == s).alias(f"k_{s}") for s in ("old", "new")],
        *[_sided(s, ["layer"], "_t", ", ").alias(f"d_{s}") for s in ("old", "new")],
    )
    ko, kn = F.col("k_old"), F.col("k_new")
    layer_hint = F.when((ko <= 1) & (kn > 1), F.format_string(HINT_LAYERED, ko, "d_old", kn, "d_new")).when(
        ko != kn, F.format_string(HINT_LAYERS, "d_old", "d_new")
    )
    fo, fn = F.col("files_old"), F.col("files_new")
    file_hint = F.when(fn > fo, F.format_string(HINT_MORE_FILES, fo, fn, fn - fo)).when(
        fn < fo, F.format_string(HINT_FEWER_FILES, fo, fn, fn - fo)
    )
    wo, wn = F.col("weight_old"), F.col("weight_new")
    weight_hint = F.when(wn < wo, F.format_string(HINT_LESS_WEIGHT, wo, wn, wn - wo)).when(
        wn > wo, F.format_string(HINT_MORE_WEIGHT, wo, wn, wn - wo)
    )
    sizes = members.groupBy(*GRAPH, "component").agg(F.count(F.lit(1)).alias("n"))
    largest = top_rows(sizes, GRAPH, [F.col("n").desc(), F.col("component")], 1).select(*GRAPH, "component")
    first = top_rows(members.join(largest, [*GRAPH, "component"], "left_semi"), GRAPH, [F.col("node")], 6)
    names = first.withColumn("_t", basename(F.col("node"))).groupBy(*GRAPH).agg(listed(["rank"], "_t").alias("scc_files"))
    cycles = diff.join(names.withColumnRenamed("rev", "old_rev"), ["repo", "old_rev"], "left")
    co, cn = F.col("scc_count_old"), F.col("scc_count_new")
    inside = F.coalesce(F.concat(F.lit(": "), "scc_files"), F.lit(""))
    cycle_hint = F.when(cn < co, F.format_string(HINT_FEWER_CYCLES, co, "largest_scc_old", inside, cn)).when(
        cn > co, F.format_string(HINT_MORE_CYCLES, co, cn)
    )
    edge = lambda form: F.format_string(form, basename(F.col("src")), basename(F.col("dest")), "kind", "weight")
    removed = heaviest.filter(F.col("status") == "removed").join(cycles.select(*PAIR, "scc_count_old", "scc_files"), PAIR, "left")
    older = F.when(F.col("scc_files").isNotNull(), F.format_string(HINT_OLDER_CYCLES, "scc_count_old", "scc_files")).otherwise("")
    po, pn = F.col("n_old"), F.col("n_new")
    order = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric"))
    rel = F.coalesce(F.format_string(", %+.2f%% relative", "relative"), F.lit(""))
    rel = F.when(F.col("relative").isNull(), "").otherwise(rel)
    metric_text = F.concat(
        "metric", F.lit(" changed from "), F.round("old_value", 2), F.lit(" to "), F.round("new_value", 2), F.lit(" (delta="),
        F.format_string("%+.2f", "delta"), F.lit(" points"), rel, F.lit(")."),
    )
    sample = allowed.filter(F.col("rank") <= 5).groupBy(*PAIR).agg(listed(["rank"], "file").alias("sample"))
    rules = [
        _hint(shape, 1, layer_hint), _hint(moves, 2, file_hint), _hint(diff, 3, weight_hint), _hint(cycles, 4, cycle_hint),
        _hint(removed, 5, F.concat(edge(HINT_REMOVED), older)),
        _hint(heaviest.filter(F.col("status") == "added"), 6, edge(HINT_ADDED)),
        _hint(patterns.filter(po != pn), 7, F.format_string(HINT_PATTERN, "type", po, pn, pn - po), F.col("type")),
        _hint(changes.filter(F.col("delta").isNotNull() & (order > 0)), 8, metric_text, order.cast("string")),
        _hint(sample, 9, F.format_string(HINT_FILES, "sample")),
    ]
    return top_rows(reduce(DataFrame.unionByName, rules), PAIR, [F.col("rule"), F.col("sub")], cap)


# --- revision payloads -----------------------------------------------------------


def revision_payloads(
    revisions: DataFrame, metrics: DataFrame, patterns: DataFrame, churn: DataFrame, typed: DataFrame, recent: DataFrame,
    hotspots: DataFrame, dangerous: DataFrame | None = None, scores: DataFrame | None = None, layer_modules: DataFrame | None = None,
) -> DataFrame:
    """One nested row per revision: metadata, metrics, pattern counts, churn, typed churn, recent commits, hotspots.

    churn(repo, rev, rank, path, churn) and typed(repo, rev, type, commit_count, …) belong to the window that ends
    at the revision; every collected list is a bounded top-n. scores(repo, rev, mscore_percentage) and
    layer_modules(repo, rev, layer_no, modules) add the calculated score.
    """
    maps = metrics.filter(F.col("value").isNotNull()).groupBy(*GRAPH).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    )
    counts = patterns.groupBy(*GRAPH).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("anti_pattern_counts")
    )
    sorted_list = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    churns = churn.groupBy(*GRAPH).agg(sorted_list("rank", "path", "churn").alias("churn_top"))
    types = typed.groupBy(*GRAPH).agg(
        sorted_list("type", "commit_count", "issue_key_count", "churn_total", "freq_total").alias("issue_typed_churn")
    )
    commits = recent.groupBy("repo").agg(sorted_list("rank", "hash", "ts", "subject").alias("git_recent"))
    spots = hotspots.groupBy(*GRAPH).agg(sorted_list("rank", "node", "fan_in", "fan_out", "total_weight").alias("structural_hotspots"))
    out = revisions.select(*GRAPH, "commit_hash", "commit_ts", "message").join(commits, "repo", "left")
    for part in (maps, counts, churns, types, spots):
        out = out.join(part, GRAPH, "left")
    if dangerous is not None:
        rows = dangerous.groupBy(*GRAPH).agg(sorted_list("rank", "file", "fan_in", "fan_out", "churn").alias("dangerous_files"))
        out = out.join(rows, GRAPH, "left")
    if scores is not None:
        out = out.join(scores.select(*GRAPH, "mscore_percentage"), GRAPH, "left")
    if layer_modules is not None:
        out = out.join(layer_modules.groupBy(*GRAPH).agg(sorted_list("layer_no", "modules").alias("layer_module_counts")), GRAPH, "left")
    return out


def payload_markdown(payloads: DataFrame) -> DataFrame:
    """Short text of a payload: metrics, pattern counts, dangerous files (else hotspots), churn, recent commits."""
    has = payloads.columns.__contains__
    entries = lambda c: F.coalesce(F.map_entries(c), F.array())
    each = lambda title, items, form: F.concat(
        F.lit(title + "\n"), F.nullif(F.array_join(F.transform(items, form), "\n"), F.lit("")))
    spots = each("## Structural hotspots (from DSM matrix)", F.slice("structural_hotspots", 1, 5), lambda h: F.concat(
        F.lit("- Filename: "), h["node"], F.lit(", FanIn: "), h["fan_in"], F.lit(", FanOut: "), h["fan_out"],
        F.lit(", TotalWeight: "), h["total_weight"]))
    if has("dangerous_files"):
        known = lambda v: F.coalesce(v.cast("string"), F.lit(""))
        spots = F.coalesce(each("## Dangerous files (from DV8 analysis-summary.html)", F.slice("dangerous_files", 1, 5), lambda d: F.concat(
            F.lit("- Filename: "), d["file"], F.lit(", FanIn: "), known(d["fan_in"]), F.lit(", FanOut: "), known(d["fan_out"]),
            F.lit(", ChangeChurn: "), known(d["churn"]))), spots)
    score = [F.concat(F.lit("- m_score_from_dsm_drh: "), F.round("mscore_percentage", 4))] if has("mscore_percentage") else []
    if has("layer_module_counts"):
        score.append(each("  - layer_module_counts:", F.col("layer_module_counts"), lambda m: F.concat(
            F.lit("    - layer "), m["layer_no"], F.lit(": "), m["modules"], F.lit(" modules"))))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Revision Summary: "), "rev"),
        F.concat(F.lit("- Commit: "), "commit_hash", F.lit(" | Date: "), F.date_format("commit_ts", "yyyy-MM-dd"), F.lit(" | Repo: "), "repo"),
        F.coalesce(each("## Metrics", entries("metrics"), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.round(e["value"], 4))), F.lit("## Metrics")),
        *score,
        each("## Anti-Patterns (counts)", entries("anti_pattern_counts"), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])),
        spots,
        each("## Top churn files (recent git log)", F.col("churn_top"), lambda c: F.concat(F.lit("- "), c["path"], F.lit(": "), c["churn"], F.lit(" LOC changed"))),
        each("## Recent commits", F.col("git_recent"), lambda c: F.concat(
            F.lit("- "), c["hash"], F.lit(" | "), F.date_format(c["ts"], "yyyy-MM-dd"), F.lit(" | "), c["subject"])),
    )
    return payloads.select(*GRAPH, text.alias("text"))


# --- metric explanations, tool problems, question context --------------------------


def metric_explanations(changed: DataFrame, summary: DataFrame) -> DataFrame:
    """Changed metrics with the commit summary of their window."""
    return changed.join(summary, PAIR, "left")


def tool_problems(steps: DataFrame) -> DataFrame:
    """Bad steps of tool logs: a non-zero return code or an error word in the error output.

    steps(repo, rev, ord, step, cmd, rc, stderr).
    """
    bad = (F.coalesce("rc", F.lit(0)) != 0) | F.coalesce("stderr", F.lit("")).rlike("(?i)error|exception|failed")
    return steps.filter(bad).withColumn("stderr", F.substring(F.trim(F.coalesce("stderr", F.lit(""))), 1, 1000))


def tool_report(problems: DataFrame) -> DataFrame:
    """Number of bad steps per revision and the text of all of them."""
    counts = problems.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("problems"))
    text = F.concat(
        F.lit("- Step: "), "step", F.lit(" (rc="), F.coalesce("rc", F.lit(0)), F.lit(")\n  Cmd: "), F.coalesce("cmd", F.lit("")),
        F.when(F.col("stderr") != "", F.concat(F.lit("\n  Stderr: "), "stderr")).otherwise(""),
    )
    return counts.join(problems.withColumn("_t", text).groupBy(*GRAPH).agg(listed(["ord"], "_t", "\n").alias("report")), GRAPH)


# Titles and character budgets of the question context.
MODULES_TITLE = "## M-SCORE WORST MODULES (most recent 5 revisions, top 5 by contribution = cross_penalty × size_factor; FanIn/FanOut per file):"
RISK_TITLE = "## MULTI-SIGNAL FILE RISK SCORES (bug_churn 30% + anti_pattern 25% + fan_in 20% + scc 15% + co_change 10%):"
COMMITS_TITLE = "## BUG-LINKED COMMITS (JIRA-typed or keyword-matched; most recent first):"
BUDGET, BUDGET_MODULES, BUDGET_RISK, BUDGET_COMMITS, BUDGET_SUMMARIES, LEAST_NARRATIVE, SUMMARY_BLOCKS = (
    28000, 6000, 4000, 6000, 6000, 500, 8
)


def question_context(rows: DataFrame) -> DataFrame:
    """Adds ``context``: capped sections, then as much of the report as the budget leaves if that is worth it.

    rows hold modules_text, risk_text, commit_text and report_text, each may be NULL.
    """
    section = lambda title, c, size: F.coalesce(
        F.concat(F.lit(title + "\n"), F.substring(F.nullif(F.col(c), F.lit("")), 1, size), F.lit("\n\n")), F.lit(""))
    blocks = F.regexp_extract_all("report_text", F.lit(r"(?s)(## Comprehensive Summary.*?)(?=\n## |\z)"), 1)
    out = rows.withColumn("_m", section(MODULES_TITLE, "modules_text", BUDGET_MODULES))
    out = out.withColumn("_r", section(RISK_TITLE, "risk_text", BUDGET_RISK))
    out = out.withColumn("_c", section(COMMITS_TITLE, "commit_text", BUDGET_COMMITS))
    out = out.withColumn("_s", F.substring(F.coalesce(F.array_join(F.slice(blocks, 1, SUMMARY_BLOCKS), "\n\n"), F.lit("")), 1, BUDGET_SUMMARIES))
    used = F.length("_m") + F.length("_r") + F.length("_c") + F.length("_s")
    left = F.greatest(F.lit(BUDGET) - used, F.lit(0))
    story = F.when(left > LEAST_NARRATIVE, F.substring(F.coalesce("report_text", F.lit("")), F.lit(1), left)).otherwise("")
    gap = F.when(F.col("_s") != "", "\n\n").otherwise("")
    return out.withColumn("context", F.concat("_m", "_r", "_c", "_s", gap, story)).drop("_m", "_r", "_c", "_s")
