"""Checks of analysis bundles and of written reports, as rows of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import basename, file_mentions, section_body
from chronolith.operators.common import PAIR, listed, top_rows

# Headings a report must have; the first one must lead.
REQUIRED_HEADINGS = ("## Comprehensive Summary", "## DRH Differences", "## Metrics & Evidence", "## Likely Drivers")


def _finding(rows: DataFrame, keys: list[str], severity: str, message: Column) -> DataFrame:
    return rows.select(*keys, F.lit(severity).alias("severity"), message.alias("message"))


def revision_sets(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Revision numbers only one of the two listings has, for repositories present in both."""
    both = expected.select("repo").distinct().join(found.select("repo").distinct(), "repo")
    tag = lambda rows, name: rows.select("repo", "rev").distinct().withColumn(name, F.lit(1))
    joined = tag(expected, "e").join(tag(found, "f"), ["repo", "rev"], "full").join(both, "repo", "left_semi")
    side = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected")
    return joined.withColumn("status", side).filter(F.col("status").isNotNull()).select("repo", "rev", "status")


# Payload reference -> severity if the named file does not exist.
REFERENCES = {
    "matrix_json": "ISSUE", "drh_clustering_json": "ISSUE", "png": "WARN", "pdf": "WARN",
    "dangerous_source": "WARN", "structural_source": "WARN",
}


def bundle_findings(payloads: DataFrame, files: DataFrame, revisions: DataFrame, diff_index: DataFrame) -> DataFrame:
    """Findings of an analysis bundle.

    payloads(repo, rev, has_metrics, has_paths and one column per reference), files(repo, rev, path) lists what
    exists (rev 0 for files of the whole bundle), revisions(repo, rev) what is expected, diff_index(repo, path)
    the graph-diff files an index names.
    """
    keys = ["repo", "rev"]
    parts = [
        _finding(payloads.filter(~F.col("has_metrics")), keys, "ISSUE", F.lit("Payload missing key: metrics")),
        _finding(payloads.filter(~F.col("has_paths")), keys, "ISSUE", F.lit("Payload missing key: dsm_paths")),
    ]
    named = payloads.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(k).alias("ref"), F.lit(v).alias("severity"), F.col(k).alias("path")) for k, v in REFERENCES.items()
    ])).alias("x")).select(*keys, "x.*").filter(F.coalesce("path", F.lit("")) != "")
    gone = named.join(files.select(*keys, "path").distinct(), [*keys, "path"], "left_anti")
    parts.append(gone.select(*keys, "severity", F.concat("ref", F.lit(" missing: "), "path").alias("message")))
    unmatched = revision_sets(revisions, payloads)
    parts.append(_finding(unmatched, keys, "WARN", F.concat(F.lit("Revision number "), "status")))
    without = revisions.select(*keys).distinct().join(payloads.select(*keys).distinct(), keys, "left_anti")
    parts.append(_finding(without, keys, "ISSUE", F.lit("Missing interpretation payload")))
    bundle = files.filter(F.col("rev") == 0).select("repo", "path").distinct()
    lost = diff_index.join(bundle, ["repo", "path"], "left_anti").withColumn("rev", F.lit(0))
    parts.append(_finding(lost, keys, "WARN", F.concat(F.lit("Missing evidence graph diff file: "), "path")))
    unindexed = revisions.select("repo").distinct().join(diff_index.select("repo").distinct(), "repo", "left_anti")
    parts.append(_finding(unindexed.withColumn("rev", F.lit(0)), keys, "INFO", F.lit("No graph diff index found (ok)")))
    return reduce(DataFrame.unionByName, parts)


def findings_rollup(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per severity and the verdict: PASS without any issue."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy(*keys).agg(
        count("ISSUE").alias("issues"), count("WARN").alias("warnings"), count("INFO").alias("infos"),
        F.when(count("ISSUE") == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def unknown_mentions(reports: DataFrame, allowed: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """File names a report mentions that are no allowed file, neither by full path nor by name.

    allowed holds (keys, file); reports without allowed files are skipped.
    """
    checked = reports.join(allowed.select(*keys).distinct(), keys, "left_semi")
    said = checked.select(*keys, F.explode(file_mentions(F.col("report_text"))).alias("token")).distinct()
    names = allowed.select(*keys, F.explode(F.array("file", basename(F.col("file")))).alias("token")).distinct()
    return said.join(names, [*keys, "token"], "left_anti")


def report_findings(reports: DataFrame, allowed: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Findings of written reports: fences, headings, repeats, short sections, unknown files."""
    text = F.col("report_text")
    has = lambda s: F.contains(text, F.lit(s))
    parts = [_finding(reports.filter(has("```")), keys, "ISSUE", F.lit("Report contains code fences (```), which are disallowed."))]
    for h in REQUIRED_HEADINGS:
        parts.append(_finding(reports.filter(~has(h)), keys, "ISSUE", F.lit(f"Missing required heading: {h}")))
    first = F.trim(F.regexp_extract(text, r"(?m)^(## [^\n]*)", 1))
    lead = REQUIRED_HEADINGS[0]
    off = reports.withColumn("_h", first).filter((F.col("_h") != "") & (F.col("_h") != lead))
    parts.append(_finding(off, keys, "ISSUE", F.concat(F.lit("First heading is '"), "_h", F.lit(f"', expected '{lead}'."))))
    twice = reports.filter(F.regexp_count(text, F.lit(rf"\Q{lead}\E")) > 1)
    parts.append(_finding(twice, keys, "ISSUE", F.lit("Comprehensive Summary appears multiple times.")))
    parts.append(_finding(reports.filter(has("ALLOWED FILES")), keys, "WARN", F.lit("Report repeats prompt scaffolding ('ALLOWED FILES').")))
    for h in REQUIRED_HEADINGS[1:]:
        body = section_body(text, h)
        short = reports.filter((body != "") & ~F.contains(body, F.lit("\n")))
        parts.append(_finding(short, keys, "WARN", F.lit(f"{h[3:]} section looks very short.")))
    bare = reports.join(allowed.select(*keys).distinct(), keys, "left_anti")
    parts.append(_finding(bare, keys, "WARN", F.lit("Prompt ALLOWED FILES list missing or empty; file reference checks skipped.")))
    sample = top_rows(unknown_mentions(reports, allowed, keys), keys, [F.col("token")], 20)
    sample = sample.groupBy(*keys).agg(listed(["rank"], "token").alias("_s"))
    parts.append(_finding(sample, keys, "ISSUE", F.concat(F.lit("Report references file names not in ALLOWED FILES: "), "_s")))
    return reduce(DataFrame.unionByName, parts)


def allowed_from_prompt(prompts: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """(keys, file): bullets between the 'ALLOWED FILES' line and the 'FACTS' line of a prompt text."""
    block = F.regexp_extract("prompt_text", r"(?ms)^[^\S\n]*ALLOWED FILES[^\n]*\n(.*?)(?=^[^\S\n]*FACTS|\z)", 1)
    lines = F.transform(F.split(block, "\n"), F.trim)
    names = F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit("- "))), lambda s: F.trim(F.substring(s, 3, 2**31 - 1)))
    kept = F.filter(names, lambda n: (n != "") & (n != "(none)"))
    return prompts.select(*keys, F.explode(kept).alias("file"))
