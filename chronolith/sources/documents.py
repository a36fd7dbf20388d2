"""Documents, reports, metric facts and revision histories as texts for the retrieval index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.classify import model_from_path, repo_from_path
from chronolith.functions.text import basename, number_text, strip
from chronolith.operators.common import listed, top_rows
from chronolith.operators.retrieval import SHORTEST_CHUNK, chunked, chunked_lines

KNOWLEDGE_SUFFIXES = ("txt", "md", "rst", "html")

# Report name pattern -> subtype and chunk id prefix.
REPORT_KINDS = {
    r"^temporal_interpretation_report_.*\.md$": ("temporal_report", "report"),
    r"^drh_diff_report_.*\.md$": ("drh_diff", "drh"),
    r"^USER_ANSWER_.*\.md$": ("user_answer", "qa"),
    r"^interpretation_payload\.md$": ("payload", "payload"),
}


def _chunks(docs: DataFrame, prefix: Column, shortest: int = SHORTEST_CHUNK) -> DataFrame:
    rows = chunked(docs.withColumn("text", strip(F.col("text"))).withColumn("_prefix", prefix), shortest=shortest)
    return rows.withColumn("chunk_id", F.concat_ws(":", "_prefix", "ord")).select(
        "chunk_id", "layer", "subtype", "repo", "model", "source_file", "ord", "text"
    )


def knowledge_chunks(files: DataFrame) -> DataFrame:
    """L1 chunks of (path, text) files with a text suffix."""
    name = basename(F.col("path"))
    docs = files.filter(name.rlike(r"\.(?:" + "|".join(KNOWLEDGE_SUFFIXES) + ")$")).select(
        F.lit("L1").alias("layer"), F.lit(None).cast("string").alias("subtype"), F.lit("").alias("repo"), F.lit("").alias("model"),
        F.col("path").alias("source_file"), "text",
    )
    return _chunks(docs, F.concat(F.lit("L1:"), basename(F.col("source_file"))))


def report_chunks(files: DataFrame) -> DataFrame:
    """L2 chunks of reports, transition reports, answers and payloads, told apart by file name."""
    name = basename(F.col("path"))
    kind = F
    for pattern, (subtype, tag) in REPORT_KINDS.items():
        kind = kind.when(name.rlike(pattern), F.struct(F.lit(subtype).alias("subtype"), F.lit(tag).alias("tag")))
    rows = files.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    is_payload = F.col("kind.subtype") == "payload"
    docs = rows.select(
        F.lit("L2").alias("layer"), "kind.subtype", repo_from_path(F.col("path")).alias("repo"),
        F.when(is_payload, "").otherwise(model_from_path(F.col("path"))).alias("model"), F.col("path").alias("source_file"), "text", "kind.tag",
    )
    # a payload is named by its revision folder two levels up
    folder = F.get(F.reverse(F.split("source_file", "/")), F.lit(2))
    label = F.when(F.col("subtype") == "payload", folder).otherwise(basename(F.col("source_file")))
    return _chunks(docs, F.concat_ws(":", F.lit("L2"), "tag", "repo", label))


def _metric_texts(metrics: DataFrame) -> DataFrame:
    """(repo, rev, mscore, pc, dl, il) as texts, '?' for unknown values."""
    pick = lambda m: F.coalesce(number_text(F.max(F.when(F.col("metric") == m, F.col("value")))), F.lit("?"))
    return metrics.groupBy("repo", "rev").agg(
        pick("m-score").alias("mscore"), pick("propagation-cost").alias("pc"), pick("decoupling-level").alias("dl"),
        pick("independence-level").alias("il"),
    )


def _headed(lines: DataFrame, head: str) -> DataFrame:
    """(repo, nth, line): the lines of a generated text with its first line, ``nth`` 0."""
    first = lines.select("repo").distinct().select("repo", F.lit(0).cast("bigint").alias("nth"), F.concat(F.lit(head), "repo", F.lit(":")).alias("line"))
    return first.unionByName(lines)


def _joined(lines: DataFrame) -> DataFrame:
    return lines.groupBy("repo").agg(listed(["nth"], "line", "\n").alias("text"))


def series_texts(revisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """(repo, text): metric values of every revision, one line each; ``fact_line_chunks`` of ``series_lines`` cuts such texts without building them."""
    return _joined(series_lines(revisions, metrics))


def history_texts(revisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """(repo, text): date, short hash, score and message of every revision, one line each."""
    return _joined(history_lines(revisions, metrics))


def series_lines(revisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """(repo, nth, line): metric values of every revision below a heading."""
    rows = revisions.join(_metric_texts(metrics), ["repo", "rev"])
    line = F.concat(
        F.lit("  rev"), "rev", F.lit(" ("), F.date_format("commit_ts", "yyyy-MM-dd"), F.lit("): mscore="), "mscore", F.lit(", propagation_cost="),
        "pc", F.lit(", decoupling_level="), "dl", F.lit(", independence_level="), "il",
    )
    return _headed(rows.select("repo", F.col("rev").cast("bigint").alias("nth"), line.alias("line")), "TIMESERIES for ")


def history_lines(revisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """(repo, nth, line): date, short hash, score and message of every revision below a heading."""
    rows = revisions.join(_metric_texts(metrics), ["repo", "rev"])
    line = F.concat(
        F.lit("  rev"), "rev", F.lit(" | "), F.date_format("commit_ts", "yyyy-MM-dd"), F.lit(" | "), F.substring("commit_hash", 1, 8),
        F.lit(" | mscore="), "mscore", F.lit(" | "), F.substring(F.trim(F.coalesce("message", F.lit(""))), 1, 200),
    )
    return _headed(rows.select("repo", F.col("rev").cast("bigint").alias("nth"), line.alias("line")), "GIT REVISION HISTORY for ")


def module_texts(scores: DataFrame, files: DataFrame, totals: DataFrame, label: Column, shown: int | None = None) -> DataFrame:
    """(repo, rev, text): overall score and the modules of a revision, the first ``shown`` if given, with up to four file names.

    files: ``sample_files`` arrays; totals: ``mscore`` rows; label: text naming the revision.
    """
    first = top_rows(scores, ["repo", "rev"], [F.col("layer_no"), F.col("module_no")], shown)
    rows = first.join(files, ["repo", "rev", "layer_no", "module_no"], "left")
    names = F.array_join(F.transform(F.slice("files", 1, 4), basename), ", ")
    line = F.concat(
        F.lit("  Layer "), "layer_no", F.lit(": size="), "module_size", F.lit(" files, cross_penalty="), number_text(F.round("cross_penalty", 6)),
        F.lit(", contribution="), number_text(F.round("contribution", 6)), F.lit(" | files: "), F.coalesce(names, F.lit("")),
    )
    lines = rows.withColumn("_t", line).groupBy("repo", "rev").agg(listed(["rank"], "_t", "\n").alias("lines"))
    head = F.concat(F.lit("M-SCORE COMPONENTS for "), "repo", F.lit(" revision "), label, F.lit(":\n  overall mscore="),
                    number_text(F.round("mscore", 6)), F.lit("\n"))
    return lines.join(totals.select("repo", "rev", "mscore"), ["repo", "rev"]).select("repo", "rev", F.concat(head, "lines").alias("text"))


def fact_chunks(texts: DataFrame, layer: str, kind: str | None, source: Column) -> DataFrame:
    """Chunks of generated texts; ``kind`` is the middle part of the chunk id."""
    docs = texts.select(
        F.lit(layer).alias("layer"), F.lit(None).cast("string").alias("subtype"), "repo", F.lit("").alias("model"), source.alias("source_file"), "text",
    )
    prefix = F.concat_ws(":", F.lit(layer), F.lit(kind), "repo") if kind else F.concat_ws(":", F.lit(layer), "repo")
    return _chunks(docs, prefix)


def fact_line_chunks(lines: DataFrame, layer: str, kind: str | None, source: Column) -> DataFrame:
    """``fact_chunks`` of the texts that ``lines`` (repo, nth, line) make, cut without building them."""
    rows = chunked_lines(lines, shortest=SHORTEST_CHUNK)
    prefix = F.concat_ws(":", F.lit(layer), F.lit(kind), "repo") if kind else F.concat_ws(":", F.lit(layer), "repo")
    return rows.select(
        F.concat_ws(":", prefix, "ord").alias("chunk_id"), F.lit(layer).alias("layer"), F.lit(None).cast("string").alias("subtype"), "repo", F.lit("").alias("model"),
        source.alias("source_file"), "ord", "text",
    )


def all_chunks(*parts: DataFrame) -> DataFrame:
    """Chunks of all layers in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
