"""Exported version-control logs and revision series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.classify import METRICS
from chronolith.functions.dates import commit_timestamp
from chronolith.functions.text import parse_percent

SENTINEL = "__COMMIT__"
UNIT = "\x1f"

# Header layouts: separator and field names, the last field keeps any further separators.
HEADERS = {
    "typed": ("\t", ("hash", "subject")),
    "dated": ("|", ("hash", "date", "author", "subject")),
    "mailed": ("|", ("hash", "author", "email", "date", "subject")),
    "unit": (UNIT, ("hash", "date", "author", "subject", "body")),
}


def _header(line: Column, layout: str) -> Column:
    separator, names = HEADERS[layout]
    quoted = {"|": r"\|"}.get(separator, separator)
    parts = F.split(line, quoted, len(names))
    return F.struct(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)], F.size(parts).alias("fields"))


def read_log(spark: SparkSession, path: str, separator: str = SENTINEL + "\n") -> DataFrame:
    """(path, lines): one row per commit record of a log; the separator keeps large logs splittable."""
    rows = spark.read.option("lineSep", separator).text(path)
    lines = F.filter(F.split("value", "\n"), lambda s: s != "")
    return rows.select(F.col("_metadata.file_path").alias("path"), lines.alias("lines")).filter(F.size("lines") > 0)


def log_records(logs: DataFrame, layout: str = "typed") -> DataFrame:
    """Adds the parsed header ``h`` and ``body`` lines.

    In the 'typed' layout the first line is the header. In the others a record may begin with headers of commits
    that changed nothing: every line with the separator is a header and the last one owns the body.
    """
    separator, names = HEADERS[layout]
    if layout == "typed":
        first = _header(F.get("lines", F.lit(0)), layout)
        return logs.select("path", F.array(first).alias("headers"), F.slice(F.col("lines"), 2, 2**31 - 1).alias("body"))
    is_head = lambda s: F.contains(s, F.lit(separator))
    heads = F.transform(F.filter("lines", is_head), lambda s: _header(s, layout))
    least = len(names) - 1 if layout == "unit" else len(names)
    return logs.select(
        "path", F.filter(heads, lambda h: h["fields"] >= least).alias("headers"),
        F.filter("lines", lambda s: ~is_head(s)).alias("body"),
    )


def log_commits(records: DataFrame) -> DataFrame:
    """One row per header; a date field also gives ``ts``."""
    rows = records.select("path", F.explode("headers").alias("h")).select("path", "h.*").drop("fields")
    if "date" in rows.columns:
        rows = rows.withColumn("ts", commit_timestamp(F.col("date")))
    return rows


def log_changes(records: DataFrame) -> DataFrame:
    """(path, hash, file, added, deleted) of lines with exactly three tab fields; '-' counts 0, other text drops the line."""
    owner = F.get(F.reverse("headers"), F.lit(0))["hash"]
    lines = records.select("path", owner.alias("hash"), F.explode("body").alias("line"))
    parts = F.split("line", "\t")
    number = lambda i: F.when(F.get(parts, F.lit(i)) == "-", F.lit("0")).otherwise(F.get(parts, F.lit(i))).try_cast("bigint")
    rows = lines.filter(F.size(parts) == 3).select(
        "path", "hash", F.get(parts, F.lit(2)).alias("file"), number(0).alias("added"), number(1).alias("deleted")
    )
    return rows.filter(F.col("added").isNotNull() & F.col("deleted").isNotNull())


def log_statuses(records: DataFrame) -> DataFrame:
    """(path, hash, status, file) of 'status<TAB>file' lines."""
    owner = F.get(F.reverse("headers"), F.lit(0))["hash"]
    lines = records.select("path", owner.alias("hash"), F.explode("body").alias("line"))
    parts = F.split("line", "\t", 2)
    return lines.filter(F.size(parts) == 2).select("path", "hash", F.get(parts, F.lit(0)).alias("status"), F.get(parts, F.lit(1)).alias("file"))


# --- revision series ---------------------------------------------------------

SERIES_SCHEMA = (
    "repo string, revisions array<struct<revision_number:int,commit_hash:string,hash:string,commit_date:string,date:string,"
    "commit_author:string,author:string,commit_message:string,message:string,metrics:map<string,string>>>"
)


def series_revisions(docs: DataFrame) -> DataFrame:
    """(repo, rev, commit_hash, commit_date, commit_ts, author, message, metrics) of revision series, newest first."""
    rows = docs.select(F.from_json("text", SERIES_SCHEMA).alias("s")).select("s.repo", F.posexplode("s.revisions").alias("pos", "r"))
    date = F.coalesce(F.nullif(F.col("r.commit_date"), F.lit("")), F.col("r.date"))
    return rows.select(
        "repo", F.coalesce("r.revision_number", F.col("pos") + 1).alias("rev"),
        F.coalesce("r.commit_hash", "r.hash").alias("commit_hash"), date.alias("commit_date"), commit_timestamp(date).alias("commit_ts"),
        F.coalesce("r.commit_author", "r.author").alias("author"), F.coalesce("r.commit_message", "r.message").alias("message"),
        F.col("r.metrics").alias("metrics"),
    )


def metric_value(metrics: Column, name: str) -> Column:
    """Value of a metric by its name, also written with underscores or without the hyphen."""
    spelled = dict.fromkeys((name, name.replace("-", "_"), name.replace("-", "")))
    return F.coalesce(*[parse_percent(F.try_element_at(metrics, F.lit(s))) for s in spelled])


def series_metrics(revisions: DataFrame) -> DataFrame:
    """Long (repo, rev, metric, value); unreadable and infinite values are NULL."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), metric_value(F.col("metrics"), m).alias("value")) for m in METRICS])
    return revisions.select("repo", "rev", F.explode(items).alias("x")).select("repo", "rev", "x.metric", "x.value")
