"""Keys read from file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.classify import repo_from_path


def revision_of_path(path: Column) -> Column:
    """Number before the first '_' of the folder that starts with two digits, NULL without one."""
    return F.regexp_extract(path, r"/([0-9]{2,})_[^/]*(?:/|$)", 1).try_cast("int")


def keyed(df: DataFrame, path: str = "path", root: str = "REPOS_ANALYZED") -> DataFrame:
    """Adds repo and rev taken from a path column."""
    return df.withColumn("repo", repo_from_path(F.col(path), root)).withColumn("rev", revision_of_path(F.col(path)))


def read_documents(spark: SparkSession, path: str, glob: str | None = None, whole: bool = True, recursive: bool = True) -> DataFrame:
    """(path, text): one row per file, or per line for line-delimited documents."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def revisions_on_disk(files: DataFrame, path: str = "path") -> DataFrame:
    """Distinct (repo, rev) that have any file."""
    return keyed(files, path).filter(F.col("rev").isNotNull()).select("repo", "rev").distinct()
