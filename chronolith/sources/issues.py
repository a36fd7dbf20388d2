"""Issue maps and issue dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.classify import label_type, tracker_type


def issue_maps(docs: DataFrame) -> DataFrame:
    """(repo, key, type, summary) of JSON maps in either shape.

    An 'issues' object wins; without it every text value under a key with a hyphen counts.
    """
    doc = F.try_parse_json("text")
    parsed = docs.select(
        "repo", F.try_variant_get(doc, "$.issues", "map<string,string>").alias("issues"),
        F.try_variant_get(doc, "$.summaries", "map<string,string>").alias("summaries"),
        F.try_variant_get(doc, "$", "map<string,variant>").alias("flat"),
    )
    texts = F.filter(
        F.map_entries("flat"), lambda e: F.contains(e["key"], F.lit("-")) & (F.schema_of_variant(e["value"]) == "STRING")
    )
    flat = F.transform(texts, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))
    entries = F.coalesce(F.map_entries("issues"), flat)
    rows = parsed.select("repo", F.explode(entries).alias("e"), "summaries")
    titled = F.try_element_at("summaries", F.col("e.key"))
    return rows.select("repo", F.col("e.key").alias("key"), F.col("e.value").alias("type"), titled.alias("summary"))


HOSTED_SCHEMA = "number bigint, title string, labels array<struct<name:string>>, pull_request string"


def hosted_issues(docs: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(repo, key 'GH#n', type, summary) of code-host issues; pull requests are skipped.

    The first label in order that is known decides; unlabelled issues keep their title.
    """
    rows = docs.select("repo", F.from_json("text", HOSTED_SCHEMA).alias("i")).select("repo", "i.*")
    rows = rows.filter(F.col("pull_request").isNull() & F.col("number").isNotNull())
    types = F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: label_type(x["name"], overrides))
    return rows.select(
        "repo", F.concat(F.lit("GH#"), "number").alias("key"),
        F.get(F.filter(types, lambda t: t.isNotNull()), F.lit(0)).alias("type"),
        F.nullif(F.trim("title"), F.lit("")).alias("summary"),
    ).filter(F.col("type").isNotNull() | F.col("summary").isNotNull())


TRACKER_SCHEMA = "issues array<struct<key:string,fields:struct<issuetype:struct<name:string>,summary:string>>>"


def tracker_issues(docs: DataFrame) -> DataFrame:
    """(repo, key, type, summary) of tracker pages; a summary is kept even without a known type."""
    rows = docs.select("repo", F.from_json("text", TRACKER_SCHEMA).alias("p")).select("repo", F.explode("p.issues").alias("i"))
    return rows.select(
        "repo", F.col("i.key").alias("key"), tracker_type(F.col("i.fields.issuetype.name")).alias("type"),
        F.nullif(F.trim("i.fields.summary"), F.lit("")).alias("summary"),
    ).filter((F.col("key") != "") & (F.col("type").isNotNull() | F.col("summary").isNotNull()))


def merged_issues(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sources; for a shared key the second one's type and summary win where it has them."""
    cols = ["repo", "key", "type", "summary"]
    both = first.select(*cols, F.lit(1).alias("_p")).unionByName(second.select(*cols, F.lit(2).alias("_p")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c)
    return both.groupBy("repo", "key").agg(latest("type"), latest("summary"))
