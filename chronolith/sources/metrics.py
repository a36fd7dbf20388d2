"""Metric files and tool logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.classify import metric_alias
from chronolith.functions.text import parse_int, parse_percent

METRIC_SCHEMA = (
    "mScore string, propagationCost string, decouplingLevel string, independenceLevel string, numberOfIsolatedItems string,"
    "numberOfItems string, totalItems string, itemCount string, propagationCostExcludeIsolatedItems string"
)


def _propagation_cost() -> Column:
    """The reported cost; without one 0 for no isolated or no items at all, else the cost without isolated items."""
    isolated = parse_int(F.col("numberOfIsolatedItems"))
    total = parse_int(F.coalesce("numberOfItems", "totalItems", "itemCount"))
    empty = F.coalesce(isolated == 0, F.lit(False)) | F.coalesce(total == 0, F.lit(False))
    return F.coalesce(
        parse_percent(F.col("propagationCost")),
        F.when(empty, F.lit(0.0)).otherwise(parse_percent(F.col("propagationCostExcludeIsolatedItems"))),
    )


def metric_files(docs: DataFrame, keys: list[str] = ("repo", "rev")) -> DataFrame:
    """Wide (keys, four metrics) from metric documents: one document may hold one metric or several."""
    parsed = docs.select(*keys, F.from_json("text", METRIC_SCHEMA).alias("m")).select(*keys, "m.*")
    has_pc = F.coalesce(
        "propagationCost", "numberOfIsolatedItems", "numberOfItems", "totalItems", "itemCount", "propagationCostExcludeIsolatedItems"
    ).isNotNull()
    values = {
        "m-score": parse_percent(F.col("mScore")), "propagation-cost": F.when(has_pc, _propagation_cost()),
        "decoupling-level": parse_percent(F.col("decouplingLevel")), "independence-level": parse_percent(F.col("independenceLevel")),
    }
    return parsed.select(*keys, *[v.alias(k) for k, v in values.items()]).groupBy(*keys).agg(
        *[F.max(F.col(f"`{k}`")).alias(k) for k in values]
    )


def metric_lookup(requests: DataFrame, metrics: DataFrame) -> DataFrame:
    """(q_id, repo, rev, metric, value) for requests(q_id, repo, query) by alias; an unknown name gives all metrics.

    ``metrics`` is long (repo, rev, metric, value).
    """
    asked = requests.withColumn("wanted", metric_alias(F.col("query")))
    columns = ["q_id", "repo", "rev", "metric", "value"]
    named = asked.filter(F.col("wanted").isNotNull()).withColumnRenamed("wanted", "metric").join(metrics, ["repo", "metric"])
    every = asked.filter(F.col("wanted").isNull()).join(metrics, "repo")
    return named.select(*columns).unionByName(every.select(*columns))


TOOL_SCHEMA = "array<struct<step:string,cmd:string,rc:int,stdout:string,stderr:string>>"


def tool_steps(docs: DataFrame, keys: list[str] = ("repo", "rev")) -> DataFrame:
    """(keys, ord, step, cmd, rc, stderr) of tool logs, one JSON array per document."""
    rows = docs.select(*keys, F.posexplode(F.from_json("text", TOOL_SCHEMA)).alias("ord", "s"))
    return rows.select(*keys, "ord", "s.step", "s.cmd", "s.rc", "s.stderr")
