"""Building blocks shared by the operators: top rows, running totals, ranks, exact quantiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.session import cut_lineage

PAIR = ["repo", "new_rev", "old_rev"]


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int | None, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group, all if None (one window task per group; ``numbered`` takes groups of any size).

    Spark prunes to ``n`` rows per group and task before the shuffle, so a hot group costs n rows per task.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return ranked if n is None else ranked.filter(F.col(rank) <= n)


def running(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, over: Callable[[str], Column] = F.sum,
    plus: Callable[[Column, Column], Column] = lambda a, b: a + b,
) -> DataFrame:
    """Inclusive running aggregate (``over``, joined by ``plus``, 0 being neutral) of a whole-number ``value`` along ``order`` in every group.

    Rows are range-partitioned on (keys, order), so a group larger than a task spreads over many slices: each
    slice is folded locally and joined with the result of the slices before it. ``order`` has to be unique in a group.
    """
    placed = cut_lineage(
        df.withColumn("_value", value.cast("bigint"))
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    slice_keys = ["_slice", *keys]
    totals = placed.groupBy(*slice_keys).agg(over("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*slice_keys, F.coalesce(over("_sum").over(earlier), F.lit(0).cast("bigint")).alias("_shift"))
    local = Window.partitionBy(*slice_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_local", over("_value").over(local)).join(shifts, slice_keys)
    return summed.withColumn(out, plus(F.col("_local"), F.col("_shift"))).drop("_slice", "_value", "_local", "_shift")


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Inclusive running sum of a whole-number ``value`` along a unique ``order`` in every group, for groups of any size."""
    return running(df, keys, order, value, out)


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """1, 2, 3 … along a unique ``order`` in every group, for groups of any size."""
    return running_total(df, keys, order, F.lit(1), out)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated exact quantiles per group, over counted distinct values and their running totals."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counted, keys, [F.col(value)], F.col("_n"), "_upto")
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = placed.join(sizes, keys)
    picks, results = [], []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        for side, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            covers = (F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto"))
            picks.append(F.max(F.when(covers, F.col(value))).alias(f"_{name}_{side}"))
        share = pos - F.floor(pos)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((low + (high - low) * share).alias(name))
    return joined.groupBy(*keys, "_total").agg(*picks).select(*keys, *results)


def adjacent_pairs(revisions: DataFrame) -> DataFrame:
    """(repo, new_rev, old_rev) of neighbouring revisions; revision 1 is the newest.

    The window runs over distinct revision numbers only, never over file or commit rows.
    """
    order = Window.partitionBy("repo").orderBy("rev")
    listed = revisions.select("repo", "rev").distinct()
    return listed.select("repo", F.col("rev").alias("new_rev"), F.lead("rev").over(order).alias("old_rev")).filter(
        F.col("old_rev").isNotNull()
    )


def by_pair(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every row twice at most: with its revision as the new and as the old side of a pair (column ``side``)."""
    sides = pairs.select("*", F.explode(F.array(
        F.struct(F.lit("new").alias("side"), F.col("new_rev").alias("rev")),
        F.struct(F.lit("old").alias("side"), F.col("old_rev").alias("rev")),
    )).alias("s")).select(*PAIR, "s.side", "s.rev")
    return rows.join(sides, ["repo", "rev"]).drop("rev")


def when_side(side: str, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def pair_column(df: DataFrame, name: str, value: Column, default=0) -> list[Column]:
    """Aggregates ``name_new`` and ``name_old`` of a summed value."""
    return [F.coalesce(F.sum(when_side(s, value)), F.lit(default)).alias(f"{name}_{s}") for s in ("new", "old")]


def listed(order: list[str], text: str, separator: str = ", ") -> Column:
    """Aggregate: the texts of a bounded group joined in the order of other columns."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(items, lambda s: s["_text"]), separator)
