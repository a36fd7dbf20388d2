"""Layered clusterings of revisions: sizes, neighbouring differences, module balance.

Table: locations(repo, rev, file, layer, layer_no, module_no, module_path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.common import PAIR, by_pair, top_rows, when_side

GRAPH = ["repo", "rev"]


def layer_sizes(locations: DataFrame) -> DataFrame:
    return locations.groupBy(*GRAPH, "layer").agg(F.count(F.lit(1)).alias("files"))


def largest_modules(locations: DataFrame, n: int = 10) -> DataFrame:
    sizes = locations.groupBy(*GRAPH, "module_path").agg(F.count(F.lit(1)).alias("files"))
    return top_rows(sizes, GRAPH, [F.col("files").desc(), F.col("module_path")], n)


def layer_module_counts(locations: DataFrame) -> DataFrame:
    """Modules per layer."""
    modules = locations.select(*GRAPH, "layer_no", "module_no").distinct()
    return modules.groupBy(*GRAPH, "layer_no").agg(F.count(F.lit(1)).alias("modules"))


def module_balance(locations: DataFrame) -> DataFrame:
    """1 / (1 + population variance of module sizes), and the number of modules."""
    sizes = locations.groupBy(*GRAPH, "layer_no", "module_no").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*GRAPH).agg(
        (1.0 / (1.0 + F.var_pop("n"))).alias("approx_balance"), F.count(F.lit(1)).alias("module_count")
    )


def file_moves(locations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every file of a pair with its status: added, removed, moved_layer, moved_module or same."""
    sides = by_pair(locations.select(*GRAPH, "file", "layer", "module_path"), pairs)
    pick = [F.max(when_side(s, F.col(c))).alias(f"{s}_{o}") for s in ("old", "new") for c, o in (("layer", "layer"), ("module_path", "module"))]
    both = sides.groupBy(*PAIR, "file").agg(*pick)
    status = (
        F.when(F.col("old_layer").isNull(), "added")
        .when(F.col("new_layer").isNull(), "removed")
        .when(F.col("old_layer") != F.col("new_layer"), "moved_layer")
        .when(F.col("old_module") != F.col("new_module"), "moved_module")
        .otherwise("same")
    )
    return both.withColumn("status", status)


def move_counts(moves: DataFrame) -> DataFrame:
    names = {"added": "added_files", "removed": "removed_files", "moved_layer": "moved_layers", "moved_module": "moved_modules"}
    return moves.groupBy(*PAIR).agg(
        *[F.count_if(F.col("status") == s).alias(n) for s, n in names.items()],
        F.count("old_layer").alias("files_old"), F.count("new_layer").alias("files_new"),
    )


def move_samples(moves: DataFrame, n: int = 25) -> DataFrame:
    """The first ``n`` moved files of each kind, by name."""
    moved = moves.filter(F.col("status").isin("moved_layer", "moved_module"))
    return top_rows(moved, [*PAIR, "status"], [F.col("file")], n)


def file_sets(locations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sizes of new∖old, old∖new and old∩new per pair."""
    moves = file_moves(locations, pairs)
    return moves.groupBy(*PAIR).agg(
        F.count_if(F.col("status") == "added").alias("only_new"),
        F.count_if(F.col("status") == "removed").alias("only_old"),
        F.count_if(~F.col("status").isin("added", "removed")).alias("common"),
    )
