"""Modularity scores of layered clusterings.

locations(repo, rev, file, layer_no, module_no) is the numbered clustering; edges(repo, rev, src, dest, weight)
the dependency graph. Only edges are walked, never pairs of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.classify import size_calibration
from chronolith.operators.common import top_rows
from chronolith.session import cut_lineage

GRAPH = ["repo", "rev"]
MODULE = [*GRAPH, "layer_no", "module_no"]

SIZE_LIMIT = 5  # modules above this size are penalised


def _key(layer: Column, module: Column) -> Column:
    return F.concat(layer.cast("string"), F.lit(","), module.cast("string"))


def layer_extents(locations: DataFrame) -> DataFrame:
    """Files per layer, in the layers below it and in the layers above it."""
    sizes = locations.groupBy(*GRAPH, "layer_no").agg(F.count(F.lit(1)).alias("files"))
    # one row per layer: the window holds a handful of rows per revision
    order = Window.partitionBy(*GRAPH).orderBy("layer_no")
    whole = Window.partitionBy(*GRAPH)
    upto = F.sum("files").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select(
        *GRAPH, "layer_no", "files", (F.sum("files").over(whole) - upto).alias("lower_files"),
        (upto - F.col("files")).alias("upper_files"), F.sum("files").over(whole).alias("total_files"),
    )


def module_edges(locations: DataFrame, edges: DataFrame) -> DataFrame:
    """Per module: edges inside it and conforming edges into it.

    An edge between modules conforms if the target's key text sorts before the source's key text.
    """
    at = lambda end: locations.select(
        *GRAPH, F.col("file").alias(end), F.col("layer_no").alias(f"l_{end}"), F.col("module_no").alias(f"m_{end}")
    )
    linked = edges.filter(F.col("weight") > 0).select(*GRAPH, "src", "dest").distinct()
    placed = linked.join(at("src"), [*GRAPH, "src"]).join(at("dest"), [*GRAPH, "dest"])
    src, dest = _key(F.col("l_src"), F.col("m_src")), _key(F.col("l_dest"), F.col("m_dest"))
    return placed.groupBy(*GRAPH, F.col("l_dest").alias("layer_no"), F.col("m_dest").alias("module_no")).agg(
        F.count_if(src == dest).alias("internal_edges"), F.count_if(dest < src).alias("conforming_deps")
    )


def module_scores(locations: DataFrame, edges: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Size factor, penalties and contribution of every module.

    ``subset`` (repo, rev, file) restricts files; layer and module numbers stay those of the whole clustering.
    """
    if subset is not None:
        locations = locations.join(subset.select(*GRAPH, "file").distinct(), [*GRAPH, "file"], "left_semi")
    sizes = locations.groupBy(*MODULE).agg(F.count(F.lit(1)).alias("module_size"))
    extents = layer_extents(locations).select(*GRAPH, "layer_no", "lower_files", "total_files")
    rows = sizes.join(extents, [*GRAPH, "layer_no"]).join(module_edges(locations, edges), MODULE, "left").fillna(0)
    n = F.col("module_size").cast("double")
    large = F.col("module_size") > SIZE_LIMIT
    rows = rows.withColumn("size_factor", n / F.col("total_files"))
    rows = rows.withColumn("size_penalty", F.when(large, F.log(F.lit(float(SIZE_LIMIT))) / F.log(n)).otherwise(1.0))
    rows = rows.withColumn(
        "cross_penalty",
        F.when(F.col("lower_files") == 0, 0.0).otherwise(
            F.col("conforming_deps") / F.nullif(F.col("lower_files") * n, F.lit(0.0))
        ),
    )
    rows = rows.withColumn(
        "internal_penalty", F.when(large, F.col("internal_edges") / (n * (n - 1))).otherwise(0.0)
    )
    rows = rows.withColumn("clddf", 1 - F.col("cross_penalty")).withColumn("imcf", 1 - F.col("internal_penalty"))
    return rows.withColumn(
        "contribution", F.col("size_factor") * F.col("size_penalty") * F.col("clddf") * F.col("imcf")
    ).withColumn("module_key", _key(F.col("layer_no"), F.col("module_no"))).drop("lower_files", "total_files")


def mscore(scores: DataFrame) -> DataFrame:
    """Score, percentage and component averages of every revision."""
    return scores.groupBy(*GRAPH).agg(
        F.sum("contribution").alias("mscore"), (F.sum("contribution") * 100).alias("mscore_percentage"),
        F.sum("module_size").cast("bigint").alias("total_files"), F.count_distinct("layer_no").alias("num_layers"),
        F.count(F.lit(1)).alias("num_modules"), F.sum("size_factor").alias("size_factor_total"),
        F.avg("clddf").alias("avg_clddf"), F.avg("imcf").alias("avg_imcf"),
    )


def sample_files(locations: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files of every module in clustering order, as an array; a pruned top-n, not a whole module."""
    order = "ord" if "ord" in locations.columns else "file"
    first = top_rows(locations, MODULE, [F.col(order), F.col("file")], n)
    items = F.array_sort(F.collect_list(F.struct("rank", "file")))
    return first.groupBy(*MODULE).agg(F.transform(items, lambda s: s["file"]).alias("files"))


def independence_level(layer_files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of all files that sit in the layer with the highest number; files per layer are distinct."""
    total = nodes.select(*GRAPH, "node").distinct().groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("n"))
    sizes = layer_files.select(*GRAPH, "layer_no", "file").distinct().groupBy(*GRAPH, "layer_no").agg(F.count(F.lit(1)).alias("files"))
    last = sizes.groupBy(*GRAPH).agg(F.max_by("files", "layer_no").alias("files"))
    return total.join(last, GRAPH, "left").select(
        *GRAPH, (F.coalesce("files", F.lit(0)) / F.col("n")).alias("independence_level")
    )


# --- approximate score over named groups -----------------------------------------


def layer_of_name(name: Column) -> Column:
    """Number of the last 'L<digits>' part of a group name."""
    parts = F.filter(F.split(name, "/"), lambda p: p.rlike("^L[0-9]+$"))
    return F.substring(F.try_element_at(parts, F.lit(-1)), 2, 9).try_cast("int")


def named_layers(groups: DataFrame) -> DataFrame:
    """Distinct (repo, rev, layer_no, file) of groups(repo, rev, name, file)."""
    return groups.select(*GRAPH, layer_of_name(F.col("name")).alias("layer_no"), "file").filter(
        F.col("layer_no").isNotNull()
    ).distinct()


def leaf_modules(groups: DataFrame) -> DataFrame:
    """Groups named as modules that are no prefix path of another module."""
    named = groups.withColumn("layer_no", layer_of_name(F.col("name"))).filter(
        F.col("layer_no").isNotNull() & F.exists(F.split("name", "/"), lambda p: F.startswith(p, F.lit("M")))
    )
    parts = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    parents = named.select(*GRAPH, "name").distinct().filter(F.size(parts) > 1).select(
        *GRAPH, F.explode(above).alias("name")
    ).distinct()
    return named.join(parents, [*GRAPH, "name"], "left_anti")


def approximate_modules(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per leaf module: size factor with penalty, cross-layer and inner factors and score.

    A file listed in several layers counts once for each; layer numbers from the number of layers on are not
    looked at as lower layers.
    """
    known = nodes.select(*GRAPH, F.col("node").alias("file")).distinct()
    n_nodes = known.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("num_files"))
    # layers and modules are read two to three times, so written once
    all_layers = cut_lineage(named_layers(groups))
    depth = all_layers.groupBy(*GRAPH).agg(F.count_distinct("layer_no").alias("depth"))
    layers = cut_lineage(all_layers.join(known, [*GRAPH, "file"], "left_semi"))
    mods = cut_lineage(leaf_modules(groups).join(known, [*GRAPH, "file"], "left_semi").select(*GRAPH, "layer_no", "name", "file"))
    module = [*GRAPH, "layer_no", "name"]
    sizes = mods.groupBy(*module).agg(F.count(F.lit(1)).alias("n"))
    # one row per (module layer, deeper layer): bounded by the squared number of layers of one revision
    per_layer = layers.groupBy(*GRAPH, "layer_no").agg(F.count(F.lit(1)).alias("files")).join(depth, GRAPH)
    order = Window.partitionBy(*GRAPH).orderBy(F.col("layer_no").desc())
    counted = F.when(F.col("layer_no") < F.col("depth"), F.col("files")).otherwise(0)
    below = per_layer.select(
        *GRAPH, "layer_no", "depth",
        (F.sum(counted).over(order.rowsBetween(Window.unboundedPreceding, 0)) - counted).alias("lower"),
    )
    linked = edges.select(*GRAPH, "src", "dest").distinct()
    from_module = cut_lineage(linked.join(mods.withColumnRenamed("file", "src"), [*GRAPH, "src"]))
    target = layers.select(*GRAPH, F.col("file").alias("dest"), F.col("layer_no").alias("to")).join(depth, GRAPH)
    down = from_module.join(target, [*GRAPH, "dest"]).filter(
        (F.col("to") > F.col("layer_no")) & (F.col("to") < F.col("depth"))
    ).groupBy(*module).agg(F.count(F.lit(1)).alias("lower_deps"))
    inside = from_module.filter(F.col("src") != F.col("dest")).join(
        mods.withColumnRenamed("file", "dest"), [*module, "dest"]
    ).groupBy(*module).agg(F.count(F.lit(1)).alias("internal_deps"))
    rows = (
        sizes.join(n_nodes, GRAPH).join(below, [*GRAPH, "layer_no"], "left")
        .join(down, module, "left").join(inside, module, "left").fillna(0)
    )
    n = F.col("n").cast("double")
    large = F.col("n") >= SIZE_LIMIT
    sp = F.when(large, F.log(F.lit(float(SIZE_LIMIT))) / F.log(n)).otherwise(1.0)
    cross = F.when(
        (F.col("layer_no") < F.col("depth") - 1) & (F.col("lower") > 0),
        F.col("lower_deps") / F.nullif(n * F.col("lower"), F.lit(0.0)),
    ).otherwise(0.0)
    inner = F.when(large, F.col("internal_deps") / F.nullif(n * (n - 1), F.lit(0.0))).otherwise(0.0)
    rows = rows.select(
        *module, F.col("n").alias("module_files"), "num_files", (n / F.col("num_files") * sp).alias("sf"), sp.alias("sp"),
        cross.alias("clddp"), inner.alias("imcp"),
    )
    return rows.withColumn("clddf", 1 - F.col("clddp")).withColumn("imcf", 1 - F.col("imcp")).withColumn(
        "score", F.col("sf") * F.col("clddf") * F.col("imcf")
    )


def approximate_mscore(modules: DataFrame) -> DataFrame:
    sums = modules.groupBy(*GRAPH, "num_files").agg(
        F.sum("score").alias("mscore_raw"), F.sum("sf").alias("total_sf"), F.avg("clddf").alias("avg_clddf"),
        F.avg("imcf").alias("avg_imcf"), F.count(F.lit(1)).alias("module_count"),
    )
    return sums.withColumn("mscore", F.col("mscore_raw") * size_calibration(F.col("num_files")) * 100)


def compare_reported(calculated: DataFrame, reported: DataFrame) -> DataFrame:
    """Absolute differences in percentage points; the calculated m-score is a percentage already."""
    joined = calculated.join(reported, GRAPH)
    gap = lambda a, b: F.abs(a - F.col(b))
    return joined.select(
        *GRAPH, gap(F.col("pc") * 100, "propagation_cost").alias("pc_gap"),
        gap(F.col("il") * 100, "independence_level").alias("il_gap"), gap(F.col("mscore"), "m_score").alias("mscore_gap"),
    )


def revision_metrics(exact: DataFrame, pc: DataFrame, il: DataFrame, balance: DataFrame, reported: DataFrame) -> DataFrame:
    """All calculated metrics of a revision; the series value is the exact score, the reported one if that is 0 or missing.

    Every part has one row per revision and is written by its own job, so the driver never holds the plans and broadcasts of all at once.
    """
    out = cut_lineage(exact.select(*GRAPH, "mscore_percentage", "size_factor_total", "avg_clddf", "avg_imcf", "num_modules"))
    for part in map(cut_lineage, (pc, il, balance, reported)):
        out = out.join(part, GRAPH, "full")
    used = F.when(F.coalesce("mscore_percentage", F.lit(0.0)) != 0, F.col("mscore_percentage")).otherwise(F.col("m_score"))
    return out.withColumn("series_mscore", used)
