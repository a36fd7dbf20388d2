"""Prefix tries of conversations: their nodes, subtree totals by depth bands, and digests of where conversations end.

A node is the sequence of the first turns that its members share. It is named by its depth and two 64-bit keys, the running
exclusive or of hashes of (depth, role, text), so a conversation of any length gets its prefixes from slices of its rows and texts are read
once, where they are hashed. Different sequences of one depth share both keys with a probability of about 2**-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import dropped, pick, written

#: Stands for a null conversation id, which counts as the largest.
NO_ID = 2**63 - 1
#: Depths of one band, and ids of one piece of a digest's text; both only divide the work.
HEIGHT, PIECE_IDS = 16, 1024
NODE = ["depth", "k1", "k2"]


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, slice, pos, h1, h2, chars): turns numbered from 1 in every conversation, texts replaced by hashes and code points.

    Turns are ordered by ``turn``, null first, ties by a hash of role and text (rows that repeat stay separate turns). A null role or text is
    empty, a null ``conv_id`` one conversation. Rows are range-partitioned along the conversations, so one of any size spreads over slices.
    """
    rows = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    who, said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("uid")]
    placed = written(
        rows.select(
            F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("conv"), F.col("turn"),
            F.xxhash64(F.lit(1), F.char_length(who), who, said).alias("h1"), F.xxhash64(said, F.lit(2), who, F.char_length(said)).alias("h2"),
            F.char_length(said).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("uid"),
        ).repartitionByRange(F.col("conv"), *order).withColumn("slice", F.spark_partition_id()), "turns",
    )
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("slice", "conv").agg(F.count(F.lit(1)).alias("n"))
    shifts = counts.select("slice", "conv", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    local = F.row_number().over(Window.partitionBy("slice", "conv").orderBy(*order))
    turns = placed.withColumn("at", local).join(shifts, ["slice", "conv"])
    out = written(turns.select("conv", "slice", (F.col("at") + F.col("shift")).alias("pos"), "h1", "h2", "chars"), "turns")
    dropped(placed)
    return out


def spliced(turns: DataFrame, base: Column, take: Column, most: int) -> DataFrame:
    """(conv, slice, depth, h1, h2, chars, length): every conversation with its first ``take`` (at most ``most``) turns replaced by those of ``base``.

    ``base`` and ``take`` are expressions of ``conv``; all turns of a shorter base, none of an absent one. The conversation's own turns after its
    first ``take`` follow. A conversation left without a turn is one row of depth 0, which others do not have.
    """
    counts = turns.groupBy("conv", "slice").agg(F.count(F.lit(1)).alias("n"))
    heads = turns.filter(F.col("pos") <= most).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "chars"))).alias("head")
    )
    own = counts.groupBy("conv").agg(F.sum("n").alias("n")).select("conv", "n", base.alias("base"), take.cast("bigint").alias("take"))
    known = own.join(heads, "base", "left").withColumn("head", F.when(F.col("take") > 0, F.slice("head", 1, F.col("take").cast("int"))))
    known = known.withColumn("head", F.coalesce("head", F.array().cast(dict(heads.dtypes)["head"])))
    length = F.size("head") + F.greatest(F.col("n") - F.col("take"), F.lit(0))
    lines = written(known.select("conv", "take", "head", length.cast("bigint").alias("length")), "lines")
    first = lines.select("conv", F.lit(-1).alias("slice"), F.explode("head").alias("t"), "length").select(
        "conv", "slice", F.col("t.pos").alias("depth"), "t.h1", "t.h2", "t.chars", "length"
    )
    # one row per slice, so that the turns of a long conversation meet their line slice by slice
    placed = counts.drop("n").join(lines.select("conv", "take", F.size("head").alias("kept"), "length"), "conv")
    rest = turns.join(placed, ["conv", "slice"]).filter(F.col("pos") > F.col("take")).select(
        "conv", "slice", (F.col("pos") - F.col("take") + F.col("kept")).alias("depth"), "h1", "h2", "chars", "length"
    )
    nothing = F.lit(0).cast("bigint")
    empty = lines.filter("length = 0").select("conv", F.lit(-1).alias("slice"), nothing.alias("depth"), nothing.alias("h1"), nothing.alias("h2"), nothing.alias("chars"), "length")
    return first.unionByName(rest).unionByName(empty)


def members_of(turns: DataFrame) -> DataFrame:
    """(depth, k1, k2, p1, p2, conv, chars, ends): one row per conversation and prefix, the empty one included; p1, p2 name the parent."""
    real = turns.filter("depth > 0")
    marked = real.withColumns({f"m{i}": F.xxhash64("depth", "h1", "h2", F.lit(i)) for i in (1, 2)})
    local = Window.partitionBy("slice", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("slice", "conv").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    shifts = sums.select("slice", "conv", *[F.coalesce(F.bit_xor(f"m{i}").over(earlier), F.lit(0).cast("bigint")).alias(f"s{i}") for i in (1, 2)])
    keyed = marked.withColumns({f"x{i}": F.bit_xor(f"m{i}").over(local) for i in (1, 2)}).join(shifts, ["slice", "conv"])
    key = lambda i: F.col(f"x{i}").bitwiseXOR(F.col(f"s{i}"))
    prefixes = keyed.select(
        "depth", key(1).alias("k1"), key(2).alias("k2"), key(1).bitwiseXOR(F.col("m1")).alias("p1"), key(2).bitwiseXOR(F.col("m2")).alias("p2"),
        "conv", "chars", (F.col("depth") == F.col("length")).alias("ends"),
    )
    nothing = F.lit(0).cast("bigint")
    tops = turns.filter("depth <= 1").select(
        nothing.alias("depth"), nothing.alias("k1"), nothing.alias("k2"), F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"),
        "conv", nothing.alias("chars"), (F.col("length") == 0).alias("ends"),
    )
    return written(prefixes.unionByName(tops), "prefixes")


def nodes_of(members: DataFrame) -> DataFrame:
    """(depth, k1, k2, p1, p2, conv, chars, n_convs, n_children) of every distinct prefix; ``conv`` is its smallest member."""
    nodes = members.groupBy(*NODE).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv").alias("conv"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n_convs")
    )
    nodes = written(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    out = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "nodes")
    dropped(nodes)
    return out


def subtree_totals(nodes: DataFrame, members: DataFrame, values: dict[str, Column], height: int = HEIGHT) -> DataFrame:
    """(depth, k1, k2, values…): every value summed over the subtrees, tops included.

    Depths are cut into bands of ``height``. A node adds its values to its ancestors in its own band only, at most ``height`` rows; their
    sums at the top of a band stand for that piece of the tree. The tops form a trie ``height`` times lower, which is summed in the same way,
    band by band; then every completed top passes its total on to the nodes of the band above it. So a trie of depth d takes
    about 2 * log(d, height) rounds, and no row is spread over more than ``height`` others. Hot ancestors receive sums made before the shuffle.
    """
    if height < 2:
        raise ValueError("a band needs a height of at least 2")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    names = list(values)
    added = [F.sum(n).alias(n) for n in names]

    def lines(stride: int) -> DataFrame:
        """Per conversation and band the prefixes at multiples of ``stride``, at most ``height``."""
        band = F.floor(F.col("depth") / (stride * height)).alias("band")
        return members.filter(F.col("depth") % stride == 0).groupBy("conv", band).agg(F.collect_list(F.struct(*NODE)).alias("line"))

    def passed(rows: DataFrame, band: Column, stride: int, wanted) -> DataFrame:
        """The rows spread over those nodes of a band of their conversation that ``wanted`` names."""
        spread = rows.withColumn("band", band).join(lines(stride), ["conv", "band"])
        ups = F.explode(F.filter("line", lambda x: wanted(x, F.col("depth")))).alias("up")
        return spread.select(ups, "conv", *names).select("up.*", "conv", *names)

    # the smallest member of a node is among its own rows, and no descendant has a smaller one
    summed = lambda rows: rows.groupBy(*NODE).agg(F.min("conv").alias("conv"), *added)
    current = nodes.select(*NODE, "conv", *[v.cast("bigint").alias(n) for n, v in values.items()])
    partial, stride = [], 1
    while True:
        own = F.floor(F.col("depth") / (stride * height))
        partial.append(written(summed(passed(current, own, stride, lambda x, depth: x["depth"] <= depth)), "bands"))
        stride *= height
        if stride > deepest:
            break
        current = partial[-1].filter(F.col("depth") % stride == 0)
    done = partial.pop()
    while partial:
        stride //= height
        above = F.floor(F.col("depth") / stride) - 1
        low = stride // height
        exits = passed(done.filter("depth > 0"), above, low, lambda x, depth: x["depth"] % stride != 0)
        inner = partial[-1].filter(F.col("depth") % stride != 0)
        after = written(summed(inner.unionByName(exits)).unionByName(done), "totals")
        dropped(done, partial.pop())
        done = after
    return done.drop("conv")


def end_digests(members: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """(depth, k1, k2, ends_sha256): digest of the ids of the conversations that end at a node, ascending, comma-joined (``null`` for the null id).

    Ids are range-partitioned and joined into texts of at most ``piece_ids`` ids; a task reads the texts of a node in order and
    feeds one running digest, so a node of any number of ends needs one text in memory.
    """
    ends = members.filter("ends").select(*NODE, "conv").repartitionByRange(*NODE, "conv").withColumn("slice", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("slice", *NODE).orderBy("conv"))
    decimal = lambda c: F.when(c == NO_ID, "null").otherwise(c.cast("string"))
    pieces = written(
        ends.withColumn("piece", F.floor((nth - 1) / piece_ids)).groupBy(*NODE, "slice", "piece")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), decimal), ",").alias("ids")), "ends",
    )

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, running = None, None
        for batch in batches:
            out = []
            for *key, ids in batch.itertuples(index=False, name=None):
                if key != node:
                    if node is not None:
                        out.append((*node, running.hexdigest()))
                    node, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, running.hexdigest())], columns=[*NODE, "ends_sha256"])

    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "slice", "piece").select(*NODE, "ids")
    return ordered.mapInPandas(digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of ``turns`` (see ``spliced``): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conv_id`` is the smallest member (null only if the null id is the only one), ``n_leaves`` the childless nodes of the subtree, ``saved_tokens``
    the code points that members beyond the first repeat in it. An empty table has no node.
    """
    members = members_of(turns)
    nodes = nodes_of(members)
    totals = subtree_totals(nodes, members, {
        "n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars"),
    }, height)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(above, ["depth", "p1", "p2"], "left").join(totals, NODE).join(end_digests(members), NODE, "left")
        .select(
            shown("conv").alias("conv_id"), "depth", shown("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )
