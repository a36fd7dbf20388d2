"""Dependency graphs of all revisions at once: summaries, neighbouring differences, reachability, cycles.

Tables: nodes(repo, rev, node) and edges(repo, rev, src, dest, kind, weight).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chronolith.operators.common import PAIR, by_pair, numbered, pair_column, top_rows, when_side
from chronolith.session import cut_and_count, cut_lineage, drop_scratch

GRAPH = ["repo", "rev"]
#: Numbered edges of one block of a graph, and sources whose reach is followed together; both bound the memory of a task.
BLOCK_EDGES, SLICE_SOURCES = 5_000_000, 4096
#: Bits of reach a task holds at once, and tasks at most that share the sources of one graph (each gets its links).
SLICE_BITS, SLICE_TASKS = 1 << 29, 8


# --- summaries ---------------------------------------------------------------


def edge_index(edges: DataFrame) -> DataFrame:
    """Summed weight per (src, dest, kind)."""
    return edges.groupBy(*GRAPH, "src", "dest", "kind").agg(F.sum("weight").alias("weight"))


def edge_summary(edges: DataFrame) -> DataFrame:
    """Total weight (kind NULL) and weight per kind of every revision."""
    sums = edges.groupBy(*GRAPH, "kind").agg(F.sum("weight").alias("w"))
    return sums.groupingSets([["repo", "rev"], ["repo", "rev", "kind"]], "repo", "rev", "kind").agg(
        F.round(F.sum("w"), 2).alias("weight")
    )


def fans(edges: DataFrame) -> DataFrame:
    """Weighted fan-in and fan-out per node that has an edge, in one shuffle."""
    ends = edges.select(*GRAPH, F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col("weight").alias("o")),
        F.struct(F.col("dest").alias("node"), F.col("weight").alias("i"), F.lit(0.0).alias("o")),
    )).alias("e"))
    return ends.groupBy(*GRAPH, F.col("e.node").alias("node")).agg(
        F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out")
    )


def hotspots(nodes: DataFrame, edges: DataFrame, top_n: int | None = 10) -> DataFrame:
    """Nodes by total weight, isolated nodes included with zeros; all of them if ``top_n`` is None."""
    rows = nodes.join(fans(edges), [*GRAPH, "node"], "left").fillna(0.0, ["fan_in", "fan_out"])
    rows = rows.select(
        *GRAPH, "node", F.round("fan_in", 2).alias("fan_in"), F.round("fan_out", 2).alias("fan_out"),
        F.round(F.col("fan_in") + F.col("fan_out"), 2).alias("total_weight"),
    )
    return rows if top_n is None else heaviest(rows, top_n)


def heaviest(hot: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` first of all hotspots of every revision."""
    return top_rows(hot, GRAPH, [F.col("total_weight").desc(), F.col("node")], top_n)


def node_counts(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Node counts of both sides of a pair and their difference."""
    counts = by_pair(nodes.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("n")), pairs)
    return counts.groupBy(*PAIR).agg(*pair_column(counts, "nodes", F.col("n"))).withColumn(
        "nodes_delta", F.col("nodes_new") - F.col("nodes_old")
    )


# --- neighbouring differences --------------------------------------------------


def edge_changes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges only one side of a pair has, as status 'added' or 'removed'.

    One aggregation over both sides replaces two anti joins.
    """
    both = by_pair(edge_index(edges), pairs).groupBy(*PAIR, "src", "dest", "kind").agg(
        F.max(when_side("new", F.col("weight"))).alias("new_w"), F.max(when_side("old", F.col("weight"))).alias("old_w")
    )
    status = F.when(F.col("old_w").isNull(), "added").when(F.col("new_w").isNull(), "removed")
    return both.withColumn("status", status).filter(F.col("status").isNotNull()).select(
        *PAIR, "status", "src", "dest", "kind", F.coalesce("new_w", "old_w").alias("weight")
    )


def top_edge_changes(edges: DataFrame, pairs: DataFrame, n: int = 25) -> DataFrame:
    order = [F.col("weight").desc(), F.col("src"), F.col("dest"), F.col("kind")]
    rows = top_rows(edge_changes(edges, pairs), [*PAIR, "status"], order, n)
    return rows.withColumn("weight", F.round("weight", 2))


def heaviest_changes(edges: DataFrame, pairs: DataFrame, added_from: float = 5, removed_from: float = 10) -> DataFrame:
    """The heaviest added and removed edge of a pair, if heavy enough."""
    rows = top_edge_changes(edges, pairs, 1).drop("rank")
    least = F.when(F.col("status") == "added", added_from).otherwise(removed_from)
    return rows.filter(F.col("weight") >= least)


def fan_changes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """New minus old fan-in and fan-out for every node either side has."""
    sides = by_pair(fans(edges), pairs)
    sums = [*pair_column(sides, "in", F.col("fan_in"), 0.0), *pair_column(sides, "out", F.col("fan_out"), 0.0)]
    return sides.groupBy(*PAIR, "node").agg(*sums).select(
        *PAIR, "node", (F.col("in_new") - F.col("in_old")).alias("fan_in_delta"),
        (F.col("out_new") - F.col("out_old")).alias("fan_out_delta"),
    )


def top_fan_changes(edges: DataFrame, pairs: DataFrame, n: int = 15) -> DataFrame:
    """Largest signed changes per direction.

    A direction covers only nodes that have an edge of that direction on some side.
    """
    ends = edges.select(*GRAPH, F.explode(F.array(
        F.struct(F.lit("fan_in").alias("direction"), F.col("dest").alias("node")),
        F.struct(F.lit("fan_out").alias("direction"), F.col("src").alias("node")),
    )).alias("e"), "weight")
    sums = ends.groupBy(*GRAPH, F.col("e.direction").alias("direction"), F.col("e.node").alias("node")).agg(
        F.sum("weight").alias("w")
    )
    sides = by_pair(sums, pairs)
    deltas = sides.groupBy(*PAIR, "direction", "node").agg(*pair_column(sides, "w", F.col("w"), 0.0)).select(
        *PAIR, "direction", "node", (F.col("w_new") - F.col("w_old")).alias("delta")
    )
    rows = top_rows(deltas, [*PAIR, "direction"], [F.col("delta").desc(), F.col("node")], n)
    return rows.withColumn("delta", F.round("delta", 2))


# --- strongly connected components ---------------------------------------------


def _on(a: str, b: str, *same: tuple[str, str]) -> Column:
    pairs = [("repo", "repo"), ("rev", "rev"), *same]
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{p}") == F.col(f"{b}.{q}") for p, q in pairs])


def _names(links: DataFrame, *nodes: DataFrame) -> DataFrame:
    """(node, id) of all names in ``links`` and ``nodes``; ids keep the order of the names, so the least id is the least name."""
    ends = reduce(DataFrame.unionByName, [links.select(F.explode(F.array("src", "dest")).alias("node")), *[n.select("node") for n in nodes]])
    placed = ends.distinct().filter(F.col("node").isNotNull()).repartitionByRange("node").sortWithinPartitions("node")
    return cut_lineage(placed.withColumn("id", F.monotonically_increasing_id()))


def _numbered_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct links without loops, their ends replaced by the ids of ``names``."""
    at = lambda end: names.select(F.col("node").alias(end), F.col("id").alias(f"id_{end}"))
    rows = links.filter(F.col("src") != F.col("dest")).join(at("src"), "src").join(at("dest"), "dest")
    return cut_lineage(rows.select(*GRAPH, F.col("id_src").alias("src"), F.col("id_dest").alias("dest")))


def _peeled(links: DataFrame) -> DataFrame:
    """Edges between nodes that are some edge's source and some edge's target."""
    ends = links.select(*GRAPH, F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dest").alias("node"), F.lit(False).alias("out"))
    )).alias("e"))
    inner = ends.groupBy(*GRAPH, F.col("e.node").alias("node")).agg(
        F.bool_or("e.out").alias("o"), F.bool_and("e.out").alias("only_out")
    ).filter(F.col("o") & ~F.col("only_out"))
    at = lambda end: inner.select(*GRAPH, F.col("node").alias(end))
    return links.join(at("src"), [*GRAPH, "src"], "left_semi").join(at("dest"), [*GRAPH, "dest"], "left_semi")


def _trim(links: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Peel edges that cannot lie on a cycle until nothing changes."""
    while size:
        before = links
        links, left = cut_and_count(_peeled(before))
        drop_scratch(before)
        if left == size:
            break
        size = left
    return links, size


def _spread_labels(links: DataFrame, size: int) -> DataFrame:
    """Per node the smallest node that reaches it (``up``) and the smallest node it reaches (``down``)."""
    node = lambda end: links.select(*GRAPH, F.col(end).alias("node"))
    none = F.lit(None).cast(dict(links.dtypes)["src"])
    labels = cut_lineage(node("src").unionByName(node("dest")).distinct().select(
        *GRAPH, "node", F.col("node").alias("up"), F.col("node").alias("down"), F.lit(True).alias("moved")
    ))
    while True:
        active = labels.filter("moved")
        forward = links.alias("e").join(active.alias("l"), _on("e", "l", ("src", "node"))).select(
            "e.repo", "e.rev", F.col("e.dest").alias("node"), "l.up", none.alias("down")
        )
        backward = links.alias("e").join(active.alias("l"), _on("e", "l", ("dest", "node"))).select(
            "e.repo", "e.rev", F.col("e.src").alias("node"), none.alias("up"), "l.down"
        )
        offers = forward.unionByName(backward).groupBy(*GRAPH, "node").agg(
            F.min("up").alias("offer_up"), F.min("down").alias("offer_down")
        )
        up, down = F.least("up", "offer_up"), F.least("down", "offer_down")
        before = labels
        labels = before.drop("moved").join(offers, [*GRAPH, "node"], "left").select(
            *GRAPH, "node", up.alias("up"), down.alias("down"), ((up < F.col("up")) | (down < F.col("down"))).alias("moved")
        )
        moving = Observation()
        labels = cut_lineage(labels.observe(moving, F.count_if("moved").alias("n")))
        drop_scratch(before)
        if not moving.get["n"]:
            return labels.drop("moved")


def _least_of_cycles(src: np.ndarray, dest: np.ndarray, n: int) -> np.ndarray:
    """For every node 0..n-1 the least node of its strongly connected component, by one depth-first search."""
    order = np.argsort(src, kind="stable")
    targets = dest[order].tolist()
    starts = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, least = [-1] * n, [0] * n, list(range(n))
    at, open_nodes, on_path, count = starts[:n], [], [False] * n, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                open_nodes.append(v)
                on_path[v] = True
            if at[v] < starts[v + 1]:
                w = targets[at[v]]
                at[v] += 1
                if index[w] < 0:
                    path.append(w)
                elif on_path[w]:
                    low[v] = min(low[v], index[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                first = len(open_nodes) - 1
                while open_nodes[first] != v:
                    first -= 1
                members = open_nodes[first:]
                del open_nodes[first:]
                name = min(members)
                for w in members:
                    on_path[w], least[w] = False, name
    return np.array(least, np.int64)


def _core(src: np.ndarray, dest: np.ndarray, n: int, rounds: int = 50) -> np.ndarray:
    """Positions of the edges left after peeling, some rounds long, those that lie on no cycle."""
    left = np.arange(len(src))
    for _ in range(rounds):
        inner = (np.bincount(dest[left], minlength=n) > 0) & (np.bincount(src[left], minlength=n) > 0)
        kept = left[inner[src[left]] & inner[dest[left]]]
        if len(kept) == len(left):
            break
        left = kept
    return left


def _in_blocks(links: DataFrame, block_edges: int) -> DataFrame:
    """``links`` plus ``blocks``, the number of blocks their graph is cut into, and ``block``."""
    sizes = links.groupBy(*GRAPH).agg(F.ceil(F.count(F.lit(1)) / block_edges).cast("int").alias("blocks"))
    return links.join(sizes, GRAPH).withColumn("block", F.pmod(F.xxhash64("src", "dest"), "blocks").cast("int"))


def _cycles_of_blocks(links: DataFrame, block_edges: int) -> DataFrame:
    """(repo, rev, blocks, node, component): components of more than one node within single blocks of edges."""
    placed = _in_blocks(links, block_edges)
    types = dict(links.dtypes)
    schema = f"repo {types['repo']}, rev {types['rev']}, blocks int, node bigint, component bigint"

    def cycles(block: pd.DataFrame) -> pd.DataFrame:
        keys = [(key, block[key].iloc[0]) for key in ("repo", "rev", "blocks")]
        m = len(block)
        names, codes = np.unique(np.concatenate([block["src"], block["dest"]]), return_inverse=True)
        core = _core(codes[:m], codes[m:], len(names))
        inner, codes = np.unique(np.concatenate([codes[:m][core], codes[m:][core]]), return_inverse=True)
        least = _least_of_cycles(codes[:len(core)], codes[len(core):], len(inner))
        kept = np.flatnonzero(np.bincount(least, minlength=len(inner))[least] > 1)
        out = pd.DataFrame({"node": names[inner[kept]], "component": names[inner[least[kept]]]})
        for i, (key, value) in enumerate(keys):
            out.insert(i, key, value)
        return out

    return placed.groupBy(*GRAPH, "block").applyInPandas(cycles, schema)


def scc_members(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(repo, rev, component, node) of components with more than one node; a component is named by its least node.

    Names are replaced by numbers in the same order. Every graph is cut into blocks of at most about ``block_edges`` edges, and each
    block's components are found in a task. A graph of one block is done. In a larger one every node is replaced by its component's
    least node, which keeps all components, and the rest is solved by rounds over tables, see ``_by_rounds``.
    """
    links = edges.filter(F.col("src") != F.col("dest")).select(*GRAPH, "src", "dest").distinct()
    links = cut_lineage(links)
    names = _names(links)
    numbers = _numbered_links(links, names)
    drop_scratch(links)
    members = _members(numbers, block_edges)
    at = lambda end: names.select(F.col("node").alias(f"name_{end}"), F.col("id").alias(end))
    return members.join(at("component"), "component").join(at("node"), "node").select(
        *GRAPH, F.col("name_component").alias("component"), F.col("name_node").alias("node")
    )


def _members(links: DataFrame, block_edges: int) -> DataFrame:
    """``scc_members`` of a stored table of distinct links between numbers, without loops."""
    found = cut_lineage(_cycles_of_blocks(links, block_edges))
    done = found.filter("blocks = 1").select(*GRAPH, "component", "node")
    large, wide = cut_and_count(links.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_edges).select(*GRAPH))
    if not wide:
        return done
    pieces = found.filter("blocks > 1").groupBy(*GRAPH, "node").agg(F.min("component").alias("component"))
    at = lambda end: pieces.select(*GRAPH, F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    left = links.join(large, GRAPH, "left_semi").join(at("src"), [*GRAPH, "src"], "left").join(at("dest"), [*GRAPH, "dest"], "left")
    left = left.select(*GRAPH, F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dest", "dest").alias("dest")).filter("src <> dest").distinct()
    rest, size = cut_and_count(left)
    if not size:
        return done.unionByName(pieces.select(*GRAPH, "component", "node"))
    wider = _by_rounds(rest, size)
    # a node's component is that of its piece; pieces that lie on no further cycle are components themselves
    homes = wider.select(*GRAPH, F.col("node").alias("piece"), F.col("component").alias("wide"))
    own = pieces.select(*GRAPH, "node", F.col("component").alias("piece")).join(homes, [*GRAPH, "piece"], "left")
    joined = own.select(*GRAPH, F.coalesce("wide", "piece").alias("component"), "node")
    return done.unionByName(joined).unionByName(wider.join(joined, [*GRAPH, "node"], "left_anti").select(*GRAPH, "component", "node"))


def _by_rounds(links: DataFrame, size: int) -> DataFrame:
    """(repo, rev, component, node) of components with more than one node, for graphs of any size.

    Rounds over all graphs together: peel what lies on no cycle, spread least labels along and against the edges;
    nodes whose two labels agree form the component of that label, the remaining edges with equal labels at both
    ends go on to the next round. Work per step is linear in the edges left; no pairs of nodes are formed.
    """
    found: list[DataFrame] = []
    empty = links.select(*GRAPH, F.col("src").alias("component"), F.col("src").alias("node")).limit(0)
    while True:
        links, size = _trim(links, size)
        if not size:
            break
        labels = _spread_labels(links, size)
        done = F.col("up") == F.col("down")
        found.append(labels.filter(done).select(*GRAPH, F.col("up").alias("component"), "node"))
        rest, before = labels.filter(~done), links
        links, size = cut_and_count(
            before.alias("e").join(rest.alias("s"), _on("e", "s", ("src", "node")))
            .join(rest.alias("d"), _on("e", "d", ("dest", "node")))
            .filter((F.col("s.up") == F.col("d.up")) & (F.col("s.down") == F.col("d.down")))
            .select("e.repo", "e.rev", "e.src", "e.dest")
        )
        drop_scratch(before)
    if not found:
        return empty
    sets = reduce(DataFrame.unionByName, found)
    single = sets.groupBy(*GRAPH, "component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return sets.join(single.drop("_n"), [*GRAPH, "component"], "left_semi")


def scc_summary(members: DataFrame, revisions: DataFrame) -> DataFrame:
    """Number of components and size of the largest for every listed (repo, rev)."""
    sizes = members.groupBy(*GRAPH, "component").agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("scc_count"), F.max("n").alias("largest_scc_size"))
    return revisions.select(*GRAPH).distinct().join(stats, GRAPH, "left").fillna(0)


def scc_counts(members: DataFrame, pairs: DataFrame, count_mode: str = "pair") -> DataFrame:
    """How often a node is in a component: once per pair side ('pair') or once per revision ('revision')."""
    rows = by_pair(members, pairs) if count_mode == "pair" else members
    return rows.groupBy("repo", "node").agg(F.count(F.lit(1)).alias("scc_count"))


# --- reachability ----------------------------------------------------------------


def _closure(links: DataFrame) -> DataFrame:
    """Transitive closure by doubling: paths found last round are extended by everything known."""
    first, total = cut_and_count(links.distinct())
    parts = [first]
    while True:
        known = reduce(DataFrame.unionByName, parts)
        longer = parts[-1].alias("a").join(known.alias("b"), _on("a", "b", ("dest", "src"))).select(
            "a.repo", "a.rev", "a.src", "b.dest"
        ).distinct()
        fresh, size = cut_and_count(longer.join(known, [*GRAPH, "src", "dest"], "left_anti"))
        if not size:
            return known
        parts.append(fresh)
        total += size


def _condensation(nodes: DataFrame, links: DataFrame, block_edges: int = BLOCK_EDGES) -> tuple[DataFrame, DataFrame]:
    """Every node's component (itself if on no cycle), and the links between components, which form no cycle; components are numbers.

    ``links`` is a stored table of distinct links.
    """
    names = _names(links, nodes)
    numbers = _numbered_links(links, names)
    members = _members(numbers, block_edges).withColumnRenamed("node", "id")
    listed = nodes.select(*GRAPH, "node").distinct().join(names, "node", "left")
    home = cut_lineage(
        listed.join(members, [*GRAPH, "id"], "left").select(*GRAPH, "node", "id", F.coalesce("component", "id").alias("component"))
    )
    at = lambda end: home.select(*GRAPH, F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    joined = numbers.join(at("src"), [*GRAPH, "src"]).join(at("dest"), [*GRAPH, "dest"])
    return home.drop("id"), joined.filter(F.col("c_src") != F.col("c_dest")).select(
        *GRAPH, F.col("c_src").alias("src"), F.col("c_dest").alias("dest")
    ).distinct()


def condensed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node's component (itself if on no cycle) and the closure between components.

    Large cycles collapse to one vertex, so the closure holds no pairs inside them.
    """
    home, outer = _condensation(nodes, cut_lineage(edges.select(*GRAPH, "src", "dest").distinct()))
    return home, _closure(outer)


def _waves(src: np.ndarray, dest: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges of a graph without cycles in waves (targets, first edge of each target, sources): all edges into a wave's targets come from earlier ones."""
    out = np.argsort(src, kind="stable")
    ends = np.searchsorted(src[out], np.arange(n + 1))
    into = np.argsort(dest, kind="stable")
    heads = np.searchsorted(dest[into], np.arange(n + 1))
    missing = np.bincount(dest, minlength=n)
    wave = np.flatnonzero(missing == 0)
    spread = lambda of, starts: np.repeat(starts[of], starts[of + 1] - starts[of]) + _steps(starts[of + 1] - starts[of])
    while len(wave):
        seen, times = np.unique(dest[out[spread(wave, ends)]], return_counts=True)
        missing[seen] -= times
        wave = seen[missing[seen] == 0]
        if len(wave):
            counts = heads[wave + 1] - heads[wave]
            yield wave, np.cumsum(counts) - counts, src[into[spread(wave, heads)]]


def _steps(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _least_sinks(src: np.ndarray, dest: np.ndarray, n: int) -> np.ndarray:
    """For every node of a graph without cycles the least sink it reaches; sources of one sink share much of their reach."""
    least = np.arange(n)
    for targets, firsts, origins in _waves(dest, src, n):
        least[targets] = np.minimum.reduceat(least[origins], firsts)
    return least


def _reached(src: np.ndarray, dest: np.ndarray, n: int, sources: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of ``sources`` of a graph without cycles: (slice, nodes reached, itself included; one bit per node and source).

    A slice follows only the links it reaches; each link ors the bits of its source into its target, in an order in which every source is complete.
    """
    out = np.argsort(src, kind="stable")
    ends = np.searchsorted(src[out], np.arange(n + 1))
    onward = lambda of: out[np.repeat(ends[of], ends[of + 1] - ends[of]) + _steps(ends[of + 1] - ends[of])]
    seen = np.zeros(n, bool)
    step = max(64, min(step, SLICE_BITS // max(1, n)))
    for lo in range(0, len(sources), step):
        mine = sources[lo:lo + step]
        seen[mine], found = True, [mine]
        while len(found[-1]):
            ahead = np.unique(dest[onward(found[-1])])
            found.append(ahead[~seen[ahead]])
            seen[found[-1]] = True
        nodes = np.sort(np.concatenate(found))
        seen[nodes] = False
        links = onward(nodes)
        words = np.zeros((len(nodes), -(-len(mine) // 64)), np.uint64)
        own = np.arange(len(mine))
        words[np.searchsorted(nodes, mine), own // 64] = np.uint64(1) << (own % 64).astype(np.uint64)
        for targets, firsts, origins in _waves(np.searchsorted(nodes, src[links]), np.searchsorted(nodes, dest[links]), len(nodes)):
            words[targets] |= np.bitwise_or.reduceat(words[origins], firsts, axis=0)
        yield mine, nodes, words


def _pairs_of_slices(links: DataFrame, slice_sources: int) -> DataFrame:
    """(repo, rev, across) for graphs of one block: node pairs between different components with a path, slice by slice of sources.

    ``links`` names components by numbers and carries their sizes n_src and n_dest. At most ``SLICE_TASKS`` tasks share the sources of a graph;
    sources that reach the same sink follow one another, so that a slice reaches few links. Pairs are counted, never listed.
    """
    sources = links.groupBy(*GRAPH).agg(F.least(F.lit(SLICE_TASKS), F.ceil(F.count_distinct("src") / slice_sources)).cast("int").alias("slices"))
    spread = links.join(sources, GRAPH).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    types = dict(links.dtypes)

    def counted(block: pd.DataFrame) -> pd.DataFrame:
        key = [block[c].iloc[0] for c in ("repo", "rev", "slice", "slices")]
        names, codes = np.unique(np.concatenate([block["src"], block["dest"]]), return_inverse=True)
        m, n = len(block), len(names)
        src, dest = codes[:m], codes[m:]
        weight = np.ones(n, np.int64)
        weight[src], weight[dest] = block["n_src"], block["n_dest"]
        del block
        mine = np.unique(src)
        mine = np.array_split(mine[np.argsort(_least_sinks(src, dest, n)[mine], kind="stable")], int(key[3]))[int(key[2])]
        across = 0
        for size in np.unique(weight[mine]):
            for own, nodes, words in _reached(src, dest, n, mine[weight[mine] == size], slice_sources):
                times = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
                across += int(size) * (int((weight[nodes] * times).sum()) - int(size) * len(own))
        return pd.DataFrame({"repo": key[:1], "rev": key[1:2], "across": [across]})

    counts = spread.groupBy(*GRAPH, "slice").applyInPandas(counted, f"repo {types['repo']}, rev {types['rev']}, across bigint")
    return counts.groupBy(*GRAPH).agg(F.sum("across").alias("across"))


def _pairs_by_rounds(links: DataFrame, slice_sources: int) -> DataFrame:
    """``_pairs_of_slices`` for graphs of any size: 64 sources to a word, words passed along the links until no bit is new.

    Slices of sources follow one another; a slice's words are counted and dropped before the next.
    """
    origins = numbered(links.select(*GRAPH, F.col("src").alias("node"), F.col("n_src").alias("n")).distinct(), GRAPH, [F.col("node")], "at")
    origins = cut_lineage(origins.withColumn("slice", F.floor((F.col("at") - 1) / slice_sources)))
    sizes = cut_lineage(links.select(*GRAPH, F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("n_src").alias("n")), F.struct(F.col("dest").alias("node"), F.col("n_dest").alias("n")))).alias("x")).select(*GRAPH, "x.*").distinct())
    last = origins.agg(F.max("slice")).first()[0]
    key, parts = [*GRAPH, "node", "word"], []
    for nth in range(-1 if last is None else last + 1):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), ((F.col("at") - 1) % 64).cast("int"))
        starts = origins.filter(F.col("slice") == nth).withColumn("word", F.floor((F.col("at") - 1) / 64))
        state = cut_lineage(starts.select(*key, bit.alias("bits"), bit.alias("fresh")))
        while True:
            moved = state.filter("fresh <> 0").alias("s").join(links.alias("e"), _on("s", "e", ("node", "src")))
            offers = moved.groupBy("s.repo", "s.rev", F.col("e.dest").alias("node"), "s.word").agg(F.bit_or("s.fresh").alias("offer"))
            known = F.coalesce("bits", F.lit(0).cast("bigint"))
            offer = F.coalesce("offer", F.lit(0).cast("bigint"))
            seen = Observation()
            merged = state.select(*key, "bits").join(offers, key, "full").select(*key, known.bitwiseOR(offer).alias("bits"), offer.bitwiseAND(F.bitwise_not(known)).alias("fresh"))
            after = cut_lineage(merged.observe(seen, F.count_if(F.col("fresh") != 0).alias("n")))
            drop_scratch(state)
            state = after
            if not seen.get["n"]:
                break
        reach = state.join(sizes, [*GRAPH, "node"]).select(*GRAPH, "word", "n", F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)).alias("i"))
        totals = reach.groupBy(*GRAPH, ((F.col("word") * 64 + F.col("i")) + 1).alias("at")).agg(F.sum("n").alias("total"))
        parts.append(cut_lineage(
            starts.join(totals, [*GRAPH, "at"]).groupBy(*GRAPH).agg(F.sum(F.col("n") * (F.col("total") - F.col("n"))).cast("bigint").alias("across"))
        ))
        drop_scratch(state)
    if not parts:
        return links.select(*GRAPH, F.lit(0).cast("bigint").alias("across")).limit(0)
    return reduce(DataFrame.unionByName, parts).groupBy(*GRAPH).agg(F.sum("across").alias("across"))


def reachability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All (src, dest) with a path of at least one edge; a node reaches itself only on a cycle."""
    home, reach = condensed(nodes, edges)
    inner = home.groupBy(*GRAPH, "component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    loops = edges.filter(F.col("src") == F.col("dest")).select(*GRAPH, F.col("src").alias("node")).distinct()
    cyclic = inner.select(*GRAPH, "component").unionByName(loops.join(home, [*GRAPH, "node"]).select(*GRAPH, "component")).distinct()
    links = reach.unionByName(cyclic.select(*GRAPH, F.col("component").alias("src"), F.col("component").alias("dest")))
    return (
        links.alias("r").join(home.alias("s"), _on("r", "s", ("src", "component")))
        .join(home.alias("d"), _on("r", "d", ("dest", "component")))
        .select("r.repo", "r.rev", F.col("s.node").alias("src"), F.col("d.node").alias("dest"))
    )


def reaches(asked: DataFrame, nodes: DataFrame, edges: DataFrame, block_edges: int = BLOCK_EDGES, slice_sources: int = SLICE_SOURCES) -> DataFrame:
    """``asked`` (repo, rev, src, dest; distinct) plus ``reached``: whether a path of at least one edge leads from src to dest.

    Answers a table of pairs without the closure: only asked sources are followed, as bits along the links between components, slice by slice;
    a pair within one component needs no search. Pairs with an unknown node are not reached.
    """
    links = cut_lineage(edges.select(*GRAPH, "src", "dest").distinct())
    home, outer = _condensation(nodes, links, block_edges)
    outer = cut_lineage(outer)
    loops = links.filter(F.col("src") == F.col("dest")).select(*GRAPH, "src").withColumn("loop", F.lit(True))
    at = lambda end: home.select(*GRAPH, F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    placed = asked.select(*GRAPH, "src", "dest").join(at("src"), [*GRAPH, "src"], "left").join(at("dest"), [*GRAPH, "dest"], "left").join(loops, [*GRAPH, "src"], "left")
    within = F.col("c_src") == F.col("c_dest")
    placed = cut_lineage(placed.withColumn("inside", F.coalesce(within & ((F.col("src") != F.col("dest")) | F.coalesce("loop", F.lit(False))), F.lit(False))))
    # a node in a component of several reaches itself, too
    several = home.groupBy(*GRAPH, F.col("component").alias("c_src")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    searched = placed.filter(~within).select(*GRAPH, "c_src", "c_dest").distinct()
    sizes = outer.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("edges"))
    wanted = searched.join(sizes, GRAPH)
    # every asked source falls into a slice by its hash
    counts = wanted.groupBy(*GRAPH).agg(F.least(F.lit(SLICE_TASKS), F.ceil(F.count_distinct("c_src") / slice_sources)).cast("int").alias("slices"))
    wanted = cut_lineage(wanted.join(counts, GRAPH).withColumn("slice", F.pmod(F.xxhash64("c_src"), "slices").cast("int")))
    small = wanted.filter(F.col("edges") <= block_edges)
    parts = outer.join(small.select(*[F.col(g).alias(g) for g in GRAPH], F.col("slice").alias("part")).distinct(), GRAPH)
    types = dict(links.dtypes)

    def search(block: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([block["src"], block["dest"], pairs["c_src"], pairs["c_dest"]]), return_inverse=True)
        m, k, n = len(block), len(pairs), len(names)
        src, dest, froms, tos = np.split(codes, [m, 2 * m, 2 * m + k])
        mine = np.unique(froms)
        mine = mine[np.argsort(_least_sinks(src, dest, n)[mine], kind="stable")]
        place = np.empty(n, np.int64)
        place[mine] = np.arange(len(mine))
        order = np.argsort(place[froms], kind="stable")
        asked_at, done, hit = place[froms][order], 0, np.zeros(k, bool)
        for own, nodes, words in _reached(src, dest, n, mine, slice_sources):
            rows = order[np.searchsorted(asked_at, done):np.searchsorted(asked_at, done + len(own))]
            bit = place[froms[rows]] - done
            at = np.minimum(np.searchsorted(nodes, tos[rows]), len(nodes) - 1)
            known = words[at, bit // 64] >> (bit % 64).astype(np.uint64) & np.uint64(1)
            hit[rows] = (nodes[at] == tos[rows]) & (known != 0)
            done += len(own)
        return pairs[["repo", "rev", "c_src", "c_dest"]].assign(found=hit)

    shape = f"repo {types['repo']}, rev {types['rev']}, c_src bigint, c_dest bigint, found boolean"
    told = parts.groupBy(*GRAPH, "part").cogroup(small.groupBy(*GRAPH, "slice")).applyInPandas(search, shape)
    large = wanted.filter(F.col("edges") > block_edges)
    told = told.unionByName(_searched_by_rounds(large, outer))
    out = placed.join(told.filter("found"), [*GRAPH, "c_src", "c_dest"], "left").join(several, [*GRAPH, "c_src"], "left")
    itself = (F.col("src") == F.col("dest")) & F.col("_n").isNotNull()
    return out.select(*GRAPH, "src", "dest", (F.col("inside") | F.coalesce(itself, F.lit(False)) | F.coalesce("found", F.lit(False))).alias("reached"))


def _searched_by_rounds(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """(repo, rev, c_src, c_dest, found) for graphs of any size: (source, node) pairs of asked sources spread along the links until none is new.

    Components reached by a source are rows here, so memory of a task is bounded by its share of them.
    """
    start = wanted.select(*GRAPH, "c_src", F.col("c_src").alias("node")).distinct()
    fresh, n = cut_and_count(start)
    parts = [fresh]
    while n:
        known = reduce(DataFrame.unionByName, parts)
        onward = fresh.alias("f").join(links.alias("e"), _on("f", "e", ("node", "src"))).select("f.repo", "f.rev", "f.c_src", F.col("e.dest").alias("node")).distinct()
        fresh, n = cut_and_count(onward.join(known, [*GRAPH, "c_src", "node"], "left_anti"))
        parts.append(fresh)
    known = reduce(DataFrame.unionByName, parts).withColumnRenamed("node", "c_dest")
    return wanted.select(*GRAPH, "c_src", "c_dest").distinct().join(known, [*GRAPH, "c_src", "c_dest"], "left_semi").withColumn("found", F.lit(True))


def propagation_cost(nodes: DataFrame, edges: DataFrame, block_edges: int = BLOCK_EDGES, slice_sources: int = SLICE_SOURCES) -> DataFrame:
    """Both propagation costs of every revision, counted from component sizes and bits of reach; no pair of nodes is listed.

    ``pc_matrix``: closure pairs over N², self pairs on cycles included. ``pc_reach``: mean share of the other
    nodes that a node reaches. ``edges`` of weight 0 stand for matrix cells without values: they count for the
    matrix form only. Graphs of up to ``block_edges`` links between components are counted in tasks of one slice of sources
    each, larger ones by rounds over words of 64 sources.
    """
    seen = Observation()
    links = cut_lineage(
        edges.groupBy(*GRAPH, "src", "dest").agg(F.max(F.col("weight") > 0).alias("valued")).observe(seen, F.count_if(~F.col("valued")).alias("bare"))
    )
    loops = links.filter(F.col("src") == F.col("dest")).select(*GRAPH, F.col("src").alias("node")).distinct()

    def counts(chosen: DataFrame, out: str) -> DataFrame:
        home, outer = _condensation(nodes, chosen, block_edges)
        groups = cut_lineage(home.groupBy(*GRAPH, "component").agg(F.count(F.lit(1)).alias("n")))
        at = lambda end: groups.select(*GRAPH, F.col("component").alias(end), F.col("n").alias(f"n_{end}"))
        sized = outer.join(at("src"), [*GRAPH, "src"]).join(at("dest"), [*GRAPH, "dest"]).select(*GRAPH, "src", "dest", "n_src", "n_dest")
        placed, big = cut_lineage(sized), Observation()
        large = placed.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_edges)
        large = cut_lineage(large.observe(big, F.count(F.lit(1)).alias("n")).select(*GRAPH))
        across = _pairs_of_slices(placed.join(large, GRAPH, "left_anti"), slice_sources)
        if big.get["n"]:
            across = across.unionByName(_pairs_by_rounds(cut_lineage(placed.join(large, GRAPH, "left_semi")), slice_sources))
        looped = home.join(loops, [*GRAPH, "node"]).select(*GRAPH, "component").distinct().withColumn("loop", F.lit(1))
        sizes = groups.join(looped, [*GRAPH, "component"], "left")
        self_pairs = F.when(F.col("n") > 1, F.col("n")).otherwise(F.coalesce("loop", F.lit(0)))
        own = sizes.groupBy(*GRAPH).agg(
            F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("n") - 1)).alias("inside"), F.sum(self_pairs).alias("selfs")
        )
        base = own.join(across, GRAPH, "left").fillna(0, ["across"])
        base = base.select(*GRAPH, *[F.col(c).cast("double").alias(c) for c in ("total", "inside", "selfs", "across")])
        others = F.col("across") + F.col("inside")
        matrix = (others + F.col("selfs")) / (F.col("total") * F.col("total"))
        reach = F.when(F.col("total") > 1, others / (F.col("total") * (F.col("total") - 1))).otherwise(0.0)
        shown = {"pc_matrix": matrix, "pc_reach": reach}
        return base.select(*GRAPH, *[v.alias(k) for k, v in shown.items() if out in (k, "both")])

    if not seen.get["bare"]:
        return counts(links, "both")
    return counts(links, "pc_matrix").join(counts(links.filter("valued"), "pc_reach"), GRAPH)


# --- composite -------------------------------------------------------------------


def graph_diff(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row per neighbouring pair: node counts, weights, kinds, components and samples of changes.

    Samples are bounded arrays; component members stay rows of ``scc_members``.
    """
    members = cut_lineage(scc_members(edges)) if members is None else members
    kinds = by_pair(edge_summary(edges), pairs).withColumn("_t", F.concat(F.col("kind"), F.lit("="), F.col("weight")))
    weights = kinds.groupBy(*PAIR).agg(
        *[F.coalesce(F.max(when_side(s, F.when(F.col("kind").isNull(), F.col("weight")))), F.lit(0.0)).alias(f"weight_{s}")
          for s in ("new", "old")],
        *[F.array_join(F.transform(F.array_sort(F.collect_list(when_side(s, F.struct("kind", "_t")))),
                                   lambda x: x["_t"]), ", ").alias(f"by_kind_{s}") for s in ("new", "old")],
    )
    scc = by_pair(scc_summary(members, nodes), pairs)
    cycles = scc.groupBy(*PAIR).agg(
        *pair_column(scc, "scc_count", F.col("scc_count")), *pair_column(scc, "largest_scc", F.col("largest_scc_size"))
    )
    changed = top_edge_changes(edges, pairs)
    sample = lambda s: F.array_sort(F.collect_list(F.when(
        F.col("status") == s, F.struct("rank", "src", "dest", "kind", "weight")))).alias(f"edges_{s}")
    edge_samples = changed.groupBy(*PAIR).agg(sample("added"), sample("removed"))
    fan = top_fan_changes(edges, pairs)
    fan_sample = lambda s: F.array_sort(F.collect_list(F.when(
        F.col("direction") == s, F.struct("rank", "node", "delta")))).alias(f"{s}_top")
    fan_samples = fan.groupBy(*PAIR).agg(fan_sample("fan_in"), fan_sample("fan_out"))
    out = node_counts(nodes, pairs)
    for part in (weights, cycles, edge_samples, fan_samples):
        out = out.join(part, PAIR, "left")
    return out


