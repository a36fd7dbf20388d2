import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronolith.operators import graph as G
from chronolith.operators.common import adjacent_pairs

EDGE = "repo string, rev int, src string, dest string, kind string, weight double"
NODE = "repo string, rev int, node string"


def closure(nodes, links):
    reach = {n: set() for n in nodes}
    for a, b in links:
        reach[a].add(b)
    for k in nodes:
        for i in nodes:
            if k in reach[i]:
                reach[i] |= reach[k]
    return reach


def build(spark, graphs):
    nodes = [(r, v, n) for (r, v), (ns, _) in graphs.items() for n in ns]
    edges = [(r, v, a, b, "Call", 1.0) for (r, v), (_, es) in graphs.items() for a, b in es]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def random_graphs(seed, sizes):
    rnd = random.Random(seed)
    out = {}
    for i, (n, m) in enumerate(sizes):
        ns = [f"n{j:02d}" for j in range(n)]
        out[(f"r{i % 2}", i)] = (ns, sorted({(rnd.choice(ns), rnd.choice(ns)) for _ in range(m)}))
    return out


@pytest.mark.parametrize("seed,sizes", [(1, [(12, 16), (8, 20), (15, 10)]), (2, [(20, 30), (1, 1), (6, 6)])])
def test_components_and_reachability_match_brute_force(spark, rows, seed, sizes):
    graphs = random_graphs(seed, sizes)
    nodes, edges = build(spark, graphs)
    want_reach, want_scc = [], []
    for (r, v), (ns, es) in graphs.items():
        reach = closure(ns, es)
        want_reach += [(r, v, a, b) for a in ns for b in reach[a]]
        for a in ns:
            mates = [b for b in ns if b == a or (b in reach[a] and a in reach[b])]
            if len(mates) > 1:
                want_scc.append((r, v, min(mates), a))
    assert rows(G.reachability(nodes, edges), "repo", "rev", "src", "dest") == sorted(want_reach, key=str)
    assert rows(G.scc_members(edges), "repo", "rev", "component", "node") == sorted(want_scc, key=str)
    for r in G.propagation_cost(nodes, edges).collect():
        ns, es = graphs[(r.repo, r.rev)]
        reach = closure(ns, es)
        n = len(ns)
        assert r.pc_matrix == pytest.approx(sum(len(x) for x in reach.values()) / n**2)
        others = sum(len(reach[a] - {a}) for a in ns)
        assert r.pc_reach == pytest.approx(others / (n * (n - 1)) if n > 1 else 0.0)


@pytest.mark.parametrize("block_edges, slice_sources", [(1, 9), (10, 70), (10_000, 1)])
def test_blocks_and_rounds_give_the_same(spark, rows, block_edges, slice_sources):
    """Graphs of one block, of several blocks and of one edge a block; slices of one source and of many."""
    graphs = random_graphs(block_edges, [(10, 14), (2, 2), (12, 8)] if block_edges == 1 else [(12, 18), (9, 22), (15, 9), (2, 2), (80, 120)])
    nodes, edges = build(spark, graphs)
    assert rows(G.scc_members(edges, block_edges)) == rows(G.scc_members(edges))
    want = []
    for (r, v), (ns, es) in graphs.items():
        reach = closure(ns, es)
        others = sum(len(reach[a] - {a}) for a in ns)
        want.append((r, v, sum(len(x) for x in reach.values()) / len(ns) ** 2, others / (len(ns) * (len(ns) - 1))))
    got = G.propagation_cost(nodes, edges, block_edges, slice_sources).collect()
    assert sorted((r.repo, r.rev, pytest.approx(r.pc_matrix), pytest.approx(r.pc_reach)) for r in got) == sorted(want)


@pytest.mark.parametrize("block_edges, slice_sources", [(1, 9), (10_000, 3), (10_000, 4096)])
def test_asked_pairs(spark, block_edges, slice_sources):
    graphs = random_graphs(3, [(10, 14), (2, 2), (14, 12)])
    nodes, edges = build(spark, graphs)
    want = {}
    for (r, v), (ns, es) in graphs.items():
        reach = closure(ns, es)
        want |= {(r, v, a, b): b in reach[a] for a in ns for b in ns}
    want[("r0", 0, "n00", "unknown")] = False
    asked = spark.createDataFrame(list(want), "repo string, rev int, src string, dest string")
    got = G.reaches(asked, nodes, edges, block_edges, slice_sources).collect()
    assert len(got) == len(want) and {tuple(r)[:4]: r.reached for r in got} == want


def test_chain_of_five_thousand(spark):
    chain = [(f"d{i:05d}", f"d{i + 1:05d}") for i in range(4999)]
    nodes, edges = build(spark, {("r", 1): (sorted({x for e in chain for x in e}), chain)})
    row = G.propagation_cost(nodes, edges).collect()[0]
    assert row.pc_matrix == pytest.approx(5000 * 4999 / 2 / 5000**2)


def test_graph_beyond_a_hundred_thousand_edges_takes_no_rounds(spark, monkeypatch):
    """20,000 rings of five, every other one linked to the next: a task of numbers, no rounds over tables."""
    def rounds(*_):
        raise AssertionError("rounds over tables")

    monkeypatch.setattr(G, "_by_rounds", rounds)
    monkeypatch.setattr(G, "_pairs_by_rounds", rounds)
    monkeypatch.setattr(G, "_searched_by_rounds", lambda wanted, links: wanted.limit(0).selectExpr("repo", "rev", "c_src", "c_dest", "true AS found"))
    rings = spark.range(100_000).selectExpr("'r' AS repo", "1 AS rev", "id", "floor(id / 5) * 5 + (id + 1) % 5 AS next")
    name = "concat('n', lpad(cast({} as string), 6, '0')) AS {}"
    edges = rings.selectExpr("repo", "rev", name.format("id", "src"), name.format("next", "dest"), "'Call' AS kind", "1D AS weight")
    bridges = rings.filter("id % 10 = 0").selectExpr("repo", "rev", name.format("id", "src"), name.format("id + 5", "dest"), "'Call' AS kind", "1D AS weight")
    edges, nodes = edges.unionByName(bridges), edges.selectExpr("repo", "rev", "src AS node")
    members = G.scc_members(edges)
    assert members.count() == 100_000 and members.select("component").distinct().count() == 20_000
    assert members.filter("component > node").count() == 0
    row = G.propagation_cost(nodes, edges).collect()[0]
    assert row.pc_matrix == pytest.approx((20_000 + 10_000) * 25 / 100_000**2)
    asked = spark.createDataFrame([("r", 1, "n000013", "n000017"), ("r", 1, "n000017", "n000013"), ("r", 1, "n000003", "n000010")], "repo string, rev int, src string, dest string")
    assert {(r.src, r.dest): r.reached for r in G.reaches(asked, nodes, edges).collect()} == {
        ("n000013", "n000017"): True, ("n000017", "n000013"): False, ("n000003", "n000010"): False
    }


@pytest.mark.parametrize("step", [1, 64, 200])
def test_reach_of_slices(step):
    rnd = random.Random(step)
    links = sorted({tuple(sorted(rnd.sample(range(300), 2))) for _ in range(500)})
    src, dest = np.array(links).T
    want = closure(range(300), links)
    sources = np.array(rnd.sample(range(300), 250))
    got = {}
    for own, nodes, words in G._reached(src, dest, 300, sources, step):
        for i, s in enumerate(own):
            got[int(s)] = {int(n) for n in nodes[(words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) != 0]} - {int(s)}
    assert got == {int(s): want[s] for s in sources}
    least = G._least_sinks(src, dest, 300)
    assert [int(x) for x in least] == [min([t for t in want[n] | {n} if not want[t]]) for n in range(300)]


def test_large_cycle_and_long_chain(spark):
    ring = [(f"c{i:03d}", f"c{(i + 1) % 40:03d}") for i in range(40)]
    chain = [(f"d{i:03d}", f"d{i + 1:03d}") for i in range(30)]
    names = sorted({x for e in ring + chain for x in e})
    nodes, edges = build(spark, {("r", 1): (names, ring + chain)})
    assert G.scc_members(edges).count() == 40
    assert G.reachability(nodes, edges).count() == 40 * 40 + 31 * 30 // 2


def test_empty_cells_count_for_the_matrix_form_only(spark):
    nodes = spark.createDataFrame([("r", 1, n) for n in "abc"], NODE)
    edges = spark.createDataFrame([("r", 1, "a", "b", "Call", 1.0), ("r", 1, "b", "c", None, 0.0)], EDGE)
    row = G.propagation_cost(nodes, edges).collect()[0]
    assert (row.pc_matrix, row.pc_reach) == (pytest.approx(3 / 9), pytest.approx(1 / 6))


def test_toy_refactoring_diff(spark):
    god = [("God", x) for x in "abcd"] + [(x, "God") for x in "abcd"]
    flat = [("a", "b"), ("b", "c"), ("God", "a")]
    nodes = spark.createDataFrame([("t", 2, n) for n in ["God", *"abcd"]] + [("t", 1, n) for n in ["God", *"abcde"]], NODE)
    edges = spark.createDataFrame([("t", 2, a, b, "Use", 6.0) for a, b in god] + [("t", 1, a, b, "Use", 2.0) for a, b in flat], EDGE)
    pairs = adjacent_pairs(nodes)
    d = G.graph_diff(nodes, edges, pairs).collect()[0]
    assert (d.nodes_new, d.nodes_old, d.nodes_delta) == (6, 5, 1)
    assert (d.weight_new, d.weight_old) == (6.0, 48.0)
    assert (d.scc_count_new, d.scc_count_old, d.largest_scc_old) == (0, 1, 5)
    assert [(e.src, e.dest) for e in d.edges_added] == [("a", "b"), ("b", "c")] and len(d.edges_removed) == 7
    assert (d.fan_in_top[0].node, d.fan_in_top[0].delta) == ("a", -4.0)
    changed = {(r.status, r.src, r.dest, r.weight) for r in G.heaviest_changes(edges, pairs).collect()}
    assert changed == set()
    assert {r.status for r in G.heaviest_changes(edges, pairs, 1, 1).collect()} == {"added", "removed"}


def test_component_counts_by_pair_and_by_revision(spark, rows):
    members = spark.createDataFrame([("r", v, "a", n) for v in (1, 2, 3) for n in "ab"], "repo string, rev int, component string, node string")
    pairs = adjacent_pairs(members)
    assert rows(G.scc_counts(members, pairs)) == [("r", "a", 4), ("r", "b", 4)]
    assert rows(G.scc_counts(members, pairs, "revision")) == [("r", "a", 3), ("r", "b", 3)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=12))
def test_components_are_disjoint(spark, links):
    _, edges = build(spark, {("r", 1): (["x"], [(f"n{a}", f"n{b}") for a, b in set(links)])})
    got = [r.node for r in G.scc_members(edges).collect()]
    assert len(got) == len(set(got))
