"""Queries over dependency graphs, clusterings and co-change."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions.text import normalise_path
from chronolith.operators import clustering as L
from chronolith.operators import cochange as K
from chronolith.operators import graph as G
from chronolith.operators import modularity as M
from chronolith.operators import reports as R
from chronolith.plans.oracle import sql
from chronolith.plans.registry import query

PAIR_SQL = "p.repo, CAST(p.new_rev AS BIGINT) AS new_rev"
FAN = """fan AS (SELECT repo, rev, node, sum(i) AS fan_in, sum(o) AS fan_out FROM (
  SELECT repo, rev, src AS node, 0.0::DOUBLE AS i, weight AS o FROM edges UNION ALL SELECT repo, rev, dest, weight, 0.0::DOUBLE FROM edges) GROUP BY 1, 2, 3)"""
HOT = """hot AS (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY total_weight DESC, node) AS rank FROM (
  SELECT n.repo, n.rev, n.node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in + fan_out, 0) AS total_weight
  FROM nodes n LEFT JOIN fan f ON n.repo = f.repo AND n.rev = f.rev AND n.node = f.node))"""
LINKS = "links AS (SELECT DISTINCT repo, rev, src, dest FROM edges)"
REACH = """reach AS (SELECT * FROM links UNION SELECT r.repo, r.rev, r.src, l.dest FROM reach r JOIN links l ON r.repo = l.repo AND r.rev = l.rev AND r.dest = l.src)"""
SCC = """scc AS (SELECT a.repo, a.rev, a.src AS node, least(a.src, min(a.dest)) AS component FROM reach a
  JOIN reach b ON a.repo = b.repo AND a.rev = b.rev AND a.src = b.dest AND a.dest = b.src WHERE a.src <> a.dest GROUP BY a.repo, a.rev, a.src)"""
SCCSUM = """sccsum AS (SELECT r.repo, r.rev, coalesce(k, 0) AS scc_count, coalesce(big, 0) AS largest FROM revisions r LEFT JOIN (
  SELECT repo, rev, count(*) AS k, max(n) AS big FROM (SELECT repo, rev, component, count(*) AS n FROM scc GROUP BY ALL) GROUP BY ALL) s ON r.repo = s.repo AND r.rev = s.rev)"""
ECHANGES = """echanges AS (
  SELECT p.repo, p.new_rev, p.old_rev, 'added' AS status, e.src, e.dest, e.kind, e.weight FROM pairs p JOIN edges e ON e.repo = p.repo AND e.rev = p.new_rev
  WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.repo = p.repo AND o.rev = p.old_rev AND o.src = e.src AND o.dest = e.dest AND o.kind = e.kind)
  UNION ALL
  SELECT p.repo, p.new_rev, p.old_rev, 'removed', e.src, e.dest, e.kind, e.weight FROM pairs p JOIN edges e ON e.repo = p.repo AND e.rev = p.old_rev
  WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.repo = p.repo AND o.rev = p.new_rev AND o.src = e.src AND o.dest = e.dest AND o.kind = e.kind))"""
TOPEDGES = "topedges AS (SELECT *, row_number() OVER (PARTITION BY repo, new_rev, status ORDER BY weight DESC, src, dest, kind) AS rank FROM echanges)"
FANDIR = """fandir AS (SELECT repo, rev, 'fan_in' AS direction, dest AS node, sum(weight) AS w FROM edges GROUP BY ALL
  UNION ALL SELECT repo, rev, 'fan_out', src, sum(weight) FROM edges GROUP BY ALL),
fdelta AS (SELECT p.repo, p.new_rev, f.direction, f.node, sum(CASE WHEN f.rev = p.new_rev THEN w ELSE -w END) AS delta FROM pairs p
  JOIN fandir f ON f.repo = p.repo AND (f.rev = p.new_rev OR f.rev = p.old_rev) GROUP BY ALL),
topfan AS (SELECT *, row_number() OVER (PARTITION BY repo, new_rev, direction ORDER BY delta DESC, node) AS rank FROM fdelta)"""


def _big(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


@query("edge_index_a2", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, src, dest, kind, weight FROM edges"))
def _(h):
    return _big(G.edge_index(h.edges), "rev")


@query("edge_summary_a1", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, kind, round(sum(weight), 2) AS weight FROM edges GROUP BY GROUPING SETS ((repo, rev), (repo, rev, kind))"))
def _(h):
    return _big(G.edge_summary(h.edges), "rev")


@query("fan_counts_a3", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, node, fan_in, fan_out FROM fan", FAN))
def _(h):
    return _big(G.fans(h.edges), "rev")


@query("structural_hotspots_a3", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, node, fan_in, fan_out, total_weight, rank FROM hot WHERE rank <= 10", FAN, HOT))
def _(h):
    return _big(G.hotspots(h.nodes.select("repo", "rev", "node"), h.edges), "rev")


@query("node_counts_a4", sql(f"""
    SELECT {PAIR_SQL}, a.n AS nodes_new, b.n AS nodes_old, a.n - b.n AS nodes_delta FROM pairs p
    JOIN (SELECT repo, rev, count(*) AS n FROM nodes GROUP BY ALL) a ON a.repo = p.repo AND a.rev = p.new_rev
    JOIN (SELECT repo, rev, count(*) AS n FROM nodes GROUP BY ALL) b ON b.repo = p.repo AND b.rev = p.old_rev"""))
def _(h):
    return _big(G.node_counts(h.nodes, h.pairs).drop("old_rev"), "new_rev", "nodes_new", "nodes_old", "nodes_delta")


@query("edge_changes_j2_u2", sql("SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, status, count(*) AS edges, sum(weight) AS weight, min(src) AS first_src, max(dest) AS last_dest FROM echanges GROUP BY ALL", ECHANGES))
def _(h):
    rows = G.edge_changes(h.edges, h.pairs).groupBy("repo", "new_rev", "status").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"), F.min("src").alias("first_src"), F.max("dest").alias("last_dest"))
    return _big(rows, "new_rev")


@query("top_edge_changes_t1", sql("SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, status, src, dest, kind, weight, rank FROM topedges WHERE rank <= 25", ECHANGES, TOPEDGES))
def _(h):
    return _big(G.top_edge_changes(h.edges, h.pairs).drop("old_rev"), "new_rev")


@query("heaviest_edges_t7", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, status, src, dest, kind, weight FROM topedges WHERE rank = 1 AND weight >= CASE status WHEN 'added' THEN 5 ELSE 10 END""", ECHANGES, TOPEDGES))
def _(h):
    return _big(G.heaviest_changes(h.edges, h.pairs).drop("old_rev"), "new_rev")


@query("fan_changes_j3", sql("""
    SELECT p.repo, CAST(p.new_rev AS BIGINT) AS new_rev, f.node, sum(CASE WHEN f.rev = p.new_rev THEN fan_in ELSE -fan_in END) AS fan_in_delta,
      sum(CASE WHEN f.rev = p.new_rev THEN fan_out ELSE -fan_out END) AS fan_out_delta
    FROM pairs p JOIN fan f ON f.repo = p.repo AND (f.rev = p.new_rev OR f.rev = p.old_rev) GROUP BY ALL""", FAN))
def _(h):
    return _big(G.fan_changes(h.edges, h.pairs).drop("old_rev"), "new_rev")


@query("top_fan_changes_t2", sql("SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, direction, node, round(delta, 2) AS delta, rank FROM topfan WHERE rank <= 15", FANDIR))
def _(h):
    return _big(G.top_fan_changes(h.edges, h.pairs).drop("old_rev"), "new_rev")


@query("reachability_g1", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, src, count(*) AS reached, max(dest) AS last FROM reach GROUP BY ALL", LINKS, REACH))
def _(h):
    h = h.stored("lines", "nodes", "edges")
    rows = G.reachability(h.nodes, h.edges).groupBy("repo", "rev", "src").agg(F.count(F.lit(1)).alias("reached"), F.max("dest").alias("last"))
    return _big(rows, "rev")


PC = """pcost AS (SELECT n.repo, n.rev, round(coalesce(k, 0) / (n.n * n.n), 9) AS pc_matrix, round(coalesce(others, 0) / (n.n * (n.n - 1)), 9) AS pc_reach,
    coalesce(k, 0) / (n.n * n.n) AS pc FROM (SELECT repo, rev, count(*)::DOUBLE AS n FROM nodes GROUP BY ALL) n
  LEFT JOIN (SELECT repo, rev, count(*) AS k, count(*) FILTER (src <> dest) AS others FROM reach GROUP BY ALL) r ON n.repo = r.repo AND n.rev = r.rev)"""


ASKED = """asked AS (SELECT DISTINCT e.repo, e.rev, e.src, e.dest FROM (SELECT p.repo, p.new_rev AS rev, e.src, e.dest FROM pairs p JOIN edges e ON e.repo = p.repo AND e.rev = p.old_rev) e)"""


@query("asked_reachability_g1", sql("""
    SELECT a.repo, CAST(a.rev AS BIGINT) AS rev, a.src, a.dest, r.src IS NOT NULL AS reached FROM asked a LEFT JOIN reach r ON r.repo = a.repo AND r.rev = a.rev AND r.src = a.src AND r.dest = a.dest""", LINKS, REACH, ASKED))
def _(h):
    """Whether the edges of the older revision still have a path in the newer one."""
    h = h.stored("nodes", "edges")
    older = h.edges.withColumnRenamed("rev", "old_rev").join(h.pairs, ["repo", "old_rev"])
    asked = older.select("repo", F.col("new_rev").alias("rev"), "src", "dest").distinct()
    return _big(G.reaches(asked, h.nodes, h.edges), "rev")


@query("propagation_cost_g2_g3", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, pc_matrix, pc_reach FROM pcost", LINKS, REACH, PC))
def _(h):
    h = h.stored("lines", "nodes", "edges")
    rows = G.propagation_cost(h.nodes, h.edges)
    return _big(rows.select("repo", "rev", *[F.round(c, 9).alias(c) for c in ("pc_matrix", "pc_reach")]), "rev")


@query("strong_components_g4", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, component, node FROM scc", LINKS, REACH, SCC))
def _(h):
    return _big(G.scc_members(h.edges), "rev")


@query("component_summary_g5", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, scc_count, largest AS largest_scc_size FROM sccsum", LINKS, REACH, SCC, SCCSUM))
def _(h):
    return _big(G.scc_summary(G.scc_members(h.edges), h.revisions), "rev")


@query("component_counts_a11", sql("""
    SELECT s.repo, s.node, count(*) AS scc_count FROM scc s JOIN pairs p ON s.repo = p.repo AND (s.rev = p.new_rev OR s.rev = p.old_rev) GROUP BY ALL""", LINKS, REACH, SCC))
def _(h):
    return G.scc_counts(G.scc_members(h.edges), h.pairs)


KINDS = """kinds AS (SELECT repo, rev, sum(w) AS total, string_agg(concat(kind, '=', w), ', ' ORDER BY kind) AS by_kind FROM (
  SELECT repo, rev, kind, round(sum(weight), 2) AS w FROM edges GROUP BY ALL) GROUP BY ALL)"""


@query("graph_diff_g6", sql(f"""
    SELECT {PAIR_SQL}, a.n AS nodes_new, b.n AS nodes_old, kn.total AS weight_new, ko.total AS weight_old, kn.by_kind AS by_kind_new, ko.by_kind AS by_kind_old,
      sn.scc_count AS scc_count_new, so.scc_count AS scc_count_old, sn.largest AS largest_scc_new, so.largest AS largest_scc_old,
      (SELECT string_agg(concat(src, '>', dest, '=', weight), ';' ORDER BY rank) FROM topedges t WHERE t.repo = p.repo AND t.new_rev = p.new_rev AND status = 'added' AND rank <= 25) AS added,
      (SELECT string_agg(concat(node, '=', round(delta, 2)), ';' ORDER BY rank) FROM topfan t WHERE t.repo = p.repo AND t.new_rev = p.new_rev AND direction = 'fan_in' AND rank <= 15) AS fan_in_top
    FROM pairs p JOIN (SELECT repo, rev, count(*) AS n FROM nodes GROUP BY ALL) a ON a.repo = p.repo AND a.rev = p.new_rev
    JOIN (SELECT repo, rev, count(*) AS n FROM nodes GROUP BY ALL) b ON b.repo = p.repo AND b.rev = p.old_rev
    JOIN kinds kn ON kn.repo = p.repo AND kn.rev = p.new_rev JOIN kinds ko ON ko.repo = p.repo AND ko.rev = p.old_rev
    JOIN sccsum sn ON sn.repo = p.repo AND sn.rev = p.new_rev JOIN sccsum so ON so.repo = p.repo AND so.rev = p.old_rev""",
    LINKS, REACH, SCC, SCCSUM, KINDS, ECHANGES, TOPEDGES, FANDIR))
def _(h):
    h = h.stored("lines", "nodes", "edges")
    d = G.graph_diff(h.nodes, h.edges, h.pairs)
    edge = F.array_join(F.transform("edges_added", lambda e: F.concat(e["src"], F.lit(">"), e["dest"], F.lit("="), e["weight"])), ";")
    fan = F.array_join(F.transform("fan_in_top", lambda e: F.concat(e["node"], F.lit("="), e["delta"])), ";")
    counts = ("nodes_new", "nodes_old", "scc_count_new", "scc_count_old", "largest_scc_new", "largest_scc_old")
    rows = d.select("repo", "new_rev", *counts, "weight_new", "weight_old", "by_kind_new", "by_kind_old", edge.alias("added"), fan.alias("fan_in_top"))
    return _big(rows, "new_rev", *counts)


# --- co-change -------------------------------------------------------------------

COARSE = "coarse AS (SELECT DISTINCT repo, hash, concat('P', p_brand, p_type) AS file FROM lines)"
FINE = "fine AS (SELECT DISTINCT f.repo, f.hash, f.node AS file FROM file_changes f JOIN placed p ON f.repo = p.repo AND f.hash = p.hash)"
COPAIRS = """copairs AS (SELECT a.repo, a.file AS file_a, b.file AS file_b, count(*) AS n FROM {t} a JOIN {t} b ON a.repo = b.repo AND a.hash = b.hash AND a.file < b.file
  GROUP BY ALL HAVING count(*) >= {k})"""
PARTNERS = """partners AS (SELECT repo, file, count(*) AS partners FROM (SELECT repo, unnest([file_a, file_b]) AS file FROM copairs c WHERE NOT EXISTS (
    SELECT 1 FROM edges e WHERE e.repo = c.repo AND e.rev = 1 AND ((e.src = c.file_a AND e.dest = c.file_b) OR (e.src = c.file_b AND e.dest = c.file_a)))) GROUP BY ALL)"""


def _coarse(h):
    return h.lines.select("repo", "hash", F.concat(F.lit("P"), "p_brand", "p_type").alias("file"))


def _fine(h):
    from chronolith.operators.history import assign_windows

    inside = assign_windows(h.commits, h.windows).select("repo", "hash")
    return h.file_changes.join(inside, ["repo", "hash"], "left_semi").select("repo", "hash", normalise_path(F.col("path")).alias("file"))


def _declared(h):
    return h.edges.filter(F.col("rev") == 1).select("repo", "src", "dest")


@query("cochange_pairs_j5", sql("SELECT * FROM copairs", COARSE, COPAIRS.format(t="coarse", k=3)))
def _(h):
    return K.cochange_pairs(_coarse(h), 3)


@query("cochange_pairs_bulk_j5", sql("SELECT * FROM copairs", COARSE, COPAIRS.format(t="coarse", k=4)))
def _(h):
    # commits of more than four files go the class-based way
    return K.cochange_pairs(_coarse(h), 4, block=4)


@query("cochange_partners_j6_a12", sql("SELECT * FROM partners", FINE, COPAIRS.format(t="fine", k=2), PARTNERS))
def _(h):
    return K.cochange_partners(_fine(h), _declared(h), 2)


@query("cochange_partners_bulk_j6_a12", sql("SELECT * FROM partners", FINE, COPAIRS.format(t="fine", k=2), PARTNERS))
def _(h):
    return K.cochange_partners(_fine(h), _declared(h), 2, block=5)


# --- clusterings -------------------------------------------------------------------

MOVES = """moves AS (SELECT repo, new_rev, file, CASE WHEN ol IS NULL THEN 'added' WHEN nl IS NULL THEN 'removed' WHEN ol <> nl THEN 'moved_layer'
    WHEN om <> nm THEN 'moved_module' ELSE 'same' END AS status, ol, nl, om, nm FROM (
  SELECT p.repo, p.new_rev, l.file, max(CASE WHEN l.rev = p.old_rev THEN layer END) AS ol, max(CASE WHEN l.rev = p.new_rev THEN layer END) AS nl,
    max(CASE WHEN l.rev = p.old_rev THEN module_path END) AS om, max(CASE WHEN l.rev = p.new_rev THEN module_path END) AS nm
  FROM pairs p JOIN locations l ON l.repo = p.repo AND (l.rev = p.new_rev OR l.rev = p.old_rev) GROUP BY ALL))"""


@query("clustering_moves_j4", sql("SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, file, status, ol AS old_layer, nm AS new_module FROM moves", MOVES))
def _(h):
    return _big(L.file_moves(h.locations, h.pairs).select("repo", "new_rev", "file", "status", "old_layer", "new_module"), "new_rev")


@query("clustering_move_counts_j4", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, count(*) FILTER (status = 'added') AS added_files, count(*) FILTER (status = 'removed') AS removed_files,
      count(*) FILTER (status = 'moved_layer') AS moved_layers, count(*) FILTER (status = 'moved_module') AS moved_modules, count(ol) AS files_old, count(nl) AS files_new
    FROM moves GROUP BY 1, 2""", MOVES))
def _(h):
    return _big(L.move_counts(L.file_moves(h.locations, h.pairs)).drop("old_rev"), "new_rev")


@query("clustering_move_samples_j4", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, status, file, om AS old_module, nm AS new_module, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, new_rev, status ORDER BY file) AS rank FROM moves WHERE status LIKE 'moved%') WHERE rank <= 25""", MOVES))
def _(h):
    rows = L.move_samples(L.file_moves(h.locations, h.pairs))
    return _big(rows.select("repo", "new_rev", "status", "file", "old_module", "new_module", "rank"), "new_rev")


@query("file_sets_u2", sql("""
    SELECT p.repo, CAST(p.new_rev AS BIGINT) AS new_rev, (SELECT count(*) FROM (SELECT file FROM locations WHERE repo = p.repo AND rev = p.new_rev EXCEPT SELECT file FROM locations WHERE repo = p.repo AND rev = p.old_rev)) AS only_new,
      (SELECT count(*) FROM (SELECT file FROM locations WHERE repo = p.repo AND rev = p.old_rev EXCEPT SELECT file FROM locations WHERE repo = p.repo AND rev = p.new_rev)) AS only_old,
      (SELECT count(*) FROM (SELECT file FROM locations WHERE repo = p.repo AND rev = p.old_rev INTERSECT SELECT file FROM locations WHERE repo = p.repo AND rev = p.new_rev)) AS common FROM pairs p"""))
def _(h):
    return _big(L.file_sets(h.locations, h.pairs).drop("old_rev"), "new_rev")


@query("layer_sizes_a14", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, layer, count(*) AS files FROM locations GROUP BY ALL"))
def _(h):
    return _big(L.layer_sizes(h.locations), "rev")


@query("largest_modules_a14", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, module_path, files, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY files DESC, module_path) AS rank
      FROM (SELECT repo, rev, module_path, count(*) AS files FROM locations GROUP BY ALL)) WHERE rank <= 10"""))
def _(h):
    return _big(L.largest_modules(h.locations), "rev")


@query("layer_modules_a14_g12", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, CAST(layer_no AS BIGINT) AS layer_no, count(DISTINCT module_no) AS modules FROM locations GROUP BY ALL"))
def _(h):
    return _big(L.layer_module_counts(h.locations), "rev", "layer_no")


BALANCE = """balance AS (SELECT repo, rev, 1.0 / (1.0 + var_pop(n)) AS approx_balance, count(*) AS module_count FROM (
  SELECT repo, rev, layer_no, module_no, count(*) AS n FROM locations GROUP BY ALL) GROUP BY ALL)"""


@query("module_balance_a15", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, round(approx_balance, 9) AS approx_balance, module_count FROM balance", BALANCE))
def _(h):
    return _big(L.module_balance(h.locations).withColumn("approx_balance", F.round("approx_balance", 9)), "rev")


# --- modularity --------------------------------------------------------------------

EXTENT = """extent AS (SELECT repo, rev, layer_no, files, CAST(sum(files) OVER (PARTITION BY repo, rev) AS BIGINT) AS total,
    CAST(sum(files) OVER (PARTITION BY repo, rev) - sum(files) OVER (PARTITION BY repo, rev ORDER BY layer_no) AS BIGINT) AS low,
    CAST(sum(files) OVER (PARTITION BY repo, rev ORDER BY layer_no) - files AS BIGINT) AS up
  FROM (SELECT repo, rev, layer_no, count(*) AS files FROM {loc} GROUP BY ALL))"""
MEDGES = """medges AS (SELECT e.repo, e.rev, d.layer_no, d.module_no, count(*) FILTER (s.k = d.k) AS internal_edges, count(*) FILTER (d.k < s.k) AS conforming_deps
  FROM (SELECT DISTINCT repo, rev, src, dest FROM edges) e
  JOIN (SELECT *, concat(layer_no, ',', module_no) AS k FROM {loc}) s ON s.repo = e.repo AND s.rev = e.rev AND s.file = e.src
  JOIN (SELECT *, concat(layer_no, ',', module_no) AS k FROM {loc}) d ON d.repo = e.repo AND d.rev = e.rev AND d.file = e.dest GROUP BY ALL)"""
MSCORES = """mscores AS (SELECT *, sf * sp * (1 - cross_penalty) * (1 - internal_penalty) AS contribution FROM (
  SELECT m.repo, m.rev, m.layer_no, m.module_no, m.n AS module_size, m.n / total::DOUBLE AS sf, CASE WHEN m.n <= 5 THEN 1.0::DOUBLE ELSE ln(5.0) / ln(m.n::DOUBLE) END AS sp,
    CASE WHEN low = 0 THEN 0.0::DOUBLE ELSE coalesce(conforming_deps, 0) / (low * m.n)::DOUBLE END AS cross_penalty,
    CASE WHEN m.n <= 5 THEN 0.0::DOUBLE ELSE coalesce(internal_edges, 0) / (m.n * (m.n - 1))::DOUBLE END AS internal_penalty
  FROM (SELECT repo, rev, layer_no, module_no, count(*) AS n FROM {loc} GROUP BY ALL) m
  JOIN extent x ON x.repo = m.repo AND x.rev = m.rev AND x.layer_no = m.layer_no
  LEFT JOIN medges e ON e.repo = m.repo AND e.rev = m.rev AND e.layer_no = m.layer_no AND e.module_no = m.module_no))"""
SCORE = [t.format(loc="locations") for t in (EXTENT, MEDGES, MSCORES)]
SUBSET = "sub AS (SELECT * FROM locations WHERE p_type IN ('ECONOMY', 'LARGE', 'SMALL'))"
SUBSCORE = [SUBSET] + [t.format(loc="sub") for t in (EXTENT, MEDGES, MSCORES)]
MTOTAL = """SELECT repo, CAST(rev AS BIGINT) AS rev, round(sum(contribution), 9) AS mscore, CAST(sum(module_size) AS BIGINT) AS total_files, count(*) AS num_modules,
  round(sum(sf), 9) AS size_factor_total, round(avg(1 - cross_penalty), 9) AS avg_clddf, round(avg(1 - internal_penalty), 9) AS avg_imcf FROM mscores GROUP BY 1, 2"""


@query("layer_extents_w4", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, CAST(layer_no AS BIGINT) AS layer_no, files, low AS lower_files, up AS upper_files FROM extent", SCORE[0]))
def _(h):
    return _big(M.layer_extents(h.locations).drop("total_files"), "rev", "layer_no")


@query("module_edges_j12", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, CAST(layer_no AS BIGINT) AS layer_no, CAST(module_no AS BIGINT) AS module_no, internal_edges, conforming_deps FROM medges", SCORE[1]))
def _(h):
    return _big(M.module_edges(h.locations, h.edges), "rev", "layer_no", "module_no")


@query("module_scores_g8", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, CAST(layer_no AS BIGINT) AS layer_no, CAST(module_no AS BIGINT) AS module_no, module_size, round(sf, 9) AS size_factor,
      round(sp, 9) AS size_penalty, round(cross_penalty, 9) AS cross_penalty, round(internal_penalty, 9) AS internal_penalty, round(contribution, 9) AS contribution FROM mscores""", *SCORE))
def _(h):
    rows = M.module_scores(h.locations, h.edges)
    numbers = ("size_factor", "size_penalty", "cross_penalty", "internal_penalty", "contribution")
    return _big(rows.select("repo", "rev", "layer_no", "module_no", "module_size", *[F.round(c, 9).alias(c) for c in numbers]), "rev", "layer_no", "module_no")


def _mscore(rows):
    numbers = ("mscore", "size_factor_total", "avg_clddf", "avg_imcf")
    return _big(M.mscore(rows).select("repo", "rev", "total_files", "num_modules", *[F.round(c, 9).alias(c) for c in numbers]), "rev")


@query("mscore_g8", sql(MTOTAL, *SCORE))
def _(h):
    return _mscore(M.module_scores(h.locations, h.edges))


@query("mscore_subset_g9", sql(MTOTAL, *SUBSCORE))
def _(h):
    subset = h.nodes.filter(F.col("p_type").isin("ECONOMY", "LARGE", "SMALL")).select("repo", "rev", F.col("node").alias("file"))
    return _mscore(M.module_scores(h.locations, h.edges, subset))


IL = """ilevel AS (SELECT n.repo, n.rev, max_by(l.files, l.layer_no) / any_value(n.n)::DOUBLE AS il FROM (SELECT repo, rev, count(*) AS n FROM nodes GROUP BY ALL) n
  JOIN (SELECT repo, rev, layer_no, count(*) AS files FROM locations GROUP BY ALL) l ON l.repo = n.repo AND l.rev = n.rev GROUP BY ALL)"""


@query("independence_level_g7", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, round(il, 9) AS independence_level FROM ilevel", IL))
def _(h):
    rows = M.independence_level(M.named_layers(h.groups), h.nodes)
    return _big(rows.withColumn("independence_level", F.round("independence_level", 9)), "rev")


APPROX = """leaf AS (SELECT g.repo, g.rev, CAST(substring(split_part(name, '/', 1), 2) AS INTEGER) AS layer_no, name, file FROM groups g
  WHERE contains(name, '/M') AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT repo, rev, name FROM groups) o WHERE o.repo = g.repo AND o.rev = g.rev AND starts_with(o.name, concat(g.name, '/')))),
ncount AS (SELECT repo, rev, count(*) AS nn FROM nodes GROUP BY ALL),
depth AS (SELECT repo, rev, count(DISTINCT layer_no) AS depth FROM locations GROUP BY ALL),
modn AS (SELECT repo, rev, layer_no, name, count(*) AS n FROM leaf GROUP BY ALL),
lown AS (SELECT m.repo, m.rev, m.layer_no, m.name, count(l.file) AS lower FROM modn m JOIN depth d ON d.repo = m.repo AND d.rev = m.rev
  LEFT JOIN locations l ON l.repo = m.repo AND l.rev = m.rev AND l.layer_no > m.layer_no AND l.layer_no < d.depth GROUP BY ALL),
downn AS (SELECT f.repo, f.rev, f.layer_no, f.name, count(*) FILTER (t.layer_no > f.layer_no AND t.layer_no < d.depth) AS down,
    count(*) FILTER (g.name = f.name AND e.src <> e.dest) AS inner_deps
  FROM leaf f JOIN (SELECT DISTINCT repo, rev, src, dest FROM edges) e ON e.repo = f.repo AND e.rev = f.rev AND e.src = f.file
  JOIN locations t ON t.repo = e.repo AND t.rev = e.rev AND t.file = e.dest JOIN leaf g ON g.repo = e.repo AND g.rev = e.rev AND g.file = e.dest
  JOIN depth d ON d.repo = e.repo AND d.rev = e.rev GROUP BY ALL),
amods AS (SELECT m.repo, m.rev, m.layer_no, m.name, m.n, nn, m.n / nn::DOUBLE * CASE WHEN m.n >= 5 THEN ln(5.0) / ln(m.n::DOUBLE) ELSE 1.0::DOUBLE END AS sf,
    CASE WHEN m.layer_no < depth - 1 AND lower > 0 THEN coalesce(down, 0) / (m.n * lower)::DOUBLE ELSE 0.0::DOUBLE END AS clddp,
    CASE WHEN m.n >= 5 THEN coalesce(inner_deps, 0) / (m.n * (m.n - 1))::DOUBLE ELSE 0.0::DOUBLE END AS imcp
  FROM modn m JOIN ncount c ON c.repo = m.repo AND c.rev = m.rev JOIN depth d ON d.repo = m.repo AND d.rev = m.rev
  JOIN lown l ON l.repo = m.repo AND l.rev = m.rev AND l.name = m.name LEFT JOIN downn x ON x.repo = m.repo AND x.rev = m.rev AND x.name = m.name),
approx AS (SELECT repo, rev, nn, sum(sf * (1 - clddp) * (1 - imcp)) AS raw, sum(sf) AS total_sf, avg(1 - clddp) AS avg_clddf, avg(1 - imcp) AS avg_imcf, count(*) AS module_count,
    sum(sf * (1 - clddp) * (1 - imcp)) * 100 * CASE WHEN nn < 1000 THEN 0.6258 WHEN nn < 5000 THEN 0.6258 + (nn - 1000) / 4000.0::DOUBLE * (0.8446 - 0.6258) ELSE 0.8446 END AS mscore
  FROM amods GROUP BY repo, rev, nn)"""


@query("approximate_modules_j13", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, name, n AS module_files, round(sf, 9) AS sf, round(clddp, 9) AS clddp, round(imcp, 9) AS imcp FROM amods""", APPROX))
def _(h):
    h = h.stored("lines", "nodes", "edges", "locations", "groups")
    rows = M.approximate_modules(h.groups, h.nodes, h.edges)
    return _big(rows.select("repo", "rev", "name", "module_files", *[F.round(c, 9).alias(c) for c in ("sf", "clddp", "imcp")]), "rev")


@query("approximate_mscore_g10", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, module_count, round(raw, 8) AS mscore_raw, round(mscore, 6) AS mscore, round(total_sf, 8) AS total_sf, round(avg_clddf, 8) AS avg_clddf,
      round(avg_imcf, 8) AS avg_imcf FROM approx""", APPROX))
def _(h):
    h = h.stored("lines", "nodes", "edges", "locations", "groups")
    rows = M.approximate_mscore(M.approximate_modules(h.groups, h.nodes, h.edges))
    numbers = {"mscore_raw": 8, "mscore": 6, "total_sf": 8, "avg_clddf": 8, "avg_imcf": 8}
    return _big(rows.select("repo", "rev", "module_count", *[F.round(c, d).alias(c) for c, d in numbers.items()]), "rev")


@query("calculated_vs_reported_g11", sql("""
    SELECT a.repo, CAST(a.rev AS BIGINT) AS rev, round(abs(p.pc * 100 - w.pc), 6) AS pc_gap, round(abs(i.il * 100 - w.il), 6) AS il_gap, round(abs(a.mscore - w.ms), 6) AS mscore_gap
    FROM approx a JOIN pcost p ON a.repo = p.repo AND a.rev = p.rev JOIN ilevel i ON a.repo = i.repo AND a.rev = i.rev JOIN mwide w ON a.repo = w.repo AND a.rev = w.rev""",
    LINKS, REACH, PC, IL, APPROX))
def _(h):
    h = h.stored("lines", "nodes", "edges", "locations")
    calculated = (
        M.approximate_mscore(M.approximate_modules(h.groups, h.nodes, h.edges)).select("repo", "rev", "mscore")
        .join(G.propagation_cost(h.nodes, h.edges).select("repo", "rev", F.col("pc_matrix").alias("pc")), ["repo", "rev"])
        .join(M.independence_level(M.named_layers(h.groups), h.nodes).withColumnRenamed("independence_level", "il"), ["repo", "rev"]))
    reported = h.metrics_wide.select("repo", "rev", F.col("`propagation-cost`").alias("propagation_cost"), F.col("`independence-level`").alias("independence_level"), F.col("`m-score`").alias("m_score"))
    rows = M.compare_reported(calculated, reported)
    return _big(rows.select("repo", "rev", *[F.round(c, 6).alias(c) for c in ("pc_gap", "il_gap", "mscore_gap")]), "rev")


@query("revision_metrics_c14", sql("""
    SELECT m.repo, CAST(m.rev AS BIGINT) AS rev, round(sum(contribution) * 100, 6) AS series_mscore, round(any_value(p.pc_matrix), 9) AS pc_matrix, round(any_value(p.pc_reach), 9) AS pc_reach,
      round(any_value(i.il), 9) AS independence_level, round(any_value(b.approx_balance), 9) AS approx_balance, round(avg(1 - cross_penalty), 9) AS avg_clddf
    FROM mscores m JOIN pcost p ON m.repo = p.repo AND m.rev = p.rev JOIN ilevel i ON m.repo = i.repo AND m.rev = i.rev JOIN balance b ON m.repo = b.repo AND m.rev = b.rev
    GROUP BY m.repo, m.rev""", LINKS, REACH, PC, IL, BALANCE, *SCORE))
def _(h):
    h = h.stored("revisions", "lines", "nodes", "edges", "locations")
    reported = h.metrics_wide.select("repo", "rev", F.col("`m-score`").alias("m_score"))
    rows = M.revision_metrics(
        M.mscore(M.module_scores(h.locations, h.edges)), G.propagation_cost(h.nodes, h.edges),
        M.independence_level(M.named_layers(h.groups), h.nodes), L.module_balance(h.locations), reported)
    numbers = {"series_mscore": 6, "pc_matrix": 9, "pc_reach": 9, "independence_level": 9, "approx_balance": 9, "avg_clddf": 9}
    return _big(rows.select("repo", "rev", *[F.round(c, d).alias(c) for c, d in numbers.items()]), "rev")


# --- ranked modules ----------------------------------------------------------------

PENALTIES = """penalties AS (SELECT *, row_number() OVER (PARTITION BY repo, rev, kind ORDER BY penalty DESC, layer_no, module_no) AS rank FROM (
  SELECT *, 'cross' AS kind, cross_penalty AS penalty FROM mscores UNION ALL SELECT *, 'internal', internal_penalty FROM mscores))"""


@query("top_penalty_modules_t4", sql("""
    SELECT p.repo, CAST(p.rev AS BIGINT) AS rev, kind, rank, CAST(p.layer_no AS BIGINT) AS layer_no, CAST(p.module_no AS BIGINT) AS module_no, round(penalty, 9) AS penalty, f.files
    FROM penalties p JOIN (SELECT repo, rev, layer_no, module_no, string_agg(file, ',' ORDER BY k) AS files FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, rev, layer_no, module_no ORDER BY file) AS k FROM locations) WHERE k <= 6 GROUP BY ALL) f
      ON f.repo = p.repo AND f.rev = p.rev AND f.layer_no = p.layer_no AND f.module_no = p.module_no WHERE rank <= 7""", *SCORE, PENALTIES))
def _(h):
    rows = R.top_penalties(M.module_scores(h.locations, h.edges)).join(M.sample_files(h.locations, 6), ["repo", "rev", "layer_no", "module_no"])
    rows = rows.select("repo", "rev", "kind", "rank", "layer_no", "module_no", F.round("penalty", 9).alias("penalty"), F.array_join("files", ",").alias("files"))
    return _big(rows, "rev", "layer_no", "module_no")


@query("refactoring_hotspot_t5", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, CAST(layer_no AS BIGINT) AS layer_no, CAST(module_no AS BIGINT) AS module_no, round(weight, 6) AS weight FROM (
      SELECT *, penalty * module_size AS weight, row_number() OVER (PARTITION BY repo, rev ORDER BY penalty * module_size DESC, rank) AS k FROM penalties WHERE kind = 'cross' AND rank <= 7)
    WHERE k = 1""", *SCORE, PENALTIES))
def _(h):
    rows = R.refactoring_hotspot(R.top_penalties(M.module_scores(h.locations, h.edges)))
    return _big(rows.select("repo", "rev", "layer_no", "module_no", F.round("weight", 6).alias("weight")), "rev", "layer_no", "module_no")


WORST = """worst AS (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY round({by}, 9) DESC, layer_no, module_no) AS rank FROM mscores WHERE rev <= 5)"""


@query("worst_modules_t6", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, CAST(layer_no AS BIGINT) AS layer_no, CAST(module_no AS BIGINT) AS module_no, rank, round(contribution, 9) AS contribution FROM worst WHERE rank <= 5""",
    *SCORE, WORST.format(by="contribution")))
def _(h):
    rows = R.worst_modules(M.module_scores(h.locations, h.edges))
    return _big(rows.select("repo", "rev", "layer_no", "module_no", "rank", F.round("contribution", 9).alias("contribution")), "rev", "layer_no", "module_no")


@query("worst_modules_by_penalty_t6", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, CAST(layer_no AS BIGINT) AS layer_no, CAST(module_no AS BIGINT) AS module_no, rank FROM worst WHERE rank <= 5""",
    *SCORE, WORST.format(by="cross_penalty * sf")))
def _(h):
    rows = R.worst_modules(M.module_scores(h.locations, h.edges), rank_by="cross_penalty_x_size")
    return _big(rows.select("repo", "rev", "layer_no", "module_no", "rank"), "rev", "layer_no", "module_no")


@query("worst_module_lines_j14", sql("""
    SELECT w.repo, CAST(w.rev AS BIGINT) AS rev, w.rank, concat('  - Layer ', w.layer_no, ' / Module ', w.module_no, ': contribution=', format('{:.4f}', contribution),
      ' (cross_penalty=', format('{:.3f}', cross_penalty), ', size=', module_size, ' files) | files: ', files) AS line
    FROM worst w JOIN (SELECT l.repo, l.rev, l.layer_no, l.module_no, string_agg(CASE WHEN k = 4 THEN '...' WHEN f.node IS NULL THEN split_part(l.file, '/', -1)
        ELSE concat(split_part(l.file, '/', -1), '(FanIn=', CAST(fan_in AS BIGINT), ',FanOut=', CAST(fan_out AS BIGINT), ')') END, ', ' ORDER BY k) AS files
      FROM (SELECT *, row_number() OVER (PARTITION BY repo, rev, layer_no, module_no ORDER BY file) AS k FROM locations) l
      LEFT JOIN fan f ON f.repo = l.repo AND f.rev = l.rev AND split_part(f.node, '/', -1) = split_part(l.file, '/', -1) WHERE k <= 4 GROUP BY ALL) f
      ON f.repo = w.repo AND f.rev = w.rev AND f.layer_no = w.layer_no AND f.module_no = w.module_no WHERE rank <= 5""", *SCORE, WORST.format(by="contribution"), FAN))
def _(h):
    worst = R.worst_modules(M.module_scores(h.locations, h.edges))
    fans = G.fans(h.edges).select("repo", "rev", F.col("node").alias("file"), "fan_in", "fan_out", F.lit(0).alias("ord"))
    files = M.sample_files(h.locations, 4).join(worst.select("repo", "rev", "layer_no", "module_no"), ["repo", "rev", "layer_no", "module_no"], "left_semi")
    return _big(R.worst_modules_text(worst, R.module_files_text(files, fans)), "rev")
