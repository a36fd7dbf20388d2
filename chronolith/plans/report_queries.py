"""Queries over transition reports, revision payloads and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions.text import normalise_path
from chronolith.operators import clustering as L
from chronolith.operators import graph as G
from chronolith.operators import history as H
from chronolith.operators import modularity as M
from chronolith.operators import reports as R
from chronolith.operators import risk as K
from chronolith.operators import verify as V
from chronolith.operators.common import PAIR
from chronolith.plans.graph_queries import ECHANGES, FAN, FANDIR, HOT, LINKS, MOVES, PENALTIES, REACH, SCC, SCCSUM, SCORE, TOPEDGES, _big
from chronolith.plans.history_queries import DELTAS, KEYROWS, ORD, PERIOD, PTYPED, RECENT, SUMMARY_SQL, TOTALS, TYPED
from chronolith.plans.oracle import sql
from chronolith.plans.registry import query, uncut
from chronolith.plans.risk_queries import CHURN10, HOT10
from chronolith.session import cut_lineage

FILES = "SELECT repo, new_rev, count(ol) AS files_old, count(nl) AS files_new FROM moves GROUP BY 1, 2"
LINE = """lines_text AS (SELECT d.repo, d.new_rev, string_agg(concat(metric, ': ', round(old_value, 2), ' → ', round(new_value, 2), ' (Δ=', format('{:+.2f}', delta), ' points',
    CASE WHEN relative IS NULL THEN '' ELSE concat(', ', format('{:+.2f}', relative), '% relative') END, ')'), ' | ' ORDER BY list_position(['m-score', 'propagation-cost', 'decoupling-level', 'independence-level'], metric)) AS metrics
  FROM deltas d WHERE raw IS NOT NULL GROUP BY 1, 2)"""
OVERALL = """overall AS (SELECT p.repo, p.new_rev, concat('- transition old=rev', p.old_rev, ' (', strftime(o.commit_ts, '%Y-%m-%d'), ' `', substring(o.commit_hash, 1, 7), '`) → new=rev', p.new_rev, ' (',
    strftime(n.commit_ts, '%Y-%m-%d'), ' `', substring(n.commit_hash, 1, 7), '`): ', substring(n.message, 1, 80)) AS headline, metrics,
    concat(files_old, ' → ', files_new, ' (Δ=', format('{:+d}', files_new - files_old), ')') AS files
  FROM pairs p JOIN revisions n ON n.repo = p.repo AND n.rev = p.new_rev JOIN revisions o ON o.repo = p.repo AND o.rev = p.old_rev
  LEFT JOIN lines_text t ON t.repo = p.repo AND t.new_rev = p.new_rev LEFT JOIN (""" + FILES + """) f ON f.repo = p.repo AND f.new_rev = p.new_rev)"""


def _move_counts(h):
    return L.move_counts(L.file_moves(h.locations, h.pairs))


@query("overall_lines_c6", sql("SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, headline, metrics, files FROM overall", DELTAS, LINE, MOVES, OVERALL))
def _(h):
    rows = R.overall_lines(H.metric_changes(h.metrics), h.revisions, _move_counts(h).select(*PAIR, "files_old", "files_new"))
    return _big(rows.drop("old_rev"), "new_rev")


@query("overall_text_c6", sql("""
    SELECT repo, string_agg(concat_ws(chr(10), headline, concat('  - metrics: ' || metrics), concat('  - DRH file count: ' || files)), chr(10) ORDER BY new_rev DESC) AS overall FROM (
      SELECT * FROM overall WHERE metrics IS NOT NULL UNION ALL SELECT repo, new_rev, headline, NULL, files FROM overall WHERE metrics IS NULL) GROUP BY repo""".replace("concat('  - metrics: ' || metrics)", "'  - metrics: ' || metrics").replace("concat('  - DRH file count: ' || files)", "'  - DRH file count: ' || files"),
    DELTAS, LINE, MOVES, OVERALL))
def _(h):
    return R.overall_text(R.overall_lines(H.metric_changes(h.metrics), h.revisions, _move_counts(h).select(*PAIR, "files_old", "files_new")))


def _patterns(h):
    return R.anti_pattern_changes(R.anti_pattern_counts(h.anti_patterns), h.pairs)


def _dangerous(h):
    churn = K.churn_by_revision(h.placed, h.file_changes, 10).select("repo", "rev", normalise_path(F.col("path")).alias("node"), "churn")
    rows = G.hotspots(h.nodes.select("repo", "rev", "node"), h.edges).withColumnRenamed("rank", "ord").join(churn, ["repo", "rev", "node"], "left")
    return R.top_dangerous(rows.withColumnRenamed("node", "file"))


def _diff(h):
    members = cut_lineage(G.scc_members(h.edges))
    return G.graph_diff(h.nodes, h.edges, h.pairs, members), members


HINTS = """apc AS (SELECT p.repo, p.new_rev, type, count(*) FILTER (a.rev = p.new_rev) AS n, count(*) FILTER (a.rev = p.old_rev) AS o FROM pairs p
  JOIN anti_patterns a ON a.repo = p.repo AND (a.rev = p.new_rev OR a.rev = p.old_rev) GROUP BY ALL),
tw AS (SELECT p.repo, p.new_rev, sum(weight) FILTER (e.rev = p.new_rev) AS n, sum(weight) FILTER (e.rev = p.old_rev) AS o FROM pairs p
  JOIN edges e ON e.repo = p.repo AND (e.rev = p.new_rev OR e.rev = p.old_rev) GROUP BY ALL),
sccfirst AS (SELECT repo, rev, string_agg(split_part(node, '/', -1), ', ' ORDER BY node) AS names FROM (SELECT s.*, row_number() OVER (PARTITION BY s.repo, s.rev ORDER BY node) AS k FROM scc s
  JOIN (SELECT repo, rev, component, row_number() OVER (PARTITION BY repo, rev ORDER BY count(*) DESC, component) AS c FROM scc GROUP BY 1, 2, 3) b ON b.repo = s.repo AND b.rev = s.rev AND b.component = s.component
    AND b.c = 1) WHERE k <= 6 GROUP BY 1, 2),
hints AS (
  SELECT repo, new_rev, 2 AS rule, '' AS sub, CASE WHEN files_new > files_old THEN concat('DRH file count changed from ', files_old, ' to ', files_new, ' (delta=', format('{:+d}', files_new - files_old),
      '), consistent with decomposing large responsibilities into more files.') WHEN files_new < files_old THEN concat('DRH file count changed from ', files_old, ' to ', files_new, ' (delta=',
      format('{:+d}', files_new - files_old), '), consistent with consolidation into fewer units.') END AS hint FROM (SELECT repo, new_rev, count(ol) AS files_old, count(nl) AS files_new FROM moves GROUP BY 1, 2)
  UNION ALL SELECT repo, new_rev, 3, '', concat('Evidence graph total dependency weight changed from ', CAST(o AS BIGINT), ' to ', CAST(n AS BIGINT), ' (delta=', format('{:+d}', CAST(n - o AS BIGINT)),
      CASE WHEN n < o THEN '), aligning with reduced propagation cost.' ELSE '), suggesting more interconnections.' END) FROM tw WHERE n <> o
  UNION ALL SELECT p.repo, p.new_rev, 4, '', CASE WHEN n.scc_count < o.scc_count THEN concat('SCC count changed from ', o.scc_count, ' (largest=', o.largest, ' files',
      CASE WHEN f.names IS NULL THEN '' ELSE concat(': ', f.names) END, ') to ', n.scc_count, ', indicating fewer dependency cycles (supports lower propagation cost).')
      WHEN n.scc_count > o.scc_count THEN concat('SCC count changed from ', o.scc_count, ' to ', n.scc_count, ', indicating more dependency cycles.') END
    FROM pairs p JOIN sccsum n ON n.repo = p.repo AND n.rev = p.new_rev JOIN sccsum o ON o.repo = p.repo AND o.rev = p.old_rev LEFT JOIN sccfirst f ON f.repo = p.repo AND f.rev = p.old_rev
  UNION ALL SELECT repo, new_rev, CASE status WHEN 'removed' THEN 5 ELSE 6 END, '', concat('The heaviest ', status, ' edge was ', split_part(src, '/', -1), ' -> ', split_part(dest, '/', -1), ' (', kind, ' weight=',
      CAST(weight AS BIGINT), CASE status WHEN 'removed' THEN concat('), indicating a high-coupling dependency was eliminated.',
        CASE WHEN names IS NULL THEN '' ELSE concat(' The older revision had ', scc_count, ' SCC(s) containing ', names, '.') END) ELSE '), indicating new coupling was introduced.' END)
    FROM topedges t LEFT JOIN (SELECT repo AS r, rev AS v, names, scc_count FROM sccfirst JOIN sccsum USING (repo, rev)) o ON o.r = t.repo AND o.v = t.old_rev WHERE rank = 1 AND weight >= CASE status WHEN 'added' THEN 5 ELSE 10 END
  UNION ALL SELECT repo, new_rev, 7, type, concat('Anti-pattern ''', type, ''' count changed from ', o, ' to ', n, ' (delta=', format('{:+d}', n - o), ').') FROM apc WHERE n <> o
  UNION ALL SELECT repo, new_rev, 8, CAST(list_position(['m-score', 'propagation-cost', 'decoupling-level', 'independence-level'], metric) AS VARCHAR), concat(metric, ' changed from ', round(old_value, 2), ' to ',
      round(new_value, 2), ' (delta=', format('{:+.2f}', delta), ' points', CASE WHEN relative IS NULL THEN '' ELSE concat(', ', format('{:+.2f}', relative), '% relative') END, ').') FROM deltas WHERE raw IS NOT NULL)"""
HINT_TABLES = (DELTAS, MOVES, LINKS, REACH, SCC, SCCSUM, ECHANGES, TOPEDGES, HINTS)


@query("narrative_hints_c5", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, rank, hint FROM (SELECT *, row_number() OVER (PARTITION BY repo, new_rev ORDER BY rule, sub) AS rank FROM hints WHERE hint IS NOT NULL) WHERE rank <= 15""", *HINT_TABLES))
def _(h):
    return _narrative_hints(h, 15)


@query("narrative_hints_all_c5", uncut("narrative_hints_c5", " WHERE rank <= 15"))
def _(h):
    return _narrative_hints(h, None)


def _narrative_hints(h, cap):
    h = h.stored("lines", "nodes", "edges")
    diff, members = _diff(h)
    none = h.pairs.select(*PAIR, F.lit(0).alias("ord"), F.lit(None).cast("string").alias("file"))
    rows = R.narrative_hints(
        L.layer_sizes(h.locations), _move_counts(h), diff, members, G.heaviest_changes(h.edges, h.pairs), _patterns(h), H.metric_changes(h.metrics), R.allowed_files([none]), cap)
    return _big(rows.select("repo", "new_rev", "rank", "hint"), "new_rev")


@query("allowed_files_u4", sql("""
    SELECT repo, CAST(new_rev AS BIGINT) AS new_rev, file, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, new_rev ORDER BY s, ord, file) AS rank FROM (
      SELECT repo, new_rev, file, min(s) AS s, arg_min(ord, s * 1000 + ord) AS ord FROM (SELECT repo, new_rev, 0 AS s, rank AS ord, src AS file FROM topedges WHERE status = 'added' AND rank <= 25
        UNION ALL SELECT repo, new_rev, 1, rank, dest FROM topedges WHERE status = 'added' AND rank <= 25 UNION ALL SELECT repo, new_rev, 2, rank, node FROM topfan WHERE direction = 'fan_in' AND rank <= 15)
      GROUP BY 1, 2, 3)) WHERE rank <= 40""", ECHANGES, TOPEDGES, FANDIR))
def _(h):
    return _allowed_files(h, 40)


@query("allowed_files_all_u4", uncut("allowed_files_u4", " WHERE rank <= 40"))
def _(h):
    return _allowed_files(h, None)


def _allowed_files(h, cap):
    added = G.top_edge_changes(h.edges, h.pairs).filter(F.col("status") == "added")
    fan = G.top_fan_changes(h.edges, h.pairs).filter(F.col("direction") == "fan_in")
    source = lambda rows, c: rows.select(*PAIR, F.col("rank").alias("ord"), F.col(c).alias("file"))
    rows = R.allowed_files([source(added, "src"), source(added, "dest"), source(fan, "node")], cap)
    return _big(rows.select("repo", "new_rev", "file", "rank"), "new_rev")


@query("transition_facts_c4", sql("""
    SELECT p.repo, CAST(p.new_rev AS BIGINT) AS new_rev, max(delta) FILTER (metric = 'm-score') AS m_score_delta, max(relative) FILTER (metric = 'propagation-cost') AS propagation_cost_relative,
      any_value(m.moved) AS moved_layers, any_value(a.n) AS nodes_new, any_value(b.text) AS anti_patterns, any_value(c.commits) AS total_commits, any_value(s.scc_count) AS scc_count_new FROM pairs p
    JOIN deltas d ON d.repo = p.repo AND d.new_rev = p.new_rev JOIN (SELECT repo, new_rev, count(*) FILTER (status = 'moved_layer') AS moved FROM moves GROUP BY 1, 2) m ON m.repo = p.repo AND m.new_rev = p.new_rev
    JOIN (SELECT repo, rev, count(*) AS n FROM nodes GROUP BY ALL) a ON a.repo = p.repo AND a.rev = p.new_rev LEFT JOIN (SELECT repo, new_rev, string_agg(concat(type, '=', n), ', ' ORDER BY type) AS text FROM apc GROUP BY 1, 2) b
      ON b.repo = p.repo AND b.new_rev = p.new_rev JOIN (SELECT repo, new_rev, count(*) AS commits FROM placed GROUP BY 1, 2) c ON c.repo = p.repo AND c.new_rev = p.new_rev
    JOIN sccsum s ON s.repo = p.repo AND s.rev = p.new_rev GROUP BY 1, 2""", *HINT_TABLES))
def _(h):
    rows = _facts(h.stored("commits", "revisions", "lines", "file_changes", "nodes", "edges", "locations"))
    return _big(rows.select("repo", "new_rev", "m_score_delta", "propagation_cost_relative", "moved_layers", "nodes_new", "anti_patterns", "total_commits", "scc_count_new"),
                "new_rev", "moved_layers", "nodes_new", "total_commits", "scc_count_new")


def _facts(h, written=None, moves=None):
    """``written`` names the parts, all of few rows, that get a job of their own, with the columns that are read (all if None).

    So the plan stays short, the driver holds the broadcasts of one part at a time, and the readers of a part share it.
    """
    written = written or {}
    parts = {
        "changes": H.metric_changes(h.metrics), "moves": _move_counts(h) if moves is None else L.move_counts(moves), "diff": _diff(h)[0], "patterns": _patterns(h), "dangerous": _dangerous(h),
        "penalties": R.top_penalties(M.module_scores(h.locations, h.edges)).join(M.sample_files(h.locations, 6), R.MODULE),
        "commits": H.period_summary(h.commits, h.file_changes, h.windows),
        "typed": H.typed_totals(h.placed, h.file_changes, h.issues, PAIR),
    }
    read = lambda name, part: part if written[name] is None else part.select(*PAIR, *written[name])
    return R.transition_facts(**{name: cut_lineage(read(name, part)) if name in written else part for name, part in parts.items()})


TEXTS = """danger AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY coalesce(churn, 0) * 10 + CAST(trunc(fan_in) AS BIGINT) + CAST(trunc(fan_out) AS BIGINT) DESC, ord) AS k FROM (
    SELECT h.repo, h.rev, h.node AS file, h.rank AS ord, round(fan_in, 2) AS fan_in, round(fan_out, 2) AS fan_out, c.churn FROM hot10 h LEFT JOIN churn10 c ON c.repo = h.repo AND c.rev = h.rev AND c.file = h.node)) WHERE k <= 7),
dtext AS (SELECT repo, rev, string_agg(concat_ws(', ', 'Filename=' || file, 'FanIn=' || fan_in, 'FanOut=' || fan_out, 'ChangeChurn=' || churn), ' | ' ORDER BY k) FILTER (k <= 3) AS d3,
  string_agg(concat('  - ', file, ' (FanIn=', fan_in, ', FanOut=', fan_out, ', ChangeChurn=', coalesce(CAST(churn AS VARCHAR), 'None'), ')'), chr(10) ORDER BY k) AS d7 FROM danger GROUP BY 1, 2),
firstfiles AS (SELECT repo, rev, layer_no, module_no, list(split_part(file, '/', -1) ORDER BY file) AS names FROM locations GROUP BY 1, 2, 3, 4),
crossed AS (SELECT p.*, names, concat('module_key=', p.layer_no, ',', p.module_no, ', layer=', p.layer_no, ', module_size=', module_size, ', cross_penalty=',
    CASE WHEN round(cross_penalty, 6) <> 0 AND round(cross_penalty, 6) < 0.0001 THEN rtrim(format('{:.6f}', cross_penalty), '0') ELSE CAST(round(cross_penalty, 6) AS VARCHAR) END, ', clddf=', round(1 - cross_penalty, 6)) AS t
  FROM penalties p JOIN firstfiles f USING (repo, rev, layer_no, module_no) WHERE kind = 'cross' AND rank <= 7),
ctext AS (SELECT repo, rev, string_agg(concat(t, ', files=[', array_to_string(names[1:3], ', '), ']'), ' | ' ORDER BY rank) AS c4, string_agg(concat('  - ', t), chr(10) ORDER BY rank) AS c4l FROM crossed WHERE rank <= 4 GROUP BY 1, 2),
top1 AS (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY cross_penalty * module_size DESC, rank) AS w FROM crossed),
dnames AS (SELECT repo, rev, split_part(file, '/', -1) AS name, arg_min(concat('(FanIn=', CAST(fan_in AS BIGINT), ',FanOut=', CAST(fan_out AS BIGINT), ')'), k) AS f FROM danger GROUP BY 1, 2, 3),
htext AS (SELECT t.repo, t.rev, concat('Layer ', any_value(layer_no), ' / ', any_value(module_size), ' files, cross_penalty=', format('{:.3f}', any_value(cross_penalty)), ' | files: ',
    string_agg(CASE WHEN i = 4 THEN '...' ELSE concat(names[i], f) END, ', ' ORDER BY i)) AS h FROM top1 t, range(1, 5) r(i) LEFT JOIN dnames d ON d.repo = t.repo AND d.rev = t.rev AND d.name = names[i]
  WHERE w = 1 AND i <= len(names) GROUP BY 1, 2),
dwide AS (SELECT repo, new_rev, string_agg(concat(metric, '=', delta), ', ' ORDER BY m) AS d, string_agg(concat(metric, '=', relative), ', ' ORDER BY m) FILTER (relative IS NOT NULL) AS r,
    string_agg(concat('- ', metric, ': old=', round(old_value, 2), ' → new=', round(new_value, 2), ' (Δ=', format('{:+.2f}', delta), ' points', CASE WHEN relative IS NULL THEN '' ELSE concat(', ', format('{:+.2f}', relative), '% relative') END, ')'),
      chr(10) ORDER BY m) AS lines FROM (SELECT *, list_position(['m-score', 'propagation-cost', 'decoupling-level', 'independence-level'], metric) AS m FROM deltas WHERE raw IS NOT NULL) GROUP BY 1, 2),
mc AS (SELECT repo, new_rev, count(ol) AS fo, count(nl) AS fn, count(*) FILTER (status = 'moved_layer') AS ml, count(*) FILTER (status = 'moved_module') AS mm, count(*) FILTER (status = 'added') AS ad,
  count(*) FILTER (status = 'removed') AS re FROM moves GROUP BY 1, 2),
apt AS (SELECT repo, new_rev, string_agg(concat(type, '=', n), ', ' ORDER BY type) AS a FROM apc GROUP BY 1, 2),
lay AS (SELECT repo, rev, string_agg(concat(layer, ': ', n), ', ' ORDER BY layer) AS t FROM (SELECT repo, rev, layer, count(*) AS n FROM locations GROUP BY ALL) GROUP BY 1, 2),
big AS (SELECT repo, rev, string_agg(concat('module_path=', module_path, ', files=', n), ' | ' ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY n DESC, module_path) AS k FROM (
  SELECT repo, rev, module_path, count(*) AS n FROM locations GROUP BY ALL)) WHERE k <= 4 GROUP BY 1, 2),
moved AS (SELECT repo, new_rev, string_agg(concat('- ', file, ': ', ol, ' → ', nl), chr(10) ORDER BY file) FILTER (status = 'moved_layer') AS l, string_agg(concat('- ', file, ': ', om, ' → ', nm), chr(10) ORDER BY file) FILTER (status = 'moved_module') AS m
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, new_rev, status ORDER BY file) AS k FROM moves) WHERE k <= 12 GROUP BY 1, 2),
wt AS (SELECT repo, rev, sum(w) AS total, string_agg(concat(kind, '=', w), ', ' ORDER BY kind) AS t FROM (SELECT repo, rev, kind, round(sum(weight), 2) AS w FROM edges GROUP BY 1, 2, 3) GROUP BY 1, 2),
nc AS (SELECT repo, rev, count(*) AS n FROM (SELECT DISTINCT repo, rev, node FROM nodes) GROUP BY 1, 2),
firstcommits AS (SELECT r.repo, r.new_rev, string_agg(concat(substring(r.hash, 1, 8), ' ', strftime(ts, '%Y-%m-%d'), ' ', substring(subject, 1, 80), ' ', coalesce(files, 0), ' files'), '; ' ORDER BY r.rank) AS t
  FROM recentw r LEFT JOIN (SELECT repo, hash, count(*) AS files FROM file_changes GROUP BY 1, 2) f ON r.repo = f.repo AND r.hash = f.hash WHERE r.rank <= 5 GROUP BY 1, 2)"""
TYPED_TEXT = """ttext AS (SELECT repo, new_rev, string_agg(concat(type, '=', commit_count), ', ' ORDER BY type) AS tc, string_agg(concat(type, '=', churn_total), ', ' ORDER BY type) AS tl
  FROM totals GROUP BY 1, 2)"""
TEXT_TABLES = (*HINT_TABLES, FAN, HOT, HOT10, CHURN10, *SCORE, PENALTIES, RECENT, PERIOD, SUMMARY_SQL, TEXTS)
MOVED = "concat('moved_layers{c}=', ml, ', moved_modules{c}=', mm, ', added_files{c}=', ad, ', removed_files{c}=', re, ' (note: renames/moves often show up as add+remove)')"
COUNTED = "fo, ' → new=', fn, ' (Δ=', format('{:+d}', fn - fo), ')'"


@query("transition_texts_c4", sql(f"""
    SELECT p.repo, CAST(p.new_rev AS BIGINT) AS new_rev, CAST(p.old_rev AS BIGINT) AS old_rev,
      concat(concat_ws(chr(10), '## Comprehensive Summary', '- Metric deltas (new-old, absolute points): ' || d.d, '- Metric deltas (new-old, relative %): ' || d.r, '- Anti-pattern counts (newer): ' || a.a,
        '- Most dangerous files (newer, DV8): ' || d3, '- Issue-typed churn (newer): commit_count=(' || tc || '), churn_total=(' || tl || ')', concat('- DRH file count: old=', {COUNTED}), concat('- DRH movement (old→new): ', {MOVED.format(c='')}),
        '- Highest cross-layer penalty modules (newer): ' || c4, '- Refactoring hotspot (top module by cross_penalty×size): ' || h), chr(10)) AS summary,
      concat(concat_ws(chr(10), '## DRH Differences', '### Structural Summary', concat('- DRH file count: old=', {COUNTED}), '- Layer file counts (old): ' || lo.t, '- Layer file counts (new): ' || ln.t,
        '- Largest modules by file count (old): ' || bo.t, '- Largest modules by file count (new): ' || bn.t, '### Movement Summary', concat('- DRH movement (old→new): ', {MOVED.format(c='_count')}),
        '### Notable Layer Moves (sample)', coalesce(v.l, '- (none)'), '### Notable Module Moves (sample)' || chr(10) || v.m), chr(10)) AS structure
    FROM pairs p JOIN mc ON mc.repo = p.repo AND mc.new_rev = p.new_rev LEFT JOIN dwide d ON d.repo = p.repo AND d.new_rev = p.new_rev LEFT JOIN apt a ON a.repo = p.repo AND a.new_rev = p.new_rev
    LEFT JOIN dtext t ON t.repo = p.repo AND t.rev = p.new_rev LEFT JOIN ctext c ON c.repo = p.repo AND c.rev = p.new_rev LEFT JOIN htext x ON x.repo = p.repo AND x.rev = p.new_rev
    LEFT JOIN ttext y ON y.repo = p.repo AND y.new_rev = p.new_rev LEFT JOIN lay lo ON lo.repo = p.repo AND lo.rev = p.old_rev LEFT JOIN lay ln ON ln.repo = p.repo AND ln.rev = p.new_rev LEFT JOIN big bo ON bo.repo = p.repo AND bo.rev = p.old_rev
    LEFT JOIN big bn ON bn.repo = p.repo AND bn.rev = p.new_rev LEFT JOIN moved v ON v.repo = p.repo AND v.new_rev = p.new_rev""", *TEXT_TABLES, KEYROWS, TYPED, PTYPED, f"totals AS ({TOTALS})", TYPED_TEXT))
def _(h):
    h = h.stored("commits", "revisions", "lines", "file_changes", "nodes", "edges", "locations")
    moves = cut_lineage(L.file_moves(h.locations, h.pairs))
    structure = R.structure_text(L.layer_sizes(h.locations), L.largest_modules(h.locations), L.move_counts(moves), L.move_samples(moves))
    rows = R.summary_text(_facts(h, dict.fromkeys(("changes", "moves", "patterns", "dangerous", "penalties", "typed")), moves)).withColumnRenamed("text", "summary").join(structure.withColumnRenamed("text", "structure"), PAIR)
    return _big(rows, "new_rev", "old_rev")


@query("evidence_texts_c4", sql("""
    SELECT p.repo, CAST(p.new_rev AS BIGINT) AS new_rev, concat(concat_ws(chr(10), '## Metrics & Evidence', '### DV8 Metric Changes (older→newer)', d.lines,
        '- note: DV8 metrics are in %; Δ points are absolute (new-old), not percentage points of a 0–1 scale.', concat('- DRH file count (older→newer): ', fo, ' → ', fn, ' (Δ=', format('{:+d}', fn - fo), ')'),
        '### Evidence Graph (matrix.json derived, if available)', concat('- nodes: new=', nn.n, ', old=', no.n, ', delta=', nn.n - no.n),
        concat('- edges: new: total_weight=', wn.total, ', ', wn.t, '; old: total_weight=', wo.total, ', ', wo.t), concat('- edges.total_weight delta (new-old): ', format('{:+.2f}', CAST(wn.total - wo.total AS DOUBLE))),
        concat('- scc_old: scc_count=', so.scc_count, ', largest_scc_size=', so.largest), concat('- scc_new: scc_count=', sn.scc_count, ', largest_scc_size=', sn.largest),
        '### Risk Signals (newer timestep)', '- anti-pattern counts: ' || a.a, '- dangerous files (top):' || chr(10) || d7, '- highest cross-layer penalty modules (newer):' || chr(10) || c4l,
        CASE WHEN total_commits IS NOT NULL THEN '### Commit Context (older→newer window)' END, '- top commits (sample): ' || f.t, '- hotspot files (sample): ' || hotspot_files), chr(10)) AS text
    FROM pairs p JOIN mc ON mc.repo = p.repo AND mc.new_rev = p.new_rev LEFT JOIN dwide d ON d.repo = p.repo AND d.new_rev = p.new_rev LEFT JOIN apt a ON a.repo = p.repo AND a.new_rev = p.new_rev
    LEFT JOIN dtext t ON t.repo = p.repo AND t.rev = p.new_rev LEFT JOIN ctext c ON c.repo = p.repo AND c.rev = p.new_rev JOIN nc nn ON nn.repo = p.repo AND nn.rev = p.new_rev JOIN nc no ON no.repo = p.repo AND no.rev = p.old_rev
    JOIN wt wn ON wn.repo = p.repo AND wn.rev = p.new_rev JOIN wt wo ON wo.repo = p.repo AND wo.rev = p.old_rev JOIN sccsum sn ON sn.repo = p.repo AND sn.rev = p.new_rev JOIN sccsum so ON so.repo = p.repo AND so.rev = p.old_rev
    LEFT JOIN summary s ON s.repo = p.repo AND s.new_rev = p.new_rev LEFT JOIN firstcommits f ON f.repo = p.repo AND f.new_rev = p.new_rev""", *TEXT_TABLES))
def _(h):
    h = h.stored("commits", "revisions", "lines", "file_changes", "nodes", "edges", "locations")
    sides = [f"{c}_{side}" for c in ("nodes", "weight", "by_kind", "scc_count", "largest_scc") for side in ("new", "old")]
    read = {"diff": [*sides, "nodes_delta"], "commits": ["total_commits", "top_commits", "hotspot_files"]}
    rows = R.evidence_text(_facts(h, {**dict.fromkeys(("changes", "moves", "patterns", "dangerous", "penalties")), **read}))
    return _big(rows.drop("old_rev"), "new_rev")


PAYLOAD = """SELECT r.repo, CAST(r.rev AS BIGINT) AS rev, r.commit_hash, round(m.ms, 6) AS m_score, a.n AS cliques, h.node AS top_hotspot, h.total_weight AS top_weight, c.path AS top_churn, c.churn AS churn, t.k AS types,
    t.churn_total AS typed_churn, g.hash AS newest_commit FROM revisions r JOIN mwide m ON m.repo = r.repo AND m.rev = r.rev
  LEFT JOIN (SELECT repo, rev, count(*) AS n FROM anti_patterns WHERE type = 'clique' GROUP BY 1, 2) a ON a.repo = r.repo AND a.rev = r.rev
  LEFT JOIN hot10 h ON h.repo = r.repo AND h.rev = r.rev AND h.rank = 1 LEFT JOIN churn10 c ON c.repo = r.repo AND c.rev = r.rev AND c.rank = 1
  LEFT JOIN (SELECT repo, new_rev, count(*) AS k, CAST(sum(churn_total) AS BIGINT) AS churn_total FROM totals GROUP BY 1, 2) t ON t.repo = r.repo AND t.new_rev = r.rev
  LEFT JOIN (SELECT repo, substring(hash, 1, 7) AS hash FROM ordered WHERE position = 1) g ON g.repo = r.repo"""


def _payloads(h):
    typed = H.typed_totals(H.assign_windows(h.commits, h.windows), h.file_changes, h.issues, ["repo", "new_rev"]).withColumnRenamed("new_rev", "rev")
    # revisions without a summary page list hotspots instead of dangerous files
    paged = _dangerous(h).join(h.anti_patterns.select("repo", "rev").distinct(), ["repo", "rev"], "left_semi")
    return R.revision_payloads(
        h.revisions, h.metrics, R.anti_pattern_counts(h.anti_patterns), K.churn_by_revision(h.placed, h.file_changes, 10), typed, H.recent_commits(h.commits),
        G.hotspots(h.nodes.select("repo", "rev", "node"), h.edges), paged, M.mscore(M.module_scores(h.locations, h.edges)), L.layer_module_counts(h.locations))


@query("revision_payloads_c3_k6", sql(PAYLOAD, KEYROWS, TYPED, PTYPED, f"totals AS ({TOTALS})", ORD, FAN, HOT, HOT10, CHURN10))
def _(h):
    from chronolith.session import scratch_path
    from chronolith.sources import sinks as W

    rows = cut_lineage(_payloads(h.stored("commits", "revisions", "lines", "file_changes", "nodes", "edges")))
    path = scratch_path(h.spark, "payloads")
    W.write_payloads(rows, R.payload_markdown(rows), path)
    back = h.spark.read.schema(rows.schema).json(f"{path}/json")
    first = lambda c, f: F.get(F.col(c), F.lit(0))[f]
    return back.select(
        "repo", F.col("rev").cast("bigint").alias("rev"), "commit_hash", F.round(F.try_element_at("metrics", F.lit("m-score")), 6).alias("m_score"),
        F.try_element_at("anti_pattern_counts", F.lit("clique")).alias("cliques"), first("structural_hotspots", "node").alias("top_hotspot"),
        first("structural_hotspots", "total_weight").alias("top_weight"), first("churn_top", "path").alias("top_churn"), first("churn_top", "churn").alias("churn"),
        F.when(F.size("issue_typed_churn") > 0, F.size("issue_typed_churn")).cast("bigint").alias("types"),
        F.aggregate(F.transform("issue_typed_churn", lambda x: x["churn_total"]), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("typed_churn"),
        first("git_recent", "hash").alias("newest_commit"))


SPOT = "string_agg(concat('- Filename: ', {c}, ', FanIn: ', round(fan_in, 2), ', FanOut: ', round(fan_out, 2), {rest}), chr(10) ORDER BY {k}) FILTER ({k} <= 5)"


@query("payload_texts_k6", sql(f"""
    SELECT r.repo, CAST(r.rev AS BIGINT) AS rev, concat_ws(chr(10), concat('# Revision Summary: ', r.rev), concat('- Commit: ', commit_hash, ' | Date: ', strftime(commit_ts, '%Y-%m-%d'), ' | Repo: ', r.repo), '## Metrics', m.t,
      concat('- m_score_from_dsm_drh: ', round(s.score, 4)), '  - layer_module_counts:' || chr(10) || y.t, '## Anti-Patterns (counts)' || chr(10) || a.t,
      CASE WHEN a.t IS NOT NULL AND d.t IS NOT NULL THEN concat('## Dangerous files (from DV8 analysis-summary.html)', chr(10), d.t) ELSE '## Structural hotspots (from DSM matrix)' || chr(10) || h.t END,
      '## Top churn files (recent git log)' || chr(10) || c.t, '## Recent commits' || chr(10) || g.t) AS text
    FROM revisions r LEFT JOIN (SELECT repo, rev, string_agg(concat('- ', metric, ': ', round(value, 4)), chr(10) ORDER BY metric) AS t FROM metrics WHERE value IS NOT NULL GROUP BY 1, 2) m ON m.repo = r.repo AND m.rev = r.rev
    LEFT JOIN (SELECT repo, rev, mscore_percentage AS score FROM (SELECT repo, rev, sum(contribution) * 100 AS mscore_percentage FROM mscores GROUP BY 1, 2)) s ON s.repo = r.repo AND s.rev = r.rev
    LEFT JOIN (SELECT repo, rev, string_agg(concat('    - layer ', layer_no, ': ', n, ' modules'), chr(10) ORDER BY layer_no) AS t FROM (SELECT repo, rev, layer_no, count(DISTINCT module_no) AS n FROM locations GROUP BY 1, 2, 3) GROUP BY 1, 2) y
      ON y.repo = r.repo AND y.rev = r.rev
    LEFT JOIN (SELECT repo, rev, string_agg(concat('- ', type, ': ', n), chr(10) ORDER BY type) AS t FROM (SELECT repo, rev, type, count(*) AS n FROM anti_patterns GROUP BY 1, 2, 3) GROUP BY 1, 2) a ON a.repo = r.repo AND a.rev = r.rev
    LEFT JOIN (SELECT repo, rev, {SPOT.format(c='file', k='k', rest="', ChangeChurn: ', churn")} AS t FROM danger GROUP BY 1, 2) d ON d.repo = r.repo AND d.rev = r.rev
    LEFT JOIN (SELECT repo, rev, {SPOT.format(c='node', k='rank', rest="', TotalWeight: ', round(total_weight, 2)")} AS t FROM hot10 GROUP BY 1, 2) h ON h.repo = r.repo AND h.rev = r.rev
    LEFT JOIN (SELECT repo, rev, string_agg(concat('- ', path, ': ', churn, ' LOC changed'), chr(10) ORDER BY rank) AS t FROM churn10 GROUP BY 1, 2) c ON c.repo = r.repo AND c.rev = r.rev
    LEFT JOIN (SELECT repo, string_agg(concat('- ', substring(hash, 1, 7), ' | ', strftime(ts, '%Y-%m-%d'), ' | ', trim(subject)), chr(10) ORDER BY position) AS t FROM ordered WHERE position <= 5 GROUP BY 1) g ON g.repo = r.repo""",
    *TEXT_TABLES, ORD))
def _(h):
    rows = R.payload_markdown(_payloads(h.stored("commits", "revisions", "lines", "file_changes", "nodes", "edges", "locations")))
    return _big(rows, "rev")


# every section is filled from the document: whole, if long enough, or with a heading for the summary block
SECTIONS = f"""SELECT doc_id, length(c) AS chars, md5(c) AS digest FROM (
  SELECT doc_id, concat(m, r, k, b, chr(10), chr(10), CASE WHEN room > {R.LEAST_NARRATIVE} THEN substring(report, 1, CAST(room AS INTEGER)) ELSE '' END) AS c FROM (
    SELECT *, greatest({R.BUDGET} - length(m) - length(r) - length(k) - length(b), 0) AS room FROM (
      SELECT doc_id, concat('{R.MODULES_TITLE}', chr(10), substring(text, 1, 6000), chr(10), chr(10)) AS m,
        CASE WHEN n_chars > 500 THEN concat('{R.RISK_TITLE}', chr(10), substring(text, 1, 4000), chr(10), chr(10)) ELSE '' END AS r,
        concat('{R.COMMITS_TITLE}', chr(10), substring(text, 1, 6000), chr(10), chr(10)) AS k,
        substring(split_part(concat('## Comprehensive Summary', chr(10), text, chr(10), '## Other'), concat(chr(10), '## '), 1), 1, 6000) AS b,
        concat('## Comprehensive Summary', chr(10), text, chr(10), '## Other', chr(10), text) AS report FROM documents WHERE text <> '')))"""


@query("question_contexts_c10", SECTIONS)
def _(h):
    text = F.col("text")
    report = F.concat(F.lit("## Comprehensive Summary\n"), text, F.lit("\n## Other\n"), text)
    rows = h.table("documents").filter(text != "").select(
        "doc_id", text.alias("modules_text"), F.when(F.col("n_chars") > 500, text).alias("risk_text"), text.alias("commit_text"), report.alias("report_text"))
    return R.question_context(rows).select("doc_id", F.length("context").cast("bigint").alias("chars"), F.md5("context").alias("digest"))


# --- checks ------------------------------------------------------------------------


@query("revision_sets_j17", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, CASE WHEN EXISTS (SELECT 1 FROM revisions r WHERE r.repo = x.repo AND r.rev = x.rev) THEN 'missing' ELSE 'unexpected' END AS status FROM (
      (SELECT repo, rev FROM revisions EXCEPT SELECT repo, rev FROM (SELECT repo, rev FROM anti_patterns UNION SELECT repo, rev + 3 FROM revisions WHERE rev > 5))
      UNION ALL (SELECT repo, rev FROM (SELECT repo, rev FROM anti_patterns UNION SELECT repo, rev + 3 FROM revisions WHERE rev > 5) EXCEPT SELECT repo, rev FROM revisions)) x"""))
def _(h):
    odd = h.revisions.filter(F.col("rev") > 5).select("repo", (F.col("rev") + 3).alias("rev"))
    return _big(V.revision_sets(h.revisions, h.anti_patterns.select("repo", "rev").unionByName(odd)), "rev")


BUNDLE = """found AS (SELECT repo, rev, 'ISSUE' AS severity, 'Payload missing key: metrics' AS message FROM mwide WHERE ms IS NULL
  UNION ALL SELECT repo, rev, 'ISSUE', 'matrix_json missing: dsm/matrix.json' FROM revisions WHERE yr = 1997
  UNION ALL SELECT repo, rev, 'WARN', 'pdf missing: plots/drh.pdf' FROM revisions WHERE yr <> 2000
  UNION ALL SELECT repo, 0, 'WARN', concat('Missing evidence graph diff file: diff_', rev) FROM revisions WHERE yr <> 2000
  UNION ALL SELECT repo, 0, 'INFO', 'No graph diff index found (ok)' FROM (SELECT DISTINCT repo FROM revisions) WHERE repo = 'FURNITURE'), kept AS (SELECT * FROM found WHERE NOT (repo = 'FURNITURE' AND severity = 'WARN' AND rev = 0))"""


def _bundle(h):
    yr = F.col("yr")
    revs = h.revisions.join(h.metrics_wide.select("repo", "rev", F.col("`m-score`").alias("ms")), ["repo", "rev"])
    none = F.lit(None).cast("string")
    payloads = revs.select(
        "repo", "rev", F.col("ms").isNotNull().alias("has_metrics"), F.lit(True).alias("has_paths"), F.lit("dsm/matrix.json").alias("matrix_json"), none.alias("drh_clustering_json"),
        none.alias("png"), F.lit("plots/drh.pdf").alias("pdf"), F.lit("").alias("dangerous_source"), none.alias("structural_source"))
    files = revs.filter(yr != 1997).select("repo", "rev", F.lit("dsm/matrix.json").alias("path")).unionByName(
        revs.filter(yr == 2000).select("repo", "rev", F.lit("plots/drh.pdf").alias("path"))).unionByName(
        revs.filter(yr == 2000).select("repo", F.lit(0).alias("rev"), F.concat(F.lit("diff_"), "rev").alias("path")))
    index = revs.filter(F.col("repo") != "FURNITURE").select("repo", F.concat(F.lit("diff_"), "rev").alias("path"))
    return V.bundle_findings(payloads, files, h.revisions, index)


@query("bundle_findings_c11", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, severity, message FROM kept", BUNDLE))
def _(h):
    return _big(_bundle(h), "rev")


@query("findings_rollup_a28", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, count(*) FILTER (severity = 'ISSUE') AS issues, count(*) FILTER (severity = 'WARN') AS warnings, count(*) FILTER (severity = 'INFO') AS infos,
      CASE WHEN count(*) FILTER (severity = 'ISSUE') = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM kept GROUP BY 1, 2""", BUNDLE))
def _(h):
    return _big(V.findings_rollup(_bundle(h), ["repo", "rev"]), "rev")


def _reports(h):
    """One written report per order: headings depend on its priority, every line names a file."""
    heads = h.commits.select("repo", "hash", F.substring("subject", 1, 3).alias("head"))
    lines = h.lines.groupBy("repo", "hash").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- see `"), "path", F.lit("` at 63.08")))), "\n").alias("files"))
    title = F.when(F.col("head") == "Fix", "## DRH Differences\n").otherwise("## Comprehensive Summary\nok\n## DRH Differences\n")
    fence = F.when(F.col("head") == "Add", "```\n").otherwise("")
    text = F.concat(title, F.col("files"), F.lit("\n## Metrics & Evidence\nshort\n## Likely Drivers\n- a\n- b\n"), fence)
    allowed = h.lines.filter(F.col("l_returnflag") != "R").select("repo", "hash", F.when(F.col("l_returnflag") == "A", F.col("path")).otherwise(
        F.concat(F.lit("other/"), F.element_at(F.split("path", "/"), -1))).alias("file"))
    return heads.join(lines, ["repo", "hash"]).select("repo", "hash", text.alias("report_text")), allowed


UNKNOWN = """allow AS (SELECT DISTINCT hash, l_returnflag, path, split_part(path, '/', -1) AS name FROM lines WHERE l_returnflag <> 'R'),
unknown AS (SELECT DISTINCT l.repo, l.hash, l.path AS token FROM lines l WHERE l.hash IN (SELECT hash FROM allow) AND NOT EXISTS (SELECT 1 FROM allow a WHERE a.hash = l.hash AND a.path = l.path AND a.l_returnflag = 'A'))"""


@query("unknown_mentions_j16_p8", sql("SELECT * FROM unknown", UNKNOWN))
def _(h):
    return V.unknown_mentions(*_reports(h), ["repo", "hash"])


REPORTED = """heads AS (SELECT DISTINCT c.repo, c.hash, substring(subject, 1, 3) AS head FROM commits c JOIN lines l ON l.hash = c.hash),
rf AS (SELECT repo, hash, 'ISSUE' AS severity, 'Report contains code fences (```), which are disallowed.' AS message FROM heads WHERE head = 'Add'
  UNION ALL SELECT repo, hash, 'ISSUE', 'Missing required heading: ## Comprehensive Summary' FROM heads WHERE head = 'Fix'
  UNION ALL SELECT repo, hash, 'ISSUE', 'First heading is ''## DRH Differences'', expected ''## Comprehensive Summary''.' FROM heads WHERE head = 'Fix'
  UNION ALL SELECT l.repo, l.hash, 'WARN', 'DRH Differences section looks very short.' FROM lines l GROUP BY 1, 2 HAVING count(DISTINCT path) = 1
  UNION ALL SELECT repo, hash, 'WARN', 'Metrics & Evidence section looks very short.' FROM heads
  UNION ALL SELECT repo, hash, 'WARN', 'Prompt ALLOWED FILES list missing or empty; file reference checks skipped.' FROM heads WHERE hash NOT IN (SELECT hash FROM allow)
  UNION ALL SELECT repo, hash, 'ISSUE', concat('Report references file names not in ALLOWED FILES: ', string_agg(token, ', ' ORDER BY token)) FROM unknown GROUP BY 1, 2)"""


@query("report_findings_c12", sql("SELECT * FROM rf", UNKNOWN, REPORTED))
def _(h):
    return V.report_findings(*_reports(h), ["repo", "hash"])


@query("allowed_from_prompts_c12", sql("SELECT repo, hash, path AS file, count(*) AS n FROM lines GROUP BY ALL"))
def _(h):
    names = h.lines.groupBy("repo", "hash").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "path"))), "\n").alias("f"))
    text = F.concat(F.lit("Rules:\n- no\nALLOWED FILES (use only these)\n"), F.col("f"), F.lit("\n- (none)\nFACTS\n- later.java\n"))
    rows = V.allowed_from_prompt(names.select("repo", "hash", text.alias("prompt_text")), ["repo", "hash"])
    return rows.groupBy("repo", "hash", "file").agg(F.count(F.lit(1)).alias("n"))
