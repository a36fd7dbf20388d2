"""Queries over the composite file risk and its statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import classify as C
from chronolith.operators import graph as G
from chronolith.operators import history as H
from chronolith.operators import risk as K
from chronolith.operators import stats as S
from chronolith.operators.common import exact_quantiles
from chronolith.plans.graph_queries import COPAIRS, FAN, FINE, HOT, LINKS, PARTNERS, REACH, SCC, _big
from chronolith.plans.history_queries import KEYROWS, PTYPED, TYPED
from chronolith.plans.oracle import sql
from chronolith.plans.registry import query

THRESHOLD = 2

# one repository has no classified issues, so that its bug churn comes from keywords
KNOWN = "known AS (SELECT * FROM issues WHERE repo <> 'MACHINERY')"
TYPED_KNOWN = TYPED.replace("JOIN issues i", "JOIN known i")
CHURN10 = """churn10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY churn DESC, path) AS rank FROM (
  SELECT f.repo, p.new_rev AS rev, f.path, f.node AS file, CAST(sum(added + deleted) AS BIGINT) AS churn FROM file_changes f JOIN placed p ON f.repo = p.repo AND f.hash = p.hash
  GROUP BY ALL)) WHERE rank <= 10)"""
BUG20 = """bug20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY churn DESC, path) AS rank FROM (
  SELECT t.repo, t.new_rev AS rev, f.path, f.node AS file, CAST(sum(added + deleted) AS BIGINT) AS churn FROM ptyped t JOIN file_changes f ON t.repo = f.repo AND t.hash = f.hash
  WHERE t.type = 'bug' GROUP BY ALL)) WHERE rank <= 20)"""
ALL_CHURN = CHURN10.replace("churn10", "allchurn").replace(" WHERE rank <= 10", "")
BUG_FILES = BUG20.replace("bug20", "bugfiles").replace(" WHERE rank <= 20", "")
KEYWORD = f"""keyword AS (SELECT f.repo, f.node AS file, CAST(sum(added + deleted) AS BIGINT) AS churn FROM file_changes f JOIN placed c ON f.repo = c.repo AND f.hash = c.hash
  WHERE regexp_matches(c.subject, '(?i)\\b({"|".join(C.BUG_WORDS_WIDE)})\\b') GROUP BY 1, 2)"""
BUGS = """bugs AS (SELECT repo, file, CAST(sum(churn) AS BIGINT) AS bug_churn FROM bugfiles GROUP BY 1, 2
  UNION ALL SELECT repo, file, churn FROM keyword WHERE repo NOT IN (SELECT repo FROM bugfiles WHERE churn > 0))"""
HOT10 = "hot10 AS (SELECT * FROM hot WHERE rank <= 10)"
PATTERNS = """patterns AS (SELECT DISTINCT repo, rev, file, type, true AS sure FROM anti_patterns
  UNION ALL SELECT repo, rev, node, 'DangerousFile', false FROM hot10 d WHERE NOT EXISTS (SELECT 1 FROM anti_patterns a WHERE a.repo = d.repo AND a.rev = d.rev))"""
STRUCT = """seen AS (SELECT repo, file, arg_min(spare, rev * 10 + stage) AS spare FROM (SELECT repo, node AS file, rev, 0 AS stage, false AS spare FROM hot
  UNION ALL SELECT repo, file, rev, 1, NOT sure FROM patterns UNION ALL SELECT repo, file, rev, 2, false FROM allchurn) GROUP BY 1, 2),
struct_sig AS (SELECT repo, node AS file, 'hotspot_fanin_score' AS signal, round(fan_in, 2) AS value FROM hot
  UNION ALL SELECT repo, node, 'rev_count', 1 FROM hot UNION ALL SELECT repo, file, 'rev_count', 1 FROM seen WHERE spare
  UNION ALL SELECT repo, file, 'rev_count', 0 FROM seen WHERE NOT spare
  UNION ALL SELECT repo, file, 'anti_pattern_count', 1 FROM patterns UNION ALL SELECT repo, file, 'total_churn', churn FROM allchurn)"""
TABLE = """sig AS (SELECT * FROM struct_sig UNION ALL SELECT repo, file, 'bug_churn_total', bug_churn FROM bugs
  UNION ALL SELECT s.repo, s.node, 'scc_membership_count', 1 FROM scc s JOIN pairs p ON s.repo = p.repo AND (s.rev = p.new_rev OR s.rev = p.old_rev)
  UNION ALL SELECT repo, file, 'co_change_without_dep', partners FROM partners),
raw AS (SELECT repo, file, """ + ", ".join(f"coalesce(sum(value) FILTER (signal = '{s}'), 0)::DOUBLE AS {s}" for s in K.RAW) + """ FROM sig GROUP BY 1, 2)"""
NORM = "norm AS (SELECT *, " + ", ".join(
    f"CASE WHEN max({s}) OVER w = min({s}) OVER w THEN 0.0 ELSE ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END AS norm_{s}" for s in K.SIGNALS
) + " FROM raw WINDOW w AS (PARTITION BY repo))"


def _score(weights):
    w = {**K.WEIGHTS, **weights}
    return (f"round({w['bug_churn']}::DOUBLE * norm_bug_churn_total + {w['anti_pattern']}::DOUBLE * norm_anti_pattern_count + {w['hotspot_fanin']}::DOUBLE * norm_hotspot_fanin_score"
            f" + {w['scc_membership']}::DOUBLE * norm_scc_membership_count + {w['co_change']}::DOUBLE * norm_co_change_without_dep, 6)")


def _ranking(weights=None):
    return f"""seen_types AS (SELECT repo, file, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM patterns GROUP BY 1, 2),
ranking AS (SELECT n.*, coalesce(types, '') AS types, row_number() OVER (PARTITION BY n.repo ORDER BY risk_score DESC, n.file) AS rank
  FROM (SELECT *, {_score(weights or {})} AS risk_score FROM norm) n LEFT JOIN seen_types t ON t.repo = n.repo AND t.file = n.file)"""


STRUCTURE = [FAN, HOT, HOT10, ALL_CHURN, PATTERNS, STRUCT]
RAWS = [KNOWN, KEYROWS, TYPED_KNOWN, PTYPED, BUG_FILES, KEYWORD, BUGS, LINKS, REACH, SCC, FINE, COPAIRS.format(t="fine", k=THRESHOLD), PARTNERS, *STRUCTURE, TABLE]
RISK = [*RAWS, NORM, _ranking()]


def _known(h):
    return h.issues.filter(F.col("repo") != "MACHINERY")


def _signals(h):
    h = h.stored("commits", "lines", "nodes", "edges", "revisions", "anti_patterns")
    return K.risk_signals(h.commits, h.file_changes, _known(h), h.revisions, h.nodes.select("repo", "rev", "node"), h.edges, h.anti_patterns, threshold=THRESHOLD)


def _ranked(h, weights=None, top_n=None):
    return K.risk_ranking(*_signals(h), weights, top_n)


OUT = ", ".join(K.RAW) + ", " + ", ".join(f"round(norm_{s}, 6) AS norm_{s}" for s in K.SIGNALS)


@query("file_risk_c1_c2", sql(f"SELECT repo, rank, file, risk_score, {OUT}, types AS anti_patterns_seen FROM ranking", *RISK))
def _(h):
    return _ranked(h).select("repo", "rank", "file", "risk_score", *K.RAW, *[f"norm_{s}" for s in K.SIGNALS], F.array_join("anti_patterns_seen", "|").alias("anti_patterns_seen"))


WEIGHTS = {"bug_churn": 0.5, "co_change": 0.4}


@query("file_risk_weighted_t9", sql("SELECT repo, rank, file, risk_score FROM ranking WHERE rank <= 25", *RAWS, NORM, _ranking(WEIGHTS)))
def _(h):
    return _ranked(h, WEIGHTS, 25).select("repo", "rank", "file", "risk_score")


@query("signal_table_j1_u1", sql(f"SELECT repo, file, {', '.join(K.RAW)} FROM raw", *RAWS))
def _(h):
    return _signals(h)[0]


@query("structural_signals_a10", sql("SELECT repo, file, signal, sum(value)::DOUBLE AS value FROM struct_sig GROUP BY ALL", *STRUCTURE))
def _(h):
    nodes = h.nodes.select("repo", "rev", "node")
    hot = G.hotspots(nodes, h.edges, None)
    patterns = K.anti_pattern_rows(h.anti_patterns, G.hotspots(nodes, h.edges).withColumn("file", F.col("node")))
    rows = K.structural_signals(hot, patterns, K.churn_by_revision(h.placed, h.file_changes))
    return rows.groupBy("repo", "file", "signal").agg(F.sum("value").alias("value"))


@query("normalised_signals_w3", sql("SELECT repo, path, round(CASE WHEN hi = lo THEN 0.0 ELSE (churn - lo) / (hi - lo)::DOUBLE END, 6) AS norm_churn FROM (SELECT *, min(churn) OVER w AS lo, max(churn) OVER w AS hi FROM (SELECT repo, path, CAST(sum(added + deleted) AS BIGINT) AS churn FROM file_changes GROUP BY 1, 2) WINDOW w AS (PARTITION BY repo))"))
def _(h):
    rows = K.normalised(H.file_churn(h.file_changes, ["repo"], None), ("churn",))
    return rows.select("repo", "path", F.round("norm_churn", 6).alias("norm_churn"))


@query("bug_churn_choice_p4_p5", sql("SELECT repo, file, bug_churn FROM bugs", KNOWN, KEYROWS, TYPED_KNOWN, PTYPED, BUG_FILES, KEYWORD, BUGS))
def _(h):
    from chronolith.functions.text import normalise_path

    typed = K.bug_rows(K.typed_churn_by_revision(h.placed, h.file_changes, _known(h))).groupBy("repo", normalise_path(F.col("path")).alias("file")).agg(F.sum("churn").alias("bug_churn"))
    return K.choose_bug_churn(typed, H.keyword_bug_churn(h.placed, h.file_changes))


@query("risk_rank_w1", sql("""
    SELECT repo, path AS file, risk_score, row_number() OVER (PARTITION BY repo ORDER BY risk_score DESC, path) AS rank
    FROM (SELECT repo, path, CAST(sum(added + deleted) AS DOUBLE) AS risk_score FROM file_changes GROUP BY 1, 2)"""))
def _(h):
    rows = H.file_churn(h.file_changes, ["repo"], None).select("repo", F.col("path").alias("file"), F.col("churn").cast("double").alias("risk_score"))
    return K.ranked(rows)


@query("risk_lines_c9", sql("""
    SELECT repo, rank, concat('#', lpad(CAST(rank AS VARCHAR), 2, ' '), ' | ', rpad(split_part(file, '/', -1), CAST(greatest(40, length(split_part(file, '/', -1))) AS INTEGER), ' '), ' | ', format('{:.3f}', risk_score),
      ' | bug=', lpad(CAST(CAST(bug_churn_total AS BIGINT) AS VARCHAR), 5, ' '), ' | ap=', lpad(CAST(CAST(anti_pattern_count AS BIGINT) AS VARCHAR), 3, ' '), ' revisions | scc=',
      lpad(CAST(CAST(scc_membership_count AS BIGINT) AS VARCHAR), 2, ' '), ' revisions | co=', lpad(CAST(CAST(co_change_without_dep AS BIGINT) AS VARCHAR), 2, ' '), ' | [',
      array_to_string(list_filter(string_split(types, '|'), lambda t: t <> '')[1:3], ', '), ']') AS line FROM ranking WHERE rank <= 25""", *RISK))
def _(h):
    return K.risk_lines(_ranked(h, top_n=25))


# --- statistics --------------------------------------------------------------------

CHURN_STATS = "filechurn AS (SELECT repo, path AS file, CAST(sum(added + deleted) AS DOUBLE) AS value FROM file_changes GROUP BY 1, 2)"


def _churn(h):
    return H.file_churn(h.file_changes, ["repo"], None).select("repo", F.col("path").alias("file"), F.col("churn").cast("double").alias("value"))


def _desc(v):
    return (f"count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, round(var_pop({v}), 6) AS var, round(min({v}), 6) AS min, round(max({v}), 6) AS max, "
            f"round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS p75")


DESC = ("mean", "std", "var", "min", "max", "p25", "median", "p75")


def _rounded(df, *keys, digits=6):
    return df.select(*keys, "n", *[F.round(c, digits).alias(c) for c in DESC])


@query("churn_statistics_a16", sql(f"SELECT repo, {_desc('value')} FROM filechurn GROUP BY repo", CHURN_STATS))
def _(h):
    return _rounded(S.describe(_churn(h), ["repo"]), "repo")


NAMES = ("risk_score", *K.RAW)
UNPIVOT = f"longsig AS (SELECT repo, file, unnest([{', '.join(repr(s) for s in NAMES)}]) AS signal, unnest([{', '.join(NAMES)}]) AS value FROM ranking)"


@query("signal_statistics_a16", sql(f"SELECT repo, signal, {_desc('value')} FROM longsig GROUP BY 1, 2", *RISK, UNPIVOT))
def _(h):
    return _rounded(S.describe(S.long_signals(_ranked(h), NAMES), ["repo", "signal"]), "repo", "signal")


@query("quantiles_a16", """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75
    FROM lineitem GROUP BY 1""")
def _(h):
    rows = exact_quantiles(h.table("lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", S.QUARTILES)
    return rows.select("l_returnflag", *[F.round(c, 6).alias(c) for c in S.QUARTILES])


HISTO = """hrange AS (SELECT repo, n, bins, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, (CASE WHEN a = b THEN 1.0 ELSE b - a END) / bins AS width, a, b, s FROM (
  SELECT repo, count(*) AS n, least(40, greatest(10, count(*) // 5)) AS bins, min(value) AS a, max(value) AS b, stddev_samp(value) AS s FROM filechurn GROUP BY repo))"""


@query("histogram_a18", sql("""
    SELECT f.repo, CAST(f.bin AS BIGINT) AS bin, round(f.lo + f.bin * f.width, 6) AS bin_from, coalesce(c.n, 0) AS n FROM (SELECT repo, lo, width, unnest(range(0, bins)) AS bin FROM hrange) f
    LEFT JOIN (SELECT repo, g - CASE WHEN value < lo + g * width THEN 1 ELSE 0 END + CASE WHEN value >= lo + (g + 1) * width AND g < bins - 1 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM (
      SELECT v.*, h.lo, h.width, h.bins, least(CAST(floor((value - lo) / width) AS BIGINT), bins - 1) AS g FROM filechurn v JOIN hrange h ON v.repo = h.repo) GROUP BY 1, 2) c
      ON c.repo = f.repo AND c.bin = f.bin""", CHURN_STATS, HISTO))
def _(h):
    return _big(S.histogram(_churn(h)), "bin").withColumn("bin_from", F.round("bin_from", 6))


@query("density_a19", sql("""
    SELECT v.repo, CAST(p AS BIGINT) AS point, round(sum(k * exp(-0.5 * pow((a + p * (b - a) / 299 - value) / (s * pow(n, -0.2)), 2)) * width / (s * pow(n, -0.2) * sqrt(2 * pi()))), 5) AS height
    FROM (SELECT repo, value, count(*) AS k FROM filechurn GROUP BY 1, 2) v JOIN hrange h ON v.repo = h.repo, range(0, 300) t(p) WHERE n > 5 AND s > 0 GROUP BY 1, 2""", CHURN_STATS, HISTO))
def _(h):
    return _big(S.density(_churn(h)).select("repo", "point", F.round("height", 5).alias("height")), "point")


MATRIX = ("risk_score", *K.SIGNALS)
RANKS = "ranks AS (SELECT repo, file, " + ", ".join(
    f"rank() OVER (PARTITION BY repo ORDER BY {s}) + (count(*) OVER (PARTITION BY repo, {s}) - 1) / 2.0::DOUBLE AS r_{s}, stddev_pop({s}) OVER (PARTITION BY repo) AS s_{s}" for s in MATRIX) + " FROM ranking)"
CELLS = " UNION ALL ".join(
    f"SELECT repo, '{a}' AS a, '{b}' AS b, round(CASE WHEN any_value(s_{a}) > 0 AND any_value(s_{b}) > 0 THEN {'1.0' if a == b else f'corr(r_{a}, r_{b})'} ELSE {1.0 if a == b else 0.0} END::DOUBLE, 6) AS rho FROM ranks GROUP BY repo"
    for a in MATRIX for b in MATRIX)


@query("rank_correlations_a20", sql(CELLS, *RISK, RANKS))
def _(h):
    rows = S.rank_correlations(_ranked(h))
    return rows.select("repo", "a", "b", F.round("rho", 6).alias("rho"))


# Student's t through its angle: the area under cos(x)^(n-3) beyond asin|r|, over twelve widths in 200 steps
STARS = f"""cells AS MATERIALIZED ({CELLS.replace(', 6) AS rho', ', 15) AS rho')}), size AS (SELECT repo, count(*) AS n FROM ranking GROUP BY repo),
angles AS (SELECT *, asin(least(abs(rho), 1.0)) AS a0, (least(pi() / 2, asin(least(abs(rho), 1.0)) + 12 / sqrt(n - 2)) - asin(least(abs(rho), 1.0))) / 200 AS step FROM cells JOIN size USING (repo)),
tails AS (SELECT repo, a, b, sum(CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp((n - 3) * ln(greatest(cos(a0 + i * step), 1e-300)))) * any_value(step) / 3 AS area FROM angles, range(0, 201) t(i) GROUP BY 1, 2, 3),
tested AS (SELECT repo, n, a, b, rho, CASE WHEN abs(rho) >= 1 THEN 0.0 ELSE 2 * area * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()) END::DOUBLE AS p FROM angles JOIN tails USING (repo, a, b))"""


@query("rank_correlation_stars_a20", sql("""
    SELECT repo, n, a, b, round(rho, 6) AS rho, round(p, 6) AS p, CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM tested""", *[r.replace("ranking AS (", "ranking AS MATERIALIZED (") for r in RISK], RANKS.replace("ranks AS (", "ranks AS MATERIALIZED (", 1), STARS))
def _(h):
    return S.rank_correlations(_ranked(h)).withColumn("rho", F.round("rho", 6)).withColumn("p", F.round("p", 6))


@query("most_variable_signals_a21", sql("""
    SELECT repo, signal, rank, round(var, 6) AS var, round(slope, 9) AS slope, round(intercept, 6) AS intercept FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(var, 6) DESC, signal) AS rank FROM (
    """ + " UNION ALL ".join(
    f"SELECT repo, '{s}' AS signal, var_pop({s}) AS var, CASE WHEN stddev_pop({s}) > 0 THEN regr_slope(risk_score, {s}) END AS slope, CASE WHEN stddev_pop({s}) > 0 THEN regr_intercept(risk_score, {s}) END AS intercept FROM ranking GROUP BY repo"
    for s in K.SIGNALS) + ")) WHERE rank <= 4", *RISK))
def _(h):
    rows = S.most_variable_signals(_ranked(h))
    return rows.select("repo", "signal", "rank", F.round("var", 6).alias("var"), F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


# a median of two scores of six digits has at most seven, so seven are compared
@query("risk_by_anti_pattern_a22", sql(f"""
    SELECT repo, type, row_number() OVER (PARTITION BY repo ORDER BY type = '(no anti-pattern)', median DESC, type) AS position, n, mean, median, std FROM (
      SELECT repo, type, {_desc('risk_score').replace(', 6)', ', 7)')} FROM (SELECT repo, risk_score, unnest(CASE WHEN types = '' THEN ['(no anti-pattern)'] ELSE string_split(types, '|') END) AS type FROM ranking) GROUP BY 1, 2)""", *RISK))
def _(h):
    rows = _rounded(S.describe_by_type(_ranked(h)), "repo", "type", "position", digits=7)
    return rows.select("repo", "type", "position", "n", "mean", "median", "std")


@query("anti_pattern_counts_a13", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, type, count(*) AS n FROM anti_patterns GROUP BY ALL"))
def _(h):
    from chronolith.operators.reports import anti_pattern_counts

    return _big(anti_pattern_counts(h.anti_patterns), "rev")


@query("anti_pattern_types_a13", sql("SELECT repo, file, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM anti_patterns GROUP BY 1, 2"))
def _(h):
    return K.types_seen(h.anti_patterns).select("repo", "file", F.array_join("anti_patterns_seen", "|").alias("types"))


@query("anti_pattern_changes_u5", sql("""
    SELECT p.repo, CAST(p.new_rev AS BIGINT) AS new_rev, type, count(*) FILTER (a.rev = p.new_rev) AS n_new, count(*) FILTER (a.rev = p.old_rev) AS n_old,
      count(*) FILTER (a.rev = p.new_rev) - count(*) FILTER (a.rev = p.old_rev) AS delta FROM pairs p JOIN anti_patterns a ON a.repo = p.repo AND (a.rev = p.new_rev OR a.rev = p.old_rev) GROUP BY ALL"""))
def _(h):
    from chronolith.operators.reports import anti_pattern_changes, anti_pattern_counts

    return _big(anti_pattern_changes(anti_pattern_counts(h.anti_patterns), h.pairs).drop("old_rev"), "new_rev")


@query("dangerous_files_t3", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, file, CAST(score AS BIGINT) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY score DESC, ord) AS k FROM (
      SELECT h.repo, h.rev, h.node AS file, h.rank AS ord, coalesce(c.churn, 0) * 10 + CAST(trunc(fan_in) AS BIGINT) + CAST(trunc(fan_out) AS BIGINT) AS score
      FROM hot10 h LEFT JOIN churn10 c ON c.repo = h.repo AND c.rev = h.rev AND c.file = h.node)) WHERE k <= 7""", FAN, HOT, HOT10, CHURN10))
def _(h):
    from chronolith.functions.text import normalise_path
    from chronolith.operators.reports import top_dangerous

    churn = K.churn_by_revision(h.placed, h.file_changes, 10).select("repo", "rev", normalise_path(F.col("path")).alias("node"), "churn")
    rows = G.hotspots(h.nodes.select("repo", "rev", "node"), h.edges).withColumnRenamed("rank", "ord").join(churn, ["repo", "rev", "node"], "left")
    return _big(top_dangerous(rows.withColumnRenamed("node", "file")).select("repo", "rev", "file", "score", "rank"), "rev")
