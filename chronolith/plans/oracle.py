"""The bindings once more as SQL common table expressions, for checking results with another engine."""

from __future__ import annotations

from chronolith.functions.text import SOURCE_ROOTS, SPACE

SPACE_SQL = SPACE.replace("'", "''")
ROOTS_SQL = "|".join(SOURCE_ROOTS)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def norm_sql(x: str) -> str:
    return f"regexp_replace(replace({strip_sql(x)}, chr(92), '/'), '^(?:{ROOTS_SQL})', '')"


BASE = f"""
commits AS (
  SELECT c_mktsegment AS repo, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS hash, o_orderdate AS ts, c_name AS author,
    concat(lower(replace(c_name, '#', '.')), '@example.org') AS email,
    concat(CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Fix crash' WHEN '2' THEN 'Add feature' WHEN '3' THEN 'Refactor module'
      WHEN '4' THEN 'Update docs' WHEN '5' THEN 'Misc' END, ' ', o_orderstatus, 'X-', o_orderkey, ' IO-', o_custkey, ' refs #', c_nationkey) AS subject,
    concat('order ', o_orderkey) AS body, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderkey, c_custkey, c_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey),
lines AS (
  SELECT l.*, p.*, c.repo, c.hash, c.yr, c.ts, concat('src/main/java/org/', lower(p_type), '/P', l_partkey, '.java') AS path,
    concat('org/', lower(p_type), '/P', l_partkey, '.java') AS node
  FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN commits c ON l_orderkey = c.o_orderkey),
file_changes AS (
  SELECT repo, hash, path, node, CAST(l_quantity AS BIGINT) AS added, CAST(round(l_discount * 100) AS BIGINT) AS deleted,
    CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' WHEN 'R' THEN 'D' END AS status FROM lines),
places AS (SELECT n.*, r_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS module_no
  FROM nation n JOIN region ON n_regionkey = r_regionkey),
issues AS (
  SELECT c_mktsegment AS repo, concat('IO-', c_custkey) AS key,
    CASE r_name WHEN 'AFRICA' THEN 'bug' WHEN 'AMERICA' THEN 'feature' WHEN 'ASIA' THEN 'refactoring' WHEN 'EUROPE' THEN 'documentation' END AS type,
    concat('Report by ', c_name) AS summary FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL
  SELECT DISTINCT c_mktsegment, concat('GH#', n_nationkey), 'bug', n_name FROM customer JOIN places ON c_nationkey = n_nationkey
  WHERE r_name = 'MIDDLE EAST' AND n_nationkey <= 14),
lastc AS (SELECT *, row_number() OVER (PARTITION BY repo, yr ORDER BY ts DESC, hash DESC) AS k FROM commits),
revisions AS (
  SELECT repo, yr, CAST(row_number() OVER (PARTITION BY repo ORDER BY yr DESC) AS INTEGER) AS rev, hash AS commit_hash, ts AS commit_ts,
    author, subject AS message FROM lastc WHERE k = 1),
pairs AS (
  SELECT * FROM (SELECT repo, rev AS new_rev, lead(rev) OVER (PARTITION BY repo ORDER BY rev) AS old_rev, commit_ts AS new_ts,
    lead(commit_ts) OVER (PARTITION BY repo ORDER BY rev) AS old_ts FROM revisions) WHERE old_rev IS NOT NULL),
placed AS (SELECT c.*, p.new_rev, p.old_rev FROM commits c JOIN pairs p ON c.repo = p.repo AND c.ts > p.old_ts AND c.ts <= p.new_ts),
mwide0 AS (
  SELECT repo, yr, 100.0::DOUBLE * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END) / sum(l_quantity) AS ms,
    100.0::DOUBLE * count(*) FILTER (l_discount >= 0.05) / count(*) AS pc, 100.0::DOUBLE * count(*) FILTER (l_tax >= 0.03) / count(*) AS dl,
    100.0::DOUBLE * count(*) FILTER (l_linestatus = 'F') / count(*) AS il FROM lines GROUP BY repo, yr),
mwide AS (
  SELECT repo, rev, CASE WHEN ok THEN ms END AS ms, CASE WHEN ok THEN pc END AS pc, CASE WHEN ok THEN dl END AS dl,
    CASE WHEN ok AND yr <> 1998 THEN il END AS il
  FROM (SELECT m.*, r.rev, NOT (m.repo = 'BUILDING' AND m.yr = 1996) AS ok FROM mwide0 m JOIN revisions r ON m.repo = r.repo AND m.yr = r.yr)),
metrics AS (
  SELECT repo, rev, 'm-score' AS metric, ms AS value FROM mwide UNION ALL SELECT repo, rev, 'propagation-cost', pc FROM mwide
  UNION ALL SELECT repo, rev, 'decoupling-level', dl FROM mwide UNION ALL SELECT repo, rev, 'independence-level', il FROM mwide),
mchanges AS (
  SELECT *, new_value - old_value AS raw FROM (SELECT repo, rev AS new_rev, lead(rev) OVER w AS old_rev, metric, lead(value) OVER w AS old_value,
    value AS new_value FROM metrics WINDOW w AS (PARTITION BY repo, metric ORDER BY rev)) WHERE old_rev IS NOT NULL),
nodes AS (SELECT DISTINCT l.repo, r.rev, r.yr, l.node, l.p_size, l.p_brand, l.p_type, l.l_partkey FROM lines l JOIN revisions r ON l.repo = r.repo AND l.yr = r.yr),
eranked AS (
  SELECT repo, yr, node, l_returnflag, l_quantity, first_value(node) OVER w AS src, row_number() OVER w AS n FROM lines
  WINDOW w AS (PARTITION BY repo, hash ORDER BY l_quantity DESC, l_partkey, l_linenumber, l_suppkey, l_returnflag)),
edges AS (
  SELECT e.repo, r.rev, e.src, e.node AS dest, e.l_returnflag AS kind, sum(l_quantity) AS weight FROM eranked e
  JOIN revisions r ON e.repo = r.repo AND e.yr = r.yr WHERE n > 1 GROUP BY ALL),
locations AS (
  SELECT b.repo, r.rev, b.node AS file, r_name AS layer, n_regionkey AS layer_no, module_no, concat(r_name, '/', n_name) AS module_path, p_type
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, yr, node ORDER BY l_quantity DESC, l_suppkey DESC) AS k FROM lines) b
  JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey JOIN revisions r ON b.repo = r.repo AND b.yr = r.yr WHERE k = 1),
groups AS (
  SELECT repo, rev, concat('L', layer_no) AS name, file FROM locations
  UNION ALL SELECT repo, rev, concat('L', layer_no, '/M', module_no), file FROM locations
  UNION ALL SELECT repo, rev, concat('L', layer_no, '/M', module_no, '/', lower(p_type)), file FROM locations WHERE layer_no = 0),
anti_patterns AS (
  SELECT repo, rev, type, p_brand AS instance, node AS file FROM (
    SELECT *, 'clique' AS type FROM nodes WHERE p_size BETWEEN 1 AND 15 UNION ALL SELECT *, 'cycle' FROM nodes WHERE p_size BETWEEN 10 AND 25
    UNION ALL SELECT *, 'unhealthy-inheritance' FROM nodes WHERE p_size BETWEEN 20 AND 30) WHERE yr <> 1999),
docs AS (
  SELECT *, CASE WHEN layer = 'L2' THEN kind END AS subtype,
    CASE WHEN layer = 'L2' AND kind <> 'payload' THEN concat('model:', CASE WHEN n_chars > 2000 THEN '32b' ELSE '14b' END) ELSE '' END AS model,
    concat(source, '/', lpad(CAST(doc_id AS VARCHAR), 10, '0'), '.md') AS source_file
  FROM (SELECT *, CASE lang WHEN 'en' THEN 'L1' WHEN 'fr' THEN 'L2' WHEN 'de' THEN 'L3' ELSE 'L4' END AS layer,
    CASE WHEN n_chars > 3000 THEN 'drh_diff' WHEN n_chars > 1000 THEN 'temporal_report' ELSE 'payload' END AS kind FROM documents)),
pieces AS (
  SELECT source_file, layer, subtype, source AS repo, model, i, {strip_sql("substring(text, i + 1, 1200)")} AS text
  FROM (SELECT *, unnest(range(0, length(text), 1000)) AS i FROM docs)),
chunks AS (
  SELECT *, concat(source_file, ':', ord) AS chunk_id FROM (
    SELECT source_file, layer, subtype, repo, model, row_number() OVER (PARTITION BY source_file ORDER BY i) - 1 AS ord, text
    FROM pieces WHERE length(text) >= 80)),
questions AS (
  SELECT item_id AS q_id, text AS question, CASE WHEN length(text) > 200 THEN 'src1' ELSE '' END AS repo,
    CASE WHEN length(text) > 300 THEN '32b' ELSE '' END AS interp_model FROM benchmark)
"""


def sql(body: str, *extra: str) -> str:
    """A full statement: the bindings, further expressions and the query."""
    return "WITH RECURSIVE " + ",\n".join([BASE, *extra]) + "\n" + body
