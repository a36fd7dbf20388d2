"""Round trips: files derived from the tables with Spark, written, scanned again and compared with the tables."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith.operators import graph as G
from chronolith.operators import history as H
from chronolith.operators import modularity as M
from chronolith.operators import reports as R
from chronolith.operators import retrieval as T
from chronolith.operators import risk as K
from chronolith.plans.graph_queries import SCORE, _big
from chronolith.plans.oracle import sql, strip_sql
from chronolith.plans.registry import query, uncut
from chronolith.plans.risk_queries import RISK, THRESHOLD, _ranked
from chronolith.plans.text_queries import TOKENS
from chronolith.session import scratch_path
from chronolith.sources import antipatterns as A
from chronolith.sources import documents as D
from chronolith.sources import graphs as X
from chronolith.sources import issues as I
from chronolith.sources import logs as V
from chronolith.sources import metrics as Y
from chronolith.sources import sinks as W
from chronolith.sources.paths import read_documents



def _repo(df):
    """The repository of a written path: repo=<name>."""
    return df.withColumn("repo", F.regexp_extract("path", "repo=([^/]+)", 1))


def _written(h, df, label):
    """Texts written below one folder per repository; returns the folder."""
    path = scratch_path(h.spark, label)
    df.select("repo", "text").write.partitionBy("repo").text(path)
    return path


def _reread(h, df, label):
    """(repo, text) after a write and a line-wise scan."""
    docs = read_documents(h.spark, _written(h, df, label), whole=False)
    return _repo(docs)


def _order_lines(h, *fields):
    """Per order its lines as a sorted array: a handful of rows."""
    place = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    rows = h.lines.withColumn("node", F.regexp_replace("path", "^src/main/java/", ""))
    return rows.groupBy("repo", "hash").agg(F.array_sort(F.collect_list(F.struct(*place, "node", "path", "l_discount", *fields))).alias("l"))


# --- graphs ------------------------------------------------------------------------

CELLS = """cells AS (SELECT repo, first_value(node) OVER w AS src, node AS dest, l_returnflag AS kind, l_quantity AS weight, row_number() OVER w AS k FROM lines
  WINDOW w AS (PARTITION BY hash ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("matrix_scan_s1", sql("SELECT repo, src, dest, kind, sum(weight) AS weight FROM cells WHERE k > 1 GROUP BY ALL", CELLS))
def _(h):
    cell = lambda s, d, v: F.struct(s.alias("src"), d.alias("dest"), v.alias("values"))
    real = F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: cell(
        F.lit(0), i, F.create_map(F.get(F.col("l"), i)["l_returnflag"], F.get(F.col("l"), i)["l_quantity"])))
    odd = [cell(F.lit(0), F.lit(99), F.create_map(F.lit("X"), F.lit(5.0))), cell(F.lit(0), F.lit(0), F.create_map(F.lit("Z"), F.lit(0.0)))]
    cells = F.concat(F.slice(real, 2, 2**31 - 1), F.array(*odd))
    doc = F.to_json(F.struct(F.transform("l", lambda x: x["node"]).alias("variables"), cells.alias("cells")))
    docs = _reread(h, _order_lines(h).select("repo", doc.alias("text")), "matrix")
    edges = X.matrix_edges(X.matrices(docs, ["repo"]), ["repo"])
    return edges.groupBy("repo", "src", "dest", "kind").agg(F.sum("weight").alias("weight"))


TREE = """tlines AS (SELECT l.repo, l.hash, l.node, n_regionkey AS r, module_no AS m, row_number() OVER (PARTITION BY l.hash ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS k
  FROM lines l JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey)"""


def _trees(h):
    """One clustering tree per order: a layer per line with an empty group, a module with one file and a single file."""
    n = h.table("nation")
    order = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    places = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r"), order.alias("m"))
    homes = h.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(places, "s_nationkey").drop("s_nationkey")
    place = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    rows = h.lines.withColumn("node", F.regexp_replace("path", "^src/main/java/", "")).join(homes, "l_suppkey")
    lines = rows.groupBy("repo", "hash").agg(F.array_sort(F.collect_list(F.struct(*place, "node", "r", "m"))).alias("l"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    layer = lambda x: F.concat(F.lit("L"), x["r"].cast("string"))
    group = lambda name, inner: F.concat(F.lit('{"@type":"group","name":'), quoted(name), F.lit(',"nested":['), inner, F.lit("]}"))
    item = lambda name: F.concat(F.lit('{"@type":"item","name":'), quoted(name), F.lit("}"))
    one = lambda x: group(layer(x), F.concat_ws(
        ",", group(F.lit("empty"), F.lit("")), group(F.concat(layer(x), F.lit("/M"), x["m"].cast("string")), item(x["node"])),
        item(F.concat(x["node"], F.lit(".md")))))
    text = F.concat(F.lit('{"id":'), quoted(F.col("hash")), F.lit(',"structure":['), F.array_join(F.transform("l", one), ","), F.lit("]}"))
    docs = _reread(h, lines.select("repo", text.alias("text")), "tree")
    return docs.withColumn("hash", F.get_json_object("text", "$.id"))


@query("tree_locations_s2", sql("""
    SELECT repo, hash, file, layer, module_path FROM (SELECT repo, hash, node AS file, concat('L', r) AS layer, concat('L', r, '/L', r, '/M', m) AS module_path,
        row_number() OVER (PARTITION BY hash, node ORDER BY k DESC) AS last FROM tlines
      UNION ALL SELECT repo, hash, concat(node, '.md'), concat('L', r), concat('L', r), row_number() OVER (PARTITION BY hash, node ORDER BY k DESC) FROM tlines) WHERE last = 1""", TREE))
def _(h):
    keys = ["repo", "hash"]
    return X.tree_locations(X.tree_items(_trees(h), keys), keys)


@query("tree_numbers_s3", sql("""
    SELECT repo, layer_no, module_no, file, count(*) AS n FROM (SELECT repo, k AS layer_no, 0::BIGINT AS module_no, node AS file FROM tlines
      UNION ALL SELECT repo, k, 1, concat(node, '.md') FROM tlines) GROUP BY ALL""", TREE))
def _(h):
    keys = ["repo", "hash"]
    rows = X.numbered_locations(X.tree_items(_trees(h), keys), keys).groupBy("repo", "layer_no", "module_no", "file").agg(F.count(F.lit(1)).alias("n"))
    return _big(rows, "layer_no", "module_no")


@query("tree_names_s4", sql("""
    SELECT repo, name, CAST(r AS BIGINT) AS layer_no, count(*) AS n FROM (SELECT repo, concat('L', r) AS name, r FROM tlines UNION ALL SELECT repo, concat('L', r), r FROM tlines
      UNION ALL SELECT repo, concat('L', r, '/M', m), r FROM tlines) GROUP BY ALL""", TREE))
def _(h):
    keys = ["repo", "hash"]
    rows = X.tree_groups(X.tree_items(_trees(h), keys), keys).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("layer_no", M.layer_of_name(F.col("name")).cast("bigint"))


@query("tree_children_g12", sql("SELECT repo, hash, CAST(k AS BIGINT) AS top, 3::BIGINT AS modules FROM tlines", TREE))
def _(h):
    return _big(X.child_counts(_trees(h), ["repo", "hash"]), "top", "modules")


# --- logs --------------------------------------------------------------------------


def _log(h, head, line, odd=()):
    """Commit records: header line and one line per change, odd lines appended."""
    heads = h.commits.select("repo", "hash", head.alias("head"))
    lines = _order_lines(h).select("repo", "hash", F.concat(F.transform("l", line), F.array(*[F.lit(o) for o in odd])).alias("body"))
    rows = heads.join(lines, ["repo", "hash"], "left")
    return rows.withColumn("body", F.coalesce("body", F.array().cast("array<string>")))


NUMSTAT = lambda x: F.concat_ws("\t", x["l_quantity"].cast("bigint"), F.round(x["l_discount"] * 100).cast("bigint"), x["path"])
ODD = ("-\t-\tdocs/logo.png", "1\tbroken", "a\tb\tc.txt")
CHANGED = "SELECT repo, hash, path AS file, count(*) AS n, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM file_changes GROUP BY ALL"
LOGO = "SELECT DISTINCT repo, hash, 'docs/logo.png', 1, 0, 0 FROM file_changes"


def _changed(rows):
    return _repo(rows).groupBy("repo", "hash", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


@query("typed_log_changes_s6", sql(f"{CHANGED} UNION ALL {LOGO}"))
def _(h):
    rows = _log(h, F.concat_ws("\t", "hash", "subject"), NUMSTAT, ODD)
    text = F.concat(F.lit(V.SENTINEL + "\n"), F.array_join(F.concat(F.array("head"), "body"), "\n"))
    path = _written(h, rows.select("repo", text.alias("text")), "typedlog")
    return _changed(V.log_changes(V.log_records(V.read_log(h.spark, path))))


@query("typed_log_commits_s6", sql("SELECT repo, hash, subject FROM commits"))
def _(h):
    rows = _log(h, F.concat_ws("\t", "hash", "subject"), NUMSTAT)
    text = F.concat(F.lit(V.SENTINEL + "\n"), F.array_join(F.concat(F.array("head"), "body"), "\n"))
    path = _written(h, rows.select("repo", text.alias("text")), "typedlog")
    return _repo(V.log_commits(V.log_records(V.read_log(h.spark, path)))).select("repo", "hash", "subject")


def _dated(h):
    head = F.concat_ws("|", "hash", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000")), "author", F.concat("subject", F.lit("|x")))
    rows = _log(h, head, NUMSTAT)
    text = F.concat(F.array_join(F.concat(F.array("head"), "body"), "\n"), F.lit("\n"))
    path = _written(h, rows.select("repo", text.alias("text")), "datedlog")
    return V.log_records(V.read_log(h.spark, path, "\n\n"), "dated")


@query("dated_log_commits_s6", sql("SELECT repo, hash, strftime(ts, '%Y-%m-%d') AS day, author, concat(subject, '|x') AS subject FROM commits"))
def _(h):
    rows = _repo(V.log_commits(_dated(h)))
    return rows.select("repo", "hash", F.date_format("ts", "yyyy-MM-dd").alias("day"), "author", "subject")


@query("dated_log_changes_s6", sql(CHANGED))
def _(h):
    return _changed(V.log_changes(_dated(h)))


@query("mail_and_unit_logs_s6", sql("SELECT repo, hash, email, author, strftime(ts, '%Y-%m-%d') AS day, subject, body FROM commits"))
def _(h):
    date = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    mailed = h.commits.select("repo", F.concat(F.concat_ws("|", "hash", "author", "email", date, "subject"), F.lit("\n")).alias("text"))
    unit = h.commits.select("repo", F.concat(F.concat_ws(V.UNIT, "hash", date, "email", "subject", "body"), F.lit("\n")).alias("text"))
    a = V.log_commits(V.log_records(V.read_log(h.spark, _written(h, mailed, "mailed"), "\n\n"), "mailed"))
    b = V.log_commits(V.log_records(V.read_log(h.spark, _written(h, unit, "unit"), "\n\n"), "unit"))
    return _repo(a).select("repo", "hash", "email", "author", F.date_format("ts", "yyyy-MM-dd").alias("day"), "subject").join(b.select("hash", "body"), "hash")


@query("status_log_s7", sql("SELECT repo, hash, status, path AS file, count(*) AS n FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END AS status FROM lines) GROUP BY ALL"))
def _(h):
    line = lambda x: F.concat_ws("\t", F.when(x["l_returnflag"] == "N", "M").when(x["l_returnflag"] == "R", "D").otherwise("A"), x["path"])
    rows = _log(h, F.concat_ws("\t", "hash", "subject"), line)
    text = F.concat(F.lit(V.SENTINEL + "\n"), F.array_join(F.concat(F.array("head"), "body"), "\n"))
    path = _written(h, rows.select("repo", text.alias("text")), "status")
    rows = _repo(V.log_statuses(V.log_records(V.read_log(h.spark, path))))
    return rows.groupBy("repo", "hash", "status", "file").agg(F.count(F.lit(1)).alias("n"))


@query("series_roundtrip_k2_s5", sql("""
    SELECT m.repo, CAST(m.rev AS BIGINT) AS rev, metric, round(value, 6) AS value, commit_hash, strftime(commit_ts, '%Y-%m-%d') AS day, author FROM metrics m
    JOIN revisions r ON m.repo = r.repo AND m.rev = r.rev"""))
def _(h):
    path = scratch_path(h.spark, "series")
    W.write_series(h.revisions, h.metrics, H.month_range(h.commits), path)
    revisions = V.series_revisions(read_documents(h.spark, path, whole=False))
    rows = V.series_metrics(revisions).join(revisions.drop("metrics"), ["repo", "rev"])
    return _big(rows.select("repo", "rev", "metric", F.round("value", 6).alias("value"), "commit_hash", F.date_format("commit_ts", "yyyy-MM-dd").alias("day"), "author"), "rev")


# --- issues ------------------------------------------------------------------------


@query("issue_maps_s8", sql("""
    SELECT repo, key, type, CASE WHEN type IN ('bug', 'feature') THEN summary END AS summary FROM issues WHERE type IS NOT NULL AND starts_with(key, 'IO-')"""))
def _(h):
    nested = F.to_json(F.struct(F.create_map("key", "type").alias("issues"), F.create_map("key", "summary").alias("summaries")))
    flat = F.to_json(F.create_map("key", "type", F.lit("note"), F.lit("x")))
    typed = h.issues.filter(F.col("type").isNotNull() & F.startswith("key", F.lit("IO-")))
    docs = typed.select("repo", F.when(F.col("type").isin("bug", "feature"), nested).otherwise(flat).alias("text"))
    return I.issue_maps(_reread(h, docs, "issuemap"))


HOSTED = """hosted AS (SELECT repo, concat('GH#', o_orderkey) AS key, CASE substring(subject, 1, 3) WHEN 'Fix' THEN 'bug' WHEN 'Add' THEN 'feature' WHEN 'Upd' THEN 'documentation' END AS type,
    author AS summary FROM commits WHERE NOT contains(subject, ' PX-'))"""


def _hosted(h):
    head = F.substring("subject", 1, 3)
    name = F.when(head == "Fix", "Type: Bug").when(head == "Add", "Enhancement ").when(head == "Upd", "docs").otherwise("later")
    labels = F.array(F.struct(F.lit("wontfix").alias("name")), F.struct(name.alias("name")), F.struct(F.when(head == "Fix", "docs").alias("name")))
    pull = F.when(F.contains("subject", F.lit(" PX-")), F.struct(F.lit("u").alias("url")))
    doc = F.to_json(F.struct(F.col("hash").cast("bigint").alias("number"), F.col("author").alias("title"), labels.alias("labels"), pull.alias("pull_request")))
    return I.hosted_issues(_reread(h, h.commits.select("repo", doc.alias("text")), "hosted"))


@query("hosted_issues_s9", sql("SELECT * FROM hosted", HOSTED))
def _(h):
    return _hosted(h)


TRACKED = """tracked AS (SELECT repo, CASE WHEN yr < 1998 THEN concat('GH#', o_orderkey) ELSE concat('IO-', o_orderkey) END AS key, CASE substring(subject, 1, 3) WHEN 'Fix' THEN 'bug'
    WHEN 'Add' THEN 'feature' WHEN 'Ref' THEN 'refactoring' END AS type, CASE WHEN yr = 1996 THEN NULL ELSE subject END AS summary FROM commits),
tracker AS (SELECT * FROM tracked WHERE type IS NOT NULL OR summary IS NOT NULL)"""


def _tracked(h):
    head = F.substring("subject", 1, 3)
    name = F.when(head == "Fix", "Bug").when(head == "Add", " New Feature").when(head == "Ref", "Sub-task").otherwise("Epic")
    key = F.concat(F.when(F.col("yr") < 1998, "GH#").otherwise("IO-"), F.col("hash").cast("bigint").cast("string"))
    fields = F.struct(F.struct(name.alias("name")).alias("issuetype"), F.when(F.col("yr") == 1996, "  ").otherwise(F.col("subject")).alias("summary"))
    doc = F.to_json(F.struct(F.array(F.struct(key.alias("key"), fields.alias("fields"))).alias("issues")))
    return I.tracker_issues(_reread(h, h.commits.select("repo", doc.alias("text")), "tracker"))


@query("tracker_issues_s10", sql("SELECT * FROM tracker", TRACKED))
def _(h):
    return _tracked(h)


@query("merged_issues_s11", sql("""
    SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.key, b.key) AS key, coalesce(b.type, a.type) AS type, coalesce(b.summary, a.summary) AS summary
    FROM tracker a FULL JOIN hosted b ON a.repo = b.repo AND a.key = b.key""", HOSTED, TRACKED))
def _(h):
    return I.merged_issues(_tracked(h), _hosted(h))


# --- anti-patterns -----------------------------------------------------------------


@query("pattern_summaries_s12", sql("""
    SELECT CAST(repo AS VARCHAR) AS repo, type, count(*) AS n, CAST(sum(files) AS BIGINT) AS files, CASE WHEN type = 'Clique' THEN CAST(sum(files) AS BIGINT) END AS clique_files FROM (
      SELECT repo, rev, CASE WHEN type = 'clique' THEN 'Clique' ELSE type END AS type, count(DISTINCT instance) AS instances, count(*) AS files FROM anti_patterns GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def _(h):
    name = F.when(F.col("type") == "clique", "Clique").otherwise(F.col("type"))
    rows = h.anti_patterns.groupBy("repo", "rev", name.alias("type")).agg(F.count_distinct("instance").alias("instances"), F.count(F.lit(1)).alias("files"))
    path = scratch_path(h.spark, "patterns")
    rows.select("repo", "type", "instances", "files").write.partitionBy("repo").option("header", True).csv(path)
    table = A.read_summaries(h.spark, path).withColumn("path", F.col("_metadata.file_path"))
    sums = _repo(table).groupBy("repo", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("files").cast("bigint")).alias("files"))
    cliques = _repo(A.clique_counts(h.spark, path)).groupBy("repo").agg(F.sum("files").alias("c"))
    return sums.join(cliques, "repo", "left").select("repo", "type", "n", "files", F.when(F.col("type") == "Clique", F.col("c")).alias("clique_files"))


def _blobs(h):
    """One compressed member file per order: a header, strings with mark and length, some noise."""
    rows = _order_lines(h).select("repo", "hash", F.transform("l", lambda x: x["node"]).alias("files"))
    path = F.concat(F.lit("/d/REPOS_ANALYZED/"), "repo", F.lit("/07_x/arch-issue/clique/"), "hash", F.lit("/members.bin"))

    def encode(batches):
        for b in batches:
            bodies = []
            for files in b["files"]:
                body = b"\x00\x07" + b"".join(b"\x01\x00" + bytes([len(f)]) + f.encode() for f in [*files, "notes.txt", "Call"])
                bodies.append(b"header" + gzip.compress(body + b" Import x", mtime=0))
            yield pd.DataFrame({"path": b["path"], "content": bodies})

    return rows.select(path.alias("path"), "files").mapInPandas(encode, "path string, content binary")


@query("pattern_members_s13", sql("SELECT repo, hash AS instance, node AS file, 'clique' AS type, 7::BIGINT AS rev, count(*) AS n FROM lines GROUP BY ALL"))
def _(h):
    rows = A.placed_members(A.decode_members(_blobs(h)))
    return _big(rows.groupBy("repo", "instance", "file", "type", "rev").agg(F.count(F.lit(1)).alias("n")), "rev")


@query("pattern_memberships_s14", sql("SELECT DISTINCT repo, 7::BIGINT AS rev, 'clique' AS type, node AS file FROM lines"))
def _(h):
    return _big(A.memberships(A.decode_members(_blobs(h), scan_text=True)), "rev")


@query("html_tables_s15", sql("""
    SELECT repo, hash, node AS file, CAST(l_quantity AS BIGINT) AS fan_in, count(*) AS n FROM lines GROUP BY ALL UNION ALL SELECT DISTINCT repo, hash, 'Filename', NULL, 1 FROM lines"""))
def _(h):
    row = lambda x: F.concat(F.lit("<tr><td><a href='x'>"), x["node"], F.lit("</a>\n</td><td> "), x["l_quantity"].cast("bigint"), F.lit("</td></tr>"))
    html = F.concat(
        F.lit("<table><tr><th>Metric</th></tr></table><TABLE class=a><tr><th>Filename</th><th>FanIn</th></tr>"), F.array_join(F.transform("l", row), ""),
        F.lit("<tr><td>only one</td></tr></TABLE>"))
    docs = _order_lines(h).select("repo", "hash", html.alias("html"))
    rows = A.html_table_rows(docs, ["repo", "hash"])
    fan = F.try_element_at("row", F.lit("FanIn")).try_cast("bigint")
    return rows.groupBy("repo", "hash", F.try_element_at("row", F.lit("Filename")).alias("file"), fan.alias("fan_in")).agg(F.count(F.lit(1)).alias("n"))


# --- metrics and tool logs ---------------------------------------------------------


@query("metric_files_s16", sql("""
    SELECT repo, CAST(rev AS BIGINT) AS rev, round(ms, 6) AS ms, round(CASE WHEN rev = 1 THEN 0.0 ELSE pc END, 6) AS pc, round(dl, 6) AS dl, round(il, 6) AS il FROM mwide"""))
def _(h):
    known = lambda m: F.concat(F.col(f"`{m}`").cast("string"), F.lit("%"))
    lost = F.col("rev") == 1
    fields = F.struct(
        known("m-score").alias("mScore"), known("decoupling-level").alias("decouplingLevel"), known("independence-level").alias("independenceLevel"),
        F.when(F.col("rev") <= 2, "∞").otherwise(known("propagation-cost")).alias("propagationCost"), F.when(lost, "0").otherwise("1,234").alias("numberOfIsolatedItems"),
        F.when(F.col("rev") == 2, known("propagation-cost")).alias("propagationCostExcludeIsolatedItems"), "rev")
    docs = _reread(h, h.metrics_wide.select("repo", F.to_json(fields).alias("text")), "metric").withColumn("rev", F.get_json_object("text", "$.rev").cast("bigint"))
    rows = Y.metric_files(docs)
    names = {"ms": "m-score", "pc": "propagation-cost", "dl": "decoupling-level", "il": "independence-level"}
    return rows.select("repo", "rev", *[F.round(F.col(f"`{m}`"), 6).alias(c) for c, m in names.items()])


@query("metric_lookup_s17", sql("""
    SELECT m.repo, CAST(m.rev AS BIGINT) AS rev, m.metric, count(*) AS lookups, round(max(value), 6) AS value FROM commits q
    JOIN metrics m ON m.repo = q.repo AND (substring(q.subject, 1, 3) = 'Mis' OR m.metric = CASE substring(q.subject, 1, 3) WHEN 'Fix' THEN 'm-score' WHEN 'Add' THEN 'propagation-cost' WHEN 'Ref' THEN 'decoupling-level'
      ELSE 'independence-level' END) GROUP BY 1, 2, 3"""))
def _(h):
    head = F.substring("subject", 1, 3)
    name = F.when(head == "Fix", "MScore ").when(head == "Add", "propagation").when(head == "Ref", "dl").when(head == "Upd", "IL").otherwise("everything")
    asked = h.commits.select(F.col("hash").alias("q_id"), "repo", name.alias("query"))
    rows = Y.metric_lookup(asked, h.metrics).groupBy("repo", "rev", "metric").agg(F.count(F.lit(1)).alias("lookups"), F.round(F.max("value"), 6).alias("value"))
    return _big(rows, "rev")


STEPS = """steps AS (SELECT event_type AS repo, event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS rc, CASE WHEN event_type = 'click' THEN ' Build FAILED here ' ELSE concat(' ', props, ' ') END AS stderr FROM events)"""


def _steps(h):
    step = F.struct(
        F.concat(F.lit("s"), "event_id").alias("step"), F.col("event_type").alias("cmd"), F.when(F.col("value") > 50, 1).otherwise(0).alias("rc"),
        F.when(F.col("event_type") == "click", " Build FAILED here ").otherwise(F.concat(F.lit(" "), "props", F.lit(" "))).alias("stderr"))
    docs = _reread(h, h.table("events").select(F.col("event_type").alias("repo"), F.to_json(F.array(step)).alias("text")), "tool")
    rows = Y.tool_steps(docs, ["repo"]).withColumn("rev", F.lit(1)).withColumn("ord", F.substring("step", 2, 20).cast("bigint"))
    return R.tool_problems(rows)


@query("tool_problems_s18", sql("SELECT repo, concat('s', event_id) AS step, rc, trim(stderr) AS stderr FROM steps WHERE rc <> 0 OR regexp_matches(stderr, '(?i)error|exception|failed')", STEPS))
def _(h):
    return _steps(h).select("repo", "step", "rc", "stderr")


@query("tool_report_c13", sql("""
    SELECT repo, n AS problems, string_agg(concat('- Step: s', event_id, ' (rc=', rc, ')', chr(10), '  Cmd: ', repo, chr(10), '  Stderr: ', trim(stderr)), chr(10) ORDER BY event_id) AS report
    FROM (SELECT *, count(*) OVER (PARTITION BY repo) AS n FROM steps WHERE rc <> 0 OR regexp_matches(stderr, '(?i)error|exception|failed'))
    GROUP BY 1, 2""", STEPS))
def _(h):
    return R.tool_report(_steps(h)).drop("rev")


# --- documents ---------------------------------------------------------------------

def _files(h, path):
    return h.documents.select(path.alias("path"), "text")


@query("knowledge_chunks_s19", sql("SELECT concat('L1:', split_part(chunk_id, '/', -1)) AS chunk_id, text FROM stripped", """
    spieces AS (SELECT source_file, i, """ + strip_sql("substring(body, i + 1, 1200)") + """ AS text FROM (SELECT *, unnest(range(0, length(body), 1000)) AS i FROM (SELECT source_file, """ + strip_sql("text") + """ AS body FROM docs))),
    stripped AS (SELECT concat(source_file, ':', row_number() OVER (PARTITION BY source_file ORDER BY i) - 1) AS chunk_id, text FROM spieces WHERE length(text) >= 80)"""))
def _(h):
    return D.knowledge_chunks(_files(h, F.col("source_file"))).select("chunk_id", "text")


@query("report_chunks_s20", sql("SELECT subtype, repo, model, source_file, count(*) AS chunks, min(length(text)) AS shortest FROM spieces WHERE length(text) >= 80 GROUP BY ALL", """
    spieces AS (SELECT source_file, subtype, repo, model, i, """ + strip_sql("substring(body, i + 1, 1200)") + """ AS text FROM (SELECT *, unnest(range(0, length(body), 1000)) AS i FROM (
      SELECT """ + strip_sql("text") + """ AS body, source AS repo, CASE lang WHEN 'en' THEN 'temporal_report' WHEN 'fr' THEN 'drh_diff' WHEN 'de' THEN 'user_answer' ELSE 'payload' END AS subtype,
        CASE WHEN lang IN ('en', 'fr', 'de') THEN 'qwen2.5:32b' ELSE '' END AS model,
        concat('/d/REPOS_ANALYZED/', source, '/run_qwen2.5_32b/', doc_id, '/OutputData/', CASE lang WHEN 'en' THEN 'temporal_interpretation_report_x.md' WHEN 'fr' THEN 'drh_diff_report_x.md'
          WHEN 'de' THEN 'USER_ANSWER_1.md' ELSE 'interpretation_payload.md' END) AS source_file FROM documents)))"""))
def _(h):
    d = h.table("documents")
    name = F.when(F.col("lang") == "en", "temporal_interpretation_report_x.md").when(F.col("lang") == "fr", "drh_diff_report_x.md").when(
        F.col("lang") == "de", "USER_ANSWER_1.md").otherwise("interpretation_payload.md")
    path = F.concat(F.lit("/d/REPOS_ANALYZED/"), "source", F.lit("/run_qwen2.5_32b/"), "doc_id", F.lit("/OutputData/"), name)
    rows = D.report_chunks(d.select(path.alias("path"), "text"))
    return rows.groupBy("subtype", "repo", "model", "source_file").agg(F.count(F.lit(1)).alias("chunks"), F.min(F.length("text")).cast("bigint").alias("shortest"))


VALUES = """mtext AS (SELECT r.*, coalesce(CAST(ms AS VARCHAR), '?') AS a, coalesce(CAST(pc AS VARCHAR), '?') AS b, coalesce(CAST(dl AS VARCHAR), '?') AS c, coalesce(CAST(il AS VARCHAR), '?') AS d
  FROM revisions r JOIN mwide m ON m.repo = r.repo AND m.rev = r.rev)"""


@query("series_texts_s21", sql("""
    SELECT repo, concat('TIMESERIES for ', repo, ':', chr(10), string_agg(concat('  rev', rev, ' (', strftime(commit_ts, '%Y-%m-%d'), '): mscore=', a, ', propagation_cost=', b, ', decoupling_level=', c,
      ', independence_level=', d), chr(10) ORDER BY rev)) AS text FROM mtext GROUP BY repo""", VALUES))
def _(h):
    return D.series_texts(h.revisions, h.metrics)


@query("history_texts_s22", sql("""
    SELECT repo, concat('GIT REVISION HISTORY for ', repo, ':', chr(10), string_agg(concat('  rev', rev, ' | ', strftime(commit_ts, '%Y-%m-%d'), ' | ', substring(commit_hash, 1, 8), ' | mscore=', a, ' | ', message),
      chr(10) ORDER BY rev)) AS text FROM mtext GROUP BY repo""", VALUES))
def _(h):
    return D.history_texts(h.revisions, h.metrics)


@query("module_texts_s21", sql("""
    SELECT m.repo, CAST(m.rev AS BIGINT) AS rev, count(*) AS modules, string_agg(concat(layer_no, ':', module_size, ':', f.names), ';' ORDER BY layer_no, m.module_no) AS text FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, rev ORDER BY layer_no, module_no) AS k FROM mscores) m
    JOIN (SELECT repo, rev, layer_no AS l, module_no AS mo, string_agg(split_part(file, '/', -1), ', ' ORDER BY k) AS names FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, rev, layer_no, module_no ORDER BY file) AS k FROM locations) WHERE k <= 4 GROUP BY ALL) f
      ON f.repo = m.repo AND f.rev = m.rev AND f.l = m.layer_no AND f.mo = m.module_no WHERE k <= 20 GROUP BY 1, 2""", *SCORE))
def _(h):
    return _module_texts(h, 20)


@query("module_texts_all_s21", uncut("module_texts_s21", " WHERE k <= 20"))
def _(h):
    return _module_texts(h, None)


def _module_texts(h, shown):
    scores = M.module_scores(h.locations, h.edges)
    texts = D.module_texts(scores, M.sample_files(h.locations, 4), M.mscore(scores), F.col("rev").cast("string"), shown)
    lines = F.regexp_extract_all("text", F.lit(r"(?m)^  Layer ([0-9]+: size=[0-9]+) files, .* \| files: .*$"), 1)
    names = F.regexp_extract_all("text", F.lit(r"(?m)^  Layer .* \| files: (.*)$"), 1)
    joined = F.array_join(F.zip_with(lines, names, lambda a, b: F.concat(F.replace(a, F.lit(" size="), F.lit("")), F.lit(":"), b)), ";")
    return _big(texts.select("repo", "rev", F.size(lines).alias("modules"), joined.alias("text")), "rev", "modules")


FACTS = f"""facts AS (SELECT layer, repo, i, {strip_sql("substring(text, i + 1, 1200)")} AS text FROM (SELECT layer, repo, text, unnest(range(0, length(text), 1000)) AS i FROM (
  SELECT 'L3' AS layer, repo, concat('TIMESERIES for ', repo, ':', chr(10), string_agg(concat('  rev', rev, ' (', strftime(commit_ts, '%Y-%m-%d'), '): mscore=', a, ', propagation_cost=', b,
    ', decoupling_level=', c, ', independence_level=', d), chr(10) ORDER BY rev)) AS text FROM mtext GROUP BY repo
  UNION ALL SELECT 'L4', repo, concat('GIT REVISION HISTORY for ', repo, ':', chr(10), string_agg(concat('  rev', rev, ' | ', strftime(commit_ts, '%Y-%m-%d'), ' | ', substring(commit_hash, 1, 8),
    ' | mscore=', a, ' | ', message), chr(10) ORDER BY rev)) FROM mtext GROUP BY repo)))"""


def _fact_chunks(h):
    source = F.concat("repo", F.lit("/timeseries.json"))
    return D.fact_line_chunks(D.series_lines(h.revisions, h.metrics), "L3", "ts", source), D.fact_line_chunks(D.history_lines(h.revisions, h.metrics), "L4", None, source)


@query("fact_chunks_s21_s22", sql("""
    SELECT concat(layer, CASE WHEN layer = 'L3' THEN ':ts' ELSE '' END, ':', repo, ':', row_number() OVER (PARTITION BY layer, repo ORDER BY i) - 1) AS chunk_id, text FROM facts WHERE length(text) >= 80""", VALUES, FACTS))
def _(h):
    three, four = _fact_chunks(h)
    return three.unionByName(four).select("chunk_id", "text")


@query("all_layers_u3", sql("""
    SELECT layer, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT layer, text FROM chunks WHERE layer IN ('L1', 'L2') UNION ALL SELECT layer, text FROM facts WHERE length(text) >= 80) GROUP BY 1""", VALUES, FACTS))
def _(h):
    three, four = _fact_chunks(h)
    rows = D.all_chunks(h.chunks.filter(F.col("layer").isin("L1", "L2")), three, four)
    return rows.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# --- sinks -------------------------------------------------------------------------


@query("risk_files_k1", sql(f"SELECT repo, rank, file, risk_score, {', '.join(K.RAW)}, types AS anti_patterns_seen FROM ranking", *RISK))
def _(h):
    path = scratch_path(h.spark, "risk")
    W.write_risk(_ranked(h), W.risk_meta(h.revisions, K.WEIGHTS, THRESHOLD), path)
    schema = "repo string, rank bigint, risk_score double, file string, " + ", ".join(f"{s} double" for s in K.RAW) + ", anti_patterns_seen string"
    rows = h.spark.read.schema(schema).option("header", True).csv(f"{path}/csv")
    return rows.fillna("", ["anti_patterns_seen"])


@query("risk_meta_k1", sql("SELECT repo, count(*) AS revision_count, concat(strftime(min(commit_ts), '%Y-%m-%d'), ' to ', strftime(max(commit_ts), '%Y-%m-%d')) AS date_range FROM revisions GROUP BY 1"))
def _(h):
    return W.risk_meta(h.revisions, K.WEIGHTS, THRESHOLD).select("repo", "revision_count", "date_range")


@query("membership_files_k3", sql("SELECT repo, CAST(rev AS BIGINT) AS rev, type, file, instance FROM anti_patterns"))
def _(h):
    path = scratch_path(h.spark, "members")
    W.write_memberships(h.anti_patterns, path)
    return h.spark.read.schema("file string, instance string, repo string, rev bigint, type string").parquet(path)


@query("index_files_k4", sql("SELECT v.term, count(*) AS postings, round(sum(w), 6) AS weight, any_value(df) AS df FROM vec v JOIN idf ON idf.term = v.term GROUP BY v.term", TOKENS))
def _(h):
    path = scratch_path(h.spark, "index")
    idf, postings, _norms = T.build_index(h.chunks)
    W.write_index(h.chunks, idf, postings, path)
    rows = h.spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.round(F.sum("w"), 6).alias("weight"))
    return rows.join(h.spark.read.parquet(f"{path}/idf").select("term", "df"), "term")


@query("graph_diff_files_k5", sql("""
    SELECT p.repo, CAST(p.new_rev AS BIGINT) AS new_rev, concat('EVIDENCE_GRAPH_DIFF/evidence_graph_diff_new', p.new_rev, '_old', p.old_rev, '.json') AS path, n AS nodes_new FROM pairs p
    JOIN (SELECT repo, rev, count(*) AS n FROM nodes GROUP BY ALL) a ON a.repo = p.repo AND a.rev = p.new_rev"""))
def _(h):
    h = h.stored("lines", "nodes", "edges")
    path = scratch_path(h.spark, "diffs")
    W.write_graph_diffs(G.graph_diff(h.nodes, h.edges, h.pairs), path)
    index = h.spark.read.schema("repo string, new_rev bigint, old_rev bigint, path string").json(f"{path}/index")
    diffs = h.spark.read.schema("repo string, new_rev bigint, nodes_new bigint").json(f"{path}/diffs")
    return index.join(diffs, ["repo", "new_rev"]).select("repo", "new_rev", "path", "nodes_new")
