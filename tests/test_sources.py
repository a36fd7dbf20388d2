import gzip
import json
from functools import cached_property

from pyspark.sql import functions as F

from chronolith.sources import antipatterns as A
from chronolith.sources import documents as D
from chronolith.sources import graphs as X
from chronolith.sources import issues as I
from chronolith.sources import logs as V
from chronolith.sources import metrics as Y
from chronolith.sources.paths import keyed, read_documents, revisions_on_disk


def docs(spark, *texts, repo="r", rev=1):
    return spark.createDataFrame([(repo, rev, t if isinstance(t, str) else json.dumps(t)) for t in texts], "repo string, rev int, text string")


def test_matrix_documents(spark, rows, tmp_path):
    cells = [
        {"src": 0, "dest": 1, "values": {"Call": 2, "Use": 1.5}}, {"src": 1, "dest": 2, "values": {"Call": 0}}, {"src": 0, "dest": 9, "values": {"Call": 1}},
        {"src": -1, "dest": 1, "values": {"Call": 1}}, {"src": 2, "dest": 0, "values": {}}, {"src": 2, "dest": 1, "values": {"Call": "x"}},
    ]
    for name, key in (("01_a_x", "cells"), ("02_a_x", "matrix")):
        folder = tmp_path / "REPOS_ANALYZED" / "io" / name / "dsm"
        folder.mkdir(parents=True)
        (folder / "matrix.json").write_text(json.dumps({"variables": ["a", "b", "c"], key: cells}, indent=1))
    files = keyed(read_documents(spark, str(tmp_path), "matrix.json"))
    assert rows(revisions_on_disk(files)) == [("io", 1), ("io", 2)]
    m = X.matrices(files)
    assert rows(X.matrix_edges(m).filter("rev = 2"), "src", "dest", "kind", "weight") == [("a", "b", "Call", 2.0), ("a", "b", "Use", 1.5)]
    assert X.matrix_edges(m).filter("rev = 1").count() == 2
    assert rows(X.matrix_edges(m, keep_empty=True).filter("rev = 1 and weight = 0"), "src", "dest") == [("b", "c"), ("c", "a"), ("c", "b")]
    assert rows(X.matrix_nodes(m).filter("rev = 1"), "idx", "node") == [(0, "a"), (1, "b"), (2, "c")]


def item(name):
    return {"@type": "item", "name": name}


def group(name, *nested):
    return {"@type": "group", "name": name, "nested": list(nested)}


def test_clustering_trees(spark, rows):
    tree = {"structure": [
        group("L0", group("L0", group("deep", group("deeper", item("a"))), item("b")), item("c")), group("empty", group("nothing")),
        group("L1", group("gone"), group("m", item("a"), item("d"))), item("loose"),
    ]}
    items = X.tree_items(docs(spark, tree))
    assert rows(X.tree_locations(items), "file", "layer", "module_path") == [
        ("a", "L1", "L1/m"), ("b", "L0", "L0"), ("c", "L0", "L0"), ("d", "L1", "L1/m")]
    assert rows(X.numbered_locations(items), "file", "layer_no", "module_no") == [
        ("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("c", 0, 1), ("d", 1, 0)]
    assert rows(X.child_counts(docs(spark, tree)), "top", "modules") == [(0, 2), (1, 1), (2, 2)]


def test_group_names_carry_layers(spark, rows):
    tree = {"structure": [group("L0/M2/L1", item("a"), group("x/L3", item("b")))]}
    groups = X.tree_groups(X.tree_items(docs(spark, tree)))
    assert rows(groups, "name", "file") == [("L0/M2/L1", "a"), ("L0/M2/L1", "b"), ("x/L3", "b")]


def test_many_layers_are_numbered_in_order(spark):
    tree = {"structure": [group(f"L{i}", item(f"f{i}")) for i in range(13)]}
    got = X.numbered_locations(X.tree_items(docs(spark, tree))).collect()
    assert {r.file: r.layer_no for r in got} == {f"f{i}": i for i in range(13)}


def test_logs(spark, rows, tmp_path):
    typed = tmp_path / "typed.txt"
    typed.write_text("__COMMIT__\nabcdefgh\tIO-1 a|b\ttail\n\n3\t4\tsrc/A.java\n-\t-\tlogo.png\n1\tbad\nx\ty\tz\n__COMMIT__\nbbbbbbbb\tempty\n")
    records = V.log_records(V.read_log(spark, str(typed)))
    assert rows(V.log_commits(records), "hash", "subject") == [("abcdefgh", "IO-1 a|b\ttail"), ("bbbbbbbb", "empty")]
    assert rows(V.log_changes(records), "hash", "file", "added", "deleted") == [("abcdefgh", "logo.png", 0, 0), ("abcdefgh", "src/A.java", 3, 4)]
    dated = tmp_path / "dated.txt"
    dated.write_text("h1|2020-01-02 03:04:05 +0100|Ann|none\nh2|2020-01-01 00:00:00 +0000|Bo|fix | more\n1\t2\ta\n\nh3|2019-01-01 00:00:00 +0000|Cy|x\n5\t0\tb\n")
    records = V.log_records(V.read_log(spark, str(dated), "\n\n"), "dated")
    assert rows(V.log_commits(records), "hash", "author", "subject") == [("h1", "Ann", "none"), ("h2", "Bo", "fix | more"), ("h3", "Cy", "x")]
    assert rows(V.log_changes(records), "hash", "file", "added") == [("h2", "a", 1), ("h3", "b", 5)]
    status = tmp_path / "status.txt"
    status.write_text("__COMMIT__\nh1\tx\nA\tnew.py\nR100\told\tnew\nM\n")
    assert rows(V.log_statuses(V.log_records(V.read_log(spark, str(status)))), "status", "file") == [("A", "new.py"), ("R100", "old\tnew")]


def test_revision_series(spark, rows):
    series = {"repo": "io", "revisions": [
        {"revision_number": 1, "commit_hash": "n", "commit_date": "2021-01-01 00:00:00 +0000", "metrics": {"m-score": "63.1%", "propagation_cost": 0.0, "decoupling-level": "∞"}},
        {"hash": "o", "date": "2020-01-01", "message": "m", "metrics": {"mscore": 5, "x": {"y": 1}}},
    ]}
    revs = V.series_revisions(docs(spark, series))
    assert rows(revs, "rev", "commit_hash", "message") == [(1, "n", None), (2, "o", "m")]
    got = {(r.rev, r.metric): r.value for r in V.series_metrics(revs).collect()}
    assert got[(1, "m-score")] == 63.1 and got[(1, "propagation-cost")] == 0.0 and got[(1, "decoupling-level")] is None and got[(2, "m-score")] == 5.0


def test_issue_sources(spark, rows):
    nested = {"meta": {"repo": "x-y"}, "issues": {"A-1": "bug"}, "summaries": {"A-1": "broken"}}
    flat = {"B-2": "feature", "count": "x", "C-3": 5}
    assert rows(I.issue_maps(docs(spark, nested, flat)), "key", "type", "summary") == [("A-1", "bug", "broken"), ("B-2", "feature", None)]
    hosted = [
        {"number": 1, "title": " one ", "labels": [{"name": "later"}, {"name": "Docs"}, {"name": "bug"}]},
        {"number": 2, "title": "pr", "labels": [{"name": "bug"}], "pull_request": {"url": "u"}}, {"number": 3, "title": "plain", "labels": []},
    ]
    got = I.hosted_issues(docs(spark, *hosted))
    assert rows(got, "key", "type", "summary") == [("GH#1", "documentation", "one"), ("GH#3", None, "plain")]
    page = {"issues": [{"key": "A-1", "fields": {"issuetype": {"name": " Sub-task"}, "summary": "s"}}, {"key": "GH#3", "fields": {"issuetype": {"name": "Epic"}, "summary": "t"}}, {"key": ""}]}
    tracked = I.tracker_issues(docs(spark, page))
    assert rows(I.merged_issues(tracked, got), "key", "type", "summary") == [
        ("A-1", "refactoring", "s"), ("GH#1", "documentation", "one"), ("GH#3", None, "plain")]


def member_blob(*names, tail=b""):
    body = b"\x09" + b"".join(b"\x01\x00" + bytes([len(n)]) + n.encode() for n in names) + tail + b"\x00\x00\x00"
    return b"magic" + gzip.compress(body)


def test_member_files(spark, rows, tmp_path):
    a = tmp_path / "REPOS_ANALYZED" / "io" / "03_x" / "OutputData" / "arch-issue" / "clique" / "7"
    b = tmp_path / "REPOS_ANALYZED" / "io" / "04_x" / "OutputData" / "deep" / "anti-pattern-instances" / "cycle" / "1"
    for folder in (a, b):
        folder.mkdir(parents=True)
        (folder / "m.clsx").write_bytes(member_blob("org/A.java", "readme.txt", "B.HPP", "org/A.java"))
    (a / "broken.clsx").write_bytes(b"no gzip here")
    (a / "torn.clsx").write_bytes(b"\x1f\x8btorn")
    (a / "cut.clsx").write_bytes(member_blob("org/A.java", *[f"f{i}/C{i * i}.java" for i in range(400)])[:-20])
    decoded = A.decode_members(A.read_blobs(spark, str(tmp_path), "*.clsx"))
    assert rows(A.memberships(decoded), "rev", "type", "file") == [
        (3, "clique", "B.HPP"), (3, "clique", "org/A.java"), (4, "cycle", "B.HPP"), (4, "cycle", "org/A.java")]
    assert rows(A.placed_members(decoded).filter("rev = 3"), "instance", "file", "ord") == [("7", "B.HPP", 1), ("7", "org/A.java", 0), ("7", "org/A.java", 2)]
    blob = spark.createDataFrame([("p", bytearray(member_blob("x/B.py", tail=b" lib/c/D.go Import Call Calls x/B.py ")))], "path string, content binary")
    got = A.decode_members(blob, scan_text=True).collect()
    assert [r.file for r in got] == ["x/B.py", "lib/c/D.go"] and got[0].kinds == ["Call", "Import"]


def test_summary_tables(spark, rows, tmp_path):
    (tmp_path / "anti-pattern-summary.csv").write_text("type,instances,files\nClique,2,17.0\nCycle,1,4\n")
    assert A.read_summaries(spark, str(tmp_path)).count() == 2
    assert [r.files for r in A.clique_counts(spark, str(tmp_path)).collect()] == [17]
    html = "<table><tr><th>Metric</th></tr></table><TABLE><tr><th>File <b>name</b></th><th>FanIn</th></tr><tr><td>a.java</td><td> 3\n4 </td></tr><tr><td>odd</td></tr></TABLE><table><th>file</th></table>"
    got = A.html_table_rows(spark.createDataFrame([("r", 1, html), ("r", 2, "<p>none</p>")], "repo string, rev int, html string")).collect()
    assert [(r.rev, r.row) for r in got] == [(1, {"File name": "File name", "FanIn": "FanIn"}), (1, {"File name": "a.java", "FanIn": "3 4"})]


def test_metric_files(spark):
    cases = [
        ({"propagationCost": "∞", "numberOfIsolatedItems": "0", "propagationCostExcludeIsolatedItems": "9%"}, 0.0),
        ({"propagationCost": "inf", "numberOfIsolatedItems": "1,200", "propagationCostExcludeIsolatedItems": "9%"}, 9.0),
        ({"propagationCost": 12.5}, 12.5), ({"mScore": "5%"}, None),
    ]
    for i, (doc, want) in enumerate(cases):
        row = Y.metric_files(docs(spark, doc, rev=i)).collect()[0]
        assert row["propagation-cost"] == want
    both = Y.metric_files(docs(spark, {"mScore": "5%"}, {"decouplingLevel": "7%"})).collect()
    assert len(both) == 1 and both[0]["m-score"] == 5.0 and both[0]["decoupling-level"] == 7.0


def test_tool_logs(spark, rows):
    from chronolith.operators.reports import tool_problems, tool_report

    log = [{"step": "a", "rc": 0, "stderr": "some Error"}, {"step": "b", "rc": 1, "cmd": "c"}, {"step": "ok", "rc": 0, "stderr": "fine"}]
    bad = tool_problems(Y.tool_steps(docs(spark, log)))
    assert rows(bad, "step", "rc") == [("a", 0), ("b", 1)]
    assert tool_report(bad).collect()[0].report == "- Step: a (rc=0)\n  Cmd: \n  Stderr: some Error\n- Step: b (rc=1)\n  Cmd: c"


def test_report_files(spark, rows):
    long = "word " * 60
    paths = ["/d/REPOS_ANALYZED/io/260224_qwen2.5_32b/drh_diff_report_x.md", "/d/REPOS_ANALYZED/io/01_io_1/OutputData/interpretation_payload.md", "/d/REPOS_ANALYZED/io/drh_diff_report_x.prompt.txt", "/d/x/short.md"]
    files = spark.createDataFrame([(p, long if "short" not in p else "tiny") for p in paths], "path string, text string")
    assert rows(D.report_chunks(files), "chunk_id", "subtype", "model") == [
        ("L2:drh:io:drh_diff_report_x.md:0", "drh_diff", "qwen2.5:32b"), ("L2:payload:io:01_io_1:0", "payload", "")]
    assert rows(D.knowledge_chunks(files).select(F.col("chunk_id"))) == [
        ("L1:drh_diff_report_x.md:0",), ("L1:drh_diff_report_x.prompt.txt:0",), ("L1:interpretation_payload.md:0",)]


def test_graph_diff_files_read_written_tables(spark, rows, monkeypatch, tmp_path):
    """Nodes and edges have many readers, so they are written once instead of being built for each."""
    from chronolith.plans import source_queries as Q
    from chronolith.plans.registry import QUERIES
    from chronolith.plans.bindings import History

    tables = {
        "lines": spark.createDataFrame([("r", 1)], "repo string, yr int"),
        "nodes": spark.createDataFrame([("r", v, n) for v in (1, 2) for n in "abc"[:v + 1]], "repo string, rev int, node string"),
        "edges": spark.createDataFrame([("r", v, "a", "b", "N", 1.0) for v in (1, 2)], "repo string, rev int, src string, dest string, kind string, weight double"),
        "revisions": spark.createDataFrame([("r", 1), ("r", 2)], "repo string, rev int"),
    }
    for name, table in tables.items():
        given = cached_property(lambda h, table=table: table)
        given.__set_name__(History, name)
        monkeypatch.setattr(History, name, given)
    seen, diff = [], Q.G.graph_diff
    monkeypatch.setattr(Q.G, "graph_diff", lambda nodes, edges, pairs: seen.extend([nodes, edges]) or diff(nodes, edges, pairs))
    got = rows(QUERIES["graph_diff_files_k5"](spark, str(tmp_path)), "repo", "new_rev", "nodes_new")
    assert got == [("r", 1, 2)]
    assert all(hasattr(t, "scratch") for t in seen)
