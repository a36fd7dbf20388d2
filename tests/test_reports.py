from chronolith.operators import reports as R
from chronolith.operators import verify as V

PAIRS = "repo string, new_rev int, old_rev int"


def test_dangerous_rows(spark):
    rows = [("r", 1, 0, "a", "3", "4", "-"), ("r", 1, 1, "b", "1.9", "0", "2"), ("r", 1, 2, "c", "x", "7", None), ("r", 1, 3, "d", "", "", "")]
    df = spark.createDataFrame(rows, "repo string, rev int, ord int, file string, fan_in string, fan_out string, churn string")
    assert [(r.file, r.score) for r in R.top_dangerous(df, 3).orderBy("rank").collect()] == [("b", 21), ("a", 7), ("c", 7)]


def test_fan_lookup_by_name(spark):
    fans = spark.createDataFrame([("r", 1, "x/A.java", 1, 2, 0), ("r", 1, "y/A.java", 5, 6, 1)], "repo string, rev int, file string, fan_in int, fan_out int, ord int")
    files = spark.createDataFrame([("r", 1, 0, 0, ["p/A.java", "p/B.java", "p/C.java", "p/D.java"])], "repo string, rev int, layer_no int, module_no int, files array<string>")
    assert R.module_files_text(files, fans).collect()[0].files_text == "A.java(FanIn=5,FanOut=6), B.java, C.java, ..."


def test_allowed_files_keep_first_mention(spark):
    a = spark.createDataFrame([("r", 1, 2, 0, "x"), ("r", 1, 2, 1, "y")], PAIRS + ", ord int, file string")
    b = spark.createDataFrame([("r", 1, 2, 0, "y"), ("r", 1, 2, 1, "z"), ("r", 1, 2, 2, None)], PAIRS + ", ord int, file string")
    assert [r.file for r in R.allowed_files([a, b]).orderBy("rank").collect()] == ["x", "y", "z"]


def test_layer_hint(spark):
    layers = spark.createDataFrame([("r", 2, "L0", 5), ("r", 1, "L0", 3), ("r", 1, "L1", 4)], "repo string, rev int, layer string, files long")
    moves = spark.createDataFrame([("r", 1, 2, 5, 7)], PAIRS + ", files_old long, files_new long")
    diff = spark.createDataFrame([("r", 1, 2, 4.0, 10.0, 0, 1, 0, 3)], PAIRS + ", weight_new double, weight_old double, scc_count_new long, scc_count_old long, largest_scc_new long, largest_scc_old long")
    members = spark.createDataFrame([("r", 2, "a", f"src/{x}.java") for x in "abc"], "repo string, rev int, component string, node string")
    heavy = spark.createDataFrame([("r", 1, 2, "removed", "p/A.java", "p/B.java", "Call", 12.0)], PAIRS + ", status string, src string, dest string, kind string, weight double")
    patterns = spark.createDataFrame([("r", 1, 2, "clique", 1, 3, -2)], PAIRS + ", type string, n_new long, n_old long, delta long")
    changes = spark.createDataFrame([("r", 1, 2, "m-score", 50.0, 60.5, 10.5, 21.0)], PAIRS + ", metric string, old_value double, new_value double, delta double, relative double")
    allowed = spark.createDataFrame([("r", 1, 2, "x.java", 1)], PAIRS + ", file string, rank long")
    hints = [r.hint for r in R.narrative_hints(layers, moves, diff, members, heavy, patterns, changes, allowed).orderBy("rank").collect()]
    assert hints[0].startswith("DRH layering changed from 1 layer(s) (L0:5) to 2 layer(s) (L0:3, L1:4)")
    assert hints[1].startswith("DRH file count changed from 5 to 7 (delta=+2)")
    assert hints[2].startswith("Evidence graph total dependency weight changed from 10 to 4 (delta=-6)")
    assert "(largest=3 files: a.java, b.java, c.java) to 0" in hints[3]
    assert hints[4].startswith("The heaviest removed edge was A.java -> B.java (Call weight=12)")
    assert hints[5] == "Anti-pattern 'clique' count changed from 3 to 1 (delta=-2)."
    assert hints[6] == "m-score changed from 50.0 to 60.5 (delta=+10.50 points, +21.00% relative)."
    assert hints[7].endswith("(e.g., x.java).") and len(hints) == 8


def test_question_context_budgets(spark):
    report = "## Comprehensive Summary\nS\n## Other\n" + "n" * 40000
    df = spark.createDataFrame([("m" * 7000, "r" * 5000, None, report), (None, None, None, "short")], "modules_text string, risk_text string, commit_text string, report_text string")
    a, b = [r.context for r in R.question_context(df).collect()]
    assert a.count("m" * 6000) == 1 and "m" * 6001 not in a and "r" * 4001 not in a and "## Comprehensive Summary\nS" in a
    assert 28000 <= len(a) <= 28002 and b == "short"


def test_report_findings(spark, rows):
    good = "## Comprehensive Summary\nx\n## DRH Differences\na\nb src/A.java\n## Metrics & Evidence\na\nb\n## Likely Drivers\n- A.java\n- c\n"
    bad = "## Metrics & Evidence\none\n```\nALLOWED FILES\n## Comprehensive Summary\n## Comprehensive Summary\nZ.java\n"
    reports = spark.createDataFrame([("r", 1, 2, good), ("r", 2, 3, bad), ("r", 3, 4, good)], PAIRS + ", report_text string")
    allowed = spark.createDataFrame([("r", 1, 2, "src/A.java"), ("r", 2, 3, "src/A.java")], PAIRS + ", file string")
    got = rows(V.report_findings(reports, allowed), "new_rev", "severity", "message")
    assert [g for g in got if g[0] == 1] == []
    assert [g[1] for g in got if g[0] == 3] == ["WARN"]
    texts = " | ".join(g[2] for g in got if g[0] == 2)
    for part in ("code fences", "heading: ## DRH Differences", "heading: ## Likely Drivers", "First heading is '## Metrics & Evidence'", "multiple times",
                 "scaffolding", "not in ALLOWED FILES: Z.java"):
        assert part in texts
    roll = {r.new_rev: r.status for r in V.findings_rollup(V.report_findings(reports, allowed), PAIRS.replace(" string", "").replace(" int", "").split(", ")).collect()}
    assert roll == {2: "FAIL", 3: "PASS"}


def test_allowed_from_prompt(spark):
    prompt = "intro\n- not\n ALLOWED FILES (only)\n- a/B.java\n- (none)\n-\nx\n- c.py \nFACTS\n- later\n"
    df = spark.createDataFrame([("r", 1, 2, prompt), ("r", 2, 3, "nothing")], PAIRS + ", prompt_text string")
    assert [r.file for r in V.allowed_from_prompt(df).collect()] == ["a/B.java", "c.py"]
