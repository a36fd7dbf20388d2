import datetime

from pyspark.sql import functions as F

from chronolith.functions import classify as C
from chronolith.functions import dates as D
from chronolith.functions import text as X


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_paths(spark):
    got = values(spark, [" src\\main\\java\\org\\A.java ", "src/main/x/B.py", "main/java/lib/C.kt", "lib/lib/D", None, "org/E"], X.normalise_path(F.col("t")))
    assert got == ["org/A.java", "x/B.py", "lib/C.kt", "lib/D", "", "org/E"]
    assert values(spark, ["a/b/C.java", "C.java"], X.basename(F.col("t")), X.parent_name(F.col("t"))) == [("C.java", "b"), ("C.java", "")]


def test_numbers_in_text(spark):
    texts = ["63.1%", " 7 ", "∞", "-inf", "nan", "1e3", "5d", "", None, "abc%", "1,234.9", "-"]
    assert values(spark, texts, X.parse_percent(F.col("t"))) == [63.1, 7.0, None, None, None, 1000.0, None, None, None, None, None, None]
    assert values(spark, texts, X.parse_int(F.col("t")))[9:] == [None, 1234, None]
    assert values(spark, ["-3.9", "2.", "-", " 4 ", "1e3"], X.strict_int(F.col("t"))) == [-3, None, None, 4, None]
    assert values(spark, ["0.000123", "63.5"], X.number_text(F.col("t").cast("double"))) == ["0.000123", "63.5"]


def test_markup_and_space(spark):
    assert values(spark, ["<b>a </b>\n <i>b</i>"], X.plain_text(F.col("t"))) == ["a b"]


def test_commit_dates(spark):
    texts = ["2020-01-05 10:11:12 +0200", "2020-01-05", "2020-13-45 1:2:3", "junk", "2020-01-05 99:99:99 +0000", "2021-02-03 04:05:06 -0700"]
    got = values(spark, texts, D.commit_timestamp(F.col("t")))
    day = datetime.datetime(2020, 1, 5)
    assert got == [day.replace(hour=10, minute=11, second=12), day, None, None, day, datetime.datetime(2021, 2, 3, 4, 5, 6)]


def test_request_dates(spark):
    a, b = D.request_range(F.col("t"))
    got = values(spark, ["between 2012 and 2014-02", "from 2011-03-04 to 2012-05-06", "whenever"], a, b)
    d = datetime.date
    assert got == [(d(2012, 1, 1), d(2014, 2, 28)), (d(2011, 3, 4), d(2012, 5, 6)), (None, None)]
    assert values(spark, ["in 1999 or 2003-04"], D.request_dates(F.col("t"))) == [[d(1999, 1, 1), d(2003, 4, 1)]]


def test_issue_keys_and_classes(spark):
    assert values(spark, ["fixes #12, AB-1 and C2D-33 A#9"], C.issue_keys(F.col("t"))) == [["AB-1", "C2D-33", "GH#12"]]
    assert values(spark, ["Move and fix", "Prefix stuff", "Add docs", "readme", "junit run", "zzz"], C.commit_category(F.col("t"))) == [
        "refactoring", "bugfix", "feature", "documentation", "test", "other"]
    assert values(spark, ["fixes it", "a FIX", "issue"], C.mentions_bug(F.col("t")), C.mentions_bug(F.col("t"), C.BUG_WORDS_NARROW)) == [
        (False, False), (True, True), (True, False)]
    assert values(spark, [" Bug", "Custom", "x"], C.label_type(F.col("t"), {" CUSTOM ": "test"})) == ["bug", "test", None]


def test_path_classes(spark):
    assert values(spark, ["src/Test/A.java", "a/testing.py", "contest/a.h", "x/noext"], C.is_excluded_path(F.col("t")), C.is_source_file(F.col("t"))) == [
        (True, True), (False, True), (False, True), (False, False)]
    paths = ["/x/REPOS_ANALYZED/io/run/a.md", "/a/b/c/d/e.md", "a.md"]
    assert values(spark, paths, C.repo_from_path(F.col("t"))) == ["io", "b", "unknown"]
    assert values(spark, ["/a/260224_deepseek-r1_32b/x.md", "/deepseek_r1_14b/qwen2.5_7b/x.md", "/p/x.md"], C.model_from_path(F.col("t"))) == [
        "deepseek-r1:32b", "qwen2.5:7b", ""]


def test_question_types(spark):
    asked = ["Which file is worst?", "compare repos in 2020", "when did it break", "What is PC?", "hello"]
    assert values(spark, asked, C.question_type(F.col("t"))) == ["file_refactor", "cross_repo", "date_range", "metric_explain", "general"]


def test_zones_close_at_the_top(spark):
    df = spark.createDataFrame([("m-score", 100.0), ("m-score", 30.0), ("propagation-cost", 29.9), ("m-score", None)], "metric string, value double")
    got = {(r.metric, r.value): r.zone for r in C.metric_zone(spark, df).collect()}
    assert got == {("m-score", 100.0): "excellent", ("m-score", 30.0): "moderate", ("propagation-cost", 29.9): "excellent", ("m-score", None): None}


def test_report_cleaning(spark):
    assert values(spark, ["Thinking...\nabc\n...done thinking.\n\nBody\nx", "Thinking\nno end", "Body"], X.strip_thinking(F.col("t"))) == [
        "Body\nx", "Thinking\nno end", "Body"]
    assert values(spark, ["pre\n```md\na\nb\n```\npost", "```\n```", "no", "```\nopen"], X.strip_fences(F.col("t"))) == ["a\nb", "```\n```", "no", "```\nopen"]
    report = "## A\n1\n## B\n2\n\n3\n### c\n## D\n"
    assert values(spark, [report, "x"], X.h2_section(F.col("t"), "## B"), X.section_body(F.col("t"), "## B")) == [("## B\n2\n\n3\n### c\n", "2\n\n3\n### c"), ("", "")]


def test_driver_bullets(spark):
    text = "## Likely Drivers\n1. one\n\n# drop\n- two\nthree\n" + "\n".join(f"{i}) x" for i in range(20))
    got = values(spark, [text, "## Likely Drivers\n", ""], X.driver_bullets(F.col("t"), cap=15))
    assert len(values(spark, [text], X.driver_bullets(F.col("t")))[0].splitlines()) == 24
    assert got[0].splitlines()[:4] == ["## Likely Drivers", "- one", "- two", "- three"] and len(got[0].splitlines()) == 16
    assert got[1:] == ["## Likely Drivers\n- (missing)\n", ""]


def test_mentions_and_counts(spark):
    assert values(spark, ["see `src/a/Foo.java`, 63.08 and b.py."], X.file_mentions(F.col("t"))) == [["src/a/Foo.java", "b.py"]]
    a, b = X.file_count_change(F.col("t"))
    assert values(spark, ["- DRH file count: old=3 → new=12 (Δ=+9)", "none"], a, b) == [(3, 12), (None, None)]
