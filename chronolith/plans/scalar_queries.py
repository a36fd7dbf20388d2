"""Queries over column functions: paths, numbers in text, dates, classifiers, report text."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import classify as C
from chronolith.functions import dates as D
from chronolith.functions import text as X
from chronolith.plans.bindings import _choose
from chronolith.plans.oracle import SPACE_SQL, norm_sql, sql, strip_sql
from chronolith.plans.registry import query, uncut


def _contains(column: str, groups: dict[str, tuple[str, ...]], default: str) -> str:
    whens = []
    for name, words in groups.items():
        hits = " OR ".join(f"contains(lower({column}), '{w}')" for w in words)
        whens.append(f"WHEN {hits} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE '{default}' END"


@query("normalise_path_f1_f2", sql(
    f"SELECT path, {norm_sql('path')} AS file, split_part(path, '/', -1) AS name, split_part(path, '/', -2) AS parent, count(*) AS n "
    "FROM file_changes GROUP BY path"))
def _(h):
    p = F.col("path")
    return h.file_changes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(
        "path", X.normalise_path(p).alias("file"), X.basename(p).alias("name"), X.parent_name(p).alias("parent"), "n")


@query("percent_text_f3", """
    SELECT l_returnflag, count(*) AS n, count(v) AS known, round(sum(v), 4) AS total FROM (
      SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN l_quantity + 0.5 WHEN l_linestatus = 'F' THEN NULL ELSE l_tax END AS v FROM lineitem)
    GROUP BY 1""")
def _(h):
    q = F.col("l_quantity").cast("bigint").cast("string")
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" "), q, F.lit(".5% "))).when(
        F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "N", "∞").otherwise("-inf")).otherwise(F.col("l_tax").cast("string"))
    rows = h.table("lineitem").select("l_returnflag", X.parse_percent(text).alias("v"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.round(F.sum("v"), 4).alias("total"))


@query("integer_text_f4", """
    SELECT l_returnflag, CAST(sum(CAST(trunc(l_extendedprice) AS BIGINT)) AS BIGINT) AS parsed,
      CAST(sum(CASE WHEN l_discount = 0 THEN NULL ELSE CAST(trunc(l_quantity) AS BIGINT) END) AS BIGINT) AS strict FROM lineitem GROUP BY 1""")
def _(h):
    money = F.format_number("l_extendedprice", 2)
    strict = F.when(F.col("l_discount") == 0, "-").otherwise(F.col("l_quantity").cast("string"))
    rows = h.table("lineitem").select("l_returnflag", X.parse_int(money).alias("a"), X.strict_int(strict).alias("b"))
    return rows.groupBy("l_returnflag").agg(F.sum("a").alias("parsed"), F.sum("b").alias("strict"))


@query("plain_text_f5", f"""
    SELECT page_id, {strip_sql(f"regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '{SPACE_SQL}+', ' ', 'g')")} AS text FROM pages""")
def _(h):
    return h.table("pages").select("page_id", X.plain_text(F.col("html")).alias("text"))


@query("commit_dates_f6", sql("""
    SELECT strftime(ts, '%d%m%Y_%H%M') AS stamp, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM commits GROUP BY 1, 2"""))
def _(h):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    rows = h.commits.select(text.alias("t"))
    return rows.groupBy(D.folder_stamp(D.commit_timestamp(F.col("t"))).alias("stamp"), D.month_text(F.col("t")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


KEYS_SQL = ("list_concat(regexp_extract_all(subject, '\\b[A-Z][A-Z0-9]+-[0-9]+\\b'), "
            "list_transform(regexp_extract_all(subject, '(?:^|[^A-Z0-9])#([0-9]+)\\b', 1), lambda x: concat('GH#', x)))")


@query("issue_keys_f7", sql(f"SELECT repo, hash, array_to_string({KEYS_SQL}, ',') AS keys FROM commits"))
def _(h):
    return h.commits.select("repo", "hash", F.array_join(C.issue_keys(F.col("subject")), ",").alias("keys"))


@query("commit_categories_f8", sql(f"""
    SELECT source, category, count(*) AS n FROM (SELECT 'commit' AS source, {_contains('subject', C.COMMIT_WORDS, 'other')} AS category FROM commits
      UNION ALL SELECT role, {_contains('text', C.COMMIT_WORDS, 'other')} FROM conversations) GROUP BY 1, 2"""))
def _(h):
    a = h.commits.select(F.lit("commit").alias("source"), C.commit_category(F.col("subject")).alias("category"))
    b = h.table("conversations").select("role", C.commit_category(F.col("text")))
    return a.union(b).groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))


@query("bug_words_f9", sql(f"""
    SELECT repo, count(*) FILTER (regexp_matches(subject, '(?i)\\b({"|".join(C.BUG_WORDS_WIDE)})\\b')) AS wide,
      count(*) FILTER (regexp_matches(subject, '(?i)\\b({"|".join(C.BUG_WORDS_NARROW)})\\b')) AS narrow FROM commits GROUP BY repo"""))
def _(h):
    s = F.col("subject")
    return h.commits.groupBy("repo").agg(
        F.count_if(C.mentions_bug(s)).alias("wide"), F.count_if(C.mentions_bug(s, C.BUG_WORDS_NARROW)).alias("narrow"))


LABELS = {"1": " Bug ", "2": "Enhancement", "3": "tech debt", "4": "DOCS", "5": "misc"}
TRACKER = {"1": "Bug", "2": "Wish ", "3": "Sub-task", "4": "documentation", "5": "Epic"}


@query("label_types_f10", """
    SELECT o_orderpriority, l AS label, t AS tracker, count(*) AS n FROM (SELECT *, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'bug'
      WHEN '2' THEN 'feature' WHEN '3' THEN 'refactoring' WHEN '4' THEN 'documentation' WHEN '5' THEN 'test' END AS l,
      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'bug' WHEN '2' THEN 'feature' WHEN '3' THEN 'refactoring'
      WHEN '4' THEN 'documentation' END AS t FROM orders) GROUP BY 1, 2, 3""")
def _(h):
    first = F.substring("o_orderpriority", 1, 1)
    rows = h.table("orders").select(
        "o_orderpriority", C.label_type(_choose(first, LABELS), {"Misc": "test"}).alias("label"),
        C.tracker_type(_choose(first, TRACKER)).alias("tracker"))
    return rows.groupBy("o_orderpriority", "label", "tracker").agg(F.count(F.lit(1)).alias("n"))


def _odd_paths(h):
    folder = F.when(F.col("p_size") < 10, "src/Test").when(F.col("p_size") < 20, "target").otherwise("src/main")
    end = F.when(F.col("p_type") == "ECONOMY", ".java").when(F.col("p_type").isin("PROMO", "SMALL"), ".py").otherwise(".md")
    return h.lines.select("repo", F.concat(folder, F.lit("/P"), "l_partkey", end).alias("path")).distinct()


ODD_SQL = """odd AS (SELECT DISTINCT repo, concat(CASE WHEN p_size < 10 THEN 'src/Test' WHEN p_size < 20 THEN 'target' ELSE 'src/main' END,
    '/P', l_partkey, CASE WHEN p_type = 'ECONOMY' THEN '.java' WHEN p_type IN ('PROMO', 'SMALL') THEN '.py' ELSE '.md' END) AS path, p_size, p_type FROM lines)"""


@query("path_filters_f11", sql("""
    SELECT repo, count(*) AS files, count(*) FILTER (p_size < 20) AS excluded, count(*) FILTER (NOT ends_with(path, '.md')) AS sources,
      CASE WHEN count(*) FILTER (ends_with(path, '.py')) >= count(*) FILTER (ends_with(path, '.java')) THEN 'python' ELSE 'java' END AS language
    FROM odd GROUP BY repo""", ODD_SQL))
def _(h):
    rows = _odd_paths(h)
    counts = rows.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(C.is_excluded_path(F.col("path"))).alias("excluded"),
        F.count_if(C.is_source_file(F.col("path"))).alias("sources"))
    return counts.join(C.repo_language(rows), "repo")


@query("path_keys_f12_s23", """
    SELECT doc_id, source AS repo, CASE lang WHEN 'en' THEN 'deepseek-r1:32b' WHEN 'fr' THEN 'qwen2.5:14b' ELSE '' END AS model,
      CAST(length(lang) + 10 AS INTEGER) AS rev FROM documents""")
def _(h):
    from chronolith.sources.paths import revision_of_path

    run = F.when(F.col("lang") == "en", "260224_deepseek_r1_32b").when(F.col("lang") == "fr", "260224_Qwen2.5-14b").otherwise("260224")
    run = F.when(F.col("lang") == "fr", "260224_qwen2.5_14b").otherwise(run)
    path = F.concat(F.lit("/data/REPOS_ANALYZED/"), "source", F.lit("/"), F.length("lang") + 10, F.lit("_x_01012020/"), run, F.lit("/"), "doc_id", F.lit(".md"))
    rows = h.table("documents").select("doc_id", path.alias("path"))
    p = F.col("path")
    return rows.select("doc_id", C.repo_from_path(p).alias("repo"), C.model_from_path(p).alias("model"), revision_of_path(p).alias("rev"))


ASKED = {"1": "Which file should I REFACTOR in ", "2": "Compare the best repo of ", "3": "What changed during ", "4": "Explain the coupling of ", "5": "Hello "}


@query("question_types_f13", """
    SELECT qtype, layers, report_class, count(*) AS n FROM (SELECT
      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'file_refactor' WHEN '2' THEN 'cross_repo' WHEN '3' THEN CASE WHEN year(o_orderdate) >= 2000
        THEN 'date_range' ELSE 'general' END WHEN '4' THEN 'metric_explain' ELSE 'general' END AS qtype,
      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'L3,L2' WHEN '2' THEN 'L2,L3' WHEN '3' THEN CASE WHEN year(o_orderdate) >= 2000
        THEN 'L4,L3,L2' ELSE 'L2,L1,L3' END WHEN '4' THEN 'L1,L2' ELSE 'L2,L1,L3' END AS layers,
      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'files' ELSE 'general' END AS report_class FROM orders) GROUP BY 1, 2, 3""")
def _(h):
    text = F.concat(_choose(F.substring("o_orderpriority", 1, 1), ASKED), F.year("o_orderdate"))
    rows = h.table("orders").select(C.question_type(text).alias("qtype"), C.report_question_class(text).alias("report_class"))
    rows = rows.withColumn("layers", F.array_join(C.question_layers(F.col("qtype")), ","))
    return rows.groupBy("qtype", "layers", "report_class").agg(F.count(F.lit(1)).alias("n"))


ZONE_SQL = "(VALUES " + ", ".join(f"('{m}', '{z}', {a}, {b})" for m, z, a, b in C.METRIC_ZONES) + ") AS z(metric, zone, lo, hi)"


@query("metric_zones_f14", sql(f"""
    SELECT m.repo, CAST(m.rev AS BIGINT) AS rev, m.metric, z.zone FROM metrics m LEFT JOIN {ZONE_SQL}
    ON m.metric = z.metric AND m.value >= z.lo AND (m.value < z.hi OR (z.hi = 100 AND m.value = 100))"""))
def _(h):
    return C.metric_zone(h.spark, h.metrics).select("repo", F.col("rev").cast("bigint").alias("rev"), "metric", "zone")


@query("size_calibration_f16", """
    SELECT p_partkey, round(CASE WHEN n < 1000 THEN 0.6258 WHEN n < 5000 THEN 0.6258 + (n - 1000) / 4000.0::DOUBLE * (0.8446 - 0.6258) ELSE 0.8446 END, 6) AS factor
    FROM (SELECT p_partkey, CAST(floor(p_retailprice * p_size / 4) AS BIGINT) AS n FROM part)""")
def _(h):
    n = F.floor(F.col("p_retailprice") * F.col("p_size") / 4)
    return h.table("part").select("p_partkey", F.round(C.size_calibration(n), 6).alias("factor"))


@query("request_ranges_f17", """
    SELECT DISTINCT concat(y, ' ', m) AS k, concat(y, '-01-01') AS since, CAST(last_day(make_date(y, m, 1)) AS VARCHAR) AS until,
      concat(y, '-12-31') AS whole_until, concat(y, '-01-01,', y, '-', lpad(CAST(m AS VARCHAR), 2, '0'), '-01') AS days
    FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)""")
def _(h):
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    rows = h.table("orders").select(F.concat_ws(" ", y, m).alias("k"), y.alias("y"), m.alias("m")).distinct()
    a = D.request_range(F.concat(F.lit("Changes BETWEEN "), "y", F.lit(" and "), "y", F.lit("-"), "m"))
    b = D.request_range(F.concat(F.lit("from "), "y", F.lit(" to "), "y"))
    days = F.array_join(F.transform(D.request_dates(F.concat(F.lit("at "), "y", F.lit(" or "), "y", F.lit("-"), "m")), lambda d: d.cast("string")), ",")
    return rows.select("k", a[0].cast("string").alias("since"), a[1].cast("string").alias("until"), b[1].cast("string").alias("whole_until"), days.alias("days"))


@query("report_sections_f18", f"""
    SELECT doc_id, {strip_sql("split_part(concat(chr(10), text), concat(chr(10), '## '), 1)")} AS body, {strip_sql("text")} AS untagged,
      concat({strip_sql("concat('## DRH Differences', chr(10), text)")}, chr(10)) AS whole FROM documents WHERE NOT contains(text, '##')
    UNION ALL
    SELECT doc_id, NULL, {strip_sql("text")}, NULL FROM documents WHERE contains(text, '##')""")
def _(h):
    t = h.table("documents").select("doc_id", "text")
    clean = ~F.contains(F.col("text"), F.lit("##"))
    report = F.concat(F.lit("## Comprehensive Summary\nx\n## DRH Differences\n"), "text", F.lit("\n## Likely Drivers\n- y"))
    return t.select(
        "doc_id", F.when(clean, X.section_body(report, "## DRH Differences")).alias("body"),
        X.strip_think_tags(F.concat(F.lit("<think>a\nb</think>"), "text")).alias("untagged"),
        F.when(clean, X.h2_section(report, "## DRH Differences")).alias("whole"))


@query("driver_bullets_f19", f"""
    SELECT doc_id, concat('## Likely Drivers', chr(10), CASE WHEN len(b) = 0 THEN '- (missing)' ELSE array_to_string(b[1:15], chr(10)) END, chr(10)) AS bullets
    FROM (SELECT doc_id, list_transform(list_filter(list_transform(string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)),
        lambda s: {strip_sql('s')}), lambda s: s <> '' AND NOT regexp_matches(s, '^#{{1,6}}\\s+')),
        lambda s: concat('- ', {strip_sql("regexp_replace(s, '^(?:[0-9]+[).:-]\\s+|- )', '')")})) AS b FROM documents)""")
def _(h):
    text = F.concat(F.lit("## Likely Drivers\n"), "text")
    return h.table("documents").select("doc_id", X.driver_bullets(text, cap=15).alias("bullets"))


@query("driver_bullets_all_f19", uncut("driver_bullets_f19", "[1:15]"))
def _(h):
    text = F.concat(F.lit("## Likely Drivers\n"), "text")
    return h.table("documents").select("doc_id", X.driver_bullets(text).alias("bullets"))


@query("key_value_texts_f21_f22", """
    SELECT p_partkey, array_to_string(list_filter([concat('name=', p_name), concat('brand=', p_brand), CASE WHEN p_size > 25 THEN concat('size=', p_size) END],
      lambda x: x IS NOT NULL), ', ') AS kv, CAST(p_size AS BIGINT) AS old_files, CAST(p_partkey AS BIGINT) AS new_files FROM part""")
def _(h):
    size = F.when(F.col("p_size") > 25, F.col("p_size"))
    text = F.concat(F.lit("x\n- DRH file count: old="), "p_size", F.lit(" → new="), "p_partkey", F.lit(" (Δ=+1)"))
    old, new = X.file_count_change(text)
    return h.table("part").select(
        "p_partkey", X.key_values(("name", F.col("p_name")), ("brand", F.col("p_brand")), ("size", size)).alias("kv"),
        old.alias("old_files"), new.alias("new_files"))


@query("file_mentions_p8", sql("""
    SELECT repo, count(*) AS commits, CAST(sum(len(regexp_extract_all(concat('See ', path), '[A-Za-z0-9/]+[.]java'))) AS BIGINT) AS mentions FROM file_changes GROUP BY repo"""))
def _(h):
    text = F.concat(F.lit("See `"), "path", F.lit("`, 63.08 and 1.5."))
    return h.file_changes.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.sum(F.size(X.file_mentions(text))).cast("bigint").alias("mentions"))


@query("clean_reports_f18", f"""
    SELECT doc_id, CASE WHEN {strip_sql('text')} = '' OR contains(text, '```') THEN NULL ELSE {strip_sql('text')} END AS unfenced,
      regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '^{SPACE_SQL}+', '') AS said
    FROM documents WHERE text IS NOT NULL AND {strip_sql('text')} <> ''""")
def _(h):
    """Reports in a fence, and behind 300 lines of thinking."""
    docs = h.table("documents").filter(X.strip(F.col("text")) != "")
    fenced = F.concat(F.lit("Here it is:\n```md\n"), "text", F.lit("\n```\nbye"))
    thought = F.concat(F.lit("Thinking...\n"), F.repeat(F.lit("one more line\n"), F.lit(300)), F.lit("...done thinking.\n\n"), "text")
    return docs.select(
        "doc_id", F.when(~F.contains("text", F.lit("```")), X.strip_fences(fenced)).alias("unfenced"), X.strip_thinking(thought).alias("said")
    )
