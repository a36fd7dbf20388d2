"""Classifiers: commits, issues, questions, metrics, files."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.text import strip

# Commit classes by words contained in the lower-case message; the first class wins.
COMMIT_WORDS = {
    "refactoring": ("refactor", "restructure", "reorganize", "extract", "move", "rename"),
    "bugfix": ("fix", "bug", "issue", "patch", "hotfix", "correct"),
    "feature": ("add", "new", "implement", "feature", "enhance"),
    "documentation": ("doc", "readme", "comment", "javadoc"),
    "test": ("test", "junit", "spec", "coverage"),
}
COMMIT_CLASSES = (*COMMIT_WORDS, "other")

# Whole words that mark a bug-fixing commit, wide and narrow list.
BUG_WORDS_WIDE = ("fix", "bug", "hotfix", "patch", "defect", "issue", "error", "correct", "regress")
BUG_WORDS_NARROW = ("fix", "bug", "hotfix", "patch", "defect", "regress")

# Code-host label -> issue type.
LABEL_TYPES = {
    "bug": "bug", "type: bug": "bug", "type:bug": "bug", "kind/bug": "bug", "bug report": "bug",
    "defect": "bug", "regression": "bug", "crash": "bug", "error": "bug", "fix": "bug", "hotfix": "bug",
    "feature": "feature", "enhancement": "feature", "type: enhancement": "feature",
    "type:enhancement": "feature", "kind/feature": "feature", "new feature": "feature",
    "improvement": "feature", "feature request": "feature",
    "documentation": "documentation", "docs": "documentation", "type: docs": "documentation",
    "test": "test", "testing": "test", "type: test": "test",
    "refactoring": "refactoring", "refactor": "refactoring", "cleanup": "refactoring",
    "tech debt": "refactoring",
}

# Tracker issue type -> issue type.
TRACKER_TYPES = {
    "bug": "bug", "bug (jira)": "bug",
    "improvement": "feature", "new feature": "feature", "wish": "feature",
    "task": "refactoring", "sub-task": "refactoring",
    "test": "test", "documentation": "documentation", "dependency upgrade": "refactoring",
}

# Path parts outside production code.
EXCLUDED_PARTS = (
    ".git", ".hg", ".svn", ".venv", "venv", "__pycache__", ".eggs", ".mypy_cache", ".pytest_cache", ".tox",
    "build", "dist", "doc", "docs", "out", "test", "tests", "testing", "target", "node_modules",
)

# Source file extensions.
SOURCE_EXTENSIONS = (
    "java", "py", "kt", "scala", "groovy", "js", "ts", "cs", "cpp", "c", "go", "rb", "h", "hpp",
)

# Phrases that decide the type of a question, types tried in this order.
QUESTION_PHRASES = {
    "file_refactor": (
        "refactor", "which file", "specific file", "worst file", "bad file", "file to fix", "file to improve",
        "give me file", "top file", "files to", "file i should", "files i should", "what file", "name the file",
        "hotspot", "most problematic", "most coupled",
    ),
    "cross_repo": (
        "across repos", "compare", "all repos", "other repos", "between repos", "which repo", "best repo",
        "worst repo",
    ),
    "date_range": (
        "from 20", "between 20", "in 20", "during 20", "since 20", "year", "period", "timeframe", "when did",
        "at what point",
    ),
    "metric_explain": (
        "what is", "what does", "explain", "define", "meaning of", "how does", "mscore", "m-score",
        "propagation cost", "decoupling level", "clique", "drh", "dsm", "design rule", "anti-pattern", "fan-in",
        "fan-out", "independence level", "clddf", "imcf", "dependency", "coupling", "modular",
        "architecture metric",
    ),
}

# Knowledge layers searched per question type.
QUESTION_LAYERS = {
    "file_refactor": ("L3", "L2"),
    "metric_explain": ("L1", "L2"),
    "cross_repo": ("L2", "L3"),
    "date_range": ("L4", "L3", "L2"),
    "general": ("L2", "L1", "L3"),
}

# Phrases of the report question classes, first class wins.
REPORT_QUESTION_PHRASES = {
    "danger": (
        "dangerous", "most dangerous", "riskiest", "worst file", "bad file", "technical debt", "most debt", "debt",
        "problematic", "priority", "5 most", "top 5", "top file",
    ),
    "mscore_causality": (
        "why did m-score", "why m-score", "why did the m-score", "m-score got worse", "m-score deteriorat",
        "m-score declin", "what caused", "what change caused", "linked to", "link to commit", "which commit",
        "which feature", "which bug", "quality decrease", "quality declin", "decreasing in quality",
        "decrease in quality",
    ),
    "files": (
        "refactor", "specific file", "which file", "file to fix", "file to improve", "give me file", "files to",
        "file i should", "files i should",
    ),
}

# Metric, zone, lower bound, upper bound; then whether a higher value is better.
METRIC_ZONES = (
    ("propagation-cost", "excellent", 0.0, 30.0), ("propagation-cost", "good", 30.0, 50.0),
    ("propagation-cost", "moderate", 50.0, 70.0), ("propagation-cost", "poor", 70.0, 100.0),
    ("m-score", "poor", 0.0, 30.0), ("m-score", "moderate", 30.0, 50.0),
    ("m-score", "good", 50.0, 70.0), ("m-score", "excellent", 70.0, 100.0),
    ("decoupling-level", "poor", 0.0, 30.0), ("decoupling-level", "moderate", 30.0, 50.0),
    ("decoupling-level", "good", 50.0, 70.0), ("decoupling-level", "excellent", 70.0, 100.0),
    ("independence-level", "poor", 0.0, 20.0), ("independence-level", "moderate", 20.0, 40.0),
    ("independence-level", "good", 40.0, 60.0), ("independence-level", "excellent", 60.0, 100.0),
)
METRICS = ("m-score", "propagation-cost", "decoupling-level", "independence-level")
HIGHER_IS_BETTER = ("m-score", "decoupling-level", "independence-level")

# Metric query aliases.
METRIC_ALIASES = {
    "m": "m-score", "m-score": "m-score", "mscore": "m-score", "m score": "m-score",
    "dl": "decoupling-level", "decoupling": "decoupling-level", "decoupling level": "decoupling-level",
    "decoupling-level": "decoupling-level",
    "pc": "propagation-cost", "propagation": "propagation-cost", "propagation cost": "propagation-cost",
    "propagation-cost": "propagation-cost", "propagation_cost": "propagation-cost",
    "il": "independence-level", "independence": "independence-level",
    "independence level": "independence-level", "independence-level": "independence-level",
}

# Size calibration of the approximate m-score.
CALIBRATION_SMALL, CALIBRATION_LARGE = 0.6258, 0.8446
CALIBRATION_FROM, CALIBRATION_TO = 1000, 5000


def _words(words) -> str:
    return "|".join(w.replace(".", r"\.").replace("-", r"\-") for w in words)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL if the key is missing."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def first_match(text: Column, phrases: dict[str, tuple[str, ...]], default: str) -> Column:
    """Name of the first group of which some phrase is contained in the lower-case text."""
    low = F.lower(text)
    chain = F
    for name, words in phrases.items():
        chain = chain.when(low.rlike(_words(words)), F.lit(name))
    return chain.otherwise(F.lit(default))


def issue_keys(subject: Column) -> Column:
    """Tracker keys in order, then code-host references in order as 'GH#n'."""
    tracker = F.regexp_extract_all(subject, F.lit(r"\b[A-Z][A-Z0-9]+-[0-9]+\b"), 0)
    hosted = F.regexp_extract_all(subject, F.lit(r"(?<![A-Z0-9])#([0-9]+)\b"), 1)
    return F.concat(tracker, F.transform(hosted, lambda n: F.concat(F.lit("GH#"), n)))


def commit_category(message: Column) -> Column:
    return first_match(message, COMMIT_WORDS, "other")


def mentions_bug(message: Column, words=BUG_WORDS_WIDE) -> Column:
    return message.rlike(r"(?i)\b(" + "|".join(words) + r")\b")


def label_type(label: Column, overrides: dict[str, str] | None = None) -> Column:
    table = {**LABEL_TYPES, **{k.lower().strip(): v for k, v in (overrides or {}).items()}}
    return lookup(strip(F.lower(label)), table)


def tracker_type(name: Column) -> Column:
    return lookup(strip(F.lower(name)), TRACKER_TYPES)


def metric_alias(query: Column) -> Column:
    return lookup(strip(F.lower(query)), METRIC_ALIASES)


def is_excluded_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(p) for p in EXCLUDED_PARTS]))


def is_source_file(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*SOURCE_EXTENSIONS) & F.contains(path, F.lit("."))


def repo_language(files: DataFrame) -> DataFrame:
    """repo -> python | java | unknown by number of files; python wins ties."""
    counts = files.groupBy("repo").agg(
        F.count_if(F.endswith(F.col("path"), F.lit(".py"))).alias("py"),
        F.count_if(F.endswith(F.col("path"), F.lit(".java"))).alias("java"),
    )
    pick = F.when((F.col("py") == 0) & (F.col("java") == 0), "unknown").when(F.col("py") >= F.col("java"), "python")
    return counts.select("repo", pick.otherwise("java").alias("language"))


def repo_from_path(path: Column, root: str = "REPOS_ANALYZED") -> Column:
    """Path part after the root marker, else the fourth part from the end, else 'unknown'."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    after = F.regexp_extract(path, rf"(?:^|/)\Q{root}\E/([^/]+)", 1)
    return F.when(after != "", after).otherwise(
        F.coalesce(F.get(F.reverse(parts), F.lit(3)), F.lit("unknown"))
    )


def model_from_path(path: Column) -> Column:
    """Model tag 'family:size' named by the deepest path part that holds one, '' if none."""
    pattern = r"(?i)(deepseek[-_]r1|qwen[0-9.]+|llama[0-9.]+|mistral[0-9.]+|phi[0-9.]+)[_\-](\w+b)\b"
    tags = F.transform(
        F.reverse(F.split(path, "/")),
        lambda p: F.when(
            p.rlike(pattern),
            F.concat(F.replace(F.regexp_extract(p, pattern, 1), F.lit("_"), F.lit("-")), F.lit(":"),
                     F.regexp_extract(p, pattern, 2)),
        ),
    )
    return F.coalesce(F.get(F.filter(tags, lambda t: t.isNotNull()), F.lit(0)), F.lit(""))


def question_type(question: Column) -> Column:
    return first_match(question, QUESTION_PHRASES, "general")


def question_layers(qtype: Column) -> Column:
    chain = F
    for name, layers in QUESTION_LAYERS.items():
        chain = chain.when(qtype == name, F.array(*[F.lit(x) for x in layers]))
    return chain.otherwise(F.array(*[F.lit(x) for x in QUESTION_LAYERS["general"]]))


def report_question_class(question: Column) -> Column:
    return first_match(question, REPORT_QUESTION_PHRASES, "general")


def metric_zone(spark: SparkSession, values: DataFrame) -> DataFrame:
    """Adds ``zone``: range join with the sixteen threshold rows, the topmost zone closed above."""
    zones = spark.createDataFrame(METRIC_ZONES, "metric string, zone string, lo double, hi double")
    v = F.col("value")
    inside = (v >= F.col("lo")) & ((v < F.col("hi")) | ((F.col("hi") == 100.0) & (v == 100.0)))
    # sixteen fixed rows: safe to broadcast at any data size
    joined = values.alias("v").join(
        F.broadcast(zones).alias("z"), (F.col("v.metric") == F.col("z.metric")) & inside, "left"
    )
    return joined.select("v.*", "zone")


def trend(metric: Column, change: Column) -> Column:
    """'improved' or 'degraded' where higher is better, 'changed' otherwise."""
    better = metric.isin(*HIGHER_IS_BETTER)
    return F.when(better & (change > 0), "improved").when(better & (change < 0), "degraded").otherwise("changed")


def size_calibration(n_files: Column) -> Column:
    share = (n_files - CALIBRATION_FROM) / float(CALIBRATION_TO - CALIBRATION_FROM)
    return (
        F.when(n_files < CALIBRATION_FROM, CALIBRATION_SMALL)
        .when(n_files < CALIBRATION_TO, CALIBRATION_SMALL + share * (CALIBRATION_LARGE - CALIBRATION_SMALL))
        .otherwise(CALIBRATION_LARGE)
    )
