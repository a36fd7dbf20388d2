"""Secret scanning: wide candidate patterns, then a random forest that removes false findings."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import as_before, dropped, pick, whole_as_text, written
from chronolith.session import scratch_path

#: Labelled findings the forest is trained on at most, chosen by a hash of their value; everything else covers all rows.
TRAINING_ROWS = 20_000
TREES, TREE_DEPTH = 30, 6

# Names before a credential, words of harmless findings, frequent words, path words.
CREDENTIAL_NAMES = frozenset("password passwd pwd passphrase secret secrets token tokens apikey api_key api-key access_key access-key accesskey auth credential credentials bearer key".split())
HARMLESS = frozenset("example sample test dummy fake placeholder changeme your foo bar xxxx none null true false default lorem ipsum".split())
DICTIONARY = HARMLESS | frozenset(
    "the and that with this from for was are have not but all can her his one our out you your will would there their what about which when make like time just know "
    "take people into year good some could them see other than then now look only come its over think also back after use two how work first well way even new want because any these "
    "give day most tion ing ness able less ment der die und das nicht mit sich auf für ist von ein eine den des dem zu les des est pas pour dans qui sur une que los las del por con para como más pero ción mente "
    "user name login admin server client config file path value data index type class function return string number".split()
)
PATH_WORDS = frozenset("test tests example examples sample samples doc docs fixture fixtures mock".split())

# Possessive classes keep the scan linear for candidates of any length; a key block ends at its END line, not beyond another BEGIN line.
CANDIDATE = re.compile(
    r"(?:(?P<name>password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|credentials?|bearer)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?!-----BEGIN )(?P<value>[^\s\"'<>,;]{6,}+))"
    r"|(?P<block>-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]++|-(?!----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----))*+-----END [A-Z ]{0,40}PRIVATE KEY-----)"
    r"|(?P<bare>[A-Za-z0-9+/_\-]{16,}+={0,2})",
    re.I,
)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURES = [
    "length", "transitions", "digits", "uppers", "lowers", "hexes", "vowels", "entropy", "coverage", "named", "assigned", "quoted", "name_near", "harmless_near",
    "words_near", "path_words", "path_depth",
]


def coverage(value: str) -> float:
    """Share of the characters that dictionary words of three letters and more cover, longest first from the left."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        step = next((n for n in range(min(11, len(low) - at), 2, -1) if low[at:at + n] in DICTIONARY), 0)
        covered += step
        at += step or 1
    return covered / max(1, len(low))


def features_of(value: str, named: bool, before: str, after: str, path: str) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    counts = Counter(value)
    near = [w.strip("\"'=:.,;()").lower() for w in _WORD.findall(before)[-3:]] + [w.strip("\"'=:.,;()").lower() for w in _WORD.findall(after)[:2]]
    words = re.findall(r"[a-z]+", path.lower())
    share = lambda k: kinds.count(k) / n
    return [
        float(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, share("d"), share("u"), share("l"), sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        sum(c in "aeiouyAEIOUY" for c in value) / n, -sum(k / n * math.log2(k / n) for k in counts.values()), coverage(value), float(named),
        float(before.rstrip("\"' ").endswith(("=", ":"))), float(before.endswith(("\"", "'"))), float(any(w in CREDENTIAL_NAMES for w in near)),
        float(any(w in HARMLESS for w in near)), sum(w in DICTIONARY for w in near) / 5, float(sum(w in PATH_WORDS for w in words)), float(path.count("/")),
    ]


def findings_of(text: str, path: str) -> list[tuple]:
    """(start, kind, value, features) of every candidate of a text; starts count code points."""
    out = []
    for m in CANDIDATE.finditer(text):
        kind = "named" if m["value"] else "block" if m["block"] else "bare"
        value, start = (m["value"], m.start("value")) if m["value"] else (m[0], m.start())
        context = text[max(0, start - 60):start], text[start + len(value):start + len(value) + 40]
        out.append((start, kind, value, features_of(value, kind == "named", *context, path)))
    return out


def candidates(docs: DataFrame, key: Column, text: str = "text", path: str = "source") -> DataFrame:
    """(key, start, length, kind, value, features) of all candidates in whole texts. Null texts have none; a null path is empty."""
    rows = pick(docs.withColumn("_key", key), key="_key", text=text, path=path).select("key", "text", F.col("path").cast("string").alias("path"))
    key_type = dict(rows.dtypes)["key"]
    rows = whole_as_text(rows)
    sent_type = dict(rows.dtypes)["key"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (k, s, len(v), kind, v, f) for k, t, p in zip(batch["key"], batch["text"], batch["path"]) for s, kind, v, f in findings_of(t or "", p or "")
            ]
            if found:
                yield pd.DataFrame(found, columns=["key", "start", "length", "kind", "value", "features"])

    found = rows.mapInPandas(scan, f"key {sent_type}, start bigint, length bigint, kind string, value string, features array<double>")
    return as_before(found, {"key": key_type})


def format_label(value: Column, kind: Column, features: Column | None = None) -> Column:
    """1 for issued formats (cloud key ids, named hexadecimal or mixed credentials, key blocks), 0 for words, numbers, paths and placeholders, else null.

    With ``features``, hexadecimal digests (32, 40 or 64 digits: checksums, commit ids) that no credential's name and no assignment precedes are 0.
    """
    issued = (
        ((kind == "bare") & value.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$")) | (kind == "block")
        | ((kind == "named") & value.rlike("^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]{12,}$"))
    )
    harmless = F.lower(value).rlike("example|changeme|placeholder|xxxx|dummy|your[_-]")
    plain = (kind != "block") & value.rlike("^([a-z]+|[0-9]+|[A-Z]+|[A-Za-z]+(?:[/_-][A-Za-z]+)++|[A-Z][a-z]+)$")
    label = F.when(harmless, 0.0).when(issued, 1.0).when(plain, 0.0)
    if features is None:
        return label
    alone = (features[FEATURES.index("name_near")] == 0) & (features[FEATURES.index("assigned")] == 0)
    return label.when((kind == "bare") & alone & value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"), 0.0)


def labelled_findings(rows: DataFrame) -> DataFrame:
    """(value, features, label) of a table of reviewed findings: text, start and length of the finding in code points, path, label (1 secret, 0 not).

    Each finding is read with the words around it, as ``candidates`` reads them; a finding that a credential's name precedes counts as named.
    Rows without a label, text or place teach nothing.
    """
    plain = pick(rows, "text", "start", "length", "path", "label").filter("text is not null and start is not null and length > 0 and label is not null")
    plain = plain.select("text", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"), F.coalesce("path", F.lit("")).alias("path"), F.col("label").cast("double").alias("label"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, start, length, path, label in batch.itertuples(index=False, name=None):
                value = text[start:start + length]
                if value:
                    before = text[max(0, start - 60):start]
                    named = bool(re.search(r"(?:%s)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?$" % "|".join(sorted(CREDENTIAL_NAMES)), before, re.I))
                    out.append((value, features_of(value, named, before, text[start + length:start + length + 40], path), label))
            yield pd.DataFrame(out, columns=["value", "features", "label"])

    return plain.mapInPandas(read, "value string, features array<double>, label double")


def held_out_quality(labelled: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.5, share: int = 5) -> tuple[float, float, int]:
    """(precision, recall, findings) on one in ``share`` of the labelled values, by a hash of the value, of a forest trained on the others."""
    apart = F.pmod(F.xxhash64(F.lit(7), "value"), F.lit(share)) == 0
    forest = trained_forest(labelled.filter(~apart), rows)
    told = judged(labelled.filter(apart), forest).withColumn("hit", F.col("probability") >= threshold)
    both, said, true, n = told.agg(
        F.count_if(F.col("hit") & (F.col("label") == 1)), F.count_if(F.col("hit")), F.count_if(F.col("label") == 1), F.count(F.lit(1))
    ).first()
    return both / max(1, said), both / max(1, true), n


def trained_forest(labelled: DataFrame, rows: int = TRAINING_ROWS, seed: int = 42):
    """A random forest over labelled findings (value, features, label 0 or 1); None if only one label occurs.

    Half of the bound goes to each label, by a seeded hash of the value; repeated values count once. The sample is brought into one order, so reruns agree.
    """
    once = labelled.groupBy("value", "label").agg(F.min("features").alias("features")).withColumn("draw", F.xxhash64(F.lit(seed), "value"))
    parts = [once.filter(F.col("label") == k).orderBy("draw", "value").limit(rows // 2) for k in (0.0, 1.0)]
    sample = written(parts[0].unionByName(parts[1]).coalesce(1).sortWithinPartitions("draw", "value"), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    table = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample.select("label", *[F.col("features")[i].alias(n) for i, n in enumerate(FEATURES)]))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH, seed=seed)
    path = scratch_path(labelled.sparkSession, "forest")
    forest.fit(table.coalesce(1)).save(path)
    dropped(sample)
    return RandomForestClassificationModel.load(path)  # without the training summary, which tasks cannot take along


def judged(found: DataFrame, forest, label: Column | None = None) -> DataFrame:
    """All findings plus ``probability`` of being a secret. Without a forest (only one label occurs) only issued formats are secrets, unlabelled ones are not."""
    if forest is None:
        return found.withColumn("probability", F.coalesce(label if label is not None else F.lit(None).cast("double"), F.lit(0.0)))
    wide = found.withColumns({f"_f_{n}": F.col("features")[i] for i, n in enumerate(FEATURES)})
    table = VectorAssembler(inputCols=[f"_f_{n}" for n in FEATURES], outputCol="vector").transform(wide)
    scored = forest.transform(table).withColumn("_p", vector_to_array("probability")[1])
    return scored.select(*found.columns, F.col("_p").alias("probability"))


def scanned(
    docs: DataFrame, key: Column, text: str = "text", path: str = "source", threshold: float = 0.5, labelled: DataFrame | None = None,
) -> DataFrame:
    """(key, start, length, kind, value, label, probability, is_secret) of all candidates.

    The forest learns from ``labelled`` (see ``labelled_findings``), else from the findings that have a format label. Issued formats are always
    secrets, words, placeholders and bare digests never; the forest decides the others.
    """
    found = written(candidates(docs, key, text, path).withColumn("label", format_label(F.col("value"), F.col("kind"), F.col("features"))), "candidates")
    teaching = found.filter("label is not null").select("value", "features", "label") if labelled is None else labelled_findings(labelled)
    forest = trained_forest(teaching)
    told = judged(found, forest, F.col("label"))
    return told.withColumn("is_secret", F.coalesce(F.col("label") == 1, F.col("probability") >= threshold)).drop("features")


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", n_chars: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` and the character count kept true; all documents and columns stay."""
    names = docs.columns
    wide = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    body = f"_c{names.index(text)}"
    key = F.concat_ws(":", F.xxhash64(body).cast("string"), F.col(f"_c{names.index(doc_id)}").cast("string"))
    found = written(scanned(wide, key, body, f"_c{names.index(path)}").filter("is_secret").select("key", "start", "length"), "secrets")
    spans = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))

    @F.pandas_udf("string")
    def blank(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for t, at, sizes in zip(texts, starts, lengths):
            if at is not None and t is not None:
                parts, last = [], 0
                for a, n in zip(np.asarray(at).tolist(), np.asarray(sizes).tolist()):
                    parts += [t[last:a], mark]
                    last = a + n
                t = "".join(parts) + t[last:]
            out.append(t)
        return pd.Series(out, dtype=object)

    starts, sizes = F.transform("spans", lambda s: s["start"]), F.transform("spans", lambda s: s["length"])
    joined = wide.withColumn("key", key).join(spans, "key", "left")
    done = joined.withColumn("_clean", blank(F.col(body), starts, sizes))
    columns = [F.col("_clean" if n == text else f"_c{i}").alias(n) for i, n in enumerate(names)]
    if n_chars in names:
        i = names.index(n_chars)
        changed = F.when(F.col("spans").isNotNull(), F.char_length("_clean")).otherwise(F.col(f"_c{i}"))
        columns[i] = changed.cast(docs.schema[i].dataType).alias(n_chars)
    return done.select(*columns)
