"""Secret findings: issued formats, bare digests, a table of labelled findings, held-out precision and recall."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.llm import secret_scan


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    digits = lambda n: "".join(draw.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(draw.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=n))
    words = "harbour market engine library orchestra mountain recipe station weather journey".split()
    rows = []
    for i in range(240):
        lead = " ".join(draw.choices(words, k=6))
        kind = i % 6
        value = [digits(40), mixed(24), digits(40), draw.choice(words) + "_" + draw.choice(words) + "_" + draw.choice(words), "your_token_here_example", "AKIA" + "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))][kind]
        line = [f'token = "{value}"', f"password: {value}", f"the commit {value} was merged", f"see {value} there", f"api_key = {value}", f"key id {value} listed"][kind]
        rows.append((i, f"{lead} {line} {lead}", "src/app/config.py", value, int(kind in (0, 1, 5))))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, want string, truth int")


def test_issued_formats_and_bare_digests(corpus):
    got = secret_scan.scanned(corpus, F.col("doc_id")).join(corpus.select(F.col("doc_id").alias("key"), "want", "truth"), "key")
    told = got.filter("value = want").collect()
    assert len(told) == 240
    assert [r for r in told if r.is_secret != bool(r.truth)] == []


def test_labelled_table_and_held_out_quality(spark, corpus):
    table = corpus.select("text", (F.instr("text", F.col("want")) - 1).alias("start"), F.char_length("want").alias("length"), F.col("source").alias("path"), F.col("truth").alias("label"))
    findings = secret_scan.labelled_findings(table.unionByName(spark.createDataFrame([(None, 1, 2, None, 1), ("a", 0, 1, None, None)], "text string, start int, length int, path string, label int")))
    assert findings.count() == 240
    precision, recall, n = secret_scan.held_out_quality(findings)
    assert n > 25 and precision >= 0.9 and recall >= 0.9, (precision, recall, n)
    # a table that calls bare digests of this corpus secrets does not overrule the formats, one for the undecided does decide
    got = secret_scan.scanned(corpus, F.col("doc_id"), labelled=table)
    assert got.filter("label = 1 and not is_secret").count() == 0 and got.filter("label = 0 and is_secret").count() == 0


def test_formats_of_the_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = secret_scan.candidates(docs, F.col("doc_id"))
    labelled = found.withColumn("label", secret_scan.format_label(F.col("value"), F.col("kind"), F.col("features"))).filter("label is not null")
    precision, recall, n = secret_scan.held_out_quality(labelled.select("value", "features", "label"))
    assert n > 20 and precision >= 0.95 and recall >= 0.95, (precision, recall, n)
