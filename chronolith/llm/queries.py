"""The registered query of each corpus operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import ctw, extract, langid, minhash, mixing, mpeg, packing, secret_scan, simhash, spelling, statements, substrings, trie, url_filter
from chronolith.llm.common import id_remainder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


@query("op2_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces_of(table(spark, sf_dir, "documents")))


@query("op5_mpeg_audio")
def mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(mpeg.framed(table(spark, sf_dir, "documents")), "audio")
    rows = mpeg.audio_columns(stored)
    payload = F.col("audio.payload")
    seek = F.crc32(F.array_join(F.col("audio.seek_offsets"), ",").cast("binary"))
    feature = F.concat_ws(
        ";", *[F.concat(F.lit(f"{n}="), F.col(f"audio.{n}").cast("string")) for n in ("frames", "samples", "sample_rate", "table_frames", "failed", "skipped")],
        F.concat(F.lit("seek="), seek.cast("string")),
    )
    return rows.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), F.col("audio.seconds").alias("seconds"), F.col("audio.seek_offsets").alias("seek_offsets"),
    )


@query("op6_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    learned = langid.prototypes(docs.filter(~F.col("held_out")))
    return langid.with_language(docs.select("doc_id", "held_out", "text"), learned).select("doc_id", "held_out", "language.lang_pred", "language.score")


@query("op10_minhash")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.neighbour_fingerprints(table(spark, sf_dir, "documents"))


@query("op7_repeated_strings")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_main_text")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract.extracted(F.col("html")).alias("text"))
    return pages.select("*", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op4_context_trees")
def context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 10) == 0)


@query("op9_secret_findings")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), F.col("doc_id"))
    return rows.select(
        F.col("key").alias("doc_id"), "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), "label", F.round("probability", 6).alias("probability"), "is_secret"
    )


#: The rules of the registered URL query.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/"),
]


@query("op11_url_filter")
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.trained(url_filter.labelled_urls(spark))
    rows = url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, model)
    return rows.select("page_id", "filter.host", "filter.path", "filter.rule", "filter.verdict", F.round("filter.score", 6).alias("score"))


@query("op12_spelling_variants", statements.SPELLING_VARIANTS)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"))
    words = spelling.word_counts(runs, spelling.slipped(F.col("doc_id"), F.col("run"), 199))
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_conversation_trie", statements.CONVERSATION_TRIE)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered_turns(table(spark, sf_dir, "conversations"))
    known = F.col("conv") != trie.NO_ID
    base = F.when(known, F.col("conv") - F.col("conv") % 100)
    take = F.when(known, F.crc32(F.col("conv").cast("string").cast("binary")) % 6).otherwise(0)
    return trie.prefix_trie(trie.spliced(turns, base, take, 5))
