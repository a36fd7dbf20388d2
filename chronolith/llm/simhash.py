"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import components, dropped, pick, written

#: Fingerprints of one table entry that are compared one by one; larger entries are linked through common neighbours.
ENTRY_ROWS = 16
_BLOCK = 65_536


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; shorter texts are one shingle, texts without words give 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[words - 1:].tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for lo in range(0, n, _BLOCK):
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[lo:lo + _BLOCK], ends[lo:lo + _BLOCK])]
        ones += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: Column, words: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return digest(text)


def neighbour_links(prints: DataFrame, entry_rows: int = ENTRY_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` reachable by steps of at most 2 differing bits.

    Two 32-bit segments: of two fingerprints within 2 bits, the first segments differ in at most one bit or the
    second ones are equal. The table holds every segment value; probes are the value itself and, for the first segment,
    its one-bit ball (set bits cleared, so a pair meets once). Fetched pairs are verified over all 64 bits.
    A probe reads at most ``entry_rows`` rows of an entry. Fingerprints that probe a larger entry are linked instead through
    their 65 neighbours in full one-bit balls: two lie within 2 bits exactly if they share one, and at most 65 distinct
    fingerprints share one, so this too is linear.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    second = low.bitwiseOR(F.lit(1 << 32))
    table = prints.select("fp", F.explode(F.array(high, second)).alias("key"))
    cleared = [F.when(high.bitwiseAND(F.lit(1 << i)) != 0, high.bitwiseXOR(F.lit(1 << i))) for i in range(32)]
    probes = prints.select(F.col("fp").alias("probe"), F.explode(F.array(high, second, *cleared)).alias("key")).filter("key is not null")
    crowded = written(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > entry_rows).select("key"), "entries")
    fetched = probes.join(table.join(crowded, "key", "left_anti"), "key")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("probe")))
    near = fetched.filter((apart >= 1) & (apart <= 2)).select(F.col("fp").alias("a"), F.col("probe").alias("b"))
    members = probes.join(crowded, "key", "left_semi").select(F.col("probe").alias("fp")).distinct()
    balls = members.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("z"))
    hubs = balls.groupBy("z").agg(F.array_sort(F.collect_list("fp")).alias("all")).filter(F.size("all") > 1)
    through = hubs.select(F.get("all", F.lit(0)).alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
    return near.unionByName(through).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp bigint, component_id, label, row_key): one row per document; documents whose fingerprints connect share the smallest id.

    Null and empty texts have fingerprint 0 and are linked like any other. Copies meet as one fingerprint before any
    pair is formed. Null ids are ignored in the smallest id. An empty table gives an empty result.
    """
    prints = written(pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", fingerprint(F.col("text"), words).alias("fp"), _row_key(F.col("doc_id"), F.col("text")).alias("row_key")
    ), "prints")
    smallest = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
    labels = components(neighbour_links(smallest.select("fp")))
    labelled = smallest.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    heads = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = written(labelled.join(heads, "label").select("fp", "component_id", "label"), "groups")
    dropped(smallest)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "label", "row_key")


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws(":", F.xxhash64(text).cast("string"), doc_id.cast("string"))


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id (null ids last); all columns stay.

    Of rows that repeat both id and text, one stays.
    """
    names = docs.columns
    groups = near_groups(docs, doc_id, text, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    kept = groups.groupBy("label").agg(first).select(F.col("first.row_key").alias("_key"))
    wide = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    key = _row_key(F.col(f"_c{names.index(doc_id)}"), F.col(f"_c{names.index(text)}"))
    rows = wide.withColumn("_key", key).join(kept, "_key", "left_semi").dropDuplicates(["_key"])
    return rows.drop("_key").toDF(*names)
