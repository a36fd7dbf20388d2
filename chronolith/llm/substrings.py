"""Removal of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import dropped, pick, written

#: Bytes of a rolling trigger hash.
TRIGGER = 64
#: Distinct contexts of one trigger, and contexts of one task, that are compared in a task; triggers with more go through a shuffle of window keys.
CONTEXTS_PER_TRIGGER, CONTEXTS_PER_TASK = 10_000, 10_000
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base modulo 2**64 and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick_of) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick_of(out[:len(out) - step], out[step:])
        have += step
    return out


def triggers(data: bytes, length: int, size: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, trigger hash, context hash) of the phrase triggers of a text.

    A position triggers if its rolling hash is the smallest of all trigger strings within some ``length``-byte window, so every window holds a
    trigger and equal windows hold the same ones at the same places. The context runs from the earliest start to the latest end of a window
    that can hold the trigger string.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = length - size
    found = []
    for lo in range(0, n - length + 1, _CHUNK):
        begin, end = max(0, lo - reach), min(n, lo + _CHUNK + length - 1 + reach)
        part = np.frombuffer(data, np.uint8, end - begin, begin).astype(np.uint64) + np.uint64(1)
        power, inverse = _powers(_CHUNK + 4 * length)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[:len(part)], out=sums[1:])
        hashes = _mixed((sums[size:] - sums[:-size]) * inverse[:len(part) - size + 1])
        a, b = lo - begin, min(lo + _CHUNK, n - length + 1) - begin  # windows that start in this chunk
        own = hashes[a:b + reach]
        lows = _sliding(own, reach + 1, np.minimum)
        ends = np.concatenate((np.zeros(reach, np.uint64), lows, np.zeros(reach, np.uint64)))
        at = np.flatnonzero(_sliding(ends, reach + 1, np.maximum) == own) + a
        left = np.minimum(at + begin, reach)
        right = np.minimum(n - at - begin, length)
        context = (sums[at + right] - sums[at - left]) * inverse[at - left]
        context = _mixed(_mixed(context) + left.astype(np.uint64) * np.uint64(length + 1) + right.astype(np.uint64))
        found.append((at + begin, hashes[at].view(np.int64), context.view(np.int64)))
    at, hashes, context = (np.concatenate(x) for x in zip(*found))
    _, first = np.unique(at, return_index=True)
    return at[first], hashes[first], context[first]


def _window_keys(rows: pd.DataFrame, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, back) of every ``length``-byte window that holds the trigger and starts ``back`` bytes before it."""
    reach = length - size
    keys, at, backs = [], [], []
    power, inverse = _powers(length + reach)
    for lo in range(0, len(rows), 2048):
        part = rows.iloc[lo:lo + 2048]
        grid = np.zeros((len(part), length + reach), np.uint64)
        left = part["back"].to_numpy(np.int64)
        right = np.zeros(len(part), np.int64)
        for i, (context, back) in enumerate(zip(part["context"], left)):
            right[i] = len(context) - back
            grid[i, reach - back:reach - back + len(context)] = np.frombuffer(context, np.uint8)
        sums = np.zeros((len(part), length + reach + 1), np.uint64)
        np.cumsum((grid + np.uint64(1)) * power, axis=1, out=sums[:, 1:])
        trigger = part["h"].to_numpy(np.int64).view(np.uint64)
        for back in range(reach + 1):
            ok = np.flatnonzero((left >= back) & (right >= length - back))
            if len(ok):
                start = reach - back
                h = (sums[ok, start + length] - sums[ok, start]) * inverse[start]
                keys.append(_mixed(_mixed(h) + trigger[ok] * np.uint64(_BASE) + np.uint64(back)))
                at.append(ok + lo)
                backs.append(np.full(len(ok), back, np.int64))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(at), np.concatenate(backs)


def repeated_spans(texts: DataFrame, length: int = 200, size: int = TRIGGER, per_trigger: int = CONTEXTS_PER_TRIGGER) -> DataFrame:
    """(uid, spans array<struct<lo, hi>>) of texts (uid, text): ranges of bytes covered by repeated ``length``-byte strings.

    1. Rolling-hash triggers parse every text into overlapping phrases, each trigger with all bytes that a window around it can hold.
       Triggers whose hash occurs once in the corpus are done: none of their windows repeats.
    2. The dictionary of a trigger is its distinct phrases. A phrase that occurs twice is covered whole. Where others remain, one phrase of
       each kind is fetched from the texts and the phrases' windows are brought into one order of keys, in which equal windows are neighbours.
       All windows of a phrase contain its trigger, so those that repeat cover one range. Triggers with more than ``per_trigger``
       different phrases do the same through a shuffle of the window keys, so no task holds them all.
    Equality of strings is that of 64-bit hashes.
    """
    reach = length - size

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo:lo + 512]
                found = [triggers(t.encode(), length, size) for t in part["text"]]
                counts = [len(f[0]) for f in found]
                if sum(counts):
                    at, h, c = (np.concatenate(x) for x in zip(*found))
                    yield pd.DataFrame({"uid": np.repeat(part["uid"].to_numpy(), counts), "at": at.astype(np.int32), "h": h, "c": c})

    parsed = texts.mapInPandas(parse, "uid bigint, at int, h bigint, c bigint")
    repeated = written(parsed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "triggers")
    occurrences = written(parsed.join(repeated, "h", "left_semi"), "occurrences")
    dictionary = written(occurrences.groupBy("h", "c").agg(
        F.count(F.lit(1)).alias("n_c"), F.first("uid").alias("uid"), F.first("at").alias("at")
    ), "dictionary")
    settled = occurrences.join(dictionary.filter("n_c > 1").select("h", "c"), ["h", "c"], "left_semi").select(
        "uid", F.greatest(F.col("at") - reach, F.lit(0)).cast("bigint").alias("lo"), (F.col("at") + length).cast("bigint").alias("hi")
    ).distinct()
    phrases = dictionary.join(dictionary.filter("n_c = 1").select("h").distinct(), "h", "left_semi")
    wanted = phrases.groupBy("uid").agg(F.collect_list(F.struct("h", "c", "at", "n_c")).alias("marks"))

    @F.pandas_udf("array<binary>")
    def contexts(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, at in zip(texts, places):
            data = text.encode()
            out.append([data[max(0, a - reach):a + length] for a in at])
        return pd.Series(out)

    fetched = texts.join(wanted, "uid").withColumn("bytes", contexts("text", F.transform("marks", lambda m: m["at"]))).select(
        "uid", F.explode(F.arrays_zip("marks", "bytes")).alias("m")
    ).select("uid", "m.marks.*", F.col("m.bytes").alias("context")).withColumn("back", F.least(F.col("at"), F.lit(reach)))
    fetched = written(fetched.dropDuplicates(["h", "c"]), "phrases")
    crowded = fetched.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_trigger).select("h")

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        keys, row, back = _window_keys(rows, length, size)
        _, of, n = np.unique(keys, return_inverse=True, return_counts=True)
        again = (n[of] > 1) & (rows["n_c"].to_numpy()[row] == 1)
        yield _ranges(rows, row[again], back[again], length)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keys, row, back = _window_keys(rows, length, size)
            yield pd.DataFrame({"key": keys.view(np.int64), "uid": rows["uid"].to_numpy()[row], "at": rows["at"].to_numpy()[row], "back": back, "n_c": rows["n_c"].to_numpy()[row]})

    tasks = max(1, -(-fetched.count() // CONTEXTS_PER_TASK))
    columns = "uid bigint, lo bigint, hi bigint"
    small = fetched.join(crowded, "h", "left_anti").repartition(tasks, "h").mapInPandas(ordered, columns)
    keys = written(fetched.join(crowded, "h", "left_semi").mapInPandas(spread, "key bigint, uid bigint, at bigint, back bigint, n_c bigint"), "keys")
    again = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    large = keys.filter("n_c = 1").join(again, "key", "left_semi").groupBy("uid", "at").agg(
        F.max("back").alias("most"), F.min("back").alias("least")
    ).select("uid", (F.col("at") - F.col("most")).alias("lo"), (F.col("at") + length - F.col("least")).alias("hi"))
    spans = settled.unionByName(small).unionByName(large)
    out = written(spans.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "spans")
    dropped(repeated, occurrences, dictionary, fetched, keys)
    return out


def _ranges(rows: pd.DataFrame, row: np.ndarray, back: np.ndarray, length: int) -> pd.DataFrame:
    least = np.full(len(rows), length, np.int64)
    most = np.full(len(rows), -1, np.int64)
    np.minimum.at(least, row, back)
    np.maximum.at(most, row, back)
    hit = np.flatnonzero(most >= 0)
    at = rows["at"].to_numpy(np.int64)[hit]
    return pd.DataFrame({"uid": rows["uid"].to_numpy()[hit], "lo": at - most[hit], "hi": at + length - least[hit]})


def merged(spans, n: int) -> list[tuple[int, int]]:
    """Maximal runs of sorted (lo, hi) ranges, cut to ``n`` bytes; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        hi = min(hi, n)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def without_repeats(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """All columns of ``docs`` plus ``n_bytes``, ``runs`` (removed byte ranges) and ``kept`` (the remaining bytes).

    Null texts are empty. Texts shorter than ``length`` bytes have no repeats; rows that repeat a text of at least ``length`` bytes lose it in
    every copy. Empty tables give empty results.
    """
    names = docs.columns
    at = F.coalesce(F.col(f"_c{names.index(text)}"), F.lit(""))
    wide = docs.toDF(*[f"_c{i}" for i in range(len(names))]).withColumn("uid", F.xxhash64(at))
    spans = repeated_spans(pick(docs, text=text).select(F.coalesce("text", F.lit("")).alias("text")).select(F.xxhash64("text").alias("uid"), "text"), length)

    @F.pandas_udf("n_bytes bigint, runs array<array<bigint>>, kept binary")
    def cut(texts: pd.Series, los: pd.Series, his: pd.Series) -> pd.DataFrame:
        out = []
        for t, lo, hi in zip(texts, los, his):
            data = (t or "").encode()
            runs = merged(zip(lo.tolist(), hi.tolist()), len(data)) if lo is not None else []
            kept, last = [], 0
            for a, b in runs:
                kept.append(data[last:a])
                last = b
            kept.append(data[last:])
            out.append((len(data), [list(r) for r in runs], b"".join(kept)))
        return pd.DataFrame(out, columns=["n_bytes", "runs", "kept"])

    lows, highs = F.transform("spans", lambda s: s["lo"]), F.transform("spans", lambda s: s["hi"])
    done = wide.join(spans, "uid", "left").withColumn("_cut", cut(at, lows, highs))
    return done.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], "_cut.*")
