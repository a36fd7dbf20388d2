"""Mixing sources to target weights by subset sums over exact document lengths."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import WORD, dropped, pick, written
from chronolith.operators.common import numbered

#: Remainder that the first subset-sum table covers; what is above goes by whole lengths first. Missed targets take larger tables.
TABLE_WORDS = 1 << 17
#: Up to this many sums are listed one by one.
SPARSE_SUMS = 1 << 20
#: Rows of one (source, length) that are ranked together.
SLICE_ROWS = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(totals: DataFrame, weights: Sequence[float], budget: float | None, most: int) -> DataFrame:
    """(source_key, source, source_size, target): shares of ``budget`` by the weights, repeated along the sorted sources (null last).

    A target ends at ``most`` times its source's size; the excess goes to the others by weight. The water level rises
    until no further source reaches its end; each round is one aggregate of three numbers.
    """
    order = numbered(totals, [], [F.col("source").asc_nulls_last()], "_place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = written(order.withColumn("_weight", F.get(cycle, ((F.col("_place") - 1) % len(weights)).cast("int"))), "sources")
    wanted = budget if budget is not None else float(placed.agg(F.sum("source_size")).first()[0] or 0)
    ends = F.col("source_size") * float(most)
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else ends <= F.col("_weight") * level
        n, held, free = placed.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, ends)), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        if n == capped or not free:
            break
        capped, level = n, max(0.0, wanted - (held or 0.0)) / free
    target = F.least(ends, F.col("_weight") * F.lit(level if level is not None else 0.0))
    if level is not None and not free:
        target = ends
    return placed.select("source_key", "source_size", target.cast("double").alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, target: float, most: int) -> tuple[int, np.ndarray]:
    """(whole, extra): every document ``whole`` times, and one more of ``extra[i]`` documents of ``lengths[i]`` words.

    What whole passes leave of the target is spread over all lengths in proportion, then filled from the longest
    length down until the rest fits the table, then met by a bounded-knapsack table over the remaining counts. While that
    misses the target by a multiple of the lengths' common divisor, the table grows fourfold, at last over all that whole
    passes leave and without shares, or over exchanges around the greedy filling where those need less; so the sum is the largest there
    is, and memory is bounded by the square of the longest length, whatever the number of documents.
    """
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), dtype=np.int64)
    if total == 0:
        return 0, extra
    whole = min(most, int(target // total))
    rest = int(round(target - whole * total)) if whole < most else 0
    if rest >= total:
        return whole + 1, extra
    share = np.minimum(counts, np.floor(counts * (rest / total)).astype(np.int64))
    order = np.argsort(-lengths, kind="stable")
    step, longest = int(np.gcd.reduce(lengths)), int(lengths.max())
    words, missed = TABLE_WORDS, rest + 1
    while missed >= step:
        trial = share.copy()
        left = rest - int((lengths * trial).sum())
        for i in order:
            if left <= words:
                break
            if lengths[i] > 0:
                k = min(int(counts[i] - trial[i]), left // int(lengths[i]))
                trial[i] += k
                left -= k * int(lengths[i])
        if 0 < left <= words:
            for i, k in bounded_knapsack(lengths, counts - trial, left, order):
                trial[i] += k
                left -= k * int(lengths[i])
        if left < missed:
            extra, missed = trial, left
        if not share.any() and words >= rest:
            break
        words *= 4
        if words >= 4 * longest * longest and words < rest:
            trial = exchanged(lengths, counts, rest, order)
            return whole, trial if rest - int((lengths * trial).sum()) < missed else extra
        if words >= rest:
            share, words = np.zeros_like(share), max(words, rest)
    return whole, extra


def exchanged(lengths: np.ndarray, counts: np.ndarray, target: int, order: np.ndarray) -> np.ndarray:
    """Counts whose lengths sum to the largest reachable value up to ``target``, by exchanges around a greedy filling.

    The filling takes the longest documents whole until one length is used in part. Some best choice differs from it in at most twice as many
    documents as the longest length has words (proximity of integer and fractional optima with one constraint), so the table covers sums within
    twice the square of the longest length around it, for documents put in and taken out.
    """
    taken, left = np.zeros(len(lengths), dtype=np.int64), target
    for i in order:
        size = int(lengths[i])
        if size > 0:
            k = min(int(counts[i]), left // size)
            taken[i] = k
            left -= k * size
            if k < counts[i]:
                break
    longest = int(lengths.max())
    parts: list[tuple[int, int]] = []
    for i in order:
        if lengths[i] > 0:
            for sign, free in ((1, int(counts[i] - taken[i])), (-1, int(taken[i]))):
                copies, part = min(free, 2 * longest), 1
                while copies > 0:
                    parts.append((int(i), sign * min(part, copies)))
                    copies -= min(part, copies)
                    part *= 2
    unit = math.gcd(*[int(lengths[i]) for i, _ in parts])
    span = 2 * longest * longest // unit
    sizes = [k * int(lengths[i]) // unit for i, k in parts]
    best, came_to = _signed_sums(sizes, span, left // unit)
    while best:
        p = came_to(best)
        taken[parts[p][0]] += parts[p][1]
        best -= sizes[p]
    return taken


def _signed_sums(sizes: list[int], span: int, most: int) -> tuple[int, Callable[[int], int]]:
    """(largest sum from 0 up to ``most``, place of the size that first reached a sum), over sums within ``span`` of 0."""
    mask, reach = (1 << (2 * span + 1)) - 1, 1 << span
    came = np.zeros(2 * span + 1, np.min_scalar_type(len(sizes)))
    for p, size in enumerate(sizes):
        fresh = (reach << size if size > 0 else reach >> -size) & mask & ~reach
        if fresh:
            reach |= fresh
            bits = np.frombuffer(fresh.to_bytes((2 * span) // 8 + 1, "little"), np.uint8)
            for lo in range(0, len(bits), 1 << 20):
                came[lo * 8 + np.flatnonzero(np.unpackbits(bits[lo:lo + (1 << 20)], bitorder="little"))] = p
        if reach >> (span + most) & 1:
            break
    return ((reach >> span) & ((1 << (most + 1)) - 1)).bit_length() - 1, lambda s: int(came[s + span])


def bounded_knapsack(lengths: np.ndarray, free: np.ndarray, left: int, order: np.ndarray) -> list[tuple[int, int]]:
    """(index, copies) whose lengths sum to the largest reachable value up to ``left``.

    Reachable sums are a sorted list if there are few, else bits of one integer; either notes the part that first reached a sum.
    """
    parts: list[tuple[int, int]] = []
    sums = 1
    for i in order:
        size = int(lengths[i])
        copies = min(int(free[i]), left // size) if 0 < size <= left else 0
        sums = min(sums * (copies + 1), SPARSE_SUMS + 1)
        part = 1
        while copies > 0:
            k = min(part, copies)
            parts.append((int(i), k))
            copies -= k
            part *= 2
    if not parts:
        return []
    unit = math.gcd(*[int(lengths[i]) for i, _ in parts])
    left //= unit
    sizes = [k * int(lengths[i]) // unit for i, k in parts]
    best, came_to = _sparse_sums(sizes, left) if sums <= SPARSE_SUMS else _dense_sums(sizes, left)
    taken = []
    while best:
        p = came_to(best)
        taken.append(parts[p])
        best -= sizes[p]
    return taken


def _sparse_sums(sizes: list[int], left: int) -> tuple[int, Callable[[int], int]]:
    """(largest sum, place of the size that first reached a sum)."""
    reach, came = np.zeros(1, np.int64), np.zeros(1, np.int32)
    for p, size in enumerate(sizes):
        fresh = np.setdiff1d(reach[reach <= left - size] + size, reach, assume_unique=True)
        reach, came = np.concatenate((reach, fresh)), np.concatenate((came, np.full(len(fresh), p, np.int32)))
        by = np.argsort(reach, kind="stable")
        reach, came = reach[by], came[by]
        if reach[-1] == left:
            break
    return int(reach[-1]), lambda s: int(came[np.searchsorted(reach, s)])


def _dense_sums(sizes: list[int], left: int) -> tuple[int, Callable[[int], int]]:
    mask, reach = (1 << (left + 1)) - 1, 1
    came = np.zeros(left + 1, np.min_scalar_type(len(sizes)))
    for p, size in enumerate(sizes):
        fresh = (reach << size) & mask & ~reach
        if fresh:
            reach |= fresh
            bits = np.frombuffer(fresh.to_bytes(left // 8 + 1, "little"), np.uint8)
            for lo in range(0, len(bits), 1 << 20):
                came[lo * 8 + np.flatnonzero(np.unpackbits(bits[lo:lo + (1 << 20)], bitorder="little"))] = p
        if reach >> left & 1:
            break
    return reach.bit_length() - 1, lambda s: int(came[s])


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, text: str = "text",
    weights: Sequence[float] = (1, 2, 3), budget: float | None = None, most: int = 3, seed: int = 42,
    out: str = "mix",
) -> DataFrame:
    """All columns of ``docs`` plus ``size``, ``source_size``, ``target`` and ``copies`` (times the mix takes the document), in a struct ``out``.

    ``docs`` must not have a column ``out``.

    Sizes are words of ``text`` unless a column is given. The order within (source, length) is a seeded hash of the
    id, so reruns agree; rows that repeat id, source and length are taken or left together. Null text counts 0
    words, null sources form one source, sorted last. Empty tables give empty results; a target of 0 takes nothing.
    """
    names = docs.columns
    wide = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    picked = pick(docs, doc_id=doc_id, source=source, **({} if size is not None else {"text": text}))
    at = {n: F.col(f"_c{i}") for i, n in reversed(list(enumerate(names)))}
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    draw = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), c.cast("string")), 1)
    words = lambda c: size if size is not None else word_count(c)
    narrow = written(picked.select(
        key(F.col("source")).alias("source_key"), "source", (size if size is not None else words(F.col("text"))).alias("size"), draw(F.col("doc_id")).alias("draw"),
    ), "sizes")
    counted = written(narrow.groupBy("source_key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = counted.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals, weights, budget, most)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        whole, extra = fit_lengths(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), float(rows["target"].iloc[0]), most)
        return rows.assign(whole=whole, extra=extra)[["source_key", "size", "n", "source_size", "target", "whole", "extra"]]

    plan = written(
        counted.join(targets, "source_key").select("source_key", "size", "n", "source_size", "target").groupBy("source_key")
        .applyInPandas(fit, "source_key string, size bigint, n bigint, source_size bigint, target double, whole bigint, extra bigint"),
        "mixplan",
    )
    partly = plan.filter("extra > 0 and extra < n").select("source_key", "size", "n", "extra")
    group = ["source_key", "size"]
    sliced = narrow.join(partly, group).withColumn(
        "slice", F.floor(F.col("draw") / F.lit(2.0**63) * F.ceil(F.col("n") / SLICE_ROWS))
    )
    from pyspark.sql import Window

    before = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        sliced.groupBy(*group, "extra", "slice").agg(F.count(F.lit(1)).alias("k"))
        .withColumn("quota", F.col("extra") - F.coalesce(F.sum("k").over(before), F.lit(0)))
        .filter("quota >= 1 and quota <= k").select(*group, "slice", "quota")
    )
    rank = Window.partitionBy(*group, "slice").orderBy("draw")
    last = (
        sliced.join(cut, [*group, "slice"]).withColumn("place", F.row_number().over(rank)).filter("place = quota")
        .select(*group, F.col("draw").alias("last"))
    )
    limits = written(plan.join(last, group, "left").select(
        *group, "source_size", "target", "whole",
        F.when(F.col("extra") >= F.col("n"), F.lit(2**63 - 1)).when(F.col("extra") <= 0, F.lit(-1)).otherwise(F.col("last")).alias("last"),
    ), "mixlimits")
    dropped(narrow, counted, plan)
    full = wide.select(
        "*", key(at[source]).alias("source_key"), (words(at[text]) if size is None else size).alias("size"), draw(at[doc_id]).alias("_draw")
    ).join(limits, group)
    copies = F.col("whole") + F.when(F.col("_draw") <= F.col("last"), 1).otherwise(0)
    return full.select(
        *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)],
        F.struct("size", "source_size", "target", copies.cast("bigint").alias("copies")).alias(out),
    )
