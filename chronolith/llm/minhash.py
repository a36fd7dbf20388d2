"""One-permutation MinHash fingerprints as column expressions, and likenesses of neighbouring documents."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import dropped, lower_ascii, pick, written

#: 2**BIN_BITS bins, LOW_BITS stored of each bin's minimum.
BIN_BITS, LOW_BITS = 7, 8
BINS = 1 << BIN_BITS
_SHIFT = 63 - BIN_BITS
#: Donor bins looked at before all others are.
_FIRST_DONORS = 16
#: Documents of one slice of the id order, and the most slices; both only balance the work.
ROWS_PER_SLICE, MOST_SLICES = 500, 65_536


def _donors(seed: int = 42) -> list[list[int]]:
    """For every bin an own random order of the other bins, in which an empty bin looks for a filled one."""
    draw = random.Random(seed)
    return [draw.sample([j for j in range(BINS) if j != i], BINS - 1) for i in range(BINS)]


def with_signature(df: DataFrame, text: str, out: str, words: int = 5) -> DataFrame:
    """Adds ``out``: array of BINS low-order values, null for a text without words.

    Every shingle of five words is hashed once; its top bits name the bin, the minimum of a bin is kept. One bound per bin is
    sorted in with the hashes, so the first entry of each bin is its minimum, or its bound if the bin is empty. Empty bins copy
    the first filled bin in their own random order (optimal densification). Shorter texts are one shingle.
    """
    t = f"_{out}_"
    parts = F.filter(F.split(lower_ascii(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn(t + "w", F.transform(parts, lambda w: F.xxhash64(w)))
    n = F.size(t + "w")
    shingles = F.when(n >= words, F.transform(
        F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))),
        lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(F.col(t + "w"), i + k) for k in range(words)]), 1),
    )).when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(F.col(t + "w")), 1)))
    bounds = F.array(*[F.lit(((i + 1) << _SHIFT) - 1) for i in range(BINS)])
    df = df.withColumn(t + "s", F.sort_array(F.concat(shingles, bounds)))
    bin_of = lambda h: F.shiftright(h, _SHIFT)
    firsts = F.filter(F.col(t + "s"), lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col(t + "s"), i - 1))))
    df = df.withColumn(t + "m", firsts)
    empty = lambda h: F.bitwise_not(h).bitwiseAND(F.lit((1 << _SHIFT) - 1)) == 0
    minimum = lambda j: F.get(F.col(t + "m"), j)
    orders = _donors()
    first = F.array(*[F.array(*[F.lit(j) for j in o[:_FIRST_DONORS]]) for o in orders])
    later = F.array(*[F.array(*[F.lit(j) for j in o[_FIRST_DONORS:]]) for o in orders])
    donor = lambda o, i: minimum(F.get(F.filter(F.get(o, i), lambda j: ~empty(minimum(j))), F.lit(0)))
    filled = F.transform(F.col(t + "m"), lambda h, i: F.when(empty(h), F.coalesce(donor(first, i), donor(later, i))).otherwise(h))
    dense = F.when(F.exists(t + "m", empty), filled).otherwise(F.col(t + "m"))
    df = df.withColumn(t + "d", dense)
    low = F.transform(F.col(t + "d"), lambda h: h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int"))
    return df.withColumn(out, low).drop(*[t + c for c in "wsmd"])


def packed_hex(signature: Column) -> Column:
    """The packed low-order bits as hex digits; empty for a text without words."""
    return F.coalesce(F.lower(F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v), LOW_BITS // 4, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, freed of chance agreement of the low-order bits.

    Two texts without words are alike (1), one alone is not (0).
    """
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-LOW_BITS
    free = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(free)


def _slices(ids: DataFrame, rows_per_slice: int) -> Column:
    """Slice number of ``id`` along its order: two-level lookup in approximate quantiles, which decide the balance only."""
    n = min(MOST_SLICES, max(1, -(-ids.count() // rows_per_slice)))
    if n == 1:
        return F.lit(0)
    probs = F.expr(f"array({','.join(f'{i / n!r}D' for i in range(1, n))})")  # the aggregate takes constants only, and thousands are parsed faster than built
    bounds = sorted(set(ids.agg(F.percentile_approx("id", probs, 10 * max(n, 1000))).first()[0] or []))
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("id")))
    literal = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    group = below(literal([g[0] for g in groups]))
    inner = F.get(F.array(*[literal(g) for g in groups]), group - 1)
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(inner))


def neighbour_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likenesses.

    The edited text replaces the last half (rounded down) of the code points by as many first ones of the next document in
    ascending integer id, the first after the last. Null texts are empty; null ids come last; rows that repeat an id
    follow each other by a hash of the text. One shuffle of the texts: by slices of the id order; each slice's last document gets the next slice's first.
    """
    rows = pick(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumns({"slice": _slices(rows.select("id"), rows_per_slice), "tie": F.xxhash64("text")})
    heads = rows.groupBy("slice").agg(F.min(F.struct("id", "tie")).alias("h")).select("slice", "h.*")
    first_rows = rows.join(F.broadcast(heads), ["slice", "id", "tie"], "left_semi").dropDuplicates(["slice"])  # at most MOST_SLICES rows of numbers
    starts = written(with_signature(first_rows.select("slice", "text"), "text", "sig"), "heads")
    order = Window.orderBy("slice")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = starts.select("slice", F.coalesce(F.lead("slice").over(order), F.first("slice").over(whole)).alias("follows"))
    follow = after.join(starts.withColumnRenamed("slice", "follows"), "follows").select("slice", F.col("text").alias("head_text"), F.col("sig").alias("head_sig"))
    along = Window.partitionBy("slice").orderBy("id", "tie")
    joined = (
        rows.withColumn("lead_text", F.lead("text").over(along)).join(follow, "slice", "left")
        .withColumn("next_text", F.coalesce("lead_text", "head_text"))
    )
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = joined.select(
        "slice", "id", "tie", "doc_id", "text", "head_sig", n.cast("bigint").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    signed = with_signature(with_signature(edited, "text", "sig"), "edited", "edited_sig").select(
        "slice", "id", "tie", "doc_id", "n_chars", "head_sig", F.sha2("edited", 256).alias("edited_sha256"), "sig", "edited_sig"
    )
    next_sig = F.when(F.lead(F.lit(1)).over(along).isNotNull(), F.lead("sig").over(along)).otherwise(F.col("head_sig"))
    return signed.withColumn("next_sig", next_sig).select(
        "doc_id", "n_chars", "edited_sha256", packed_hex(F.col("sig")).alias("fingerprint"), packed_hex(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
