"""Spelling variants: words one edit apart, found by asymmetric chunks, and the common form each rare word belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chronolith.llm.common import dropped, lower_ascii, pick, written

#: A run of letters.
LETTERS = r"[A-Za-z\x{00C0}-\x{00FF}]+"


def letter_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of letters of the whole texts, A-Z lower-cased; null texts have none."""
    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.select("doc_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(LETTERS), 0)).alias("run"))


def slipped(doc_id: Column, run: Column, every: int) -> Column:
    """The run, without its code point h % length where ``every`` divides h, the crc32 of ``<doc_id>:<run>`` (a null id is empty)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, less).otherwise(run)


def word_counts(rows: DataFrame, word: Column, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): distinct words of at least ``shortest`` code points and ``least`` occurrences over all rows.

    Counts are summed before the shuffle, so a word that is a third of all rows arrives as one row a task. Null words are no words.
    """
    words = rows.select(word.alias("word")).filter(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _quarters(length: Column) -> Column:
    """One row per quarter of a word, its chunks (halves) cut in two: number, code points before and behind it."""
    half = F.floor(length / 2).cast("int")
    bounds = [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((length - half) / 2).cast("int"), length]
    return F.explode(F.array(*[
        F.struct(F.lit(k).alias("quarter"), bounds[k].alias("lo"), (length - bounds[k + 1]).alias("behind")) for k in range(4)
    ]))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): every unordered pair of different words that one inserted, deleted or replaced code point turns into each other, once.

    The shorter word (either, if equally long) contributes its two halves as chunks; one edit leaves one of them whole. The other
    word contributes the grams in which such a chunk can appear: at its own place, or one further behind an insertion; other
    positional grams meet no chunk within shift one, so they are not formed. Chunks that many words share (common beginnings and endings)
    would make long lists, so the key also holds what the edit leaves whole of the other half, which is cut in two in the same way:
    only words that differ in one quarter at most meet. Met pairs are verified on that quarter; a pair that
    meets in two quarters (an insertion on their border) counts in the later one.
    """
    sized = words.select("word", "n", F.char_length("word").cast("int").alias("size"))
    chunks = sized.select("*", F.col("size").alias("of"), _quarters(F.col("size")).alias("p"))
    spread = sized.select("*", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("of")).filter("of > 0")
    grams = spread.select("*", _quarters(F.col("of")).alias("p"))

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        ahead = F.substring(F.col("word"), F.lit(1), F.col("p.lo"))
        behind = F.substring(F.col("word"), F.col("size") - F.col("p.behind") + 1, F.col("p.behind"))
        middle = F.substring(F.col("word"), F.col("p.lo") + 1, F.col("size") - F.col("p.behind") - F.col("p.lo"))
        return rows.select(
            "of", F.col("p.quarter").alias("quarter"), ahead.alias("ahead"), behind.alias("behind"),
            F.col("word").alias(side), F.col("n").alias(f"n_{side}"), middle.alias(f"middle_{side}"), (F.col("size") - F.col("of")).alias(f"more_{side}"),
        )

    met = keyed(chunks, "a").drop("more_a").join(keyed(grams, "b"), ["of", "quarter", "ahead", "behind"])
    first = (F.col("more_b") == 1) | (F.col("a") < F.col("b"))
    one_edit = F.levenshtein("middle_a", "middle_b", 1) == 1
    begins = F.startswith(F.col("middle_b"), F.col("middle_a")) & (F.col("more_b") == 1)
    return met.filter(first & one_edit & ((F.col("quarter") == 3) | ~begins)).select("a", "b", "n_a", "n_b")


def variant_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n) for ``words`` (word, n): ``form`` is the near word of largest n (ties: smallest in code point order) if that is ``ratio`` times n."""
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_b").alias("other_n"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), F.col("n_a").alias("other_n"), F.col("a").alias("other")),
    )).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    far = -F.col("best.m") >= ratio * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"),
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` plus ``root``, the last word reached from a word along its forms; the word itself if it has none.

    Every step at least doubles n (``ratio`` above 1), so chains are short; each round doubles the steps taken, and rounds end when
    no pointer has a form left. Only words with a form take part.
    """
    links = written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        seen = Observation()
        stepped = links.join(onward, "root", "left").withColumn("moved", F.col("next").isNotNull())
        after = written(
            stepped.observe(seen, F.count_if("moved").alias("n")).select("word", F.coalesce("next", "root").alias("root")), "roots"
        )
        dropped(links)
        links = after
        if not seen.get["n"]:
            return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table of distinct words and counts; an empty table gives no rows.

    Words of any length are compared whole; null words must not occur (``word_counts`` gives none).
    """
    if ratio < 2:
        raise ValueError("forms need a ratio of at least 2, else they may form cycles")
    counted = written(words.select("word", "n"), "words")
    return with_roots(written(variant_forms(counted, ratio), "forms"))
