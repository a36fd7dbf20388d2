"""Language identification by hyperdimensional letter profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import pick

DIMENSIONS = 1024
NO_LANGUAGE = "und"
#: More learned languages than this is an error: the prototypes go to every task.
MOST_LANGUAGES = 10_000
_CHUNK = 1 << 20
_GRAMS = 2048


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=20_000)
def _letter_vector(code: int) -> np.ndarray:
    """A random vector of +1 and -1 that stands for a letter, drawn from its code point."""
    return np.random.Generator(np.random.PCG64([42, code])).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


def letter_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the letter trigrams of the lower-cased text; a run of other characters is one space.

    Long texts are read in pieces; the last two letters or spaces of a piece go before the next one, so every trigram counts once.
    """
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lowered = (text or "").lower()
    carried = np.array([32], np.int64)
    for lo in range(0, len(lowered), _CHUNK):
        points = np.frombuffer(lowered[lo:lo + _CHUNK].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ending = [32] if lo + _CHUNK >= len(lowered) else []
        points = np.concatenate((carried, np.where(_letters()[points], points, 32), np.array(ending, np.int64)))
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        carried = points[-2:]
        if len(points) < 3:
            continue
        found, n = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
        codes, counts = np.concatenate((codes, found)), np.concatenate((counts, n))
    if len(lowered) > _CHUNK:
        codes, back = np.unique(codes, return_inverse=True)
        counts = np.bincount(back, weights=counts).astype(np.int64)
    return codes, counts


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams: the letters' vectors, permuted by place (rotated by 2, 1 and 0) and multiplied."""
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        letters, at = np.unique(codes >> shift & 0x1FFFFF, return_inverse=True)
        out *= np.stack([np.roll(_letter_vector(int(c)), turn) for c in letters])[at]
    return out


def bundled(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Document vectors: the sums of their trigrams' vectors, by blocks of trigrams."""
    sums = np.zeros((len(docs), DIMENSIONS), np.float32)
    codes = np.unique(np.concatenate([c for c, _ in docs])) if docs else np.zeros(0, np.int64)
    places = [np.searchsorted(codes, c) for c, _ in docs]
    for lo in range(0, len(codes), _GRAMS):
        vectors = gram_vectors(codes[lo:lo + _GRAMS]).astype(np.float32)
        counts = np.zeros((len(docs), len(vectors)), np.float32)
        for i, (at, (_, n)) in enumerate(zip(places, docs)):
            a, b = np.searchsorted(at, [lo, lo + len(vectors)])
            counts[i, at[a:b] - lo] = n[a:b]
        sums += counts @ vectors
    return sums


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, list[float]]]:
    """(lang, unit vector) of every non-null language of the labelled documents, sorted by language.

    Bundling is linear: trigrams are counted by language over all rows, each is bound once, and the vectors are summed
    in Spark. Only one vector per language reaches the driver.
    """
    rows = pick(docs, text=text, lang=lang).filter("lang is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang", sort=True):
                pairs = [letter_grams(t) for t in part["text"]]
                codes, back = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([k for _, k in pairs]), minlength=len(codes)).astype(np.int64)
                yield pd.DataFrame({"lang": name, "gram": codes, "n": n})

    def bind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang", sort=True):
                vector = bundled([(np.sort(part["gram"].to_numpy()), part.sort_values("gram")["n"].to_numpy())])[0].astype(float)
                yield pd.DataFrame({"lang": name, "place": np.arange(DIMENSIONS), "value": np.round(vector)})

    grams = rows.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = grams.mapInPandas(bind, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
    found = vectors.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = []
    for r in found:
        v = np.array([x["value"] for x in r["v"]])
        out.append((r["lang"], (v / max(np.linalg.norm(v), 1e-12)).tolist()))
    return out


def with_language(docs: DataFrame, learned: list[tuple[str, list[float]]], text: str = "text", out: str = "language") -> DataFrame:
    """All columns of ``docs`` plus the struct ``out`` (lang_pred, score): the prototype with the largest cosine. ``docs`` must not have a column ``out``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned. Negative
    cosines count as 0; of equal cosines the first language wins.
    """
    names = [name for name, _ in learned]
    matrix = np.array([v for _, v in learned], np.float32).reshape(len(names), DIMENSIONS)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for lo in range(0, len(texts), 64):
            docs = [letter_grams(t) for t in texts.iloc[lo:lo + 64]]
            sums = bundled(docs)
            norms = np.sqrt((sums.astype(np.float64) ** 2).sum(1))
            cosines = (sums @ matrix.T) / np.maximum(norms, 1e-9)[:, None] if names else np.zeros((len(docs), 1))
            for (codes, _), row, norm in zip(docs, cosines, norms):
                best = int(row.argmax())
                known = bool(names) and len(codes) > 0 and norm > 0
                out.append((names[best], float(min(1.0, max(0.0, row[best])))) if known else (NO_LANGUAGE, 0.0))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    wide = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    done = wide.withColumn("_told", predict(F.col(f"_c{docs.columns.index(text)}")))
    return done.toDF(*docs.columns, out)
