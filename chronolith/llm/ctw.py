"""Context-tree weighting over bytes, learned and applied as Spark jobs, beside a smoothed word model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import as_before, dropped, pick, whole_as_text, written

#: Bytes of context.
DEPTH = 4
#: Depths below this are mixed over the whole corpus, the others within the task that holds a context's last bytes.
TOP = 2
#: Bytes of text that one block holds; a longer text is a block of its own.
BLOCK_BYTES = 16_000_000
#: Bytes of text whose symbols are in memory at once; a longer text is taken whole.
PART_BYTES = 2_000_000
#: Distinct strings whose trees one task builds at a time, at least one two-byte context.
TREE_ROWS = 100_000
_WORD = -(1 << 63)


def _word_key(word: bytes) -> int:
    """A word's key, below 0; strings of DEPTH + 1 bytes have keys from 0."""
    return (xxhash.xxh64_intdigest(word, 42) & ((1 << 63) - 1)) + _WORD


#: The end of a text, counted as a token.
END_KEY = _word_key(b"")


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of every byte with its context, symbols of each text). A text starts after zero bytes and ends with one, its end symbol."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b"".join(bytes(DEPTH) + t + b"\0" for t in texts), np.uint8).astype(np.int64)
    ends = np.cumsum(sizes + DEPTH)
    real = np.ones(len(data), bool)
    for i in range(DEPTH):
        real[ends - sizes - DEPTH + i] = False
    key = np.zeros(len(data), np.int64)
    for back in range(1, DEPTH + 1):
        key[back:] |= data[:-back] << (8 * (DEPTH + 1 - back))
    return (key | data)[real], sizes


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about PART_BYTES."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > PART_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


class _Lookup:
    """Places of keys in an array: a hash table with open addressing, filled and read by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Places of keys that all are in the table."""
        at = self._first(wanted)
        found = self.slots[at]
        miss = np.flatnonzero(self.keys[found] != wanted)
        while len(miss):
            at[miss] = (at[miss] + 1) & (len(self.slots) - 1)
            found[miss] = self.slots[at[miss]]
            miss = miss[self.keys[found[miss]] != wanted[miss]]
        return found


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive arguments: Stirling's series after eight steps up."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with so many zeros and ones under the Krichevsky-Trofimov estimator."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class _Depth:
    """The nodes of one depth and bit level over sorted strings: one node per context and leading bits of the next byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, level: int):
        self.context = keys >> (8 * (DEPTH + 1 - depth)) if depth else np.zeros(len(keys), np.int64)
        symbol = keys & 255
        name = self.context << 8 | symbol >> (8 - level)
        self.names, self.of = np.unique(name, return_inverse=True)
        self.bit = symbol >> (7 - level) & 1
        self.ones = np.bincount(self.of, weights=counts * self.bit, minlength=len(self.names))
        self.zeros = np.bincount(self.of, weights=counts * (1 - self.bit), minlength=len(self.names))
        self.own = _estimate(self.zeros, self.ones)
        self.weighted = self.own

    def mix(self, below: _Depth) -> None:
        """Half the node's own estimate, half the product of the weighted probabilities of the contexts one byte longer."""
        parent = np.searchsorted(self.names, below.names >> 16 << 8 | below.names & 255)
        longer = np.bincount(parent, weights=below.weighted, minlength=len(self.names))
        self.weighted = np.logaddexp(self.own, longer) + np.log(0.5)

    def chance(self) -> np.ndarray:
        """The node's own probability of each string's bit."""
        hits = np.where(self.bit == 1, self.ones[self.of], self.zeros[self.of])
        return (hits + 0.5) / (self.zeros + self.ones + 1.0)[self.of]

    def share(self) -> np.ndarray:
        """The posterior weight of stopping at the node."""
        return np.exp(np.log(0.5) + self.own - self.weighted)[self.of]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (keys, counts) of a task in portions of whole TOP-byte contexts."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values("key", ignore_index=True)
    keys, counts = rows["key"].to_numpy(), rows["n"].to_numpy(np.float64)
    top = keys >> (8 * (DEPTH + 1 - TOP))
    starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    lo = 0
    while lo < len(keys):
        later = starts[np.searchsorted(starts, lo + TREE_ROWS, "right") - 1]
        hi = int(later) if later > lo else int(starts[np.searchsorted(starts, lo, "right")]) if starts[-1] > lo else len(keys)
        if len(keys) - lo <= TREE_ROWS:
            hi = len(keys)
        yield keys[lo:hi], counts[lo:hi]
        lo = hi


def _levels(keys: np.ndarray, counts: np.ndarray, level: int) -> list[_Depth]:
    """Depths from DEPTH to TOP of one bit level, weighted bottom-up."""
    out = [_Depth(keys, counts, DEPTH, level)]
    for depth in range(DEPTH - 1, TOP - 1, -1):
        out.append(_Depth(keys, counts, depth, level))
        out[-1].mix(out[-2])
    return out


def _top_tables(rows: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(zeros, ones, stop weight) by (context, node) of depths 1 and 0. A node is 2**level plus the leading bits, so a depth has at most 256 x 256."""
    zeros, ones, longer = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        zeros[r["context"], r["node"]], ones[r["context"], r["node"]], longer[r["context"], r["node"]] = r["zeros"], r["ones"], r["weighted"]
    own = _estimate(zeros, ones)
    weighted = np.logaddexp(own, longer) + np.log(0.5)
    first = (zeros, ones, np.exp(np.log(0.5) + own - weighted))
    z, o, below = (x.sum(0, keepdims=True) for x in (zeros, ones, weighted))
    own = _estimate(z, o)
    weighted = np.logaddexp(own, below) + np.log(0.5)
    return [first, (z, o, np.exp(np.log(0.5) + own - weighted))]


def tree_scores(strings: DataFrame) -> DataFrame:
    """(key, value): log10 probability of the last byte of every string (key, n) of DEPTH + 1 bytes after the others.

    ``n`` counts the training occurrences; strings with 0 are scored too. The next byte is eight binary decisions, each with
    its own tree of contexts. Trees are cut by the last TOP context bytes, so a task builds whole subtrees; the depths above have
    at most 2**16 nodes each and are summed in Spark. A context never seen in training predicts as its parent.
    """
    dealt = strings.repartition(F.shiftright("key", 8 * (DEPTH + 1 - TOP)))

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, counts in _groups(batches):
            for level in range(8):
                d = _levels(keys, counts, level)[-1]
                yield pd.DataFrame({
                    "context": d.names >> 16, "node": (1 << level) + (d.names & 255), "zeros": d.zeros, "ones": d.ones, "weighted": d.weighted,
                })

    summed = dealt.mapInPandas(roots, "context bigint, node bigint, zeros double, ones double, weighted double").groupBy("context", "node").agg(
        *[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]
    )
    tables = _top_tables(summed.collect())  # at most 256 x 255 rows

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, counts in _groups(batches):
            total = np.zeros(len(keys))
            for level in range(8):
                p = np.full(len(keys), 0.5)
                seen = np.zeros(len(keys), bool)
                for i, d in enumerate(_levels(keys, counts, level)):
                    own = d.chance()
                    stop = d.share() if i else np.ones(len(keys))
                    p = np.where(seen, stop * own + (1 - stop) * p, own)
                    seen = (d.zeros + d.ones)[d.of] > 0
                node = (1 << level) + ((keys & 255) >> (8 - level))
                bit = (keys & 255) >> (7 - level) & 1
                for context, (zeros, ones, stops) in zip((keys >> (8 * DEPTH), np.zeros(len(keys), np.int64)), tables):
                    z, o, stop = zeros[context, node], ones[context, node], stops[context, node]
                    own = (np.where(bit == 1, o, z) + 0.5) / (z + o + 1.0)
                    p = np.where(seen, stop * own + (1 - stop) * p, own)
                    seen = z + o > 0
                total += np.log10(p)
            yield pd.DataFrame({"key": keys, "value": total})

    return dealt.mapInPandas(score, "key bigint, value double")


def _blocked(rows: DataFrame) -> DataFrame:
    """Blocks of documents with their distinct keys: strings and words, and how often the block's training documents have them."""
    rows = whole_as_text(rows)
    id_type = dict(rows.dtypes)["doc_id"]

    def finish(docs: list[tuple]) -> pd.DataFrame:
        texts = [t for _, _, t in docs]
        train = np.array([not h for _, h, _ in docs])
        parts = []
        for lo, hi in _parts(texts):
            symbols, sizes = _symbols(texts[lo:hi])
            keys, n = np.unique(symbols << 1 | np.repeat(train[lo:hi], sizes), return_counts=True)
            parts.append((keys >> 1, n * (keys & 1)))
        words: Counter = Counter()
        for learn, text in zip(train, texts):
            if learn:
                words.update(text.split())
            else:
                for w in set(text.split()) - words.keys():
                    words[w] = 0
        words[b""] += int(train.sum())
        parts.append((np.fromiter(map(_word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words))))
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)
        return pd.DataFrame({
            "ids": [[d for d, _, _ in docs]], "held": [[bool(h) for _, h, _ in docs]], "sizes": [np.fromiter(map(len, texts), np.int64, len(texts))],
            "texts": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], "keys": [keys], "counts": [counts],
        })

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, size = [], 0
        for batch in batches:
            for doc, held, text in zip(batch["doc_id"], batch["held_out"], batch["text"]):
                data = (text or "").encode().lower()
                if docs and size + len(data) > BLOCK_BYTES:
                    yield finish(docs)
                    docs, size = [], 0
                docs.append((doc, held, data))
                size += len(data)
        if docs:
            yield finish(docs)

    kinds = f"ids array<{id_type}>, held array<boolean>, sizes array<bigint>, texts binary, keys array<bigint>, counts array<bigint>"
    return rows.mapInPandas(block, kinds).withColumn("block", F.monotonically_increasing_id())


def scored(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document.

    Learns from documents for which ``held_out`` is false. Texts are lower-cased (A-Z); null texts are empty and score their end
    alone. ``score`` is the log10 probability of all bytes and the end under the context trees, ``base_score`` that of the words and the end under add-0.1
    word frequencies. Documents travel in blocks that carry each distinct string and word once: counts are summed by key, and every block
    gets back the values of its own keys only, so no task holds a model larger than its texts. Words are told apart by 63-bit hashes.
    """
    rows = pick(docs.withColumn("_held", held_out), doc_id=doc_id, text=text, held_out="_held")
    blocks = written(_blocked(rows), "blocks")
    counted = blocks.select(F.explode(F.arrays_zip("keys", "counts")).alias("e")).groupBy(F.col("e.keys").alias("key")).agg(F.sum("e.counts").alias("n"))
    totals = written(counted, "totals")
    words = totals.filter("key < 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    room = n + 0.1 * (v + 1)
    values = tree_scores(totals.filter("key >= 0")).unionByName(
        words.select("key", F.log10((F.col("n") + 0.1) / F.lit(room)).alias("value"))
    )
    values = written(values, "values")
    dropped(totals)
    slices = written(
        blocks.select("block", F.explode("keys").alias("key")).join(values, "key").groupBy("block")
        .agg(F.collect_list("key").alias("keys"), F.collect_list("value").alias("values")), "slices"
    )
    dropped(values)
    unseen = float(np.log10(0.1 / room))
    id_type = dict(rows.dtypes)["doc_id"]
    sent_type = dict(whole_as_text(rows).dtypes)["doc_id"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, held, sizes, packed, keys, found in zip(*[batch[c] for c in ("ids", "held", "sizes", "texts", "keys", "values")]):
                keys, found = np.ascontiguousarray(keys, np.int64), np.asarray(found)
                place = _Lookup(keys)
                data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(np.sum(sizes)) or 1)
                ends = np.cumsum(sizes).tolist()
                texts = [data[a:b] for a, b in zip([0, *ends], ends)]
                end = float(found[place(np.array([END_KEY]))[0]])
                values: dict[bytes, float] = {}
                sums, tokens, known, base = [], [], [], []
                for lo, hi in _parts(texts):
                    symbols, lengths = _symbols(texts[lo:hi])
                    sums.append(np.add.reduceat(found[place(symbols)], np.concatenate(([0], np.cumsum(lengths)[:-1]))))
                    parts = [t.split() for t in texts[lo:hi]]
                    fresh = list(set().union(*parts) - values.keys())
                    if fresh:
                        values.update(zip(fresh, found[place(np.fromiter(map(_word_key, fresh), np.int64, len(fresh)))].tolist()))
                    for part in parts:
                        each = np.fromiter(map(values.__getitem__, part), np.float64, len(part))
                        tokens.append(len(part) + 1)
                        known.append(int((each > unseen + 1e-9).sum()) + int(end > unseen + 1e-9))
                        base.append(float(each.sum() + end))
                total = np.concatenate(sums)
                lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
                yield pd.DataFrame({
                    "doc_id": list(ids), "held_out": list(held), "n_tokens": tokens, "n_known": known, "train_tokens": n, "base_score": base,
                    "score": total, "bits_per_byte": -total / np.log10(2) / lengths,
                })

    result = blocks.select("block", "ids", "held", "sizes", "texts").join(slices, "block").drop("block")
    told = result.mapInPandas(
        score, f"doc_id {sent_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    )
    return as_before(told, {"doc_id": id_type})
