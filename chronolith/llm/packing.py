"""Best-fit packing of tokenized documents into fixed windows, partition by partition, then along a tree."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chronolith.llm.common import as_before, dropped, pick, whole_as_text, written

#: Items that one task packs.
ITEMS_PER_TASK = 200_000
_PIECES = "uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@cache
def _fast(tokenizer_file: str, ranks_file: str):
    """The encoder from ranks and the strings of the tokenizer's added tokens."""
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(tokenizer_file, encoding="utf-8") as f:
        specials = [t["content"] for t in json.load(f).get("added_tokens", [])]
    return fast, specials


@cache
def _exact(tokenizer_file: str):
    """The tokenizer itself, loaded only in tasks that need it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file)


def token_ids(text: str, tokenizer_file: str, ranks_file: str) -> list[int]:
    """Ids of the tokenizer file without special tokens added; a special token's string in the text gives its id.

    The same vocabulary read as ranks is about three times faster and gives the same ids for ordinary text, which tests hold
    against the tokenizer itself; texts that hold a special string go through the tokenizer.
    """
    fast, specials = _fast(tokenizer_file, ranks_file)
    if any(s in text for s in specials):
        return _exact(tokenizer_file).encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_of(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 1024, end: int = 2,
    files: tuple[str, str] | None = None, keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut into windows if longer.

    All pieces but the first are full. Null text is empty: one piece with the end id. Rows that repeat stay separate, null ids stay null
    and leave the others unchanged.
    """
    tokenizer_file, ranks_file = files or tokenizer_files()
    picked = pick(docs, doc_id=doc_id, text=text)
    id_type = dict(picked.dtypes)["doc_id"]
    rows = whole_as_text(picked)
    sent_type = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo:lo + 256]
                out = []
                for doc, body in zip(part["doc_id"], part["text"]):
                    ids = np.array([*token_ids(body or "", tokenizer_file, ranks_file), end], dtype="<u4")
                    first = (len(ids) - 1) % window + 1
                    bounds = [0, *range(first, len(ids) + 1, window)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].tolist()] if keep_ids else [])))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    more = ", ids array<bigint>" if keep_ids else ""
    pieces = rows.mapInPandas(cut, f"doc_id {sent_type}, piece int, start bigint, length bigint, ids_crc32 bigint{more}")
    return as_before(pieces, {"doc_id": id_type})


def best_fit(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item: longest first, each into the fullest bin that still holds it."""
    room: list[list[int]] = [[] for _ in range(window + 1)]
    open_rooms, opened = 0, 0
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, at = window, opened
            opened += 1
        bins[i], offsets[i] = at, window - left
        left -= size
        if left:
            room[left].append(at)
            open_rooms |= 1 << left
    return bins, offsets


def packed(pieces: DataFrame, window: int = 1024, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``pieces`` (rows with ``length`` from 1 to ``window``) plus ``sequence_id`` and ``offset``.

    Full pieces are sequences of their own. The others are dealt out evenly; each task packs its share best-fit and emits
    bins too full for the smallest bin left anywhere. Emptier bins go on as items of their filled length to fewer tasks, until one task
    has packed them all or a round merges nothing. A task holds at most about ``items_per_task`` bins, whatever the table's size.
    """
    names = pieces.columns
    columns = {n: f"_c{i}" for i, n in enumerate(names)}
    numbered = pieces.toDF(*columns.values())
    types = dict(numbered.dtypes)
    plain = whole_as_text(numbered).withColumn("bin", F.monotonically_increasing_id())
    size = F.col(columns["length"]).cast("bigint")
    seen = Observation()
    start = plain.withColumns({"offset": F.lit(0).cast("bigint"), "fill": size})
    table = written(
        start.observe(seen, F.count(F.when(F.col("fill") < window, 1)).alias("n"), F.min("fill").alias("least")), "pieces"
    )
    least, n = seen.get["least"] or 1, seen.get["n"]
    done = [table.filter(F.col("fill") >= window)]
    rest = table.filter(F.col("fill") < window)
    schema = rest.schema
    level = 0
    while n:
        tasks = -(-n // items_per_task)
        level += 1

        def pack(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            rows = [b for b in batches if len(b)]
            if not rows:
                return
            rows = pd.concat(rows, ignore_index=True).sort_values(["bin", "offset"], kind="stable", ignore_index=True)
            items, first, of = np.unique(rows["bin"].to_numpy(), return_index=True, return_inverse=True)
            bins, offsets = best_fit(rows["fill"].to_numpy()[first], window)
            fills = np.bincount(bins, weights=rows["fill"].to_numpy()[first]).astype(np.int64)
            task = TaskContext.get().partitionId()
            rows["bin"] = (level << 56) | (task << 32) | bins[of]
            rows["offset"] += offsets[of]
            rows["fill"] = fills[bins[of]]
            for lo in range(0, len(rows), 50_000):
                yield rows.iloc[lo:lo + 50_000]

        seen = Observation()
        opened = F.col("offset") == 0
        after = written(
            rest.repartition(tasks, "bin").mapInPandas(pack, schema)
            .observe(seen, F.min("fill").alias("least"), F.count(F.when(opened, 1)).alias("bins")), "bins"
        )
        least, bins = seen.get["least"], seen.get["bins"]
        if tasks == 1 or bins == n:
            done.append(after)
            break
        done.append(after.filter(F.col("fill") > window - least))
        rest = after.filter(F.col("fill") <= window - least)
        n = rest.filter(opened).count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = as_before(out, types)
    return out.select(*[F.col(c).alias(n) for n, c in columns.items()], F.col("bin").alias("sequence_id"), "offset")
