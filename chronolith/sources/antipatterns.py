"""Anti-pattern summaries, memberships in compressed cluster files, and tables in HTML summaries."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.classify import SOURCE_EXTENSIONS
from chronolith.functions.text import plain_text
from chronolith.sources.paths import keyed

# Dependency kinds named in sub-matrix files.
DEPENDENCY_KINDS = (
    "Implement", "Cast", "Set", "Call", "Contain", "Annotation", "Use", "Return", "Extend", "Import", "Throw",
    "Create", "Parameter", "Override", "Mixin",
)
GZIP_MAGIC = b"\x1f\x8b"
STRING_MARK = b"\x01\x00"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Rows of anti-pattern summary tables with every column of their header."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)


def clique_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, files): third column of the row that starts with 'Clique'."""
    rows = spark.read.option("recursiveFileLookup", True).schema("a string, b string, c string").csv(path)
    named = rows.select(F.col("_metadata.file_path").alias("path"), "*").filter(F.trim("a") == "Clique")
    return named.select("path", F.col("c").try_cast("double").try_cast("bigint").alias("files"))


# --- compressed cluster files --------------------------------------------------


def _body(content: bytes) -> bytes:
    """What the gzip members inside a file hold, one after the other; b'' if there is none or one is broken or cut off."""
    start = content.find(GZIP_MAGIC)
    parts, rest = [], content[start:] if start >= 0 else b""
    try:
        while rest.startswith(GZIP_MAGIC):
            member = zlib.decompressobj(zlib.MAX_WBITS | 16)
            parts.append(member.decompress(rest))
            if not member.eof:
                return b""
            rest = member.unused_data.lstrip(b"\0")
    except zlib.error:
        return b""
    return b"".join(parts)


def _marked_strings(body: bytes) -> Iterator[str]:
    """Strings written as mark, length byte, UTF-8 bytes."""
    at = body.find(STRING_MARK)
    while 0 <= at < len(body) - 3:
        first, size = at + 3, body[at + 2]
        if first + size <= len(body):
            yield body[first:first + size].decode("utf-8", errors="replace").strip()
            at = body.find(STRING_MARK, first + size)
        else:
            at = body.find(STRING_MARK, at + 1)


def _is_source(name: str) -> bool:
    return "." in name and not name.startswith("\0") and name.rsplit(".", 1)[1].lower() in SOURCE_EXTENSIONS


_PATHS = re.compile(r"[a-zA-Z][\w$/.\-]*/[\w$/.\-]*\.(?:" + "|".join(sorted(SOURCE_EXTENSIONS)) + r")\b", re.ASCII)
_KINDS = re.compile(r"\b(?:" + "|".join(DEPENDENCY_KINDS) + r")\b")


def _decoded(content: bytes, scan_text: bool) -> tuple[list[str], list[str]]:
    body = _body(content)
    names = [s for s in _marked_strings(body) if _is_source(s)]
    if not scan_text:
        return names, []
    text = body.decode("utf-8", errors="replace")
    return list(dict.fromkeys([*names, *_PATHS.findall(text)])), sorted(set(_KINDS.findall(text)))


def decode_members(blobs: DataFrame, scan_text: bool = False) -> DataFrame:
    """(path, ord, file, kinds) from (path, content) rows; every file is decoded on its own on the executors.

    With ``scan_text`` (sub-matrix files) paths and dependency kinds are also searched in the text and repeats dropped.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                files, kinds = _decoded(bytes(content), scan_text)
                rows.extend((path, i, f, kinds) for i, f in enumerate(files))
            yield pd.DataFrame(rows, columns=["path", "ord", "file", "kinds"])

    return blobs.select("path", "content").mapInPandas(decode, "path string, ord int, file string, kinds array<string>")


def read_blobs(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content")


def placed_members(decoded: DataFrame) -> DataFrame:
    """(repo, rev, type, instance, file, ord): type and instance are the two folders above the file."""
    parts = F.reverse(F.split("path", "/"))
    return keyed(decoded).select(
        "repo", "rev", F.get(parts, F.lit(2)).alias("type"), F.get(parts, F.lit(1)).alias("instance"), "file", "ord"
    )


def memberships(decoded: DataFrame) -> DataFrame:
    """Distinct (repo, rev, type, file) for both folder layouts: below 'arch-issue' or 'anti-pattern-instances'."""
    kind = F.regexp_extract("path", r"/(?:arch-issue|anti-pattern-instances)/([^/]+)/", 1)
    rows = keyed(decoded).withColumn("type", kind).filter(F.col("type") != "")
    return rows.select("repo", "rev", "type", "file").distinct()


# --- HTML tables ---------------------------------------------------------------


def html_table_rows(docs: DataFrame, keys: list[str] = ("repo", "rev"), word: str = "file") -> DataFrame:
    """(keys, ord, row): rows of the first table with a header cell naming ``word``, as header -> cell maps.

    Rows with another number of cells than the header are skipped; the header row itself has the right number.
    """
    texts = lambda source, pattern: F.transform(F.regexp_extract_all(source, F.lit(pattern), 1), plain_text)
    heads = lambda t: texts(t, r"(?is)<th[^>]*>(.*?)</th>")
    tables = F.regexp_extract_all("html", F.lit(r"(?is)<table[^>]*>.*?</table>"), 0)
    fits = F.filter(tables, lambda t: F.exists(heads(t), lambda h: F.contains(F.lower(h), F.lit(word))))
    chosen = docs.select(*keys, F.get(fits, F.lit(0)).alias("t")).filter(F.col("t").isNotNull())
    rows = chosen.select(
        *keys, heads(F.col("t")).alias("heads"), F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("ord", "r")
    ).withColumn("cells", texts(F.col("r"), r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"))
    whole = rows.filter(F.size("cells") == F.size("heads"))
    names = F.array_distinct("heads")
    last = F.transform(names, lambda h: F.get(F.col("cells"), F.size("heads") - F.array_position(F.reverse("heads"), h).cast("int")))
    return whole.select(*keys, "ord", F.map_from_arrays(names, last).alias("row"))
