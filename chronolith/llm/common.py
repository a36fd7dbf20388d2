"""Helpers shared by the corpus operators: column picking, written tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chronolith.session import scratch_path

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns (``new=old`` renames), chosen by exact name, so extra columns cannot clash by letter case."""
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    wanted = {**{n: n for n in names}, **renamed}
    return plain.select(*[F.col(f"_c{at[old]}").alias(new) for new, old in wanted.items()])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Types of numbers that pandas turns into floating point beside a null; they travel as text.
_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def whole_as_text(df: DataFrame) -> DataFrame:
    """``df`` with its whole-number columns as text, so that Python sees every digit even beside nulls."""
    return df.select(*[F.col(f"`{n}`").cast("string").alias(n) if t in _WHOLE else F.col(f"`{n}`") for n, t in df.dtypes])


def as_before(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """``df`` with the named columns cast to their types."""
    return df.select(*[F.col(f"`{n}`").cast(types[n]).alias(n) if n in types and t != types[n] else F.col(f"`{n}`") for n, t in df.dtypes])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table below the shared checkpoint folder; losing executors costs no recomputation beyond it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the links (a, b): the smallest node reachable.

    Alternating large-star and small-star rounds; a hub's rows are only aggregated by minimum and joined back, where
    adaptive execution can split them. Each round is written and the table before it is dropped. Ends when a round
    changes nothing; more than ``rounds`` rounds is an error, not a cut.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
        large = both.join(nearest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(
                F.struct(F.col("u"), F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v"))
            )).alias("e"))
            .select("e.*").filter("u <> v").distinct()
        )
        seen = Observation()
        after = written(small.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "links")
        state = (seen.get["n"], seen.get["x"])
        dropped(edges)
        edges = after
        if state == before:
            labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return labels.unionByName(roots)
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
