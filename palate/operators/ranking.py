"""Numbers and sums along an order of all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.sources.storage import scratch


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt into ranges of ``order``, with ``__part``, the number of the range. Written once, so that whoever
    reads it again finds the same ranges."""
    path = scratch(df.sparkSession, "ranged")
    out = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    out.withColumn("__part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``, each row's place from 0 in the order of all rows, which must be total. Rows are numbered
    within ranges; what stands before a range is a row for each range."""
    rows = ranged(df, *order)
    # a row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + at).drop("__part", "__start")


def permuted(keys: tuple[Column, Column, Column], place: Column, bits: int) -> Column:
    """The number at ``place`` of the order that ``keys`` draw over 0 to 2 ** ``bits`` - 1 (31 bits at most). Odd factors
    modulo a power of two and shifts to the right under an exclusive or can be undone, so it is a permutation: the
    head of an order is computed without any other row of it. All in whole numbers that any SQL has."""
    size, half = 1 << bits, (bits + 1) // 2
    a, b, c = keys
    seed = ((a % 4294967296) * 374761393 + (b % 65536) * 668265263 + (c % 65536) * 2246822519) % 4294967296
    again = (seed * 40503 + 2654435761) % 4294967296
    x = place
    for factor, shift in ((seed * 2 + 1, F.floor(seed / 65536)), (again * 2 + 1, F.floor(again / 65536))):
        x = (x * (factor % size) + shift) % size
        x = x.bitwiseXOR(F.shiftright(x, half))
    return x


def permuted_sql(a: str, b: str, c: str, place: str, bits: str) -> str:
    """The same in DuckDB."""
    seed = f"((({a}) % 4294967296) * 374761393 + (({b}) % 65536) * 668265263 + (({c}) % 65536) * 2246822519) % 4294967296"
    again = f"(({seed}) * 40503 + 2654435761) % 4294967296"
    x = place
    for s in (seed, again):
        x = f"(({x}) * ((({s}) * 2 + 1) % (1::BIGINT << {bits})) + ({s}) // 65536) % (1::BIGINT << {bits})"
        x = f"xor({x}, ({x}) >> (({bits} + 1) // 2))"
    return x
