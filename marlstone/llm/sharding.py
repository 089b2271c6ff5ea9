"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number in the total order (bucket, id, row hash, text),
the permutation maps 0..N-1 onto itself, and place p becomes shard p mod k, slot p div k.
Shard counts differ by at most one and slots have no gaps. All of it is DataFrame work.

Defined cases: a null text counts no bytes and CRC 0; rows that tie in every column take
their places among themselves in any order, which no output can tell apart; an empty table
gives no rows; columns of the input named like an output are replaced by it
(names that begin with two underscores are this package's own).
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Row numbers come from this many hash buckets, so offsets are a table of at most this many rows.
BUCKETS = 4096
ROUNDS = 6


def _numbered(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Add `__row`, the row's place in the order of (bucket, id, row hash, text), from 0."""
    keyed = df.withColumn("__hash", F.xxhash64(F.col(id_column), F.col(text_column))).withColumn("__bucket", F.pmod("__hash", F.lit(BUCKETS)))
    counts = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__offset"))
    within = Window.partitionBy("__bucket").orderBy(F.col(id_column).asc_nulls_first(), "__hash", F.col(text_column).asc_nulls_first())
    return keyed.withColumn("__within", F.row_number().over(within) - 1).join(F.broadcast(offsets), "__bucket").withColumn("__row", F.col("__offset") + F.col("__within"))


def feistel(row: Column, left: int, right: int, seed: int) -> Column:
    """A bijection of 0..left*right-1: alternating rounds add a keyed hash of one half to the other."""
    halves = F.struct(F.floor(row / F.lit(right)).cast("long").alias("l"), F.pmod(row, F.lit(right)).cast("long").alias("r"))
    for i in range(0, ROUNDS, 2):
        # one-element transforms hold each round's halves, so that they are computed once
        def two_rounds(h: Column, i: int = i) -> Column:
            l = F.pmod(h["l"] + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), h["r"]), F.lit(left)), F.lit(left))
            return F.transform(F.array(l), lambda l: F.struct(l.alias("l"), F.pmod(h["r"] + F.pmod(F.xxhash64(F.lit(seed), F.lit(i + 1), l), F.lit(right)), F.lit(right)).alias("r")))[0]

        halves = F.transform(F.array(halves), two_rounds)[0]
    return F.transform(F.array(halves), lambda h: h["l"] * F.lit(right) + h["r"])[0]


def domain(n: int) -> tuple[int, int]:
    """Two factors whose product is the least such square-like number of at least n."""
    left = max(1, isqrt(max(n, 1) - 1) + 1)
    return left, -(-max(n, 1) // left)


def walk_length(df: DataFrame, n: int, seed: int) -> int:
    """The most times that any row number below n must be permuted to land below n again.

    At most sqrt(n) numbers leave the range at their first step; those are followed until all are
    back. (Points that no number reaches may lie on cycles outside of it and are left alone.)
    """
    left, right = domain(n)
    steps, points = 1, df.sparkSession.range(n)
    while left * right > n:
        points = points.select(feistel(F.col("id"), left, right, seed).alias("id")).where(F.col("id") >= n)
        if not points.count():
            break
        steps += 1
    return steps


def permuted(row: Column, n: int, steps: int, seed: int) -> Column:
    left, right = domain(n)
    once = feistel(row, left, right, seed)
    if steps == 1:
        return once
    return F.aggregate(F.sequence(F.lit(2), F.lit(steps)), once, lambda at, _: F.when(at < n, at).otherwise(feistel(at, left, right, seed)))


def assign(df: DataFrame, shards: int, seed: int = 20240229, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`df` with shard and slot (long) by a seeded, reproducible shuffle of all rows."""
    n = df.count()
    place = permuted(F.col("__row"), n, walk_length(df, n, seed), seed)
    placed = _numbered(df, id_column, text_column).withColumn("__place", place)
    shard, slot = F.pmod("__place", F.lit(shards)).cast("int"), F.floor(F.col("__place") / F.lit(shards)).cast("long")
    kept = [F.col(c) for c in df.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, shard.alias("shard"), slot.alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """Store the shuffled rows as Parquet, a folder for each shard, ordered by slot within it."""
    assign(df, shards, **options).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The contract's columns for a documents table; only these narrow columns are shuffled."""
    data = F.col("text").cast("binary")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(data), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    placed = assign(narrow, shards, text_column="text_hash")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
