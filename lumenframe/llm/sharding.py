"""Operator 9 [native]: a reproducible shuffle, and the shard and slot of every row, by a Feistel permutation.

Rows get global numbers 0..n-1 in an order that depends on their content alone. A Feistel network permutes
[0, side * side), the smallest square not under n; a value of n or more walks on through the permutation until it is
under n (cycle walking), which gives a permutation of [0, n). Shard and slot are remainder and quotient of the permuted
number, so shards differ by one row at most, slots have no gaps, and a row's place is computed from its number alone.

Numbering needs no sort in one task: rows are dealt to BUCKETS buckets by hash, a bucket's first number comes from the
buckets' counts (a table of at most BUCKETS rows, hence broadcast), and equal rows are counted before they are
numbered, so that a group of copies is one row until the end. DataFrame functions only.

Law: ``rows``. Null texts have no bytes and the CRC of the empty text; null ids are values like any other; equal rows
get different slots. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize, read

BUCKETS = 4096
ROUNDS = 6
SHARDS = 24
SEED = 42
#: Rows of a group of equal rows that one task expands at a time.
CHUNK = 4096


def feistel(number: Column, side: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """A permutation of [0, side * side); the halves are quotient and remainder by ``side``."""
    n = F.lit(side).cast("long")
    # a transform of one element binds a round's halves to a name, so that the expression doesn't double each round
    pair = F.array(F.struct(F.call_function("div", number, n).alias("l"), F.pmod(number, n).alias("r")))

    def turn(step: int):
        return lambda p: F.struct(p["r"].alias("l"), F.pmod(p["l"] + F.pmod(F.xxhash64(F.lit(seed), F.lit(step), p["r"]), n), n).alias("r"))

    for step in range(rounds):
        pair = F.transform(pair, turn(step))
    return F.transform(pair, lambda p: p["l"] * n + p["r"])[0]


def walk_length(spark: SparkSession, n: int, side: int, seed: int = SEED) -> int:
    """The most steps that any walk needs after the first.

    Walks pass through the values from n to side * side, at most 2 * sqrt(n) + 1, and enter them at one that is no image
    of another; cycles wholly among them are never entered. Those entries are walked until all are under n.
    """
    beyond = spark.range(n, side * side).select(F.col("id").alias("x"))
    images = materialize(beyond.select(feistel(F.col("x"), side, seed).alias("x")), "walk")
    values, steps = materialize(beyond.join(images, "x", "left_anti"), "walk"), 0
    while not values.isEmpty():
        # a written table each step, so that the expression doesn't grow into the next
        values = materialize(values.select(feistel(F.col("x"), side, seed).alias("x")).where(F.col("x") >= n), "walk")
        steps += 1
    return steps


def permuted(number: Column, n: int, side: int, walk: int, seed: int = SEED) -> Column:
    """A permutation of [0, n)."""
    state = F.array(feistel(number, side, seed))
    for _ in range(walk):
        state = F.transform(state, lambda x: F.when(x < n, x).otherwise(feistel(x, side, seed)))
    return state[0]


def number_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """``by`` of each row with ``row_number`` (0..n-1), an order by content: equal rows share neither number nor task."""
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__copies"))
    groups = groups.withColumn("__bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)))
    groups = materialize(groups, "groups")
    counts = groups.groupBy("__bucket").agg(F.sum("__copies").alias("__n"))
    first = counts.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__first"))
    inside = Window.partitionBy("__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in by]).rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.withColumn("__before", F.sum("__copies").over(inside) - F.col("__copies")).join(F.broadcast(first), "__bucket")
    placed = placed.withColumn("__start", F.col("__first") + F.col("__before"))
    chunks = placed.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / CHUNK))))
    if groups.where(F.col("__copies") > CHUNK).limit(1).count():
        chunks = chunks.repartition(*by, "__chunk")
    last = F.least(F.col("__copies"), (F.col("__chunk") + 1) * CHUNK) - 1
    return chunks.select(*by, F.explode(F.sequence(F.col("__chunk") * CHUNK, last)).alias("__k"), "__start").select(*by, (F.col("__start") + F.col("__k")).alias("row_number"))


def shard_rows(df: DataFrame, n_shards: int = SHARDS, *, id_col: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, law, shard, slot, grown_shard, and the row_number they are computed from."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = number_rows(df.select(F.col(id_col), size.alias("size"), crc.alias("text_crc32")), [id_col, "size", "text_crc32"])
    rows = materialize(rows, "numbered")
    n = rows.count()
    side = math.isqrt(max(n - 1, 0)) + 1
    place = permuted(F.col("row_number"), n, side, walk_length(df.sparkSession, n, side, seed) if side * side > n else 0, seed)
    return rows.withColumn("__p", place).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("__p", F.lit(n_shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("__p"), F.lit(n_shards).cast("long")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"))
