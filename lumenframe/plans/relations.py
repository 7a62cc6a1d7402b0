"""The driver tables as the engine's relations, and the same relations in SQL.

Identities come from a row number inside a bounded key (an order's lines, a user's events), never from a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: an order is an asset, a line a box."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset"), place.alias("id"), ((F.col("l_partkey") * 7) % 120).alias("x"), ((F.col("l_suppkey") * 5) % 60).alias("y"),
        (F.col("l_quantity") + 20).cast("bigint").alias("w"), (F.col("l_linenumber") * 4 + 12).cast("bigint").alias("h"), F.col("l_discount").alias("conf"),
        (F.col("l_suppkey") % 2).alias("backend"), F.col("l_returnflag").alias("lang"), F.col("l_linestatus").alias("state"), F.repeat(F.col("l_returnflag"), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("text"),
    )


BOXES = f"""boxes AS (
  SELECT l_orderkey AS asset, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) AS id,
    (l_partkey * 7) % 120 AS x, (l_suppkey * 5) % 60 AS y, CAST(l_quantity + 20 AS BIGINT) AS w, CAST(l_linenumber * 4 + 12 AS BIGINT) AS h,
    l_discount AS conf, l_suppkey % 2 AS backend, l_returnflag AS lang, l_linestatus AS state, repeat(l_returnflag, CAST(l_linenumber % 3 + 1 AS BIGINT)) AS text
  FROM lineitem)"""

PAIRS = """pairs AS (
  SELECT *, ih * iw AS inter, (ih * iw) / (aw * ah + bw * bh - ih * iw) AS iou FROM (
    SELECT a.asset, a.id AS a_id, b.id AS b_id, a.w AS aw, a.h AS ah, b.w AS bw, b.h AS bh, a.backend AS a_backend, b.backend AS b_backend, a.text AS a_text, b.text AS b_text,
      a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_,
      least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih
    FROM boxes a JOIN boxes b ON a.asset = b.asset) WHERE iw > 0 AND ih > 0)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text regions: the lines of documents that have any letter, mark or digit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return docs.select("doc_id", "lang", F.col("pos").cast("bigint").alias("pos"), "text")


LINES = """lines AS (
  SELECT doc_id, lang, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS text FROM documents)"""

NORM = "lower(regexp_replace({c}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'))"


def norm(c: str) -> str:
    return NORM.format(c=c)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as frames of a track."""
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), frame.alias("frame"), "event_id", "ts", F.col("event_type").alias("text"), "value", "props")


FRAMES = """frames AS (
  SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, event_id, ts, event_type AS text, value, props FROM events)"""
