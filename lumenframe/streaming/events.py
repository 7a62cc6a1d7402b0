"""Streaming operators on events (ts, key, value): rate windows, sessions, consensus votes, a tracker and a chunk sink.

Each has a batch form with the same rows, which tests hold the stream against.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 900
TOP = 8


def micros(ts: str):
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def rate_window(events: DataFrame, key: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Each event with the number of its caller's events in the window that ends with it."""
    span = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(span))


def sessions(events: DataFrame, key: str, gap: int = GAP_SECONDS, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """(key, start, last, n): runs of events less than ``gap`` seconds apart. For streams give a watermark."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    out = rows.groupBy(key, F.session_window(ts, f"{gap} seconds").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    return out.select(key, F.col("s.start").alias("start"), "last", "n")


def chunks(events: DataFrame, every: str, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """(start, n): tumbling windows."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    return rows.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def consensus(observations: DataFrame, track: str = "track", text: str = "text", conf: str = "conf", sharpness: str = "sharpness") -> DataFrame:
    """Exact vote: each track's text with the largest sum of confidence times clamped sharpness, and its share."""
    weight = F.col(conf) * F.least(F.greatest(F.col(sharpness) / 100, F.lit(0.25)), F.lit(2.0))
    votes = observations.groupBy(track, F.lower(text).alias("key")).agg(F.sum(weight).alias("mass"), F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(track)
    place = F.row_number().over(Window.partitionBy(track).orderBy(F.desc("mass"), F.asc("key")))
    ranked = votes.withColumns({"total": F.sum("mass").over(total), "__r": place}).where("__r = 1")
    return ranked.select(track, "key", "mass", "n", F.when(F.col("total") > 0, F.col("mass") / F.col("total")).alias("share"))


class BoundedVote:
    """A vote that holds at most TOP texts: the lightest goes when a new one comes, its mass stays in the total."""

    def __init__(self, held: dict[str, float] | None = None, evicted: float = 0.0):
        self.held, self.evicted = held or {}, evicted

    def add(self, key: str, mass: float) -> None:
        self.held[key] = self.held.get(key, 0.0) + mass
        if len(self.held) > TOP:
            least = min(self.held, key=lambda k: (self.held[k], k))
            self.evicted += self.held.pop(least)

    def best(self) -> tuple[str, float]:
        total = sum(self.held.values()) + self.evicted
        key = min(self.held, key=lambda k: (-self.held[k], k))
        return key, self.held[key] / total if total else 0.0


def bounded_consensus(stream: DataFrame, track: str = "track") -> DataFrame:
    """Streaming form with a state of TOP texts a track: (track, key, share) after each batch. Rows need track, key, mass and seq."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, masses, evicted = state.get if state.exists else ([], [], 0.0)
        vote = BoundedVote(dict(zip(held, masses)), evicted)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for key, mass in zip(rows["key"], rows["mass"]):
            vote.add(key, float(mass))
        state.update((list(vote.held), list(vote.held.values()), vote.evicted))
        best, share = vote.best()
        yield pd.DataFrame({track: [k[0]], "key": [best], "share": [share]})

    kind = stream.schema[track].dataType.simpleString()
    return stream.groupBy(track).applyInPandasWithState(step, f"{track} {kind}, key string, share double", "held array<string>, masses array<double>, evicted double", "update", "NoTimeout")


def split_runs(events: DataFrame, key: str, text: str, *order) -> DataFrame:
    """Numbered runs of equal text of a key, in order: a change of text ends a run."""
    span = Window.partitionBy(key).orderBy(*order)
    new = ~F.col(text).eqNullSafe(F.lag(text).over(span)) | (F.row_number().over(span) == 1)
    return events.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(span.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def settle(tracks: DataFrame, least: int = 2) -> DataFrame:
    """Finished tracks: dropped under ``least`` observations, review on low confidence or share."""
    status = F.when(F.coalesce("excluded", F.lit(False)), "excluded").when((F.col("conf") < 0.7) | (F.col("share") < 1), "review").otherwise("ok")
    return tracks.where((F.col("n") >= least) | F.coalesce("excluded", F.lit(False))).withColumn("status", status)


def commit_chunks(stream: DataFrame, path: str, checkpoint: str, name: str = "batch"):
    """Start a query that writes every micro-batch to a folder of its own number, so that a replayed batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{name}={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
