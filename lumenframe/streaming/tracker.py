"""Tracks of text through frames: association by overlap and text, birth, death and reconnection, in batch and as a stream.

One state machine serves both forms. Its state is bounded: a track that was not seen for GAP frames is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LEAST_IOU = 0.10
LEAST_SCORE = 0.34
#: Under this likeness of texts a track ends and another begins.
SPLIT = 0.6
#: Frames that a track may be hidden.
GAP = 15
#: Frames without a sight after which an active track is dormant.
MISSES = 2
#: Sights that confirm a track.
BIRTH = 2


def box_iou(a, b) -> float:
    wide = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    high = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    return wide * high / (a[2] * a[3] + b[2] * b[3] - wide * high)


def likeness(a: str | None, b: str | None) -> float:
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    return SequenceMatcher(None, a, b).ratio() if a and b else float(a == b)


class Tracker:
    """The tracks of one shot. ``tracks`` maps a number to [box, text, last frame, misses, sights]."""

    def __init__(self, next_track: int = 0, last_frame: int | None = None, tracks: dict[int, list] | None = None):
        self.next_track, self.last_frame, self.tracks = next_track, last_frame, tracks or {}

    @classmethod
    def load(cls, text: str) -> Tracker:
        n, last, held = json.loads(text)
        return cls(n, last, {int(k): v for k, v in held})

    def dump(self) -> str:
        return json.dumps([self.next_track, self.last_frame, list(self.tracks.items())])

    def step(self, frame: int, seen: list[tuple[tuple, str | None]]) -> list[tuple[int, int, bool]]:
        """(track, sights so far, continued) of each observation of a frame; frames have to come in order.

        Pairs are taken by falling score, then track, then observation. A pair whose texts differ too much ends its
        track: the observation begins a new one.
        """
        for k in [k for k, t in self.tracks.items() if frame - t[2] > GAP]:
            del self.tracks[k]
        pairs = []
        for i, (box, text) in enumerate(seen):
            for k, t in self.tracks.items():
                over = box_iou(t[0], box)
                if over >= LEAST_IOU:
                    same = likeness(t[1], text)
                    score = 0.65 * over + 0.35 * same
                    if score >= LEAST_SCORE:
                        # active tracks come before dormant ones
                        pairs.append((t[3] >= MISSES, -score, k, i, same))
        given: dict[int, int] = {}
        used, ended = set(), set()
        for _, _, k, i, same in sorted(pairs):
            if k in used or i in given:
                continue
            used.add(k)
            if same < SPLIT:
                ended.add(k)
                given[i] = -1
            else:
                given[i] = k
        for k in ended:
            del self.tracks[k]
        for k, t in self.tracks.items():
            if k not in used:
                t[3] += 1
        out = []
        for i, (box, text) in enumerate(seen):
            k = given.get(i, -1)
            known = k >= 0
            if not known:
                k, self.next_track = self.next_track, self.next_track + 1
            sights = self.tracks[k][4] + 1 if known else 1
            self.tracks[k] = [list(box), text, frame, 0, sights]
            out.append((k, sights, known))
        self.last_frame = frame
        return out

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows (frame, id, x, y, w, h, text) in any order, with track, sights and confirmed. Frames not later than the last one are late and left out."""
        rows = rows.sort_values(["frame", "id"], kind="stable")
        if self.last_frame is not None:
            rows = rows[rows["frame"] > self.last_frame]
        tracks, sights = [], []
        for frame, own in rows.groupby("frame", sort=True):
            boxes = list(zip(own.x.tolist(), own.y.tolist(), own.w.tolist(), own.h.tolist()))
            for k, n, _ in self.step(int(frame), list(zip(boxes, own.text.tolist()))):
                tracks.append(k)
                sights.append(n)
        return rows.assign(track=pd.Series(tracks, rows.index, "int64"), sights=pd.Series(sights, rows.index, "int64"), confirmed=pd.Series([n >= BIRTH for n in sights], rows.index, bool))


_COLUMNS = ["frame", "id", "x", "y", "w", "h", "text"]


def _result(df: DataFrame, by: list[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in [*by, "frame", "id"]] + [T.StructField("track", T.LongType()), T.StructField("sights", T.LongType()), T.StructField("confirmed", T.BooleanType())])


def track(observations: DataFrame, by: tuple[str, ...] = ("asset", "shot")) -> DataFrame:
    """Every observation with its track of the shot, and how often that was seen so far; those without a frame are left out.

    Shots run apart, in one pass over rows in order of shot and frame: memory is for one batch and the live tracks.
    """
    columns, out = [*by, *_COLUMNS], _result(observations, list(by))
    ordered = observations.where("frame IS NOT NULL").select(*columns).repartition(*by).sortWithinPartitions(*by, "frame", "id")

    def run(batches):
        kinds, n = to_arrow_schema(out), len(by)
        tracker, shot, held = Tracker(), None, []

        def settle(done):
            # a frame is complete once a row of another comes
            if held:
                found = tracker.step(held[0][n], [(r[n + 2 : n + 6], r[n + 6]) for r in held])
                done += [(*r[: n + 2], k, sights, sights >= BIRTH) for r, (k, sights, _) in zip(held, found)]
                held.clear()

        def table(done):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kinds)], schema=kinds)

        for batch in batches:
            done: list[tuple] = []
            for r in zip(*(batch.column(c).to_pylist() for c in columns)):
                if held and r[: n + 1] != held[0][: n + 1]:
                    settle(done)
                if r[:n] != shot:
                    shot, tracker = r[:n], Tracker()
                held.append(r)
            if done:
                yield table(done)
        done = []
        settle(done)
        if done:
            yield table(done)

    return ordered.mapInArrow(run, out)


def track_stream(stream: DataFrame, by: tuple[str, ...] = ("asset", "shot")) -> DataFrame:
    """The same over micro-batches with the shot's state kept by the engine: a shot of any length needs memory for its live tracks and one batch."""
    names = [*by, "frame", "id", "track", "sights", "confirmed"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker = Tracker.load(state.get[0]) if state.exists else Tracker()
        out = tracker.feed(pd.concat(list(batches)))
        state.update((tracker.dump(),))
        yield out[names]

    return stream.select(*by, *_COLUMNS).groupBy(*by).applyInPandasWithState(run, _result(stream, list(by)), "state string", "append", "NoTimeout")
