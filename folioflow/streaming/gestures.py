"""Touches of devices to gestures, as a stateful stream.

Samples of a device are cut into stretches of contact and of none. A stretch of contact is one touch, whose start, last place and longest way
are taken over all its samples at once; its gesture follows from these by one expression. Between batches only the
touch that is still going on is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import shared_folder, table

# Pixels of a swipe and of a finger held still; milliseconds of a press, of the longest swipe, and between two touches.
SWIPE_PX, SLOP_PX, PRESS_MS, SWIPE_MS, DEBOUNCE_MS = 44, 18, 650, 900, 120
OUT = "device string, at_ms bigint, gesture string, x int, y int"
STATE = "going boolean, since bigint, x int, y int, to_x int, to_y int, way int, pressed boolean, free_from bigint"
DIRECTIONS = {(True, False): "swipe-right", (True, True): "swipe-left", (False, False): "swipe-down", (False, True): "swipe-up"}


class Touch(NamedTuple):
    """A touch so far: when and where it began, where it is, its longest way from there, and whether it was a press already."""

    since: int
    x: int
    y: int
    to_x: int
    to_y: int
    way: int = 0
    pressed: bool = False


def seen_until(touch: Touch | None, free_from: int, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[Touch | None, int | None]:
    """The touch after more samples of one stretch of contact, and when it became a press, if it did now; samples before ``free_from`` begin none."""
    if touch is None:
        k = int(np.searchsorted(t, free_from))
        if k == len(t):
            return None, None
        touch = Touch(int(t[k]), int(x[k]), int(y[k]), int(x[k]), int(y[k]))
        t, x, y = t[k + 1 :], x[k + 1 :], y[k + 1 :]
    if len(t) == 0:
        return touch, None
    way = np.maximum(np.maximum.accumulate(abs(x - touch.x) + abs(y - touch.y)), touch.way)
    still = np.flatnonzero((way <= SLOP_PX) & (t - touch.since >= PRESS_MS))
    now = int(t[still[0]]) if len(still) and not touch.pressed else None
    return touch._replace(to_x=int(x[-1]), to_y=int(y[-1]), way=int(way[-1]), pressed=touch.pressed or now is not None), now


def gesture_of(touch: Touch, ended: int) -> str | None:
    """What a touch that ended was: a tap where it led nowhere, a swipe where it was quick; a press was told before, a slow drag is nothing."""
    dx, dy = touch.to_x - touch.x, touch.to_y - touch.y
    far = max(abs(dx), abs(dy))
    if touch.pressed or far > SWIPE_PX and ended - touch.since > SWIPE_MS:
        return None
    sideways = abs(dx) > abs(dy)
    return "tap" if far < SWIPE_PX else DIRECTIONS[sideways, (dx if sideways else dy) < 0]


def recognise(device: str, samples: pd.DataFrame, touch: Touch | None = None, free_from: int = -(2**62)) -> tuple[list[tuple], Touch | None, int]:
    """(gestures, touch still going on, when the next may begin) of one device's samples; samples with nulls are passed over."""
    rows = samples.dropna().sort_values("ts_ms", kind="stable")
    t, x, y, on = (rows[c].to_numpy(kind) for c, kind in (("ts_ms", np.int64), ("x", np.int64), ("y", np.int64), ("touching", bool)))
    found = []
    bounds = [0, *(np.flatnonzero(on[1:] != on[:-1]) + 1).tolist(), len(t)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        if on[a]:
            touch, pressed_at = seen_until(touch, free_from, t[a:b], x[a:b], y[a:b])
            told = [(pressed_at, "long-press")] if pressed_at is not None else []
        else:
            told = [(int(t[a]), g)] if touch and (g := gesture_of(touch, int(t[a]))) else []
            free_from = int(t[a]) + DEBOUNCE_MS if touch else free_from
        found += [(device, at, gesture, touch.x, touch.y) for at, gesture in told]
        if not on[a]:
            touch = None
    return found, touch, free_from


def gesture_stream(touches: DataFrame) -> DataFrame:
    """Gestures of a stream of (device, ts_ms, touching, x, y); the touch in progress is the state of a device."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        going, *kept, free_from = state.get if state.exists else (False, -(2**62))
        # what came of one device in one micro-batch, which the stream's trigger bounds: order needs all of it
        found, touch, free_from = recognise(key[0], pd.concat(batches), Touch(*kept) if going else None, free_from)
        state.update((touch is not None, *(touch or Touch(0, 0, 0, 0, 0)), free_from))
        yield pd.DataFrame(found, columns=["device", "at_ms", "gesture", "x", "y"])

    return touches.groupBy("device").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def touches_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples per event, as if its user had touched a screen: down, moved, released."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("device"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id")
    dx, dy, held = (F.col("event_id") % 5 - 2) * 40, (F.col("event_id") % 3 - 1) * 50, (F.col("event_id") % 4) * 300 + 50
    sample = lambda at, touching, x, y: F.struct((F.col("ms") + at).alias("ts_ms"), F.lit(touching).alias("touching"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    middle = F.lit(300)
    return e.select("device", F.inline(F.array(sample(F.lit(0), True, middle, middle), sample(held - 1, True, middle + dx, middle + dy), sample(held, False, middle, middle))))


def gesture_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gestures of the touches of all events, recognised by the stream."""
    folder = shared_folder(spark, "gestures")
    touches_of_events(spark, sf_dir).write.parquet(f"{folder}/touches")
    schema = spark.read.parquet(f"{folder}/touches").schema
    found = gesture_stream(spark.readStream.schema(schema).parquet(f"{folder}/touches"))
    query = found.writeStream.format("parquet").option("path", f"{folder}/found").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/found")


GESTURE_SQL = """
with e as (select user_id::varchar as device, epoch_us(ts) // 1000 as ms, (event_id % 5 - 2) * 40 as dx, (event_id % 3 - 1) * 50 as dy, (event_id % 4) * 300 + 50 as held from events),
g as (select *, case when abs(dx) + abs(dy) <= 18 and held - 1 >= 650 then 'long-press'
  when greatest(abs(dx), abs(dy)) > 44 and held > 900 then null when greatest(abs(dx), abs(dy)) < 44 then 'tap'
  when abs(dx) > abs(dy) then case when dx < 0 then 'swipe-left' else 'swipe-right' end else case when dy < 0 then 'swipe-up' else 'swipe-down' end end as gesture from e)
select device, (ms + case when gesture = 'long-press' then held - 1 else held end)::bigint as at_ms, gesture, 300 as x, 300 as y from g where gesture is not null"""

QUERIES = {"gesture_replay": (gesture_replay, GESTURE_SQL)}
