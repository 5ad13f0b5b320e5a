"""A reading session: gestures move a reader through an edition, as a stateful stream per device."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import selection
from folioflow.session import shared_folder, table
from folioflow.streaming.gestures import OUT, gesture_stream, touches_of_events

MOVES = "device string, at_ms bigint, mode string, story int, page int, marked boolean"
STATE = "mode string, at int, page int, armed boolean, read array<int>"


class Session:
    """Home, an article, or the end of the news. ``pages`` has the page count of each story in reading order."""

    def __init__(self, pages: list[int], mode: str = "home", at: int = 0, page: int = 0, armed: bool = False, read: tuple[int, ...] = ()):
        self.pages, self.mode, self.at, self.page, self.armed, self.read = pages, mode, at, page, armed, set(read)

    def _unread(self, start: int) -> bool:
        """Open the first unread story from ``start`` on, or come to the end."""
        for k in range(start, len(self.pages)):
            if k not in self.read:
                return self._open(k)
        self.mode = "finished"
        return True

    def _open(self, start: int) -> bool:
        """Open a story and mark it read; stories whose pages can't be loaded are passed over unmarked."""
        for k in range(start, len(self.pages)):
            if self.pages[k] > 0:
                self.mode, self.at, self.page = "article", k, 0
                self.read.add(k)
                return True
        self.mode = "finished"
        return True

    def _mark_all(self) -> bool:
        """Two taps on the home page mark everything read."""
        if self.armed:
            self.read.update(range(len(self.pages)))
        self.armed = not self.armed
        return True

    def _back(self) -> bool:
        return self.at > 0 and self._open(self.at - 1)

    def _turn(self, step: int) -> bool:
        if not 0 <= self.page + step < self.pages[self.at]:
            return False
        self.page += step
        return True

    def act(self, gesture: str) -> bool:
        """Whether the gesture changed what is shown."""
        if gesture == "long-press":
            moved = self.mode != "home"
            self.mode, self.armed = "home", False
            return moved
        if self.mode == "article":
            moves = {"swipe-right": lambda: self._unread(self.at + 1), "swipe-left": self._back, "swipe-down": lambda: self._turn(1), "swipe-up": lambda: self._turn(-1)}
            return moves.get(gesture, lambda: False)()
        if self.mode == "finished":
            return gesture == "swipe-left" and self._back()
        if gesture == "tap":
            return self._mark_all()
        disarmed, self.armed = self.armed, False
        return self._unread(0) if gesture == "swipe-right" else disarmed


def session_stream(gestures: DataFrame, pages: list[int]) -> DataFrame:
    """What each gesture of a device showed; the state of a device is its place and the stories of this edition it has read."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = Session(pages, *state.get) if state.exists else Session(pages)
        rows = []
        for g in pd.concat(batches).sort_values("at_ms", kind="stable").itertuples():
            before = len(s.read)
            if s.act(g.gesture):
                rows.append((key[0], int(g.at_ms), s.mode, s.at if s.mode == "article" else -1, s.page if s.mode == "article" else -1, len(s.read) > before))
        state.update((s.mode, s.at, s.page, s.armed, sorted(s.read)))
        yield pd.DataFrame(rows, columns=["device", "at_ms", "mode", "story", "page", "marked"])

    return gestures.groupBy("device").applyInPandasWithState(step, MOVES, STATE, "append", "NoTimeout")


def reader_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all devices over the edition, from the gestures of their touches."""
    order = selection.reading_order(selection.edition(spark, sf_dir)).select("reading_pos", "item_id")
    size = table(spark, sf_dir, "items").select("item_id", F.ceil(F.coalesce("text_bytes", F.lit(0)) / 800).cast("int").alias("pages"))
    pages = [r.pages for r in order.join(size, "item_id").orderBy("reading_pos").collect()]  # the stories of one edition
    folder = shared_folder(spark, "sessions")
    touches_of_events(spark, sf_dir).write.parquet(f"{folder}/touches")
    schema = spark.read.parquet(f"{folder}/touches").schema

    def run(stream: DataFrame, name: str) -> None:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-log").trigger(availableNow=True).start()
        query.awaitTermination()

    run(gesture_stream(spark.readStream.schema(schema).parquet(f"{folder}/touches")), "gestures")
    run(session_stream(spark.readStream.schema(OUT).parquet(f"{folder}/gestures"), pages), "moves")
    return spark.read.schema(MOVES).parquet(f"{folder}/moves")


QUERIES = {"reader_replay": (reader_replay, None)}
