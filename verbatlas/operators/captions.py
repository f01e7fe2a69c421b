"""Caption cues: rolling overlap, chunks by time, transcript lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timecode import code
from .fold import BLOCK, Machine, fold

#: Words that a repetition is looked for in, and the pause in seconds that ends all repetition.
MEMORY, PAUSE = 80, 15

EDGE_MARKS = '.,;:!?¿¡()[]{}"'


class Overlap(Machine):
    """What was last said in a video, to tell new words of a rolling caption from those shown again."""

    def __init__(self) -> None:
        self.said: list[str] = []
        self.at: int | None = None
        self.last: int | None = None

    def new_words(self, second: int, text: str) -> str:
        """The part of text that isn't a repetition; empty if all of it is."""
        words = text.split()
        if not words:
            return ""
        if self.at is None or second - self.at > PAUSE:
            self.said = []
        self.at = second
        heard = [w.lower().strip(EDGE_MARKS) for w in words]
        n = len(heard)
        if n <= len(self.said) and self.said[-n:] == heard:
            return ""
        shared = next((k for k in range(min(n, len(self.said)), 0, -1) if self.said[-k:] == heard[:k]), 0)
        self.said = (self.said + heard[shared:])[-MEMORY:]
        return " ".join(words[shared:])

    def feed(self, row: tuple) -> list[tuple]:
        index, second, text = row
        if index == self.last:
            return []
        self.last = index
        new = self.new_words(second, text)
        return [(index, second, new)] if new else []

    def state(self) -> str:
        return json.dumps([self.said, self.at])

    def resume(self, state: str) -> None:
        self.said, self.at = json.loads(state)


def readable(cues: DataFrame) -> DataFrame:
    """cues (video_id, cue_index, second, text) without rows that lack one of these."""
    rows = cues.select("video_id", F.col("cue_index").cast("bigint").alias("cue_index"), F.col("second").cast("bigint").alias("second"), "text")
    return rows.where("video_id is not null and cue_index is not null and second is not null and text is not null")


def without_overlap(cues: DataFrame, block: int = BLOCK) -> DataFrame:
    """(video_id, cue_index, second, text): cues reduced to their new words, those without any left out.

    cues: (video_id, cue_index, second, text). Rows without key, second or text are left out; of a cue
    delivered twice the first by (second, text) counts. A pause of more than 15 s clears what was said. The
    size of blocks changes nothing.
    """
    return fold(readable(cues), "video_id", "cue_index", ["cue_index", "second", "text"], Overlap, "cue_index bigint, second bigint, text string", block)


def chunks(cues: DataFrame, keys: list[str], order: str, second: str, text: str, minutes: int = 5) -> DataFrame:
    """(keys, chunk, start, end, n, text): runs of cues in the same stretch of minutes; a time that jumps back opens a new chunk."""
    size = minutes * 60
    w = W.partitionBy(*keys).orderBy(order)
    rows = cues.withColumn("bucket", F.floor(F.col(second) / size) * size)
    rows = rows.withColumn("chunk", F.sum(F.when(F.lag("bucket").over(w) == F.col("bucket"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    out = rows.groupBy(*keys, "chunk", "bucket").agg(F.count("*").alias("n"), joined.alias("text"))
    return out.select(*keys, F.col("chunk").cast("bigint"), code(F.col("bucket")).alias("start"), code(F.col("bucket") + size).alias("end"), "n", "text")


def transcript_lines(cues: DataFrame, with_time: bool = True) -> DataFrame:
    """(video_id, cue_index, line)."""
    line = F.concat(F.lit("["), code(F.col("second")), F.lit("] "), F.col("text")) if with_time else F.col("text")
    return cues.select("video_id", "cue_index", line.alias("line"))


def sessions(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """(keys, session, n, first, last): rows of a key no more than `gap` seconds apart in order of time."""
    w = W.partitionBy(*keys).orderBy(at)
    rows = rows.withColumn("session", F.sum(F.when(F.unix_seconds(F.col(at)) - F.unix_seconds(F.lag(at).over(w)) <= gap, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "session").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
