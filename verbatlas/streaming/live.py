"""Live cues: new words and gap sessions of a stream, as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.captions import Overlap


def new_words(cues: DataFrame) -> DataFrame:
    """(video_id, cue_index, second, text): the streaming form of captions.without_overlap. Each batch's cues of a
    video are taken in order of cue_index; the state holds the last words said, and no more."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = Overlap()
        if state.exists:
            said, at = state.get
            last.said, last.at = list(said), at
        f = pd.concat(list(frames)).dropna().sort_values("cue_index")
        text = [last.new_words(int(s), t) for s, t in zip(f["second"], f["text"])]
        if last.at is not None:
            state.update((last.said, last.at))
        f = f.assign(text=text)
        yield f[f["text"] != ""][["video_id", "cue_index", "second", "text"]]

    out = "video_id string, cue_index bigint, second bigint, text string"
    rows = cues.select("video_id", F.col("cue_index").cast("bigint").alias("cue_index"), F.col("second").cast("bigint").alias("second"), "text")
    return rows.groupBy("video_id").applyInPandasWithState(step, out, "said array<string>, at bigint", "append", GroupStateTimeout.NoTimeout)


def sessions(rows: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    """(keys, start, end, n): rows of a key no further apart than gap; a session is given out once `late` has passed."""
    window = F.session_window(at, gap)
    df = rows.withWatermark(at, late).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"))
    return df.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
