"""Ideas and section summaries: the units and sentences that say most, without repetition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.plain import NEAR, profile, shared
from ..functions.plain import distinct as distinct_texts
from ..session import cut
from .captions import chunks
from .keywords import keywords
from .units import UNIT, windows


def weighed(texts: DataFrame, keys: list[str], at: list[str], words: DataFrame) -> DataFrame:
    """texts with weight: the counts of the key's keywords (keys, term, n) among each text's content tokens."""
    tokens = texts.select(*keys, *at, F.explode(T.content_tokens(F.col("text"))).alias("term")).join(words.select(*keys, "term", "n"), [*keys, "term"])
    return texts.join(tokens.groupBy(*keys, *at).agg(F.sum("n").alias("weight")), [*keys, *at], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def ideas(units: DataFrame, limit: int = 12, first: int = 128) -> DataFrame:
    """(video_id, rank, position, part, second, text, fragments): at most `limit` windows a video, best scores first
    unless nearly the same as one chosen before; rank is by place in the video. units: informative ones. The `first` best windows of a
    video are looked at first, more where these hold fewer than `limit` different ones."""
    ordered = units.withColumn("o", F.struct("position", "part"))
    words = keywords(ordered, ["video_id"], "text", 25, order="o")
    packed = weighed(windows(units), ["video_id"], ["position", "part"], words)
    packed = packed.withColumn("score", T.text_score(F.col("text"), F.col("weight"), F.col("position"))).drop("weight")

    best = W.partitionBy("video_id").orderBy(F.desc("score"), "position", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, []
        for batch in batches:
            kept = []
            for video, text in zip(batch.column("video_id").to_pylist(), batch.column("text").to_pylist()):
                if video != now:
                    now, seen = video, []
                own = len(seen) < limit and profile(text)
                kept.append(bool(own) and all(shared(own, p) < NEAR for p in seen))
                if kept[-1]:
                    seen.append(own)
            yield batch.filter(pa.array(kept, pa.bool_()))

    # The best windows of a video are enough, unless many of them say the same: such a video asks for more.
    chosen, upto = None, first
    while True:
        few = cut(packed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= upto))
        placed = few.select("video_id", "r", "position", "part", "second", "text", "fragments").repartition("video_id").sortWithinPartitions("video_id", "r")
        got = cut(placed.mapInArrow(run, f"video_id string, r int, {UNIT}"))
        enough = got.groupBy("video_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("video_id")
        more = few.where(F.col("r") == upto).select("video_id")
        asking = cut(more.join(enough, "video_id", "left_anti"))
        done = got.drop("r")
        if asking.isEmpty():
            chosen = done if chosen is None else chosen.unionByName(done)
            break
        done = done.join(asking, "video_id", "left_anti")
        chosen = done if chosen is None else chosen.unionByName(done)
        packed, upto = packed.join(asking, "video_id", "left_semi"), upto * 16
    return chosen.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy("position", "part")))


def best_sentences(texts: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """(keys, sentences): of each text its `limit` best sentences in order; of a text without a sentence its first 240 characters."""
    words = keywords(texts, keys, "text", 20)

    @F.pandas_udf("array<string>")
    def distinct(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: [x[k] for k in distinct_texts(list(x))])

    listed = texts.select(*keys, distinct(T.sentences(F.col("text"))).alias("s"))
    each = listed.select(*keys, F.posexplode("s").alias("pos", "text"))
    each = weighed(each, keys, ["pos"], words).withColumn("score", T.text_score(F.col("text"), F.col("weight"), F.col("pos")))
    each = each.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "pos"))).where(F.col("r") <= limit)
    best = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("sentences"))
    start = F.trim(F.substring("text", 1, 240))
    excerpt = F.when(start == "", F.array().cast("array<string>")).otherwise(F.array(F.when(F.char_length("text") > 240, F.concat(start, F.lit("..."))).otherwise(start)))
    return texts.join(best, keys, "left").select(*keys, F.coalesce("sentences", excerpt).alias("sentences"))


def sections(units: DataFrame, minutes: int = 5) -> DataFrame:
    """(video_id, chunk, start, end, topic, sentences): five keywords and at most three sentences of each stretch."""
    rows = units.withColumn("o", F.struct("position", "part"))
    parts = chunks(rows, ["video_id"], "o", "second", "text", minutes)
    keys = ["video_id", "chunk"]
    topic = keywords(parts, keys, "text", 8).where("rank <= 5").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("topic"))
    out = parts.join(topic, keys, "left").join(best_sentences(parts.select(*keys, "text"), keys), keys)
    return out.select(*keys, "start", "end", F.coalesce("topic", F.lit("")).alias("topic"), "sentences")
