"""Languages of subtitle tracks and of the segments of mixed ones.

Cues are compared with rank-order profiles one by one; the distances of a track's cues are smoothed
into stretches, and stretches too short to be a segment go to the one around them. The n-grams of each
stretch are then ranked, and the profile least out of place gives its language. Tracks are worked
on in blocks that overlap, so an endless one is many groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.barrier import where_computed
from ..session import Shipped
from .profiles import Profiles, encode, trained
from .streams import whole_groups

#: Labelled tracks of each language, and first positions of each, that the profiles are made from.
TRACKS, POSITIONS = 64, 150
#: Positions per block, and how many of its neighbours' a block also sees. Stretches are decided by what
#: is near: a longest one that is too short, and the next that isn't, on both sides.
BLOCK, OVERLAP = 4096, 256
#: What a change of language costs, in distance UNITs: part of what one clear cue is worth.
SWITCH = 250
#: Out-of-place distance by which the second nearest language must be further off for a confidence of 0.73.
MARGIN = 0.03

# Writings of each language's name and its codes; regions follow after - or _.
NAMES = {
    "es": "es spa esp spanish español espanol castellano castilian espagnol spanisch spagnolo espanhol",
    "en": "en eng english inglés ingles anglais englisch inglese inglês",
    "pt": "pt por portuguese portugués portugues português portugais portugiesisch portoghese",
    "fr": "fr fra fre french francés frances français francais französisch franzosisch francese francês",
    "de": "de deu ger german alemán aleman allemand deutsch tedesco alemão alemao",
    "it": "it ita italian italiano italien italienisch italiana",
}


def language_of(label: Column) -> Column:
    """es, en, pt, fr, de or it from a code with or without region, or a name; else null."""
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in names.split() for x in (name, code)])
    plain = F.regexp_replace(F.lower(label), "^[\\s\\u00a0]+|[\\s\\u00a0]+$", "")
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.regexp_extract(plain, r"^(\p{L}+)(?:[-_ (].*)?$", 1)))


def with_speech(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: the text in lower case without mark-up, entities and sound annotations; "" if nothing is spoken."""
    t = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"<[^<>]*>|&(?:#?[a-z0-9]+);|\[[^\[\]]*\]|\([^()]*\)|\*[^*]*\*|[♪♫]", " ")
    df = df.withColumn(out, t)
    return df.withColumn(out, F.when(F.col(out).rlike(r"[\p{L}\p{N}]"), F.col(out)).otherwise(F.lit("")))


def fit(tracks: DataFrame, cues: DataFrame) -> Profiles:
    """Profiles from the labelled tracks (id, language): of each language at most TRACKS tracks, chosen by
    hash, and of each its cues at the first POSITIONS positions."""
    known = tracks.where("language is not null and id is not null").select("id", "language", F.xxhash64("id").alias("h")).distinct()
    share = {r.language: min(1.0, 4.0 * TRACKS / r.n) for r in known.groupBy("language").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Profiles({})
    limit = F.create_map(*[F.lit(x) for p in share.items() for x in p])
    thin = known.where(F.pmod("h", F.lit(1_000_003)) <= F.try_element_at(limit, F.col("language")) * 1_000_003)
    chosen = thin.withColumn("k", F.row_number().over(W.partitionBy("language").orderBy("h", "id"))).where(F.col("k") <= TRACKS).collect()
    label = {r.id: r.language for r in chosen}
    rows = cues.where(F.col("id").isin(list(label)) & (F.col("i") < POSITIONS)).select("id", "i", "speech").where("speech <> ''").distinct().collect()
    return trained(sorted((r.id, label[r.id], r.speech) for r in rows))


def smooth(cost: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The cheapest sequence of languages where a change costs `switch`."""
    n, k = cost.shape
    if k < 2:
        return np.zeros(n, int)
    back = np.empty((n, k), np.int8)
    best = cost[0].astype(float)
    back[0] = np.arange(k)
    own = np.arange(k, dtype=np.int8)
    for t in range(1, n):
        low = int(best.argmin())
        move = best[low] + switch < best
        back[t] = np.where(move, low, own)
        best = np.where(move, best[low] + switch, best) + cost[t]
    out = np.empty(n, int)
    at = int(best.argmin())
    for t in range(n - 1, -1, -1):
        out[t] = at
        at = back[t][at]
    return out


def stretches(languages: np.ndarray, least: int = 5) -> list[tuple[int, int]]:
    """(start, language) of the segments: runs of fewer than `least` go, shortest first, to the language around
    them; then those between two languages go to the run before, at the beginning to the next. Empty if nothing is long enough."""
    if len(languages) < least:
        return []
    change = np.flatnonzero(np.diff(languages)) + 1
    starts = [0, *change.tolist()]
    runs = [[a, b - a, int(languages[a])] for a, b in zip(starts, [*starts[1:], len(languages)])]
    while len(runs) > 1:
        around = lambda k: 0 < k < len(runs) - 1 and runs[k - 1][2] == runs[k + 1][2]
        short = [(not around(k), r[1], k) for k, r in enumerate(runs) if r[1] < least]
        if not short:
            break
        k = min(short)[2]
        into = k + 1 if k == 0 else k - 1
        lang = runs[into][2]
        a, b = min(k, into), max(k, into)
        runs[a : b + 1] = [[runs[a][0], runs[a][1] + runs[b][1], lang]]
        merged = [runs[0]]
        for r in runs[1:]:
            if r[2] == merged[-1][2]:
                merged[-1][1] += r[1]
            else:
                merged.append(r)
        runs = merged
    return [(a, lang) for a, _, lang in runs]


def _measure(sent):
    """Cues to their distances above the nearest language, in int16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Profiles = sent.value
        for batch in batches:
            d = model.distances(batch.column(2).to_pylist())
            d = np.minimum(d - d.min(axis=1, keepdims=True), 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(d[:, k]) for k in range(d.shape[1]))], names=["id", "i", "speech", *model.languages])

    return run


def _segment(sent, least: int, block: int):
    """Sorted blocks of cues to the segments' pieces inside each block. Where a segment begins comes from the smoothed distances of its
    cues; its language is the one whose profile is nearest to the ranks of its own n-grams, all its cues taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Profiles = sent.value
        languages = model.languages
        for rows, starts in whole_groups(batches, ["id", "b"]):
            index = rows.column("i").to_numpy()
            cost = np.stack([rows.column(x).to_numpy() for x in languages], axis=1).astype(np.int64)
            blocks = rows.column("b").to_numpy()
            symbols, begins = encode(rows.column("speech").to_pylist())
            begins = np.append(begins, len(symbols))
            ids = rows.column("id")
            ends = [*starts[1:].tolist(), len(index)]
            out: list[tuple] = []
            # Tracks in one language are seen from sums over all groups at once: no window of `least` cues
            # is nearer to another language than to the group's.
            total = np.add.reduceat(cost, starts, axis=0)
            best = total.argmin(axis=1)
            group = np.repeat(np.arange(len(starts)), np.diff([*starts.tolist(), len(index)]))
            gain = cost[np.arange(len(index)), best[group]][:, None] - cost
            run_sum = np.concatenate([np.zeros((1, len(languages)), np.int64), np.cumsum(gain, axis=0)])
            mixed = np.zeros(len(starts), bool)
            if len(index) >= 2:
                window = run_sum[2:] - run_sum[:-2]
                inside = group[1:] == group[:-1]
                mixed[np.unique(group[:-1][inside & (window.max(axis=1) > 0)])] = True
            for g, (a, b) in enumerate(zip(starts.tolist(), ends)):
                i = index[a:b]
                new = np.ones(len(i), bool)
                new[1:] = i[1:] != i[:-1]
                at = a + np.flatnonzero(new)
                i, c = i[new], cost[a:b][new]
                found = stretches(smooth(c), least) if mixed[g] else ([(0, int(best[g]))] if len(i) >= least else [])
                own = blocks[a]
                name = ids[a].as_py()
                for k, (s, lang) in enumerate(found):
                    e = found[k + 1][0] if k + 1 < len(found) else len(i)
                    core = np.flatnonzero(i[s:e] // block == own)
                    if len(core):
                        # The whole stretch, its rows of neighbouring blocks included, is ranked.
                        far = model.ranked_distance(symbols[begins[at[s]] : begins[at[e - 1] + 1]])
                        out.append((name, int(i[s:e][core[0]]), int(i[s:e][core[-1]]), languages[lang], len(core), (far * len(core)).tolist()))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["id", "i0", "i1", "stretch", "n", "far"])

    return run


def segments(cues: DataFrame, model: Profiles, least: int = 5, block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """(id, first_cue, last_cue, language, n_cues, confidence) of the segments of all tracks; cues: (id, i, speech).

    confidence grows from 0.5 to 1 with the out-of-place distance by which the second nearest language is
    further off. A cue delivered twice counts once.
    """
    spark = cues.sparkSession
    if not model.languages:
        return spark.createDataFrame([], "id string, first_cue bigint, last_cue bigint, language string, n_cues bigint, confidence double")
    names = model.languages
    sent = Shipped(spark, model)
    measured = cues.mapInArrow(_measure(sent), "id string, i bigint, speech string, " + ", ".join(f"{x} smallint" for x in names))
    own, at = F.floor(F.col("i") / F.lit(block)), F.pmod("i", F.lit(block))
    seen = F.array_compact(F.array(own, F.when((at < overlap) & (own > 0), own - 1), F.when(at >= block - overlap, own + 1)))
    blocks = measured.withColumn("b", F.explode(seen)).repartition("id", "b").sortWithinPartitions("id", "b", "i")
    pieces = blocks.mapInArrow(_segment(sent, least, block), "id string, i0 bigint, i1 bigint, stretch string, n bigint, far array<double>")
    order = W.partitionBy("id").orderBy("i0")
    number = lambda df, c: df.withColumn("new", F.when(F.lag(c).over(order) == F.col(c), 0).otherwise(1)).withColumn("s", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    sums = [F.sum(F.col("far")[k]).alias(x) for k, x in enumerate(names)]
    ends = [F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.sum("n").alias("n")]
    whole = number(pieces, "stretch").groupBy("id", "s").agg(*ends, *sums)
    ranks = F.array_sort(F.array(*[F.struct((F.col(x) / F.col("n")).alias("far"), F.lit(x).alias("language")) for x in names]))
    whole = whole.withColumn("ranks", ranks).withColumn("language", F.col("ranks")[0]["language"])
    # Neighbours that turn out to be of one language are one segment.
    margin = (F.col("ranks")[1]["far"] - F.col("ranks")[0]["far"]) if len(names) > 1 else F.lit(1.0)
    whole = number(whole.withColumn("margin", margin * F.col("n")), "language").groupBy("id", "s", "language").agg(F.min("i0").alias("first_cue"), F.max("i1").alias("last_cue"), F.sum("n").alias("n_cues"), F.sum("margin").alias("margin"))
    return whole.select("id", "first_cue", "last_cue", "language", "n_cues", (1 / (1 + F.exp(-F.col("margin") / F.col("n_cues") / F.lit(MARGIN)))).alias("confidence"))


def track_languages(subtitles: DataFrame, cues: DataFrame, *, model: Profiles | None = None, least: int = 5) -> DataFrame:
    """One row per segment of each track of subtitles: video_id, first_cue, last_cue, language, confidence,
    n_cues, n_segments, label (null where it names no language), source_label, is_translation, and label_is: right, missing or
    wrong (of a mixed track: whether it names the language of most cues).

    subtitles (video_id, language, source_language, is_translation): of rows repeated for a video a label that names a language counts
    before none, and of several the smallest. cues (video_id, cue_index, text). Null keys are left
    out; tracks with fewer than `least` spoken cues have no segment and no row; empty tables give an empty
    result. Other columns are ignored.
    """
    label = subtitles.where("video_id is not null").groupBy(F.col("video_id").alias("id")).agg(F.min(language_of(F.col("language"))).alias("label"), F.min(language_of(F.col("source_language"))).alias("source_label"), F.max("is_translation").alias("is_translation"))
    rows = cues.select(F.col("video_id").alias("id"), F.col("cue_index").cast("bigint").alias("i"), F.col("text")).where("id is not null and i is not null")
    rows = with_speech(rows, "text", "speech").drop("text")
    model = model or fit(label.select("id", F.col("label").alias("language")), rows)
    found = segments(where_computed(rows, F.col("speech") != ""), model, least)
    each = W.partitionBy("id")
    out = found.join(label, "id").withColumn("n_segments", F.count("*").over(each)).withColumn("main", F.max(F.struct("n_cues", "language")).over(each)["language"])
    state = F.when(F.col("label").isNull(), "missing").when(F.col("label") == F.col("main"), "right").otherwise("wrong")
    return out.select(F.col("id").alias("video_id"), "first_cue", "last_cue", "language", "confidence", "n_cues", "n_segments", "label", "source_label", "is_translation", state.alias("label_is"))
