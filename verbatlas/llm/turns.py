"""Captions of conversations to ordered speaker turns.

A turn is a segment of cues of one speaker. A semi-Markov conditional model scores whole segmentations:
a segment earns what the labels at its start and inside it say for its speaker, what a bare change mark
says for a change, and pays or earns for its boundary by the pause before it and by whether the text
runs on across it. All of these are sums over the places in a segment where a boundary can be, so the
best segmentation is found by a recursion over these places alone. The weights are learnt by a
structured perceptron on a bounded sample of videos whose labels are spelt as in the table of speakers.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Shipped, bounded_rows, cut
from .streams import whole_groups

#: Positions per block: a block is decoded for every speaker that may be speaking at its start.
BLOCK = 4096
#: The sample that the weights are learnt from: this many videos, and of each the first positions.
VIDEOS, POSITIONS = 300, 300
#: Speakers that the table may hold.
MOST_SPEAKERS = 5000

# Words that fill a pause, followed by a comma, in the languages of the captions.
FILLERS = (
    "eh este esto mmm mm hmm o sea a ver bueno|um uh erm er like you know well i mean|é né tipo então pois|euh ben bah voilà du coup hein|"
    "äh ähm öhm halt also nun ja naja|ehm cioè allora beh insomma diciamo"
)
FILLER_PHRASES = ("o sea", "a ver", "you know", "i mean", "du coup", "nun ja")

MARK = re.compile(r"(?:\s|<(?!v[ .])[^<>]*>|[♪♫])*(?:>>+|[-–—](?=\s|[^\W\d_]))\s*")
VOICE = re.compile(r"<v(?:\.[^\s<>]*)?\s+([^<>]+)>")
BRACKET = re.compile(r"[\[(]\s*([^\W\d_][^\[\]()<>]{0,60}?)\s*[\])]")
COLON = re.compile(r"\s?[:—](?=\s|<|$)")
WORDS = re.compile(r"(?:^|(?<=[\s>\-–—.]))((?:[^\W\d_][\w.'’]*\s+){0,2}[^\W\d_][\w.'’]*)$")
ANNOTATION = re.compile(r"<[^<>]*>|\[[^\[\]]*\]|\*[^*]*\*|[♪♫]")


def plain(name: str) -> str:
    t = unicodedata.normalize("NFKD", name.casefold())
    return " ".join("".join(c if c.isalnum() else " " for c in t if not unicodedata.combining(c)).split())


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between a and b; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


class Names:
    """Who a label may mean: (speaker, score) with 1 for a name as in the table, less for initials and misspellings."""

    def __init__(self, rows: list[tuple]):
        self.exact: dict[str, set[int]] = {}
        self.initials: dict[str, dict[int, float]] = {}
        for who, given, family, nick in rows:
            g, f, n = (plain(x or "") for x in (given, family, nick))
            for x in (g, f, n, f"{g} {f}" if g and f else "", f"{f} {g}" if g and f else ""):
                if x:
                    self.exact.setdefault(x, set()).add(who)
            if g and f:
                for x, score in ((g[0] + f[0], 0.9), (f[0] + g[0], 0.7)):  # family names first are rarer
                    at = self.initials.setdefault(x, {})
                    at[who] = max(score, at.get(who, 0.0))
                for x in (f"{g[0]} {f}", f"{g} {f[0]}", f"{f} {g[0]}"):
                    self.exact.setdefault(x, set()).add(who)
        self.known: dict[tuple[str, int], list[tuple[int, float]]] = {}

    def match(self, label: str, most: int = 2) -> list[tuple[int, float]]:
        if (label, most) not in self.known:
            self.known[label, most] = self._match(label, most)
        return self.known[label, most]

    def _match(self, label: str, most: int) -> list[tuple[int, float]]:
        words = label.split()
        while len(words) > 1 and words[0].endswith(".") and 2 < len(words[0]) <= 6:  # a title
            words = words[1:]
        name = plain(" ".join(words))
        if name in self.exact:
            return [(w, 1.0) for w in sorted(self.exact[name])]
        short = name.replace(" ", "")
        if len(short) == 2 and re.fullmatch(r"[^\W\d_]\.?\s?[^\W\d_]\.?", label) and label.upper() == label:
            return sorted(self.initials.get(short, {}).items())
        limit = min(most, 1 if len(name) <= 4 else 2)
        found: dict[int, int] = {}
        if len(name) >= 4 and limit:
            for x, who in self.exact.items():
                if len(x) >= 4 and abs(len(x) - len(name)) <= limit and (d := edits(name, x, limit)) <= limit:
                    for w in who:
                        found[w] = min(found.get(w, 9), d)
        return [(w, 0.8 - 0.2 * d / limit) for w, d in sorted(found.items())]


def places(text: str, names: Names) -> list[tuple[int, int, list[tuple[int, float]]]]:
    """(start, end, who) of the places in a cue where a turn may begin: labels with those they may mean,
    and a bare change mark at the cue's start, which names nobody."""
    out = []
    for m in VOICE.finditer(text):
        if who := names.match(m[1].strip()):
            out.append((m.start(), m.end(), who))
    for m in BRACKET.finditer(text):
        if m[1][:1].isupper() and (who := names.match(m[1], 1)):
            out.append((m.start(), m.end(), who))
    for m in COLON.finditer(text):
        if not (w := WORDS.search(text, max(0, m.start() - 80), m.start())):
            continue
        words = w[1].split()
        for n in range(min(3, len(words)), 0, -1):
            label = " ".join(words[-n:])
            titled = n > 1 and words[-n].endswith(".")
            if n == 3 and not titled:
                continue
            first = plain(label).split()
            # A misspelling inside a cue must look like a name; a name as in the table need not.
            most = 2 if label[:1].isupper() or w.start(1) + len(w[1]) - len(label) < 4 else 0
            if first and (who := names.match(label, most)):
                at = m.start() - len(label)
                lead = re.search(r"(?:>>+|[-–—])?\s*$", text[max(0, at - 12) : at])
                out.append((max(0, at - 12) + lead.start(), m.end(), who))
                break
    out.sort(key=lambda x: x[0])
    kept = []
    for x in out:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    m = MARK.match(text)
    if m and m.end() and (not kept or kept[0][0] > m.end()):
        kept.insert(0, (0, m.end(), []))
    return kept


def cleaned(text: str) -> str:
    """Speech without labels' remains, mark-up, annotations and fillers."""
    t = ANNOTATION.sub(" ", text) if any(map(text.__contains__, "<[*♪♫")) else text
    t = NOISE.sub(" ", t) if "(" in t else t
    t = FILLER.sub("", t) if "," in t else t
    return " ".join(t.split()).lstrip(" >-–—,:")


def _fillers() -> re.Pattern:
    words = set(FILLER_PHRASES)
    for group in FILLERS.split("|"):
        rest = group
        for p in FILLER_PHRASES:
            rest = rest.replace(p, " ")
        words |= set(rest.split())
    return re.compile(r"(?<![\w'’])(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r"),\s*", re.I)


FILLER = _fillers()
# Sound annotations that stand in round brackets.
NOISE = re.compile(
    r"\((?:música|aplausos|risas|tose|toses|ruido de fondo|silencio|music|applause|laughter|laughs|coughs|cough|door slams|background noise|palmas|risos|tosse|ruído de fundo|porta bate|"
    r"musique|applaudissements|rires|toux|bruit de fond|musik|applaus|gelächter|lacht|husten|hintergrundgeräusch|geräusch im hintergrund|musica|applausi|risate|colpi di tosse|rumore di fondo)\s*\)",
    re.I,
)

FEATURES = ("label for", "label against", "mark and change", "mark and no change", "change after a pause", "change in a running text", "change")


def features(who: dict[int, float], marked: bool, pause: bool, runs_on: bool, before: int, now: int) -> np.ndarray:
    """What a place says for speaker `now` after speaker `before` (-1: nobody yet)."""
    change = now != before
    return np.array(
        [who.get(now, 0.0), max((s for w, s in who.items() if w != now), default=0.0), marked and change, marked and not change, change and pause, change and runs_on, change], float
    )


#: Where learning starts: labels count for their speaker, marks for a change.
START = np.array([4.0, -4.0, 1.5, -1.5, 0.1, -0.1, -0.5])


def decode(events: list[tuple[dict[int, float], bool, bool, bool]], speakers: list[int], before: int, weights: np.ndarray) -> list[int]:
    """The speaker after each place of the best segmentation; -1 until somebody is named."""
    states = [-1, *speakers]
    score = {before: 0.0}
    back: list[dict[int, int]] = []
    for who, marked, pause, runs_on in events:
        new: dict[int, tuple[float, int]] = {}
        for p, s in score.items():
            own = {w: x for w, x in who.items() if w in speakers}
            for n in states:
                # Nobody stays nobody until a label names somebody, and a speaker never becomes nobody.
                if (p == -1 and n != -1 and n not in own) or (p != -1 and n == -1) or (p == -1 == n and own):
                    continue
                if n != p and not own and not marked:
                    continue
                v = s if n == -1 else s + float(weights @ features(own, marked, pause, runs_on, p, n))
                if n not in new or v > new[n][0]:
                    new[n] = v, p
        back.append({n: p for n, (_, p) in new.items()})
        score = {n: v for n, (v, _) in new.items()}
    out = []
    at = max(sorted(score), key=lambda n: score[n])
    for b in reversed(back):
        out.append(at)
        at = b[at]
    return out[::-1]


def by_rule(events: list, speakers: list[int]) -> list[int] | None:
    """The speaker after each place where labels leave no doubt, as the sample's truth; else null."""
    now, out = -1, []
    for who, marked, _, _ in events:
        own = [w for w, s in who.items() if w in speakers and s == 1.0]
        if len(who) > 1 or (who and not own):
            return None
        if own:
            now = own[0]
        elif marked and now != -1 and len(speakers) == 2:
            now = speakers[1 - speakers.index(now)]
        out.append(now)
    return out


def learn(videos: list[tuple[list, list[int]]], rounds: int = 5) -> np.ndarray:
    """Averaged perceptron over (events, speakers) whose truth by_rule gives. Labels are learnt from as if
    they were misspelt as badly as a match allows, so that those that are still outweigh the rest."""
    w, total, n = START.copy(), np.zeros(len(START)), 0
    sample = [([({k: 0.6 for k in who}, *rest) for who, *rest in e], s, t) for e, s in videos if len(s) == 2 and (t := by_rule(e, s)) is not None]
    for _ in range(rounds):
        for events, speakers, truth in sample:
            guess = decode(events, speakers, -1, w)
            if guess != truth:
                step = np.zeros(len(w))
                for sign, seq in ((1, truth), (-1, guess)):
                    p = -1
                    for e, now in zip(events, seq):
                        if now != -1:
                            step += sign * features({k: v for k, v in e[0].items() if k in speakers}, *e[1:], p, now)
                        p = now
                w = w + step / max(1, len(events)) ** 0.5
            total, n = total + w, n + 1
    return total / n if n else w


def _places(sent):
    """Cues that may hold a label or mark to a row per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: Names = sent.value
        for batch in batches:
            ids, index, texts, gaps, ended = (batch.column(k).to_pylist() for k in range(5))
            out: list[tuple] = []
            for v, i, raw, gap, end in zip(ids, index, texts, gaps, ended):
                text = html.unescape(raw)
                for k, (a, b, who) in enumerate(places(text, names)):
                    head = text[:a].rstrip(" >-–—")
                    runs_on = text[b:].lstrip()[:1].islower() and not (head[-1:] in ".!?…" if head else end)
                    out.append((v, i, k, [w for w, _ in who], [s for _, s in who], not who, bool(a < 4 and (gap or 0) > 8), runs_on))
            cols = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["id", "i", "k", "who", "score", "marked", "pause", "runs_on"])

    return run


#: Cues that may hold a label or a mark; entities are still encoded.
MAY = r"^[\s♪♫]*(?:<[^<>]*>\s*)*(?:&nbsp;|&gt;|>>|[-–—])|[:—]|<v[ .]|[\[(]\p{Lu}[\p{L}. ]*[\])]|&gt;"


def turn_places(cues: DataFrame, second: Column, names: Names, block: int = BLOCK) -> DataFrame:
    """All places of all cues where a turn may begin, with what the model sees of them."""
    t = F.col("text")
    rows = cues.select(F.col("video_id").alias("id"), F.col("cue_index").cast("bigint").alias("i"), second.cast("bigint").alias("s"), "text").where("id is not null and i is not null and text is not null and trim(text) <> ''")
    may = t.rlike(MAY)
    rows = rows.select("id", "i", "s", F.floor(F.col("i") / F.lit(block)).alias("b"), t.rlike(r"[.!?…][\s\p{Pe}»”]*$").alias("ended"), F.when(may, t).alias("t"))
    at = W.partitionBy("id", "b").orderBy("i", "s", "t")
    rows = rows.select("*", F.lag("i").over(at).alias("pi"), (F.col("s") - F.lag("s").over(at)).alias("gap"), F.coalesce(F.lag("ended").over(at), F.lit(True)).alias("end"))
    rows = rows.where("t is not null and (pi is null or pi <> i)").select("id", "i", "t", "gap", "end")
    sent = Shipped(cues.sparkSession, names)
    return rows.mapInArrow(_places(sent), "id string, i bigint, k int, who array<int>, score array<float>, marked boolean, pause boolean, runs_on boolean")


def voices(events: DataFrame) -> DataFrame:
    """(id, speakers): those of each video whom a label names and nobody else, and of a label that may mean several, none
    of whom is named otherwise, the one it fits best; most named first. Which of the speakers another label means is
    left to the model."""
    labels = events.where("size(who) > 0").groupBy("id", "who", "score").agg(F.count("*").alias("n"))
    one = labels.where("size(who) = 1").select("id", F.col("who")[0].alias("w"), (F.col("score")[0] * F.col("n")).alias("v"))
    each = one.groupBy("id", "w").agg(F.round(F.sum("v"), 3).alias("v"))  # at most a row per speaker and video
    named = each.groupBy("id").agg(F.collect_set("w").alias("named"))
    several = labels.where("size(who) > 1").join(named, "id", "left").where("named is null or not arrays_overlap(who, named)")
    fits = F.filter(F.arrays_zip("who", "score"), lambda x: x["score"] == F.array_max("score"))
    # Who fits equally well is admitted if no other does better: two that nothing tells apart name nobody.
    best = several.withColumn("fits", fits).where("size(fits) = 1").select("id", F.col("fits")[0]["who"].alias("w"), (F.col("fits")[0]["score"] * F.col("n")).alias("v"))
    each = each.unionByName(best.groupBy("id", "w").agg(F.round(F.sum("v"), 3).alias("v")))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "w"))), lambda x: x["w"]).alias("speakers"))


def _decode(sent):
    """Sorted blocks of places to the turns of each block under each speaker that may come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for rows, starts in whole_groups(batches, ["id", "b"]):
            cols = {n: rows.column(n).to_pylist() for n in rows.column_names}
            out: list[tuple] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
                at = range(a, b)
                speakers = cols["speakers"][a]
                events = [(dict(zip(cols["who"][r], cols["score"][r])), cols["marked"][r], cols["pause"][r], cols["runs_on"][r]) for r in at]
                for before in [-1, *speakers] if cols["b"][a] > 0 else [-1]:
                    found = decode(events, speakers, before, weights)
                    now, begun = before, []
                    for r, w in zip(at, found):
                        if w != now:
                            begun.append((cols["i"][r], cols["k"][r], w))
                            now = w
                    out.append((cols["id"][a], cols["b"][a], before, now, [x[0] for x in begun], [x[1] for x in begun], [x[2] for x in begun]))
            t = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(t, kinds)], names=["id", "b", "before", "after", "i", "k", "w"])

    return run


def turn_starts(cues: DataFrame, speakers: DataFrame, second: Column, block: int = BLOCK) -> DataFrame:
    """(id, i, k, speaker_id): the places where the turns of all videos begin, k counting inside a cue."""
    spark = cues.sparkSession
    names = Names([tuple(r) for r in bounded_rows(speakers.select("speaker_id", "given_name", "family_name", "nickname").where("speaker_id is not null"), MOST_SPEAKERS)])
    events = cut(turn_places(cues, second, names, block))
    who = voices(events)
    events = events.join(who, "id").withColumn("b", F.floor(F.col("i") / F.lit(block)))
    chosen = {r.id: r.speakers for r in who.where(F.size("speakers") == 2).orderBy(F.xxhash64("id"), "id").limit(VIDEOS).collect()}
    sample: dict[str, list] = {}
    for r in events.where(F.col("id").isin(list(chosen)) & (F.col("i") < POSITIONS)).orderBy("id", "i", "k").collect() if chosen else []:
        sample.setdefault(r.id, []).append((dict(zip(r.who, r.score)), r.marked, r.pause, r.runs_on))
    sent = Shipped(spark, learn([(e, chosen[v]) for v, e in sample.items()]))
    blocks = events.repartition("id", "b").sortWithinPartitions("id", "b", "i", "k")
    found = cut(blocks.mapInArrow(_decode(sent), "id string, b bigint, before int, after int, i array<bigint>, k array<int>, w array<int>"))
    return _chained(found).select("id", F.explode(F.arrays_zip("i", "k", "w")).alias("x")).select("id", "x.i", "x.k", F.col("x.w").alias("speaker_id"))


def _chained(found: DataFrame) -> DataFrame:
    """Of each block the turns under the speaker that the blocks before it end with. Videos of one block are done;
    of longer ones only the speakers before and after each block are walked through, once and in order."""
    last = found.groupBy("id").agg(F.max("b").alias("last")).where("last > 0").select("id")
    steps = found.join(last, "id", "left_semi").select("id", "b", "before", "after")

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        maps: dict[int, dict[int, int]] = {}
        for b, before, after in zip(f["b"].tolist(), f["before"].tolist(), f["after"].tolist()):
            maps.setdefault(b, {})[before] = after
        now, rows = -1, []
        for b in sorted(maps):
            rows.append((f["id"].iloc[0], b, now))
            now = maps[b].get(now, now)
        return pd.DataFrame(rows, columns=["id", "b", "now"])

    before = steps.groupBy("id").applyInPandas(walk, "id string, b bigint, now int")
    return found.join(before, ["id", "b"], "left").where(F.col("before") == F.coalesce("now", F.lit(-1)))


def _pieces(sent):
    """Cues to clean pieces of speech, one per place and one for what is before the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: Names = sent.value
        for batch in batches:
            out: list[tuple] = []
            for v, i, s, raw, may in zip(*(batch.column(k).to_pylist() for k in range(5))):
                text = html.unescape(raw)
                found = places(text, names) if may else []
                edges = [(0, -1), *((b, k) for k, (_, b, _) in enumerate(found))]
                stops = [*(a for a, _, _ in found), len(text)]
                out += [(v, i, k, s, piece) for (a, k), b in zip(edges, stops) if (piece := cleaned(text[a:b])) or k >= 0]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["id", "i", "k", "s", "piece"])

    return run


def speaker_turns(cues: DataFrame, speakers: DataFrame, second: Column, block: int = BLOCK) -> DataFrame:
    """One row per turn: video_id, turn (from 1), first_cue, last_cue, start (seconds, null if unreadable), speaker_id and clean text.

    cues (video_id, cue_index, text and what `second` reads); speakers (speaker_id, given_name, family_name,
    nickname), a table of at most MOST_SPEAKERS rows, which is checked. A cue delivered twice counts once;
    rows without video, position or text are left out. Cues before a video's first label belong to no
    turn, videos without labels have none; empty tables give an empty result. Other columns are ignored.
    """
    names = Names([tuple(r) for r in bounded_rows(speakers.select("speaker_id", "given_name", "family_name", "nickname").where("speaker_id is not null"), MOST_SPEAKERS)])
    sent = Shipped(cues.sparkSession, names)
    own = F.floor(F.col("i") / F.lit(block)).alias("b")
    starts = cut(turn_starts(cues, speakers, second, block)).select("id", own, "i", "k", F.struct("i", "k", "speaker_id").alias("turn"))
    rows = cues.select(F.col("video_id").alias("id"), F.col("cue_index").cast("bigint").alias("i"), second.cast("bigint").alias("s"), "text").where("id is not null and i is not null and text is not null")
    # Videos without turns are left out by block, so that an endless one is many groups.
    there = rows.select("id", own).distinct().join(starts.select("id").distinct(), "id", "left_semi")
    rows = rows.withColumn("b", own).join(there, ["id", "b"], "left_semi").select("id", "i", "s", "text", F.col("text").rlike(MAY).alias("may"))
    # What a block's first pieces belong to is the last turn of the blocks before it: a row ahead of them says so.
    ends = starts.groupBy("id", "b").agg(F.max("turn").alias("carry"))
    blocks = there.join(ends, ["id", "b"], "left")
    ahead = F.last("carry", ignorenulls=True).over(W.partitionBy("id").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("id", "b", F.lit(-1).cast("bigint").alias("i"), F.lit(-1).alias("k"), ahead.alias("turn")).where("turn is not null")
    nothing = (F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("string").alias("piece"))
    known = starts.unionByName(blocks).select("id", "b", "i", "k", *nothing, "turn")
    pieces = rows.mapInArrow(_pieces(sent), "id string, i bigint, k int, s bigint, piece string").select("id", own, "i", "k", "s", "piece", F.lit(None).cast(known.schema["turn"].dataType).alias("turn"))
    # One shuffle brings the pieces of a block together; turns are put together in it before those that go on elsewhere meet.
    pieces = pieces.unionByName(known).repartition("id", "b").groupBy("id", "b", "i", "k").agg(F.min("s").alias("s"), F.min("piece").alias("piece"), F.max("turn").alias("turn"))
    at = W.partitionBy("id", "b").orderBy("i", "k").rowsBetween(W.unboundedPreceding, 0)
    pieces = pieces.withColumn("turn", F.last("turn", ignorenulls=True).over(at)).where("turn is not null and i >= 0")
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["piece"]), " ")
    first = F.struct("i", "k")
    parts = pieces.groupBy("id", "b", "turn").agg(F.max("i").alias("last_cue"), F.min_by("s", first).alias("s"), text(F.collect_list(F.when(F.col("piece") != "", F.struct("i", "k", "piece")))).alias("piece"))
    out = parts.groupBy("id", "turn").agg(F.max("last_cue").alias("last_cue"), F.min_by("s", "b").alias("start"), text(F.collect_list(F.when(F.col("piece") != "", F.struct("b", "piece")))).alias("text"))
    number = F.row_number().over(W.partitionBy("id").orderBy("turn"))
    return out.select(F.col("id").alias("video_id"), number.alias("turn_no"), F.col("turn.i").alias("first_cue"), "last_cue", "start", F.col("turn.speaker_id").alias("speaker_id"), "text").withColumnRenamed("turn_no", "turn")
