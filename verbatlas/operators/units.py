"""Sentence units rebuilt from cues, with the exact source of every character."""

from __future__ import annotations

import json
import re
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.plain import NEAR, profile, shared
from .captions import Overlap, readable
from .fold import BLOCK, Machine, fold

# When a unit must end.
MAX_GAP, MAX_CUES, MAX_WORDS = 15, 4, 80

# What ends a sentence, and what only looks like it.
CLOSERS = "\"'»”)]"
SENTENCE = re.compile(r".*?[.!?…]+[\"'»”\)\]]*(?=\s|$)|.+$", re.S)
ENDED = re.compile(r"[.!?…][\"'»”\)\]]*$")
ABBREVIATED = re.compile(r"\b(?:sr|sra|srta|dr|dra|ing|lic|etc|ej|núm|num)\.$", re.I)
STAGE_ONLY = re.compile(r"(?:\s*\[[^\]]+\]\s*)+$")
WORDS = re.compile(r"\w+")

FRAGMENT = "struct<cue_index:bigint,second:bigint,start:int,end:int,text:string>"
UNIT = f"position bigint, part int, second bigint, text string, fragments array<{FRAGMENT}>"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences; neither an abbreviation nor the dot of a version number ends one."""
    spans: list[tuple[int, int]] = []
    for m in SENTENCE.finditer(text):
        body = m[0]
        a = m.start() + len(body) - len(body.lstrip())
        b = m.end() - (len(body) - len(body.rstrip()))
        if a >= b:
            continue
        if spans:
            head = text[spans[-1][0] : spans[-1][1]]
            if ABBREVIATED.search(head) or (re.search(r"\b\d+\.$", head) and text[a].isdigit()):
                spans[-1] = (spans[-1][0], b)
                continue
        spans.append((a, b))
    return spans


class Units(Machine):
    """Collects fragments of cues until a unit is complete."""

    def __init__(self) -> None:
        self.held: list[dict] = []
        self.words = 0
        self.last: tuple[int, int] | None = None  # index and second of the last cue
        self.begun: tuple[int, int] = (-1, -1)  # the cue the last unit began in, and how many began there before it
        self.out: list[tuple] = []

    def flush(self) -> None:
        if self.held:
            at = self.held[0]["cue_index"]
            self.begun = at, self.begun[1] + 1 if self.begun[0] == at else 0
            self.out.append((*self.begun, self.held[0]["second"], " ".join(x["text"] for x in self.held), self.held))
        self.held, self.words = [], 0

    def feed(self, row: tuple) -> list[tuple]:
        index, second, text = row
        self.out = []
        if self.last is not None:
            if index == self.last[0]:
                return []
            if second - self.last[1] > MAX_GAP:
                self.flush()
        self.last = index, second
        alone = bool(STAGE_ONLY.match(text))
        if alone:
            self.flush()
        for a, b in sentence_spans(text):
            part = text[a:b]
            n = len(WORDS.findall(part))
            if self.held:
                cues = {f["cue_index"] for f in self.held}
                if self.words + n > MAX_WORDS or (index not in cues and len(cues) >= MAX_CUES):
                    self.flush()
            self.held.append({"cue_index": index, "second": second, "start": a, "end": b, "text": part})
            self.words += n
            if ENDED.search(part):
                self.flush()
        if alone:
            self.flush()
        return self.out

    def rest(self) -> list[tuple]:
        self.out = []
        self.flush()
        return self.out

    def state(self) -> str:
        # How many units began in a cue before this block matters only while one that began there is held.
        return json.dumps([self.held, self.last and self.last[1], self.begun if self.held and self.begun[0] == self.held[0]["cue_index"] else [-1, -1]])

    def resume(self, state: str) -> None:
        self.held, second, begun = json.loads(state)
        self.last, self.begun = (None if second is None else (-1, second)), tuple(begun)
        self.words = sum(len(WORDS.findall(f["text"])) for f in self.held)


class Spoken(Machine):
    """Units of cues reduced to their new words."""

    def __init__(self) -> None:
        self.overlap, self.units = Overlap(), Units()

    def feed(self, row: tuple) -> list[tuple]:
        return [u for x in self.overlap.feed(row) for u in self.units.feed(x)]

    def rest(self) -> list[tuple]:
        return self.units.rest()

    def state(self) -> str:
        return json.dumps([self.overlap.state(), self.units.state()])

    def resume(self, state: str) -> None:
        a, b = json.loads(state)
        self.overlap.resume(a)
        self.units.resume(b)


def sentence_units(cues: DataFrame, block: int = BLOCK, overlap: bool = False) -> DataFrame:
    """(video_id, position, part, second, text, fragments): units in order of (position, part).

    position is the cue a unit begins in, part counts units that begin in one cue, second is its
    start. A unit ends with a final mark, at a pause of more than 15 s, around stage directions, and
    before it would hold more than 80 words or span more than four cues. Of a cue delivered twice the
    first by (second, text) counts; null keys, seconds and texts are left out. overlap: cues are reduced to their
    new words first, in the same pass. The size of blocks changes nothing.
    """
    return fold(readable(cues), "video_id", "cue_index", ["cue_index", "second", "text"], Spoken if overlap else Units, UNIT, block)


def in_order(units: DataFrame) -> DataFrame:
    """units with unit, a number that follows their order (a cue begins fewer than 2 ** 20 units)."""
    return units.withColumn("unit", F.col("position") * (1 << 20) + F.col("part"))


def informative(units: DataFrame) -> DataFrame:
    return units.where(~T.is_noise(F.col("text")))


def joined(units: list[dict]) -> dict:
    """One unit of several."""
    fragments = [f for u in units for f in u["fragments"]]
    return {**{k: units[0][k] for k in ("video_id", "position", "part", "second")}, "text": " ".join(f["text"] for f in fragments), "fragments": fragments}


class Windows(Machine):
    """Packs units in order; distinct leaves out those nearly the same as one of the eight kept before within 15 s."""

    def __init__(self, size: int, max_words: int, max_gap: int, distinct: bool) -> None:
        self.size, self.max_words, self.max_gap, self.distinct = size, max_words, max_gap, distinct
        self.held: list[dict] = []
        self.words = 0
        self.seen: list[tuple[int, str, tuple]] = []  # seconds, texts and profiles of the last eight

    def rest(self) -> list[tuple]:
        if not self.held:
            return []
        fragments = [f for u in self.held for f in u["fragments"]]
        first = self.held[0]
        return [(first["position"], first["part"], first["second"], " ".join(f["text"] for f in fragments), fragments)]

    def feed(self, row: tuple) -> list[tuple]:
        position, part, second, text, fragments = row
        if self.distinct:
            p = profile(text)
            if any(abs(second - s) <= 15 and shared(p, q) >= NEAR for s, _, q in self.seen):
                return []
            self.seen = [*self.seen[-7:], (second, text, p)]
        out = []
        n = len(WORDS.findall(text))
        if self.held and (len(self.held) >= self.size or self.words + n > self.max_words or second - self.held[-1]["fragments"][-1]["second"] > self.max_gap):
            out = self.rest()
            self.held, self.words = [], 0
        self.held.append({"position": position, "part": part, "second": second, "fragments": [dict(f) for f in fragments], "n": n})
        self.words += n
        return out

    def state(self) -> str:
        return json.dumps([self.held, [(s, t) for s, t, _ in self.seen]])

    def resume(self, state: str) -> None:
        self.held, seen = json.loads(state)
        self.words = sum(u["n"] for u in self.held)
        self.seen = [(s, t, profile(t)) for s, t in seen]


def windows(units: DataFrame, size: int = 3, max_words: int = 90, max_gap: int = MAX_GAP, distinct: bool = True, block: int = BLOCK) -> DataFrame:
    """Units packed in order into windows of at most `size` units and `max_words` words without a pause of more than
    `max_gap` seconds inside. distinct leaves out units nearly the same as one of the eight kept before
    within 15 s. The size of blocks changes nothing."""
    return fold(units, "video_id", "position", ["position", "part", "second", "text", "fragments"], partial(Windows, size, max_words, max_gap, distinct), UNIT, block)


def is_source_of(text: str, fragments: list) -> bool:
    """The invariant of every unit."""
    return " ".join(f["text"] for f in fragments) == text and all(f["end"] - f["start"] == len(f["text"]) for f in fragments)
