"""The whole analysis of many videos as one bundle of lazy frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import captions, concepts, ideas, keywords, questions, tools, units
from ..session import cut

#: Version of what an analysis holds.
FORMAT = 3


class Bundle(dict):
    """Frames by name; those given as functions are made when they are first asked for."""

    def __init__(self, **later):
        super().__init__()
        self.later = later

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.later[name]()
        return self[name]

    def __or__(self, more: dict) -> Bundle:
        self.update(more)
        return self


def analyze(cues: DataFrame, catalog: DataFrame, *, overlap: bool = True) -> dict[str, DataFrame]:
    """cues, units, keywords, tools, ideas, sections, concepts, questions and cards of the videos in cues (video_id,
    cue_index, second, text); catalog (name, description, category, aliases). Units are made once and kept in the
    shared folder, for all the rest reads them."""
    base = cut(units.informative(units.sentence_units(cues, overlap=overlap)))
    placed = units.in_order(base)
    named = tools.tool_mentions(placed, ["video_id"], "text", catalog, order="unit")
    best = cut(ideas.ideas(base))
    ranked = cut(concepts.concepts(placed, ["video_id"]))
    asked = questions.questions(base, named, ranked, best)
    return Bundle(cues=lambda: captions.without_overlap(cues) if overlap else cues) | {
        "units": base, "keywords": keywords.keywords(placed, ["video_id"], "text", 25, order="unit"), "tools": named, "ideas": best, "sections": ideas.sections(base), "concepts": ranked, "questions": asked,
        "cards": questions.flashcards(asked, named),
    }
