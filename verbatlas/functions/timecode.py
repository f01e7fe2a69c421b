"""Caption time codes: strings H..H:MM:SS[.fff] or MM:SS[.fff] and whole seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Whole seconds of a time code, the fraction cut; null where it cannot be read.

    Two parts are minutes and seconds, three are hours (any width), minutes, seconds.
    """
    clean = F.trim(ts)
    parts = F.split(F.substring_index(clean, ".", 1), ":")
    number = lambda k: F.try_element_at(parts, F.lit(-k)).try_cast("bigint")
    return F.when(clean.rlike(r"^(\d+:)?\d+:\d+(\.\d*)?$"), F.coalesce(number(3), F.lit(0)) * 3600 + number(2) * 60 + number(1))


def code(secs: Column) -> Column:
    """H:MM:SS with at least two digits for the hours; they may have more."""
    s = secs.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
