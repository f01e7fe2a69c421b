"""Ranked concepts of one to three words.

A key of few units is counted, scored and chosen from in one pass of Python over its units. Of one that has many the
n-grams are counted batch by batch and added up, scores are made set-at-a-time, and only its best candidates are chosen
from at once. Both give the same.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.timecode import code
from ..session import cut

TOKEN = r"(?i)[a-záéíóúñüÁÉÍÓÚÑÜ0-9]+(?:[.-][a-záéíóúñüÁÉÍÓÚÑÜ0-9]+)*"
BREAK = r"[,;:!?…—–]|\s-\s"

#: The same for Python, where case and blanks would go beyond ASCII.
_TOKEN = re.compile("[a-zA-ZáéíóúñüÁÉÍÓÚÑÜ0-9]+(?:[.-][a-zA-ZáéíóúñüÁÉÍÓÚÑÜ0-9]+)*")
_BREAK = re.compile(BREAK, re.A)
_DESCRIPTIVE = re.compile(L.DESCRIPTIVE_ENDING)
_DESCRIPTORS, _DETERMINERS = frozenset(L.DESCRIPTORS), frozenset(L.DETERMINERS)

#: Keys of more units than this are counted in parts.
MOST_UNITS = 10_000


def ngrams(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit, i, words, name, second, hinted): every run of one to three words without a break inside.

    units: keys, unit (order within keys), text and fragments of (second, text) that make it up, or second
    alone. hinted: a determiner stands before, or the last word looks descriptive.
    """
    # No word runs across fragments, for they are one blank apart.
    own = lambda text, second: F.transform(T.all_matches(text, TOKEN), lambda t: F.struct(F.lower(t).alias("t"), second.alias("second")))
    found = F.flatten(F.transform("fragments", lambda f: own(f["text"], f["second"]))) if "fragments" in units.columns else own(F.col("text"), F.col("second"))
    rows = units.select(*keys, "unit", found.alias("found"), F.transform(F.split("text", TOKEN, -1), lambda g: g.rlike(BREAK)).alias("broken")).where(F.size("found") > 0)
    # Each place takes its neighbours along, so that no row carries a whole text.
    at = lambda i: F.get("found", i)["t"]
    near = F.transform(
        F.sequence(F.lit(0), F.size("found") - 1),
        lambda i: F.struct(i.alias("i"), at(i - 1).alias("before"), F.get("found", i).alias("x"), at(i + 1).alias("t1"), at(i + 2).alias("t2"), F.get("broken", i + 1).alias("b1"), F.get("broken", i + 2).alias("b2")),
    )
    each = rows.select(*keys, "unit", F.explode(near).alias("p")).select(*keys, "unit", "p.*").select(*keys, "unit", "i", "before", F.col("x.t").alias("t0"), F.col("x.second").alias("second"), "t1", "t2", "b1", "b2")
    two = F.col("t1").isNotNull() & ~F.col("b1")
    sizes = F.array(F.array("t0"), F.when(two, F.array("t0", "t1")), F.when(two & F.col("t2").isNotNull() & ~F.col("b2"), F.array("t0", "t1", "t2")))
    each = each.select(*keys, "unit", "i", "before", "second", F.explode(F.array_compact(sizes)).alias("words"))
    last = F.element_at("words", -1)
    hinted = F.coalesce(F.col("before").isin(*L.DETERMINERS), F.lit(False)) | last.rlike(L.DESCRIPTIVE_ENDING) | last.isin(*L.DESCRIPTORS)
    return each.select(*keys, "unit", "i", "words", F.array_join("words", " ").alias("name"), "second", hinted.alias("hinted"))


#: Bits of what the words of an n-gram alone decide.
POSSIBLE, CONTENT, LONG, LINKED = 1, 2, 4, 8


class Traits(dict):
    """What the words of each n-gram alone decide. POSSIBLE: a concept by its words; CONTENT: one word that carries content; LONG: of several words
    none but stopwords inside is short; LINKED: the middle one of three is a connector. A possible one of several words has content at both ends."""

    def __init__(self, stopwords: Iterable[str] = L.STOPWORDS) -> None:
        self.stop, self.terms, self.actions, self.connectors = (frozenset(x) for x in (stopwords, L.GENERIC_TERMS, L.GENERIC_ACTIONS, L.CONNECTORS))

    def __missing__(self, name: str) -> int:
        w = name.split(" ")
        n, first, last, stop = len(w), w[0], w[-1], self.stop
        fits = len(first) >= 3 and first not in self.terms and first not in self.actions if n == 1 else not any(x in self.actions for x in w)
        possible = fits and first not in stop and last not in stop and len(set(w)) == n and not any(x.isdigit() for x in w)
        long = len(first) >= 4 and len(last) >= 4 and (n < 3 or w[1] in stop or len(w[1]) >= 4)
        out = POSSIBLE * possible + CONTENT * (n == 1 and first not in stop) + LONG * long + LINKED * (n == 3 and w[1] in self.connectors)
        if len(self) > 300_000:
            self.clear()
        self[name] = out
        return out


def is_eligible(n: int, hints: int, size: int, traits: int) -> bool:
    """As `eligible`."""
    return bool(traits & POSSIBLE) and (size == 1 or bool((n > 1 or traits & LONG) and (n > 1 or (traits & LINKED if size == 3 else hints))))


def places(text: str | None, parts: list[str | None] | None, seconds: list[int | None], traits: Traits) -> Iterator[tuple[int, str, int, int | None, bool]]:
    """(i, name, size, second, hinted) as in `ngrams`, of n-grams that are possible or content. parts: the fragments' texts, one after the other."""
    if parts is None:
        words = [w.lower() for w in _TOKEN.findall(text or "")]
        at = seconds * len(words)
    else:
        found = [(w.lower(), s) for part, s in zip(parts, seconds) for w in _TOKEN.findall(part or "")]
        words, at = [w for w, _ in found], [s for _, s in found]
    gaps = _TOKEN.split(text) if text is not None else []
    last = len(words) - 1
    # Whether what follows a word goes on with it.
    on = [k < last and k + 1 < len(gaps) and (gaps[k + 1] == " " or not _BREAK.search(gaps[k + 1])) for k in range(last + 1)]
    hints = [bool(w in _DESCRIPTORS or _DESCRIPTIVE.search(w)) for w in words]
    led = False
    for i, name in enumerate(words):
        second = at[i]
        if traits[name] & (POSSIBLE | CONTENT):
            yield i, name, 1, second, led or hints[i]
        if on[i]:
            name = f"{name} {words[i + 1]}"
            if traits[name] & POSSIBLE:
                yield i, name, 2, second, led or hints[i + 1]
            if on[i + 1]:
                name = f"{name} {words[i + 2]}"
                if traits[name] & POSSIBLE:
                    yield i, name, 3, second, led or hints[i + 2]
        led = words[i] in _DETERMINERS


def part_of(second: int, t0: int, t1: int, bins: int) -> int:
    """Which of `bins` equal parts of a key's time has second, as a bit."""
    return 1 << (min(bins - 1, math.floor((second - t0) * bins / (t1 - t0 + 1))) & 31)


def eligible() -> Column:
    """Which of the possible n-grams are concepts by their counts (n, hints)."""
    often, size = F.col("n") >= 2, F.col("size")
    has = lambda n: F.col("traits").bitwiseAND(F.lit(n)) > 0
    many = (often | has(LONG)) & F.when(size == 3, has(LINKED) | often).otherwise(often | (F.col("hints") > 0))
    return has(POSSIBLE) & ((size == 1) | many)


def texts(units: DataFrame) -> list[Column]:
    """What `places` reads of units: text, parts and seconds."""
    if "fragments" not in units.columns:
        return [F.col("text"), F.lit(None).cast("array<string>").alias("parts"), F.array("second").alias("seconds")]
    return [F.col("text"), F.transform("fragments", lambda f: f["text"]).alias("parts"), F.transform("fragments", lambda f: f["second"]).alias("seconds")]


def by_rows(df: DataFrame, make: Callable[[], Callable[[tuple | None], list[tuple]]], schema: str) -> DataFrame:
    """What the function that `make` gives returns for each row in turn and, at the end of a partition, for None."""
    fields = StructType.fromDDL(schema)
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        out: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out += step(row)
                if len(out) >= 20_000:
                    yield batch_of()
                    out = []
        out += step(None)
        if out:
            yield batch_of()

    return df.mapInArrow(run, schema)


def types_of(df: DataFrame, columns: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in columns)


#: What `concepts` is told of each chosen one.
CHOSEN = "name string, rank int, size int, n bigint, traits int, spread bigint, bins bigint, most bigint, top bigint, seconds array<bigint>"


def best_of(rows: list[tuple], traits: Traits, limit: int, first: int) -> list[tuple]:
    """The columns CHOSEN for a key's (unit, second, text, parts, seconds) in order of unit."""
    times = {r[1] for r in rows} - {None}
    t0, t1, bins = min(times, default=0), max(times, default=0), max(1, min(len(times), 5))
    bits = {None: 0}
    got: dict[str, list] = {}
    at, now = -1, None
    for unit, _, text, parts, seconds in rows:
        if at < 0 or unit != now:
            at, now = at + 1, unit
        for _, name, size, second, hinted in places(text, parts, seconds, traits):
            x = got.get(name)
            if x is None:
                x = got[name] = [0, 0, 0, size, at, traits[name], []]
            if second not in bits:
                bits[second] = part_of(second, t0, t1, bins)
            x[0] += 1
            x[1] += hinted
            x[2] |= bits[second]
            if len(x[6]) < 5 and second not in x[6]:
                x[6].append(second)
    found = [(name, x) for name, x in got.items() if is_eligible(x[0], x[1], x[3], x[5])]
    top = max((x[0] for _, x in found), default=0)
    ranked, rounded = [], {}
    for name, x in found:
        n, _, spread, size, at, t, _ = x
        most = max((got[w][0] for w in name.split(" ") if w in got and got[w][5] & CONTENT), default=None) if size > 1 else None
        score = score_of(n, top, spread, bins, size, t, most)
        if score not in rounded:
            rounded[score] = Decimal(repr(score)).quantize(DIGITS, ROUND_HALF_UP)
        ranked.append((-rounded[score], -n, -size, at, name, most))
    ranked.sort(key=lambda r: r[:5])
    while True:
        few = [(r[4], -r[1]) for r in ranked[:first]]
        longer = nested(few)
        kept = choose([(x, longer.get(x, set())) for x, _ in few], limit)
        if len(kept) >= limit or len(few) < first:
            break
        first *= 16
    most_of = {r[4]: r[5] for r in ranked[:first]}
    return [(x, k + 1, got[x][3], got[x][0], got[x][5], got[x][2], bins, most_of[x], top, got[x][6]) for k, x in enumerate(kept)]


def score_of(n: int, top: int, spread: int, bins: int, size: int, traits: int, most: int | None) -> float:
    """As `with_scores`."""
    frequency = math.log1p(n) / math.log1p(top)
    distribution = 1.0 if bins <= 1 else spread.bit_count() / bins
    if size == 1:
        return 0.65 * frequency + 0.35 * distribution
    multi = min(1.0, 0.45 * frequency + 0.25 * distribution + 0.30 * (n / most) + 0.08)
    return min(1.0, multi + 0.12) if traits & LINKED else multi


#: Scores that agree to so many digits rank as equal.
DIGITS = Decimal("1e-12")


def at_once(units: DataFrame, keys: list[str], limit: int, stopwords: Iterable[str], first: int) -> DataFrame:
    """(keys, CHOSEN) of units none of whose keys has many."""
    k = len(keys)

    def make() -> Callable[[tuple | None], list[tuple]]:
        traits, held, now = Traits(stopwords), [], None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal held, now
            out: list[tuple] = []
            if row is None or row[:k] != now:
                out = [(*now, *x) for x in best_of(held, traits, limit, first)] if held else []
                held, now = [], row and row[:k]
            if row is not None:
                held.append(row[k:])
            return out

        return step

    rows = units.select(*keys, "unit", "second", *texts(units)).repartition(*keys).sortWithinPartitions(*keys, "unit")
    return by_rows(rows, make, f"{types_of(units, keys)}, {CHOSEN}")


def counted(units: DataFrame, keys: list[str], stopwords: Iterable[str] = L.STOPWORDS, held: int = 100_000) -> DataFrame:
    """What is counted of each key's n-grams in one pass: keys, name, size, n, hints, traits, first (the least unit), spread (of up to five
    equal parts of the key's time those that have it, as bits) and bins (how many parts there are). For keys of many units, of which there are few."""
    times = units.groupBy(*keys).agg(F.min("second").alias("t0"), F.max("second").alias("t1"), F.least(F.countDistinct("second"), F.lit(5)).cast("bigint").alias("bins"))
    k = len(keys)

    def make() -> Callable[[tuple | None], list[tuple]]:
        traits, got = Traits(stopwords), {}

        def step(row: tuple | None) -> list[tuple]:
            if row is not None:
                of = row[:k]
                t0, t1, bins, unit, text, parts, seconds = row[k:]
                for _, name, size, second, hinted in places(text, parts, seconds, traits):
                    x = got.get((of, name))
                    if x is None:
                        # Rows come in order of unit, so the first place has the least.
                        x = got[of, name] = [size, 0, 0, traits[name], unit, 0, bins]
                    x[1] += 1
                    x[2] += hinted
                    x[5] |= 0 if second is None else part_of(second, t0, t1, bins)
            if row is not None and len(got) < held:
                return []
            out = [(*of, name, *x) for (of, name), x in got.items()]
            got.clear()
            return out

        return step

    rows = units.select(*keys, "unit", *texts(units)).join(F.broadcast(times), keys).select(*keys, "t0", "t1", "bins", "unit", "text", "parts", "seconds").sortWithinPartitions(*keys, "unit")
    each = by_rows(rows, make, f"{types_of(units, keys)}, name string, size int, n bigint, hints bigint, traits int, first {dict(units.dtypes)['unit']}, spread bigint, bins bigint")
    return each.groupBy(*keys, "name").agg(
        F.max("size").alias("size"), F.sum("n").alias("n"), F.sum("hints").alias("hints"), F.max("traits").alias("traits"), F.min("first").alias("first"), F.bit_or("spread").alias("spread"), F.max("bins").alias("bins")
    )


def scored(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of what `counted` gives with their scores: its columns, most (of the words of several, the count of the most frequent), top (of the
    key, that of the most frequent candidate) and those of `with_scores`."""
    found = counts.where(eligible())
    tokens = counts.where(F.col("traits").bitwiseAND(F.lit(CONTENT)) > 0).select(*keys, F.col("name").alias("word"), F.col("n").alias("of"))
    many = found.where("size > 1").select(*keys, "name", F.explode(F.split("name", " ")).alias("word")).join(tokens.hint("shuffle_hash"), [*keys, "word"]).groupBy(*keys, "name").agg(F.max("of").alias("most"))
    top = found.groupBy(*keys).agg(F.max("n").alias("top"))
    return with_scores(found.join(many, [*keys, "name"], "left").join(top, keys))


def with_scores(df: DataFrame) -> DataFrame:
    """df (n, top, spread, bins, size, traits, most) with frequency, distribution, association (null for one word) and score, not rounded."""
    df = df.withColumn("frequency", F.log1p("n") / F.log1p("top"))
    df = df.withColumn("distribution", F.when(F.col("bins") <= 1, F.lit(1.0)).otherwise(F.bit_count("spread") / F.col("bins")))
    df = df.withColumn("association", F.col("n") / F.col("most"))
    multi = F.least(F.lit(1.0), F.lit(0.45) * F.col("frequency") + F.lit(0.25) * F.col("distribution") + F.lit(0.30) * F.col("association") + 0.08)
    linked = F.col("traits").bitwiseAND(F.lit(LINKED)) > 0
    return df.withColumn("score", F.when(F.col("size") == 1, F.lit(0.65) * F.col("frequency") + F.lit(0.35) * F.col("distribution")).otherwise(F.when(linked, F.least(F.lit(1.0), multi + 0.12)).otherwise(multi)))


def nested(candidates: list[tuple[str, int]], share: float = 0.8) -> dict[str, set[str]]:
    """Of candidates (name, n) those longer ones that hold each: the words of a candidate are different, so each place of the longer one
    holds the shorter at one place of its own, and it's enough to know that it has at least `share` of its places."""
    n = dict(candidates)
    longer: dict[str, set[str]] = {}
    for name, times in candidates:
        words = name.split(" ")
        for size in range(1, len(words)):
            for k in range(len(words) - size + 1):
                short = " ".join(words[k : k + size])
                if short in n and times >= share * max(n[short], times):
                    longer.setdefault(short, set()).add(name)
    return longer


def choose(candidates: list[tuple[str, set[str]]], limit: int) -> list[str]:
    """Names kept of candidates (name, those it is nested in) in order of rank: a longer one drives out what is
    nested in it, a nested one gives way. What was driven out before a candidate gives way stays out."""
    inside = dict(candidates)
    kept: list[str] = []
    for name, longer in candidates:
        give_way = False
        for other in list(kept):
            if name in inside[other]:
                kept.remove(other)
            elif other in longer:
                give_way = True
                break
        if not give_way:
            kept.append(name)
            if len(kept) >= limit:
                break
    return kept


def in_parts(units: DataFrame, keys: list[str], limit: int, stopwords: Iterable[str], first: int) -> DataFrame:
    """(keys, CHOSEN) of units whose keys have many each. The `first` best candidates of a key are looked at first, more where these don't give `limit` concepts."""
    ranked = cut(scored(cut(counted(units, keys, stopwords)), keys))
    order = W.partitionBy(*keys).orderBy(F.desc(F.round("score", 12)), F.desc("n"), F.desc("size"), "first", "name")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("r")
        longer = nested(list(zip(f["name"], f["n"].tolist())))
        kept = choose([(x, longer.get(x, set())) for x in f["name"]], limit)
        at = {x: k + 1 for k, x in enumerate(kept)}
        short = len(kept) < limit and len(f) == f["upto"].iloc[0]
        return f[f["name"].isin(at)].assign(rank=lambda d: d["name"].map(at), short=short)[[*keys, "name", "rank", "short"]]

    chosen, left, upto = None, ranked, first
    while True:
        few = left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= upto).select(*keys, "name", "n", "r", F.lit(upto).alias("upto"))
        got = cut(few.groupBy(*keys).applyInPandas(run, f"{types_of(units, keys)}, name string, rank int, short boolean"))
        done = got.where("not short").drop("short")
        chosen = done if chosen is None else chosen.unionByName(done)
        asking = got.where("short").select(*keys).distinct()
        if asking.isEmpty():
            break
        left, upto = left.join(asking, keys, "left_semi"), upto * 16
    # Times of the chosen alone: the least place of each, in order of place.
    names = chosen.groupBy(*keys).agg(F.collect_list("name").alias("names"))
    k = len(keys)

    def make() -> Callable[[tuple | None], list[tuple]]:
        traits = Traits(stopwords)

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return []
            unit, text, parts, seconds, wanted = row[k:]
            return [(*row[:k], name, second, unit, i) for i, name, _, second, _ in places(text, parts, seconds, traits) if name in wanted]

        return step

    rows = units.select(*keys, "unit", *texts(units)).join(F.broadcast(names), keys).select(*keys, "unit", "text", "parts", "seconds", "names")
    seen = by_rows(rows, make, f"{types_of(units, keys)}, name string, second bigint, unit {dict(units.dtypes)['unit']}, i int")
    seen = seen.groupBy(*keys, "name", "second").agg(F.min(F.struct("unit", "i")).alias("p"))
    times = seen.groupBy(*keys, "name").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("p", "second"))), 1, 5), lambda x: x["second"]).alias("seconds"))
    return chosen.join(ranked, [*keys, "name"]).join(times, [*keys, "name"]).select(*keys, *[f.name for f in StructType.fromDDL(CHOSEN)])


def concepts(units: DataFrame, keys: list[str], limit: int = 15, stopwords: Iterable[str] = L.STOPWORDS, first: int = 200, many: int = MOST_UNITS) -> DataFrame:
    """(keys, rank, name, score, n, frequency, distribution, association, timestamps): at most `limit` a key, scores
    rounded to six digits, the first five different times. Scores that agree to twelve digits rank as equal. Keys of more than `many`
    units are counted in parts, which changes nothing."""
    units = units.dropna(subset=keys)
    large = cut(units.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > many).select(*keys))
    if large.isEmpty():
        found = at_once(units, keys, limit, stopwords, first)
    else:
        found = at_once(units.join(F.broadcast(large), keys, "left_anti"), keys, limit, stopwords, first)
        found = found.unionByName(in_parts(cut(units.join(F.broadcast(large), keys, "left_semi")), keys, limit, stopwords, first))
    r6 = lambda c: F.round(c, 6).alias(c)
    return with_scores(found).select(*keys, "rank", "name", r6("score"), "n", r6("frequency"), r6("distribution"), r6("association"), F.transform("seconds", code).alias("timestamps"))
