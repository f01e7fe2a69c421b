"""Runs of near-identical consecutive events, collapsed to one row each.

Every event is compared with its predecessor (lag), a change raises a flag, and the cumulated
flags number the runs. A sequence is cut into blocks of consecutive positions so that one
endless sequence is many groups: flags and their sums are made per block, and only the runs
that touch a block's edge take part in a second, much smaller pass that joins them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.barrier import where_computed

#: Positions per block: large enough that few runs touch an edge, small enough to sort in memory.
BLOCK = 4096

# Fixed value: letters that are compared without their accents.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿšž"


def with_plain_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: the words of text in lower case without accents, mark-up, entities and punctuation,
    one blank apart. In steps, so that each is computed once a row."""
    accented = ACCENTED + "".join(map(chr, range(0x300, 0x370)))  # combining marks have no partner and go
    plain = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)
    c = F.col(out)
    df = df.withColumn(out, F.lower(F.col(text)))
    accents = F.regexp_replace(F.replace(c, F.lit("&szlig;"), F.lit("ß")), "&([a-z])(?:acute|grave|circ|uml|tilde|cedil|ring);", "$1")
    df = df.withColumn(out, F.when(F.contains(c, F.lit("&")), F.regexp_replace(accents, "&lt;[^&<>]*&gt;|&(?:#x?[0-9a-f]+|[a-z]+[0-9]*);", " ")).otherwise(c))
    df = df.withColumn(out, F.regexp_replace(c, "<[^<>]*>", " "))
    df = df.withColumn(out, F.when(F.octet_length(c) > F.char_length(c), F.replace(F.translate(c, accented, plain), F.lit("ß"), F.lit("ss"))).otherwise(c))
    return df.withColumn(out, F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of b."""
    at: dict[str, int] = {}
    for k, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def near_identical(a: str, b: str, share: float) -> bool:
    """Same numbers, and share of the longer text's words in the same order in the other."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if sorted(w for w in x if w.isdigit()) != sorted(w for w in y if w.isdigit()):
        return False
    return in_order(x, y) >= share * max(len(x), len(y))


def _possible(share: float, gap: int) -> Column:
    """Whether an event (w, s) can continue the one before it (pw, ps): the words they share, counting
    all repeats, bound the common subsequence."""
    x, y = F.split("w", " "), F.split("pw", " ")
    longer = F.greatest(F.size(x), F.size(y))
    most = F.size(F.array_intersect(x, y)) + F.greatest(F.size(x) - F.size(F.array_distinct(x)), F.size(y) - F.size(F.array_distinct(y)))
    return F.coalesce((F.col("s") - F.col("ps") <= gap) & ((F.col("w") == F.col("pw")) | (most >= longer * share)), F.lit(False))


def _exactly(share: float, words: Column, before: Column) -> Column:
    """near_identical where before isn't null, else false."""

    @F.pandas_udf("boolean")
    def judge(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            yield pd.Series([y is not None and near_identical(x, y, share) for x, y in zip(a, b)], dtype=bool)

    return judge(words, before)


def collapse_runs(
    events: DataFrame, key: str, position: str, second: Column, text: str, *, share: float = 0.75, gap: int = 15, block: int = BLOCK, with_text: bool = True
) -> DataFrame:
    """One row per run of two or more events: key, first and last position, n_events, start,
    seconds (from the first start to the last) and, unless with_text is off, the first event's text.

    An event delivered twice (same key and position) counts once; of differing deliveries the one
    with the smallest (start, text) counts. Events without a word, a start, a key or a position are
    in no run and break none. Ties can't occur, for a position is unique after that. Other columns
    are ignored whatever their names, and an empty table gives an empty result.
    """
    kept = [F.col(text).alias("t")] if with_text else []
    rows = events.select(F.col(key).alias("k"), F.col(position).alias("i"), second.cast("bigint").alias("s"), F.col(text).alias("raw"), *kept).where("k is not null and i is not null")
    rows = where_computed(with_plain_words(rows, "raw", "w"), F.expr("s is not null and w <> ''")).drop("raw").withColumn("b", F.floor(F.col("i") / F.lit(block)))
    at = W.partitionBy("k", "b").orderBy("i", "s", "w", *["t"] * with_text)
    prior = lambda c: F.lag(c).over(at)
    seq = rows.select("*", prior("i").alias("pi")).where("pi is null or pi <> i").drop("pi")
    seq = seq.select("*", prior("w").alias("pw"), prior("s").alias("ps"), F.lead("i").over(at).isNull().alias("ends"), (F.row_number().over(at) == 1).alias("begins"))
    seq = seq.withColumn("maybe", _possible(share, gap))
    # Whoever stands alone inside its block is done with; the exact comparison sees only the rest.
    seq = seq.withColumn("next", F.coalesce(F.lead("maybe").over(at), F.lit(False))).where("maybe or next or begins or ends")
    seq = seq.select("k", "b", "i", "s", *["t"] * with_text, "begins", "ends", F.when(F.col("begins") | F.col("ends"), F.col("w")).alias("w"), _exactly(share, F.col("w"), F.when(F.col("maybe"), F.col("pw"))).alias("linked"))
    seq = seq.withColumn("run", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(W.partitionBy("k", "b").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "i").alias(f"{c}0")
    last = lambda c: F.max_by(c, "i").alias(f"{c}1")
    part = seq.groupBy("k", "b", "run").agg(
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.count("*").alias("n"), first("s"), last("s"), *[first("t")] * with_text,
        F.max(F.when(F.col("begins"), F.col("w"))).alias("w0"), F.max(F.when(F.col("ends"), F.col("w"))).alias("w1"), F.max("begins").alias("begins"), F.max("ends").alias("ends"),
    )
    # Runs at an edge meet by sequence; the others pass in their own block's group and are left alone.
    group = F.when(F.col("begins") | F.col("ends"), F.lit(-1)).otherwise(F.col("b"))
    edge = part.where("begins or ends or n > 1").withColumn("g", group)
    over = W.partitionBy("k", "g").orderBy("i0")
    edge = edge.select("*", F.lag("w1").over(over).alias("pw"), F.lag("s1").over(over).alias("ps"), F.lag("ends").over(over).alias("pe"))
    joins = F.col("begins") & F.coalesce(F.col("pe"), F.lit(False))
    near = joins & _possible(share, gap)
    edge = edge.withColumnsRenamed({"w0": "w", "s0": "s"}).withColumn("linked", _exactly(share, F.col("w"), F.when(near, F.col("pw")))).withColumnRenamed("s", "s0")
    over = over.rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("run", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(over))
    edge = edge.groupBy("k", "g", "run").agg(
        F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.sum("n").alias("n"), F.min_by("s0", "i0").alias("s0"), F.max_by("s1", "i1").alias("s1"), *[F.min_by("t0", "i0").alias("t0")] * with_text
    )
    return edge.where("n > 1").select(
        F.col("k").alias(key), F.col("i0").alias("first_cue"), F.col("i1").alias("last_cue"), F.col("n").alias("n_events"),
        F.col("s0").alias("start"), (F.col("s1") - F.col("s0")).alias("seconds"), *[F.col("t0").alias("text")] * with_text,
    )
