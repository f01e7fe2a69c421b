"""Fixed-capacity containers filled with whole items.

The plan is made on the histogram of item lengths alone, whose size is bounded by the capacity:
shallow combinations of lengths that fill a window below the capacity are enumerated, non-negative
least squares finds how often each should be used to consume the histogram, the counts are rounded
down to what is there, and what remains is packed greedily, again by length. Items then find their
containers by their rank among the items of their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Shipped, cut

#: Groups that the items of one length are ranked in, so that a frequent length is no single group: one for each so many items,
#: at least and at most so many.
PER_SALT, SALTS, MOST_SALTS = 1_000_000, 64, 512
#: Lengths that a combination is started from, and combinations kept for each.
STARTS, PER_START = 600, 6


def combinations(hist: np.ndarray, capacity: int, window: int) -> list[dict[int, int]]:
    """Combinations {length: times} of at most three lengths with a sum in [capacity - window, capacity].

    Each starts from one of the lengths with most items (at any number of copies), adds copies of a
    second and closes with the length that fills the rest best.
    """
    present = np.flatnonzero(hist)
    lengths = present[np.argsort(-hist[present] * present, kind="stable")][:STARTS]
    if not len(lengths):
        return []
    # best[r]: the longest present length of at most r, for closing a combination.
    best = np.maximum.accumulate(np.where(hist > 0, np.arange(len(hist)), 0))
    rng = np.random.default_rng(17)
    weight = hist[present] / hist[present].sum()
    out, seen = [], set()
    for a in lengths.tolist():
        kept = 0
        most = capacity // a
        for b in rng.choice(present, size=8 * PER_START, p=weight).tolist():
            k = int(rng.integers(1, most + 1))
            m = (capacity - k * a) // b
            m = int(rng.integers(0, m + 1)) if m > 0 else 0
            c = int(best[capacity - k * a - m * b])
            combo: dict[int, int] = {}
            for x, n in ((a, k), (b, m), (c, (capacity - k * a - m * b) // c if c else 0)):
                if n:
                    combo[x] = combo.get(x, 0) + n
            total = sum(x * n for x, n in combo.items())
            key = tuple(sorted(combo.items()))
            if capacity - window <= total <= capacity and key not in seen:
                seen.add(key)
                out.append(combo)
                kept += 1
                if kept >= PER_START:
                    break
    return out


def least_squares(combos: list[dict[int, int]], hist: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """How often to use each combination: min |A x - hist| for x >= 0, by coordinate descent on the
    sparse columns. Items count by length, so that a long one left over weighs more."""
    left, x = hist.astype(float).tolist(), [0.0] * len(combos)
    columns = [(list(c.items()), sum(n * n * k for k, n in c.items())) for c in combos]
    scale = float(hist.sum()) or 1.0
    for _ in range(sweeps):
        moved = 0.0
        for j, (column, norm) in enumerate(columns):
            new = x[j] + sum(n * k * left[k] for k, n in column) / norm
            step = (new if new > 0 else 0.0) - x[j]
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, n in column:
                    left[k] -= n * step
        if moved < 1e-7 * scale:
            break
    return np.array(x)


def greedy(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns for what is left: the longest item first, then always the longest that fits; a pattern
    repeats as long as its lengths last, so each one uses a length up."""
    out = []
    left = left.copy()
    while left.any():
        combo: dict[int, int] = {}
        room = capacity
        for k in np.flatnonzero(left)[::-1].tolist():
            if k <= room:
                n = min(room // k, int(left[k]))
                combo[k] = n
                room -= n * k
                if not room:
                    break
        times = min(int(left[k]) // n for k, n in combo.items())
        for k, n in combo.items():
            left[k] -= n * times
        out.append((combo, times))
    return out


def plan(hist: np.ndarray, capacity: int, window: int | None = None) -> list[tuple[dict[int, int], int]]:
    """(combination, containers) for all items of the histogram, hist[k] items of length k."""
    left = hist.astype(np.int64).copy()
    combos = combinations(left, capacity, capacity // 64 if window is None else window)
    out = []
    if combos:
        x = least_squares(combos, left)
        for j in np.argsort(-x, kind="stable").tolist():
            times = min(int(x[j]), *(int(left[k]) // n for k, n in combos[j].items()))
            if times > 0:
                for k, n in combos[j].items():
                    left[k] -= n * times
                out.append((combos[j], times))
    return out + greedy(left, capacity)


def pack(items: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """One row per item, or per part of one larger than the capacity: key, part (from 0), n_parts,
    size and container (from 0).

    An item larger than the capacity is cut into full containers and one rest, which is packed like
    an item; no other is split. Items of size null or 0 need no room: one row, size 0, container null.
    Keys may repeat or be null, each row is an item of its own; equal sizes are interchangeable. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = items.sparkSession
    base = items.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("s"))
    base = cut(base.withColumn("n_parts", F.greatest(F.ceil(F.col("s") / F.lit(capacity)), F.lit(1))))
    salts = min(MOST_SALTS, max(SALTS, base.count() // PER_SALT))
    parts = base.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_parts") - 1)).alias("part"))
    parts = parts.withColumn("length", F.least(F.col("s") - F.col("part") * capacity, F.lit(capacity)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("k", "part"), F.lit(salts)).cast("int"))
    # At most capacity * MOST_SALTS rows, whatever the number of items.
    counts = parts.where("length > 0").groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "salt"], ignore_index=True)
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, counts["length"].to_numpy(int), counts["n"].to_numpy(int))
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used, base_id = np.zeros(capacity + 1, np.int64), 0
    for combo, times in plan(hist, capacity):
        for k, n in combo.items():
            slots.setdefault(k, []).append((int(used[k]), n, base_id))
            used[k] += n * times
        base_id += times
    starts = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}
    before = dict(zip(zip(counts["length"].tolist(), counts["salt"].tolist()), (counts.groupby("length")["n"].cumsum() - counts["n"]).tolist()))
    sent = Shipped(spark, (starts, before))

    @F.pandas_udf("bigint")
    def container(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.Series:
        starts, before = sent.value
        out = np.full(len(length), -1, np.int64)
        ls, r = length.to_numpy(int), rank.to_numpy(np.int64)
        r = r + np.array([before.get(x, 0) for x in zip(ls.tolist(), salt.tolist())], np.int64)
        for k in np.unique(ls).tolist():
            if k > 0:
                at = np.flatnonzero(ls == k)
                first, times, base = starts[k]
                p = np.searchsorted(first, r[at], side="right") - 1
                out[at] = base[p] + (r[at] - first[p]) // times[p]
        return pd.Series(out)

    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("k", "part")) - 1)
    placed = ranked.select("k", "part", "n_parts", "length", container("length", "salt", "rank").alias("c"))
    return placed.select(F.col("k").alias(key), F.col("part").cast("int"), F.col("n_parts").cast("int"), F.col("length").alias("size"), F.when(F.col("length") > 0, F.col("c")).alias("container"))
