"""Items that appear together: exact pair counts against a fitted bipartite configuration null.

Pairs are counted batch by batch before anything is shuffled. The null model gives item a and
basket k an incidence probability x_a y_k / (1 + x_a y_k), fitted so that every item's frequency
and every basket's size come out right on average; it is solved on the histograms of both, whose
size doesn't follow the number of baskets. The number of baskets that hold a pair is then a
Poisson-binomial variable, whose upper tail comes from its saddlepoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows, cut

#: Items of a basket that meet in one row; wider baskets become several rows.
CHUNK = 256
#: Items up to which the frequent ones are sent to the tasks; beyond, rare pairs are dropped after counting.
MOST_SENT = 200_000
#: Classes of item frequency and of basket size in the fit; beyond, neighbours share a class.
MOST_CLASSES = 1500
#: Resolution of the surprise (minus log10 of a p value) for false-discovery control.
BIN, TOP = 0.01, 400.0


def clean_name(name: Column) -> Column:
    """Lower case without blanks of any kind around it."""
    return F.regexp_replace(F.lower(name), "^[\\s\\u0000-\\u0020\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]+|[\\s\\u0000-\\u0020\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]+$", "")


def latest_entries(library: DataFrame, items: str = "tools") -> DataFrame:
    """(id, items) of the newest version of each entry with an id and a path.

    updated_at counts as an instant; null or unreadable is earliest. Of versions of the same
    instant the one with the greatest item list counts, so repeated rows do no harm.
    """
    blank = lambda c: F.coalesce(clean_name(F.col(c)), F.lit("")) == ""
    at = F.col("updated_at").try_cast("timestamp")
    order = F.struct(F.coalesce(F.unix_micros(at), F.lit(-(2**62))), F.coalesce(F.col(items), F.array().cast("array<string>")))
    return library.where(~blank("id") & ~blank("path")).groupBy("id").agg(F.max(order).alias("v")).select("id", F.col("v.col2").alias("items"))


def canonical(entries: DataFrame, catalog: DataFrame, most: int = 50_000) -> DataFrame:
    """(id, items) with names cleaned, aliases replaced, blanks and repeats dropped. The catalogue is a
    dimension table of at most `most` names, which is checked; beyond that this raises."""
    known = {}
    rows = bounded_rows(catalog.select(clean_name(F.col("name")).alias("n"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), clean_name).alias("a")), most)
    for r in rows:
        if r.n:
            known |= {a: r.n for a in r.a if a}
    known = {a: n for a, n in known.items() if a not in {r.n for r in rows}}
    names = F.transform(F.coalesce("items", F.array().cast("array<string>")), clean_name)
    if known:
        table = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
        aliases = sorted(known)  # looked for in a hash set; a map is searched from end to end
        names = F.transform(names, lambda x: F.when(x.isin(*aliases), F.try_element_at(table, x)).otherwise(x))
    return entries.select("id", F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))).alias("items"))


def _pairs_of(frequent: set | None):
    """Arrow batches of (left, right) to partial counts of pairs; right null means the pairs inside left."""

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return column.flatten(), np.asarray(column.value_lengths().fill_null(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = flat(batch.column(0))
            others, widths = flat(batch.column(1))
            both = pa.concat_arrays([values.cast(pa.string()), others.cast(pa.string())]).dictionary_encode()
            names, codes = both.dictionary.to_pylist(), np.asarray(both.indices)
            rank = np.argsort(np.argsort(np.array(names, dtype=object))) if names else np.zeros(0, int)
            keep = np.array([frequent is None or x in frequent for x in names], dtype=bool)
            order = np.argsort(rank)
            left, right = codes[: len(values)], codes[len(values) :]
            tally: dict[int, int] = {}
            n = max(len(names), 1)
            found, held = [], 0

            def flush() -> None:
                nonlocal found, held
                if found:
                    code, times = np.unique(np.concatenate(found), return_counts=True)
                    for c, t in zip(code.tolist(), times.tolist()):
                        tally[c] = tally.get(c, 0) + t
                found, held = [], 0

            i = j = 0
            for a, b, inner in zip(sizes.tolist(), widths.tolist(), np.asarray(batch.column(1).is_null())):
                x, y = left[i : i + a], right[j : j + b]
                i, j = i + a, j + b
                x = np.sort(rank[x[keep[x]]])
                if inner:
                    p, q = np.triu_indices(len(x), 1)
                    low, high = x[p], x[q]
                else:
                    y = rank[y[keep[y]]]
                    low, high = np.minimum.outer(x, y).ravel(), np.maximum.outer(x, y).ravel()
                if len(low):
                    found.append(low.astype(np.int64) * n + high)
                    held += len(low)
                if held > 2_000_000:
                    flush()
            flush()
            if tally:
                code = np.fromiter(tally, np.int64, len(tally))
                name = lambda r: pa.array([names[k] for k in order[r]], pa.string())
                yield pa.RecordBatch.from_arrays([name(code // n), name(code % n), pa.array(list(tally.values()), pa.int64())], ["a", "b", "n"])

    return count


def pair_counts(baskets: DataFrame, least: int, frequent: set | None) -> DataFrame:
    """(a, b, n) with a < b for pairs in at least `least` baskets; items must be distinct in a basket."""
    size = F.size("items")
    rows = baskets.where((size > 1) & (size <= CHUNK)).select(F.col("items").alias("l"), F.lit(None).cast("array<string>").alias("r"))
    # Wide baskets are cut into chunks that meet each other; their pairs of chunks are spread over all tasks.
    wide = baskets.where(size > CHUNK).withColumn("basket", F.monotonically_increasing_id())
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(size / F.lit(CHUNK)).cast("int") - 1), lambda k: F.slice("items", k * CHUNK + 1, CHUNK))
    wide = wide.select("basket", F.posexplode(chunks).alias("i", "chunk"))
    if not wide.isEmpty():
        wide = cut(wide)
        other = wide.select("basket", F.col("i").alias("j"), F.col("chunk").alias("r"))
        meet = wide.join(other, "basket").where("i <= j").repartition("basket", "i", "j")
        rows = rows.unionByName(meet.select(F.col("chunk").alias("l"), F.when(F.col("i") < F.col("j"), F.col("r")).alias("r")))
    counted = rows.mapInArrow(_pairs_of(frequent), "a string, b string, n bigint")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def classes(histogram: list[tuple[int, int]], most: int = MOST_CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Values and weights of a histogram; beyond `most` values, neighbours are merged at their weighted mean."""
    v, w = (np.array(x, float) for x in zip(*sorted(histogram))) if histogram else (np.zeros(0), np.zeros(0))
    while len(v) > most:
        group = np.floor(np.log(v) / np.log(v[-1] + 1) * (most - 1))
        _, first = np.unique(group, return_index=True)
        merged = np.add.reduceat(w, first)
        v, w = np.add.reduceat(v * w, first) / merged, merged
        most = max(most, len(v))
    return v, w


def fit(freq: np.ndarray, items: np.ndarray, size: np.ndarray, baskets: np.ndarray, rounds: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Fitness x per item class and y per basket class, by fixed-point iteration on both margins."""
    total = (freq * items).sum()
    x, y = freq / math.sqrt(total), size / math.sqrt(total)
    for _ in range(rounds):
        odds = 1 + np.outer(x, y)
        x1 = freq / np.maximum((baskets * y / odds).sum(1), 1e-300)
        odds = 1 + np.outer(x1, y)
        y1 = size / np.maximum((items[:, None] * x1[:, None] / odds).sum(0), 1e-300)
        moved = max(np.abs(x1 / x - 1).max(initial=0), np.abs(y1 / y - 1).max(initial=0))
        x, y = np.minimum(x1, 1e9), np.minimum(y1, 1e9)
        if moved < tol:
            break
    return x, y


def _log_upper_normal(z: np.ndarray) -> np.ndarray:
    near = np.array([math.log(max(math.erfc(t / math.sqrt(2)) / 2, 1e-300)) for t in np.clip(z, -30, 30)])
    with np.errstate(all="ignore"):
        far = -z * z / 2 - np.log(z * math.sqrt(2 * math.pi)) + np.log1p(-1 / z**2 + 3 / z**4)
    return np.where(z > 30, far, near)


def log_tail(n: np.ndarray, q: np.ndarray, times: np.ndarray) -> np.ndarray:
    """log P(X >= n) for X a sum of times[k] trials of probability q[:, k], by the saddlepoint with
    continuity correction; exact where n is 0 or all trials."""
    q = np.clip(q, 1e-300, 1 - 1e-12)
    n = n.astype(float)
    mean, most = (q * times).sum(1), times.sum()
    at = np.clip(n - 0.5, 1e-9, most - 1e-9)
    t = np.log(np.maximum(at, 1e-9) / np.maximum(mean, 1e-300))
    for _ in range(60):
        e = np.exp(np.clip(t, -700, 700))[:, None]
        r = q * e / (1 - q + q * e)
        step = ((r * times).sum(1) - at) / np.maximum((r * (1 - r) * times).sum(1), 1e-300)
        t = t - np.clip(step, -2, 2)
        if np.abs(step).max(initial=0) < 1e-10:
            break
    e = np.exp(np.clip(t, -700, 700))[:, None]
    r = q * e / (1 - q + q * e)
    k0, k2 = (times * np.log1p(q * (e - 1))).sum(1), (r * (1 - r) * times).sum(1)
    w = np.sign(t) * np.sqrt(2 * np.maximum(t * at - k0, 0))
    u = 2 * np.sinh(np.clip(t, -600, 600) / 2) * np.sqrt(k2)
    with np.errstate(all="ignore"):
        star = w + np.log(u / w) / w
    skew = (r * (1 - r) * (1 - 2 * r) * times).sum(1) / np.maximum(k2, 1e-300) ** 1.5
    star = np.where(np.abs(w) < 1e-4, w - skew / 6, star)
    out = _log_upper_normal(star)
    return np.where(n <= 0, 0.0, np.where(n > most, -np.inf, np.minimum(out, 0.0)))


def surprising_pairs(baskets: DataFrame, *, least: int = 10) -> DataFrame:
    """One row per pair of items that at least `least` baskets hold: a < b, n, n_a, n_b, n_baskets,
    lift, expected (under the null), surprise (-log10 of the tail) and q_value (Benjamini-Hochberg
    over all pairs of items, seen or not).

    baskets: (id, items), the items of a basket distinct, sorted and not null (see `canonical`).
    Baskets without items count in n_baskets. An empty table gives an empty result; ties and
    repeats of baskets are counted as they come; other columns are ignored.
    """
    spark = baskets.sparkSession
    baskets = cut(baskets.select("items"))
    margin = {r.k: r.n for r in baskets.groupBy(F.size("items").alias("k")).agg(F.count("*").alias("n")).collect()}
    total = sum(margin.values())
    counts = cut(baskets.select(F.explode("items").alias("i")).groupBy("i").agg(F.count("*").alias("n")))
    spread = [(r.n, r.items) for r in counts.groupBy("n").agg(F.count("*").alias("items")).collect()]
    n_items = sum(w for _, w in spread)
    sent = counts.where(F.col("n") >= least).limit(MOST_SENT + 1).collect()
    frequent = {r.i for r in sent} if len(sent) <= MOST_SENT else None
    pairs = pair_counts(baskets, least, frequent)
    of = lambda k: counts.select(F.col("i").alias(k), F.col("n").alias(f"n_{k}"))
    if frequent is not None and len(sent) <= 20_000:
        pairs = pairs.join(F.broadcast(of("a")), "a").join(F.broadcast(of("b")), "b") if n_items <= 20_000 else pairs.join(of("a"), "a").join(of("b"), "b")
    else:
        pairs = pairs.join(of("a"), "a").join(of("b"), "b")
    pairs = pairs.select("a", "b", "n", "n_a", "n_b", F.lit(total).alias("n_baskets"), (F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b").cast("double"))).alias("lift"))

    freq, items = classes(spread)
    size, held = classes([(k, n) for k, n in margin.items() if k > 0])
    x, y = fit(freq, items, size, held) if len(freq) else (freq, size)
    tests = max(n_items * (n_items - 1) / 2, 1.0)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = []
            for c in ("n_a", "n_b"):
                z = np.interp(f[c].to_numpy(float), freq, x) if len(freq) else np.zeros(len(f))
                p.append(np.outer(z, y) / (1 + np.outer(z, y)))
            q = p[0] * p[1]
            f["expected"] = (q * held).sum(1)
            f["surprise"] = np.clip(-log_tail(f["n"].to_numpy(), q, held) / math.log(10), 0, None) if len(f) else f["expected"]
            yield f

    judged = cut(pairs.mapInPandas(judge, pairs.schema.simpleString()[7:-1].replace(":", " ") + ", expected double, surprise double"))
    bins = sorted(((r.k, r.n) for r in judged.groupBy(F.floor(F.least(F.col("surprise"), F.lit(TOP)) / BIN).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    # Benjamini-Hochberg over bins of surprise: every pair has its bin's least favourable p value.
    rank, raw = 0, []
    for k, n in bins:
        rank += n
        raw.append((k, min(1.0, tests * 10.0 ** (-k * BIN) / rank)))
    best, q_values = 1.0, []
    for k, q in reversed(raw):
        best = min(best, q)
        q_values.append((k, best))
    table = spark.createDataFrame(q_values or [(0, 1.0)], "bin int, q_value double")
    return judged.withColumn("bin", F.floor(F.least(F.col("surprise"), F.lit(TOP)) / BIN).cast("int")).join(F.broadcast(table), "bin").drop("bin")
