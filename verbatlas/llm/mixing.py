"""Records of several sources mixed to target shares by weighted fair queueing.

Each source's records are shuffled and repeated up to a cap; a record's virtual finish time is the
source's cumulated size at its end over the source's weight. Taking records in the order of their
finish times up to the budget serves every source at its weight for as long as it has records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded_rows, cut

#: Groups that a source's records are cumulated in, so that a large source is no single group.
BUCKETS = 512
#: Groups of all sources together.
MOST_GROUPS = 1_000_000


def source_key(source: Column) -> Column:
    """Lower case without blanks around it; null and blank are one unnamed source."""
    return F.coalesce(F.regexp_replace(F.lower(source), "^[\\s\\u00a0]+|[\\s\\u00a0]+$", ""), F.lit(""))


def served(until: float, sources: Sequence[tuple[float, float]]) -> float:
    return sum(min(w * until, most) for w, most in sources)


def finish_of(budget: float, sources: Sequence[tuple[float, float]]) -> float:
    """The virtual time by which sources (weight, available size) have been served the budget in all."""
    until = 0.0
    ends = sorted({most / w for w, most in sources if w > 0})
    for end in ends:
        if served(end, sources) >= budget:
            rate = sum(w for w, most in sources if w > 0 and most / w > until)
            return until + (budget - served(until, sources)) / rate if rate else until
        until = end
    return until


def mix(records: DataFrame, targets: DataFrame, *, key: str, source: str, size: str, budget: int | None = None, seed: int = 1, buckets: int | None = None, most_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(picks, report).

    picks: key, source, repeat (from 0), size, finish; range-sorted by finish. report: a row per source
    of targets with target_share, max_repeats, n_records, available (size once), picked, actual_share,
    reached (picked is target_share times the budget or more) and short: available times max_repeats is below that.
    budget defaults to the size of all records, those of other or no sources included. Records
    without a size (null) don't count, those of size 0 are picked with the record before them; a source
    of weight 0 or without records gives none. targets (source, target_share, max_repeats) is a table
    of at most most_sources rows, which is checked; of a source written twice the first row by
    (target_share, max_repeats) counts, null means share 0 or one repeat. Keys may repeat: equal rows
    are records of their own. Other columns are ignored.
    """
    spark = records.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in sorted(bounded_rows(targets.select(source_key(F.col("source")).alias("s"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("m")), most_sources)):
        wanted.setdefault(r.s, (max(float(r.w), 0.0), max(int(r.m), 0)))
    buckets = buckets or max(1, min(BUCKETS, MOST_GROUPS // max(1, len(wanted))))
    base = records.select(F.col(key).alias("k"), source_key(F.col(source)).alias("source"), F.col(size).cast("bigint").alias("size")).where("size is not null")
    base = base.withColumn("u", F.xxhash64(F.lit(seed), F.col("k"), F.col("size"))).withColumn("bucket", F.pmod(F.shiftrightunsigned(F.col("u"), 20), F.lit(buckets)).cast("int"))
    base = cut(base)
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own = base.where(F.col("source").isin(list(wanted))) if wanted else base.where("false")
    # At most sources * buckets rows, which is checked before they are collected and broadcast.
    sums = sorted(tuple(r) for r in bounded_rows(own.groupBy("source", "bucket").agg(F.sum("size").alias("v"), F.count("*").alias("n")), MOST_GROUPS))
    have: dict[str, tuple[int, int]] = {}
    offsets = []
    for s, b, v, n in sums:
        held, count = have.get(s, (0, 0))
        offsets.append((s, b, held))
        have[s] = held + v, count + n
    budget = total if budget is None else budget
    until = finish_of(budget, [(w, have.get(s, (0, 0))[0] * m) for s, (w, m) in wanted.items()])

    facts = [(s, w, m, have.get(s, (0, 0))[1], have.get(s, (0, 0))[0], bool(have.get(s, (0, 0))[0] * m < w * budget)) for s, (w, m) in wanted.items()]
    facts = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, n_records bigint, available bigint, short boolean")
    starts = spark.createDataFrame(offsets, "source string, bucket int, offset bigint")
    running = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("u", "k").rowsBetween(W.unboundedPreceding, 0))
    queue = own.withColumn("run", running).join(F.broadcast(starts), ["source", "bucket"]).withColumn("end", F.col("offset") + F.col("run")).drop("offset", "run", "bucket", "u")
    queue = queue.join(F.broadcast(facts.select("source", "target_share", "max_repeats", "available")), "source").where("target_share > 0 and max_repeats > 0")
    rounds = F.least(F.col("max_repeats").cast("double"), F.floor(F.lit(until) * F.col("target_share") / F.greatest(F.col("available"), F.lit(1))) + 1).cast("int")
    queue = queue.withColumn("repeat", F.explode(F.sequence(F.lit(0), rounds - 1)))
    queue = queue.withColumn("finish", (F.col("repeat") * F.col("available") + F.col("end")) / F.col("target_share")).where(F.col("finish") <= F.lit(until * (1 + 1e-12)))
    picks = queue.select(F.col("k").alias(key), "source", "repeat", "size", "finish").repartitionByRange("finish", "source", key).sortWithinPartitions("finish", "source", key)
    got = queue.groupBy("source").agg(F.sum("size").alias("picked"))
    everything = F.sum("picked").over(W.partitionBy(F.lit(0)))  # over the rows of targets
    report = facts.join(got, "source", "left").withColumn("picked", F.coalesce("picked", F.lit(0)))
    report = report.withColumn("reached", F.col("picked") >= F.col("target_share") * F.lit(float(budget)))
    return picks, report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("picked"), everything), F.lit(0.0)))
