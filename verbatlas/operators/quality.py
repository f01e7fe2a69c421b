"""Quality of analyses against annotated targets, and regressions against a baseline."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..errors import QualityCorpusError
from ..functions.timecode import code

METRIC_VERSION, CORPUS_VERSION = 3, 2
# Metrics that must not fall, and those that must not rise.
RISING = (
    "topic_coverage", "standalone_claim_coverage", "concept_coverage", "compound_concept_coverage", "concept_timestamp_accuracy", "concept_timestamp_recall", "concept_precision",
    "useful_question_precision", "useful_question_recall", "useful_question_f1",
)
FALLING = ("concept_redundancy_rate", "noise_rule_violation_rate", "summary_duplicate_rate")
METRICS = (*RISING[:7], *FALLING, *RISING[7:])


def ratio(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n, of), F.lit(0.0))


def precision_recall(rows: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """(keys, precision, recall, f1) of a yes or no prediction; 0 where nothing was predicted or true."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    df = rows.groupBy(*keys).agg(count(predicted & truth).alias("hit"), count(predicted).alias("said"), count(truth).alias("true"))
    df = df.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("true")))
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*keys, "precision", "recall", "f1")


def text_at(fragments: Column, timestamps: Column) -> Column:
    """What a source says at the given times."""
    return F.array_join(F.transform(F.filter(fragments, lambda f: F.array_contains(timestamps, code(f["second"]))), lambda f: f["text"]), " ")


def duplicate_rate(texts: DataFrame, key: str, text: str, order: str, near: float = 0.72) -> DataFrame:
    """(key, rate): share of a key's pairs of texts that are nearly the same. For short lists, as a video's ideas."""
    words = texts.select(key, F.col(order).alias("o"), F.array_distinct(F.filter(F.split(T.folded(F.col(text)), " "), lambda w: w != "")).alias("w"))
    a, b = words.alias("a"), words.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.o") < F.col("b.o"))).where("size(a.w) > 0 and size(b.w) > 0")
    same = T.jaccard(F.col("a.w"), F.col("b.w")) >= near
    rates = pairs.groupBy(F.col(f"a.{key}").alias(key)).agg(F.avg(same.cast("int")).alias("rate"))
    return texts.select(key).distinct().join(rates, key, "left").select(key, F.coalesce("rate", F.lit(0.0)).alias("rate"))


def redundancy_rate(concepts: DataFrame, key: str) -> DataFrame:
    """(key, rate): of a key's pairs of concepts (name, n, timestamps) as frequent as each other, one inside the other, the
    share that stands at the same times."""
    c = concepts.select(key, "rank", "n", "timestamps", F.concat(F.lit(" "), T.folded(F.col("name")), F.lit(" ")).alias("t"))
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.rank") < F.col("b.rank")) & (F.col("a.n") == F.col("b.n")))
    pairs = pairs.where(F.contains("a.t", "b.t") | F.contains("b.t", "a.t"))
    share = F.size(F.array_intersect("a.timestamps", "b.timestamps")) / F.greatest(F.size("a.timestamps"), F.size("b.timestamps"))
    return pairs.groupBy(F.col(f"a.{key}").alias(key)).agg(F.avg((share >= 0.8).cast("int")).alias("rate"))


def matching(edges: list[tuple[int, int]]) -> int:
    """Size of a largest matching between questions and targets, by augmenting paths."""
    of: dict[int, list[int]] = {}
    for q, t in edges:
        of.setdefault(q, []).append(t)
    taken: dict[int, int] = {}

    def place(q: int, tried: set[int]) -> bool:
        for t in of[q]:
            if t not in tried:
                tried.add(t)
                if t not in taken or place(taken[t], tried):
                    taken[t] = q
                    return True
        return False

    return sum(place(q, set()) for q in sorted(of))


def evaluate(result: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
    """(case_id, METRICS..., ideas, questions, concepts) with metrics rounded to six digits.

    result: an analysis whose video_id is the case. targets: one row per case with case_id and the arrays
    topics (aliases, timestamps), claims (groups, timestamps), noise_rules (scope, aliases, max_occurrences), question_targets
    (category, prompt_groups, answer_groups, timestamps) and concept_targets (id, aliases, timestamps, compound).
    """
    t = targets.withColumnRenamed("case_id", "video_id")
    ideas, asked, found = result["ideas"], result["questions"], result["concepts"]

    def hits(name: str, test) -> DataFrame:
        """Targets of a case that any idea meets."""
        each = t.select("video_id", F.posexplode(name).alias("k", "x"))
        met = each.join(ideas.select("video_id", "fragments"), "video_id").where(test(F.col("x"), text_at(F.col("fragments"), F.col("x.timestamps"))))
        return met.groupBy("video_id").agg(F.countDistinct("k").alias(f"{name}_hit"))

    topics = hits("topics", lambda x, s: F.exists(x["aliases"], lambda a: T.contains_alias(s, a)))
    claims = hits("claims", lambda x, s: T.matches_groups(s, x["groups"]))

    each = t.select("video_id", F.posexplode("concept_targets").alias("k", "x"))
    names = found.select("video_id", "rank", T.folded(F.col("name")).alias("folded"), "timestamps")
    met = each.join(names, "video_id").where(F.array_contains(F.transform("x.aliases", lambda a: T.folded(a)), F.col("folded")))
    met = met.withColumn("right", F.size(F.array_intersect("timestamps", "x.timestamps")))
    by_concept = met.groupBy("video_id").agg(
        F.countDistinct("k").alias("concept_hit"), F.countDistinct("rank").alias("accepted"), F.sum(F.size("timestamps")).alias("emitted"), F.sum("right").alias("right"),
        F.countDistinct(F.when(F.col("x.compound") & (F.col("right") > 0), F.col("k"))).alias("compound_hit"),
    )
    joined = lambda c, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, c.alias("c")))), lambda x: x["c"]), "\n")
    scopes = ideas.groupBy("video_id").agg(joined(F.col("text"), ["rank"]).alias("ideas_text")).join(found.groupBy("video_id").agg(joined(F.col("name"), ["rank"]).alias("concepts_text")), "video_id", "full")
    scopes = scopes.join(asked.groupBy("video_id").agg(joined(F.col("question"), ["category", "rank"]).alias("prompts_text"), joined(F.col("answer"), ["category", "rank"]).alias("answers_text")), "video_id", "full")
    scope = F.when(F.col("x.scope") == "ideas", F.col("ideas_text")).when(F.col("x.scope") == "concepts", F.col("concepts_text")).when(F.col("x.scope") == "question_prompts", F.col("prompts_text")).otherwise(F.col("answers_text"))
    rules = t.select("video_id", F.explode("noise_rules").alias("x")).join(scopes, "video_id", "left").withColumn("s", F.coalesce(scope, F.lit("")))
    broken = F.aggregate("x.aliases", F.lit(0), lambda n, a: n + T.occurrences(F.col("s"), a)) > F.col("x.max_occurrences")
    noise = rules.groupBy("video_id").agg(F.sum(broken.cast("int")).alias("noise_hit"))

    q = asked.withColumn("q", F.row_number().over(W.partitionBy("video_id").orderBy("category", "rank")))
    want = t.select("video_id", F.posexplode("question_targets").alias("k", "x"))
    edge = q.join(want, "video_id").where((F.col("category") == F.col("x.category")) & F.array_contains("x.timestamps", code(F.col("second"))))
    edge = edge.where(T.matches_groups(F.col("question"), F.col("x.prompt_groups")) & T.matches_groups(text_at(F.col("fragments"), F.col("x.timestamps")), F.col("x.answer_groups")))

    def matched(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f["video_id"].iloc[0], matching(sorted(zip(f["q"], f["k"]))))], columns=["video_id", "matched"])

    pairs = edge.select("video_id", "q", "k").groupBy("video_id").applyInPandas(matched, "video_id string, matched int")
    counts = [frame.groupBy("video_id").agg(F.count("*").alias(name)) for frame, name in ((ideas, "ideas"), (asked, "questions"), (found, "concepts"))]
    df = t.select("video_id", *[F.size(c).alias(f"n_{c}") for c in ("topics", "claims", "noise_rules", "question_targets", "concept_targets")], F.size(F.filter("concept_targets", lambda c: c["compound"])).alias("n_compound"), F.aggregate("concept_targets", F.lit(0), lambda n, c: n + F.size(c["timestamps"])).alias("n_times"))
    for frame in (topics, claims, by_concept, noise, pairs, duplicate_rate(ideas, "video_id", "text", "rank").withColumnRenamed("rate", "summary_duplicate_rate"), redundancy_rate(found, "video_id").withColumnRenamed("rate", "concept_redundancy_rate"), *counts):
        df = df.join(frame, "video_id", "left")
    df = df.na.fill(0)
    c = F.col
    df = df.withColumns({
        "topic_coverage": ratio(c("topics_hit"), c("n_topics")), "standalone_claim_coverage": ratio(c("claims_hit"), c("n_claims")), "concept_coverage": ratio(c("concept_hit"), c("n_concept_targets")),
        "compound_concept_coverage": ratio(c("compound_hit"), c("n_compound")), "concept_timestamp_accuracy": ratio(c("right"), c("emitted")), "concept_timestamp_recall": ratio(c("right"), c("n_times")), "concept_precision": ratio(c("accepted"), c("concepts")),
        "noise_rule_violation_rate": ratio(c("noise_hit"), c("n_noise_rules")), "useful_question_precision": ratio(c("matched"), c("questions")), "useful_question_recall": ratio(c("matched"), c("n_question_targets")),
    })
    df = df.withColumn("useful_question_f1", ratio(2 * c("useful_question_precision") * c("useful_question_recall"), c("useful_question_precision") + c("useful_question_recall")))
    # bround: halves go to the even digit, as in the published figures.
    return df.select(c("video_id").alias("case_id"), *[F.bround(m, 6).alias(m) for m in METRICS], "ideas", "questions", "concepts")


def digest(corpus: bytes, cases: Iterable[tuple[str, bytes]]) -> str:
    """SHA-256 of a corpus and of its cases' ids and captions in order: what a baseline was measured on."""
    total = hashlib.sha256(corpus)
    for name, captions in cases:
        total.update(name.encode())
        total.update(captions)
    return total.hexdigest()


def report_payload(reports: DataFrame, **head: object) -> dict:
    """The report as it is stored: head (versions, digest), the cases by id and the macro average. For the few cases of a corpus."""
    extra = [c for c in ("profile", "ideas", "questions", "concepts") if c in reports.columns]
    cases = {r.case_id: {"metrics": {m: r[m] for m in METRICS}} | {c: r[c] for c in extra} for r in reports.orderBy("case_id").toLocalIterator()}
    return {**head, "cases": cases, "macro": macro(reports).first().asDict()}


def same_corpus(report: dict, baseline: dict) -> None:
    """Raises unless a baseline was measured by the same metrics, on the same corpus and cases and by the same analysis."""
    for field in ("metric_version", "corpus_schema_version", "corpus_digest", "analysis_format_version"):
        if baseline.get(field) != report.get(field):
            raise QualityCorpusError(f"the baseline has another {field}")
    if not isinstance(baseline.get("cases"), dict) or set(baseline["cases"]) != set(report["cases"]):
        raise QualityCorpusError("the baseline has other cases")


def macro(reports: DataFrame) -> DataFrame:
    """The mean of each metric over cases, rounded again."""
    return reports.agg(*[F.bround(F.avg(m), 6).alias(m) for m in METRICS])


def long_metrics(reports: DataFrame) -> DataFrame:
    """(location, metric, value) of reports and their macro average."""
    wide = reports.select(F.concat(F.lit("case:"), "case_id").alias("location"), *METRICS).unionByName(macro(reports).withColumn("location", F.lit("macro")))
    return wide.unpivot(["location"], list(METRICS), "metric", "value")


def regressions(actual: DataFrame, baseline: DataFrame) -> DataFrame:
    """(location, metric, actual, baseline) where a metric got worse. Both are (location, metric, value) of the same locations, and the
    baseline's values lie between 0 and 1; else QualityCorpusError."""
    a, b = actual.withColumnRenamed("value", "actual"), baseline.withColumnRenamed("value", "baseline")
    both = a.join(b, ["location", "metric"], "full_outer")
    wrong = both.where(F.col("actual").isNull() | F.col("baseline").isNull() | F.isnan("baseline") | ~F.col("baseline").between(0, 1)).limit(1).collect()
    if wrong:
        raise QualityCorpusError(f"baseline and report don't agree at {wrong[0].location}.{wrong[0].metric}")
    worse = F.when(F.col("metric").isin(*RISING), F.col("actual") < F.col("baseline")).otherwise(F.col("actual") > F.col("baseline"))
    return both.where(worse).select("location", "metric", "actual", "baseline")
