"""The pN_ queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecode import seconds
from ..session import table
from .cooccur import canonical, latest_entries, surprising_pairs
from .languages import track_languages
from .mixing import mix
from .packing import pack
from .pairs import defects
from .pii import personal_spans, redacted
from .runs import collapse_runs
from .sizes import with_tokens
from .turns import speaker_turns

P4_FOUND = r"""
WITH latest AS (
  SELECT id, tools, row_number() OVER (PARTITION BY id ORDER BY try_cast(updated_at AS timestamptz) DESC NULLS LAST, tools DESC NULLS LAST) AS k
  FROM library WHERE regexp_matches(coalesce(id, ''), '[^\s\x{00A0}]') AND regexp_matches(coalesce(path, ''), '[^\s\x{00A0}]')
), entries AS (SELECT id, tools FROM latest WHERE k = 1
), named AS (
  SELECT id, regexp_replace(lower(t), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS t FROM (SELECT id, unnest(tools) AS t FROM entries)
), aliases AS (SELECT name, lower(unnest(aliases)) AS alias FROM tools
), held AS (
  SELECT DISTINCT id, coalesce(a.name, t) AS t FROM named LEFT JOIN aliases a ON a.alias = t WHERE coalesce(t, '') <> ''
), freq AS (SELECT t, count(*) AS n FROM held GROUP BY t)
SELECT p.a AS tool_a, p.b AS tool_b
FROM (SELECT x.t AS a, y.t AS b, count(*) AS n FROM held x JOIN held y ON x.id = y.id AND x.t < y.t GROUP BY ALL) p
JOIN freq f ON f.t = p.a JOIN freq g ON g.t = p.b
WHERE p.n >= 10 AND p.n * (SELECT count(*) FROM entries) >= 3.0 * f.n * g.n
""".replace("\\\\", "\\")

# Any tokenizer of words gives the same rows, so SQL counts words and marks.
P6_FOUND = r"""
SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) > 2048
"""

P7_FOUND = r"""
WITH sized AS (
  SELECT trim(lower(source)) AS source, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS n FROM documents WHERE text IS NOT NULL
)
SELECT t.source FROM mix_targets t
WHERE coalesce((SELECT sum(n) FROM sized s WHERE s.source = t.source), 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM sized)
"""


def p1_runs(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_runs(table(spark, sf, "cues"), "video_id", "cue_index", seconds(F.col("ts")), "text")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_runs(spark, sf).select("video_id", F.col("first_cue").cast("int"), F.col("last_cue").cast("int"))


def p2_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return track_languages(table(spark, sf, "subtitles"), table(spark, sf, "cues"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = p2_tracks(spark, sf).where("label_is <> 'right' or n_segments > 1")
    return found.select("video_id", F.col("first_cue").cast("int"), "language")


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda t, kind, key: table(spark, sf, t).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "video_id", "question", "answer")
    pairs = of("study_questions", "question", "question_id").unionByName(of("flashcards", "card", "card_id"))
    return defects(pairs, table(spark, sf, "subtitles").select("video_id", "language"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pairs(spark, sf).where("defect is not null").select(F.col("kind").alias("pair_kind"), F.col("id").alias("pair_id"), "defect")


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return surprising_pairs(canonical(latest_entries(table(spark, sf, "library")), table(spark, sf, "tools")), least=10)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    # Whether a pair is more than chance says the fitted null: a tail of at most a tenth. The exact lift follows.
    return p4_pairs(spark, sf).where("surprise >= 1 and lift >= 3").select(F.col("a").alias("tool_a"), F.col("b").alias("tool_b"))


def p5_turns(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_turns(table(spark, sf, "cues"), table(spark, sf, "speakers"), seconds(F.col("ts")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_turns(spark, sf).select("video_id", F.col("first_cue").cast("int"), "speaker_id")


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack(with_tokens(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "tokens", 2048)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    # What was put into more than one container.
    held = p6_containers(spark, sf).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return held.where("a <> b").select("doc_id")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    documents = with_tokens(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return mix(documents, table(spark, sf, "mix_targets"), key="doc_id", source="source", size="tokens")


def p7_picks(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    # What the queue could not serve as wanted; the exact sum of what there is follows.
    return _mix(spark, sf)[1].where("not reached and short").select("source")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal_spans(table(spark, sf, "documents"), table(spark, sf, "name_list")).select("doc_id", "kind", "value").distinct()


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "name_list"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND}
