"""Files the analyses read: WebVTT captions, info.json, library.json, tools.json, the tool catalogue, transcripts and the quality corpus."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import seconds
from ..operators.library import kind_of, validated


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files, invalid UTF-8 left out as far as it shows."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\ufffd"), F.lit("")).alias("value"))
    return df


def parse_vtt(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, cue_index, ts, second, text) of WebVTT texts (key, value). A cue is a time line and the lines up to the next blank or header line;
    lines of digits are numbers of cues, text without a time line is lost, cues without readable time or text go."""
    lines = files.select(key, F.posexplode(F.split("value", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]")).alias("no", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^[\s\u00a0\ufeff]+|[\s\u00a0]+$", "")))
    time = F.contains("line", F.lit("-->"))
    edge = (F.col("line") == "") | F.col("line").rlike("^(?:WEBVTT|Kind:|Language:|NOTE)") | time
    w = W.partitionBy(key).orderBy("no")
    lines = lines.withColumn("edge", edge).withColumn("block", F.sum(F.when(edge, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    clean = F.when(~F.col("edge") & ~F.col("line").rlike(r"^\d+$"), F.struct("no", T.caption_text(F.col("line")).alias("t")))
    blocks = lines.groupBy(key, "block").agg(F.max(F.when(time, F.trim(F.split("line", "-->", 2)[0]))).alias("start"), F.array_sort(F.collect_list(clean)).alias("parts"))
    parts = F.filter(F.transform("parts", lambda x: x["t"]), lambda t: t != "")
    blocks = blocks.where("start is not null").select(key, "block", F.split("start", r"\.", 2)[0].alias("ts"), T.merged_lines(parts).alias("text")).where("text <> ''")
    blocks = blocks.withColumn("second", seconds(F.col("ts"))).where("second is not null")
    return blocks.select(key, (F.row_number().over(W.partitionBy(key).orderBy("block")) - 1).cast("bigint").alias("cue_index"), "ts", "second", "text")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of .vtt files; video_id and language come from names <video>.<language>.vtt."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    cues = parse_vtt(text_files(spark, path))
    return cues.select(F.split(name, r"\.", 2)[0].alias("video_id"), F.regexp_extract(name, r"^[^.]*\.(.*)\.vtt$", 1).alias("language"), "cue_index", "ts", "second", "text")


def parse_info(files: DataFrame) -> DataFrame:
    """(path, id, title, uploader, duration, webpage_url, source_subtitle: JSON text, format_version, reason) of info.json texts (path, value); reason is null
    for a sound one. Types count as they stand in the JSON, a title defaults to the id."""
    v = F.col("v")
    df = files.withColumn("v", F.try_parse_json("value"))
    text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    kind = lambda f: kind_of(v, f"$.{f}")
    none = lambda f: kind(f).isNull() | (kind(f) == "VOID")
    whole = "^(?:BIGINT|INT|SMALLINT|TINYINT)"
    number = F.coalesce(kind("duration").rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(v, "$.duration", "double") >= 0), F.lit(False))
    version = F.try_variant_get(v, "$.analysis.format_version", "bigint")
    sub = kind("source_subtitle")
    sub_bad = ~none("source_subtitle") & (sub != "STRING") & ~(sub.startswith("OBJECT") & F.coalesce((kind("source_subtitle.path") == "STRING") & (kind("source_subtitle.language") == "STRING"), F.lit(False)))
    checks = [
        (~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "no object"), (~F.coalesce((kind("id") == "STRING") & (text("id") != ""), F.lit(False)), "id"), (~none("title") & ((kind("title") != "STRING") | (text("title") == "")), "title"),
        *((~none(f) & (kind(f) != "STRING"), f) for f in ("uploader", "webpage_url")), (~none("duration") & ~number, "duration"), (sub_bad, "source_subtitle"),
        (~none("analysis.format_version") & ~(kind("analysis.format_version").rlike(whole) & (version > 0)), "analysis.format_version"),
    ]
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks])
    return df.select("path", text("id").alias("id"), F.coalesce(text("title"), text("id")).alias("title"), text("uploader").alias("uploader"), F.try_variant_get(v, "$.duration", "double").alias("duration"), text("webpage_url").alias("webpage_url"), F.to_json(F.try_variant_get(v, "$.source_subtitle", "variant")).alias("source_subtitle"), version.alias("format_version"), reason.alias("reason"))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a library.json with reason, null for valid ones; none for a file that is missing or empty. ValueError if it isn't a library."""
    if not os.path.exists(path) or not os.path.getsize(path):
        return validated(spark.createDataFrame([], "index int, value string"))
    try:
        with open(path, encoding="utf-8") as f:
            videos = json.load(f)["videos"]
        if not isinstance(videos, list):
            raise TypeError
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"no library: {path}; rebuild it") from e
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(videos)]
    return validated(spark.createDataFrame(rows, "index int, value string"))


def write_library(entries: DataFrame, path: str) -> None:
    """Puts the library in place of the old file at once. It is one JSON document, so its rows pass the driver."""
    import tempfile

    rows = [{k: v for k, v in r.asDict().items()} for r in entries.orderBy(F.desc(F.coalesce("updated_at", F.lit(""))), "id").toLocalIterator()]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".library.", suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump({"videos": rows}, f, ensure_ascii=False, indent=2)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def parse_tool_names(files: DataFrame) -> DataFrame:
    """(path, tools) of tools.json texts: different names in order, null where the text isn't a list of named objects."""
    v = F.try_parse_json("value")
    names = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda t: F.when(F.schema_of_variant(F.try_variant_get(t, "$.name", "variant")) == "STRING", F.try_variant_get(t, "$.name", "string")))
    sound = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)) & F.forall(names, lambda n: F.coalesce(n != "", F.lit(False)))
    return files.select("path", F.when(sound, F.array_distinct(names)).alias("tools"))


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The tool catalogue (name, description, category, aliases) and names never taken for unknown tools."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    rows = [(t["name"].lower(), t["description"], t["category"], [a.lower() for a in t.get("aliases", [])]) for t in data["tools"]]
    return spark.createDataFrame(list({r[0]: r for r in rows}.values()), "name string, description string, category string, aliases array<string>"), [x.lower() for x in data.get("unknown_candidate_exclusions", [])]


CORPUS = (
    "schema_version int, cases array<struct<id:string,profile:string,vtt:string,topics:array<struct<id:string,aliases:array<string>,timestamps:array<string>>>,standalone_claims:array<struct<id:string,marker_groups:array<array<string>>,timestamps:array<string>>>,"
    "noise_rules:array<struct<id:string,scope:string,aliases:array<string>,max_occurrences:int>>,question_targets:array<struct<id:string,category:string,prompt_groups:array<array<string>>,answer_groups:array<array<string>>,timestamps:array<string>>>,"
    "concept_targets:array<struct<id:string,aliases:array<string>,timestamps:array<string>,compound:boolean>>>>"
)


# Where a noise rule looks, and kinds of questions.
SCOPES, CATEGORIES = ("ideas", "concepts", "question_prompts", "question_answers"), ("basicas", "comprension", "practicas")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Targets as operators.quality.evaluate takes them, with profile and vtt. A corpus of another version raises, and so does one with repeated ids,
    a list of targets that is empty, a scope or category that isn't known, or a noise rule without a sound maximum."""
    from ..errors import QualityCorpusError
    from ..operators.quality import CORPUS_VERSION

    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", CORPUS).alias("c")).select("c.*")
    head = raw.select("schema_version", F.size("cases").alias("n"), F.size(F.array_distinct(F.transform("cases", lambda c: c["id"]))).alias("ids")).first()
    if not head or head.schema_version != CORPUS_VERSION or head.n < 1 or head.n != head.ids:
        raise QualityCorpusError(f"no corpus of version {CORPUS_VERSION}: {path}")
    lists = ("topics", "standalone_claims", "noise_rules", "question_targets", "concept_targets")
    whole = lambda x: (F.size(x) > 0) & (F.size(F.array_distinct(F.transform(x, lambda t: t["id"]))) == F.size(x)) & F.forall(x, lambda t: F.trim(t["id"]) != "")
    sound = F.lit(True)
    for x in lists:
        sound = sound & F.coalesce(whole(F.col(f"c.{x}")), F.lit(False))
    sound = sound & F.forall("c.noise_rules", lambda r: F.coalesce(r["scope"].isin(*SCOPES) & (r["max_occurrences"] >= 0), F.lit(False)))
    sound = sound & F.forall("c.question_targets", lambda q: F.coalesce(q["category"].isin(*CATEGORIES), F.lit(False))) & F.forall("c.concept_targets", lambda t: t["compound"].isNotNull())
    bad = raw.select(F.explode("cases").alias("c")).where(~sound).select("c.id").limit(1).collect()
    if bad:
        raise QualityCorpusError(f"case {bad[0].id} of {path} isn't sound")
    claims = F.transform("c.standalone_claims", lambda x: F.struct(x["id"].alias("id"), x["marker_groups"].alias("groups"), x["timestamps"].alias("timestamps")))
    return raw.select(F.explode("cases").alias("c")).select(F.col("c.id").alias("case_id"), "c.profile", "c.vtt", "c.topics", claims.alias("claims"), "c.noise_rules", "c.question_targets", "c.concept_targets")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(location, metric, value) of a baseline file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    places = {"macro": data["macro"], **{f"case:{k}": v["metrics"] for k, v in data["cases"].items()}}
    rows = [(place, m, float(v)) for place, metrics in places.items() for m, v in metrics.items() if not isinstance(v, bool)]
    return spark.createDataFrame(rows, "location string, metric string, value double")
