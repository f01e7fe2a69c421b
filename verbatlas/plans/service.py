"""From caption files to published study files and the library index."""

from __future__ import annotations

import os
import shutil
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidLibraryError
from ..operators import captions, library, search, subtitles
from ..sources import artifacts, files
from .analysis import analyze


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def requested_languages(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def track_files(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, path, size) of folder/<video>/<video>.<language>.vtt."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.vtt").load(os.path.join(folder, "*"))
    path = F.regexp_replace("path", "^file:/+", "/")
    return df.select(F.element_at(F.split(path, "/"), -2).alias("video_id"), path.alias("path"), F.col("length").alias("size"))


def resolve(library_path: str, stored: str) -> str:
    """Where a video's folder is: absolute, or as it stands, or from the data folder, which older paths begin with."""
    if os.path.isabs(stored) or os.path.exists(stored):
        return stored
    data = os.path.dirname(library_path)
    first = stored.split(os.sep, 1)[0]
    return os.path.join(os.path.dirname(data) if first == os.path.basename(data) else data, stored)


def infos(spark: SparkSession, folder: str) -> DataFrame:
    """info.json of folder/<video>/, with name (the video's folder) and reason (null if sound and of that name)."""
    parsed = files.parse_info(files.text_files(spark, os.path.join(folder, "*", "info.json")))
    name = F.element_at(F.split("path", "/"), -2)
    return parsed.withColumn("name", name).withColumn("reason", F.coalesce("reason", F.when(F.col("id") != F.col("name"), F.lit("id"))))


SELECTION = "path string, language string, kind string, reason string, is_translation boolean, source_language string"


def registered(spark: SparkSession, folder: str) -> DataFrame | None:
    """(video_id, path, language, kind, reason, is_translation, source_language): the tracks that the videos' info.json names."""
    if not _has_info(folder):
        return None
    known = infos(spark, folder).where("reason is null").select(F.col("id").alias("video_id"), F.from_json("source_subtitle", SELECTION).alias("x"))
    return known.where("x.path is not null").select("video_id", "x.*")


def analyze_folder(spark: SparkSession, folder: str, catalog: DataFrame, languages: list[str], now: str | None = None, listed: DataFrame | None = None, video_id: str | None = None) -> int:
    """Chooses each video's track, analyses all videos together, or the one named, and publishes their files beside their captions. listed
    (video_id, path, language, kind, is_translation, source_language) is what a site's metadata says of the tracks; an earlier choice in a
    video's info.json counts first. Returns the number of files."""
    now = now or utc_now()
    there = track_files(spark, folder)
    if video_id is not None:
        there = there.where(F.col("video_id") == video_id)
    chosen = subtitles.choose(subtitles.inventory(_listed(spark) if listed is None else listed, there), languages, registered(spark, folder))
    cues = files.parse_vtt(files.text_files(spark, os.path.join(folder, "*", "*.vtt")).withColumn("path", F.regexp_replace("path", "^file:/+", "/")))
    cues = cues.join(chosen.select("video_id", "path"), "path").select("video_id", "cue_index", "second", "text")
    known = infos(spark, folder).where("reason is null").select(F.col("id").alias("video_id"), "title", F.col("uploader").alias("channel"), "duration", F.col("webpage_url").alias("url")) if _has_info(folder) else None
    videos = cues.select("video_id").distinct()
    track = chosen.select("video_id", F.struct("path", "language", "kind", "reason", "is_translation", "source_language").alias("subtitle"))
    if known is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("channel", "string"), ("duration", "double"), ("url", "string"))]
        videos = videos.select("video_id", F.col("video_id").alias("title"), *none)
    else:
        videos = videos.join(known, "video_id", "left").withColumn("title", F.coalesce("title", "video_id"))
    return artifacts.publish(artifacts.study_files(analyze(cues, catalog), videos.join(track, "video_id"), now), folder)


def _listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "video_id string, path string, language string, kind string, is_translation boolean, source_language string")


def _has_info(folder: str) -> bool:
    return any(os.path.exists(os.path.join(folder, d, "info.json")) for d in os.listdir(folder))


def rebuild(spark: SparkSession, library_path: str, folder: str, now: str | None = None) -> tuple[int, list[str]]:
    """Makes the library anew from the videos' info.json and tools.json. An index that can't be read, or has invalid entries, is copied aside
    first. Returns the number of entries and what was skipped."""
    now = now or utc_now()
    backup = False
    try:
        before = files.read_library(spark, library_path)
        backup = not before.where("reason is not null").isEmpty()
    except ValueError:
        before, backup = files.validated(spark.createDataFrame([], "index int, value string")), True
    before = before.where("reason is null")
    names = sorted(d for d in (os.listdir(folder) if os.path.isdir(folder) else []) if os.path.isdir(os.path.join(folder, d)))
    skipped = [f"{d}: falta info.json" for d in names if not os.path.exists(os.path.join(folder, d, "info.json"))]
    if len(skipped) < len(names):
        found = infos(spark, folder)
        skipped += [f"{r.name}: {r.reason}" for r in found.where("reason is not null").select("name", "reason").toLocalIterator()]
        found = found.where("reason is null")
        if any(os.path.exists(os.path.join(folder, d, "tools.json")) for d in names):
            named = files.parse_tool_names(files.text_files(spark, os.path.join(folder, "*", "tools.json"))).select(F.element_at(F.split("path", "/"), -2).alias("id"), "tools")
        else:
            named = spark.createDataFrame([], "id string, tools array<string>")
        base = os.path.relpath(os.path.abspath(folder), os.path.dirname(os.path.abspath(library_path)))
        entries = found.join(named, "id", "left").select("id", "title", F.col("uploader").alias("channel"), "duration", F.col("webpage_url").alias("url"), F.concat(F.lit(base + "/"), "name").alias("path"), "tools")
        entries = library.rebuilt(entries, before.select(*library.FIELDS, "created_at", "updated_at"), now)
    else:
        entries = spark.createDataFrame([], library.ENTRY)
    n = entries.count()
    if backup and os.path.exists(library_path) and os.path.getsize(library_path):
        stamp, k = datetime.now(UTC).strftime("%Y%m%d%H%M%S"), 0
        while os.path.exists(target := f"{library_path}.corrupt-{stamp}" + (f"-{k}" if k else "")):
            k += 1
        shutil.copy2(library_path, target)
    files.write_library(entries, library_path)
    return n, sorted(skipped)


def upsert(spark: SparkSession, library_path: str, changes: DataFrame, now: str | None = None) -> None:
    """Writes changes (FIELDS) into the library; refuses if it has invalid entries."""
    entries = files.read_library(spark, library_path)
    if not entries.where("reason is not null").isEmpty():
        raise InvalidLibraryError(f"the library has invalid entries; rebuild it: {library_path}")
    files.write_library(library.upsert(entries.select(*library.FIELDS, "created_at", "updated_at"), changes, now or utc_now()), library_path)


def search_library(spark: SparkSession, library_path: str, query: str, *, video_id: str | None = None, limit: int = 10, context: int = 0) -> DataFrame:
    """Search of the transcripts of the library's videos; one without a transcript has no lines."""
    entries = library.ordered(files.read_library(spark, library_path).where("reason is null"))
    if video_id:
        entries = entries.where(F.col("id") == video_id)
    paths = {r.id: os.path.join(resolve(library_path, r.path), "transcript.txt") for r in entries.select("id", "path").toLocalIterator()}
    there = {os.path.abspath(p): v for v, p in paths.items() if os.path.exists(p)}
    if not there:
        return search.search(spark.createDataFrame([], "video_id string, line_no int, line string"), query, limit=limit)
    owner = spark.createDataFrame([(p, v) for p, v in there.items()], "path string, video_id string")
    text = spark.read.text(sorted(there), wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), "value")
    lines = text.join(owner, "path").select("video_id", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r\n|[\n\r\x0b\x0c\u0085\u2028\u2029]")).alias("line_no", "line"))
    return search.search(lines, query, library=entries.select("id", "title", "updated_at"), limit=limit, context=context)


__all__ = ["analyze_folder", "captions", "rebuild", "search_library", "upsert"]
