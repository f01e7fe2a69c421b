"""Which of a video's subtitle tracks to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why a track was chosen, best first.
REASONS = (
    "selección registrada en info.json", "subtítulo manual en idioma solicitado", "subtítulo automático original en idioma solicitado", "traducción automática en idioma solicitado",
    "subtítulo local en idioma solicitado sin metadata", "fallback a subtítulo en inglés", "fallback controlado al subtítulo local más grande",
)


def base_language(language: Column) -> Column:
    return F.lower(F.split(F.regexp_replace(language, "-orig$", ""), "-", 2)[0])


def language_rank(language: Column, wanted: Column) -> Column:
    """0 the same, 1 its original, 2 the same language in another form, 99 another."""
    a, b = F.lower(language), F.lower(wanted)
    return F.when(a == b, 0).when(a == F.concat(b, F.lit("-orig")), 1).when(base_language(a) == base_language(b), 2).otherwise(99)


def url_parameter(url: Column, name: str) -> Column:
    """The last value, if not empty, that a URL's query gives a parameter; null without one."""
    values = F.regexp_extract_all(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(rf"(?:^|&){name}=([^&]+)"), F.lit(1))
    return F.try_element_at(values, F.lit(-1))


def has_vtt(extensions: Column) -> Column:
    """Whether a track can be had as WebVTT: one of its formats is, or none is listed. extensions: an array of the formats' ext."""
    return F.when(extensions.isNull() | (F.size(extensions) == 0), True).otherwise(F.coalesce(F.array_contains(extensions, "vtt"), F.lit(False)))


def is_translation(kind: Column, explicit: Column, source_language: Column, language: Column, url: Column) -> Column:
    """Of automatic tracks only: what is stated, else whether the source is another language, else whether the URL asks for one."""
    asked = F.coalesce(url_parameter(url, "tlang"), F.lit("")) != ""
    other = base_language(source_language) != base_language(language)
    return (kind == "automatic") & F.coalesce(explicit, F.when(F.coalesce(source_language, F.lit("")) != "", other), asked)


def inventory(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(video_id, path, language, kind, is_translation, source_language, size): the files (video_id, path, size), with what metadata
    lists of them (video_id, path, language, kind, is_translation, source_language). Manual goes before automatic before
    unknown; a file that isn't listed has its language from its name <video>.<language>.vtt."""
    order = F.when(F.col("kind") == "manual", 0).when(F.col("kind") == "automatic", 1).otherwise(2)
    best = listed.groupBy("video_id", "path").agg(F.min(F.struct(order.alias("o"), "language", "kind", F.coalesce("is_translation", F.lit(False)).alias("is_translation"), "source_language")).alias("x")).select("video_id", "path", "x.*").drop("o")
    name = F.element_at(F.split("path", "/"), -1)
    own = F.regexp_replace(F.substr(name, F.char_length("video_id") + 2), r"\.vtt$", "")
    out = files.join(best, ["video_id", "path"], "left")
    return out.select("video_id", "path", F.coalesce("language", own).alias("language"), F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("is_translation", F.lit(False)).alias("is_translation"), "source_language", "size")


def choose(candidates: DataFrame, wanted: list[str], registered: DataFrame | None = None) -> DataFrame:
    """One row per video: path, language, kind, reason, is_translation, source_language.

    candidates as `inventory` gives them. registered (video_id, path, language, kind, reason, is_translation, source_language) holds earlier
    choices; one counts if its language is wanted and a file of its name is there.
    """
    wanted = [x for x in wanted if x]
    name = F.element_at(F.split("path", "/"), -1)
    c = candidates.withColumn("file", name)
    asks = F.array(*[F.struct(F.lit(k).alias("k"), language_rank(F.col("language"), F.lit(x)).alias("r")) for k, x in enumerate(wanted)]).cast("array<struct<k:int,r:int>>") if wanted else F.array().cast("array<struct<k:int,r:int>>")
    ask = F.array_min(F.filter(asks, lambda a: a["r"] < 99))
    kind, asked = F.col("kind"), F.col("ask").isNotNull()
    tier = (
        F.when(asked & (kind == "manual") & ~F.col("is_translation"), 1).when(asked & (kind == "automatic") & ~F.col("is_translation"), 2).when(asked & (kind == "automatic"), 3)
        .when(asked & (kind == "unknown") & ~F.col("is_translation"), 4).when(base_language(F.col("language")) == "en", 5).otherwise(6)
    )
    c = c.withColumn("ask", ask).withColumn("tier", tier)
    k = F.when(kind == "manual", 0).when(kind == "automatic", 1).otherwise(2)
    n, size = F.lit(None).cast("int"), F.coalesce(F.col("size"), F.lit(0))
    # Wanted languages: the order asked, closeness, name. English: manual first, originals first, name. The rest: size, first name.
    order = F.when(F.col("tier") <= 4, F.struct(F.col("ask.k").cast("bigint").alias("a"), F.col("ask.r").alias("b"), "file")).when(F.col("tier") == 5, F.struct(k.cast("bigint").alias("a"), F.col("is_translation").cast("int").alias("b"), "file"))
    order = order.otherwise(F.struct((-size).cast("bigint").alias("a"), F.lit(0).alias("b"), "file"))
    chosen = c.groupBy("video_id").agg(F.min_by(F.struct("path", "language", "kind", F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("tier") + 1).alias("reason"), "is_translation", "source_language"), F.struct("tier", order.alias("o"))).alias("x"))
    if registered is not None:
        there = c.select("video_id", "file", F.col("path").alias("there"))
        match = F.lit(True) if not wanted else language_rank(F.col("language"), F.lit(wanted[0])) < 99
        for x in wanted[1:]:
            match = match | (language_rank(F.col("language"), F.lit(x)) < 99)
        old = registered.where((F.coalesce("language", F.lit("")) != "") & match).withColumn("file", name).join(there, ["video_id", "file"])
        old = old.groupBy("video_id").agg(F.min(F.struct(F.col("there").alias("path"), "language", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("reason", F.lit(REASONS[0])).alias("reason"), F.coalesce("is_translation", F.lit(False)).alias("is_translation"), "source_language")).alias("y"))
        chosen = chosen.join(old, "video_id", "left").select("video_id", F.coalesce("y", "x").alias("x"))
    return chosen.select("video_id", "x.*")
