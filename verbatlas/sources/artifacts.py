"""Study files: their text as columns, and publishing them.

Every file is a row (video_id, file, content); texts are made by ordered aggregation, one row per video,
and written by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArtifactPublicationError, VideoDataError
from ..functions import text as T
from ..functions.timecode import code
from ..session import cut

FILES = (
    "info.json", "transcript.txt", "transcript_clean.txt", "transcript_paragraphs.md", "summary.md", "tools.md", "tools.json", "concepts.md", "concepts.json", "questions.md", "flashcards.md", "study_guide.md", "study.md", "anki.csv",
)


def escaped(text: Column) -> Column:
    """As HTML text."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def reference(stamp: Column, url: Column, second: Column) -> Column:
    """[stamp], linked to the video at that time where it has a URL."""
    at = T.url_at(url, second)
    return F.when(at.isNull(), F.concat(F.lit("["), stamp, F.lit("]"))).otherwise(F.concat(F.lit("["), stamp, F.lit("]("), at, F.lit(")")))


def anki_card(cards: DataFrame) -> DataFrame:
    """Adds front, back and tags to cards (video_id, question, answer, ts, tags, channel, url)."""
    from ..functions.timecode import seconds

    ts = F.coalesce("ts", F.lit(""))
    at = T.url_at(F.col("url"), seconds(F.col("ts")))
    shown = F.when(at.isNull(), escaped(ts)).otherwise(F.concat(F.lit('<a href="'), escaped(at), F.lit('">'), escaped(ts), F.lit("</a>")))
    back = F.when(ts == "", F.col("answer")).otherwise(F.concat("answer", F.lit("<br><br>Referencia: "), shown))
    channel = F.regexp_replace(F.trim(F.coalesce("channel", F.lit(""))), r"\s+", "_")
    filled = lambda c: F.when(c != "", c)
    tags = F.concat_ws(" ", F.concat(F.lit("video::"), "video_id"), F.concat(F.lit("channel::"), filled(channel)), filled(F.coalesce("tags", F.lit(""))))
    return cards.withColumn("front", F.col("question")).withColumn("back", back).withColumn("tags", tags)


def joined(rows: DataFrame, order: list[str], line: Column, sep: str = "\n") -> DataFrame:
    """(video_id, text): a video's lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), line.alias("l"))))
    return rows.groupBy("video_id").agg(F.array_join(F.transform(lines, lambda x: x["l"]), sep).alias("text"))


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def study_files(result: dict[str, DataFrame], videos: DataFrame, now: str) -> DataFrame:
    """(video_id, file, content) of all FILES of the videos (video_id, title, channel, duration, url, subtitle: struct)."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    urls = videos.select("video_id", "url")
    stamped = lambda df: df.join(urls, "video_id", "left").withColumn("ref", reference(code(F.col("second")), F.col("url"), F.col("second")))
    head = videos.select("video_id", "title")

    def of(text: DataFrame, name: str) -> DataFrame:
        return text.withColumnRenamed("text", name)

    cues = result["cues"]
    words = joined(result["keywords"].where("rank <= 15"), ["rank"], line("- ", F.col("term"), ": ", F.col("n").cast("string")))
    told = joined(stamped(result["ideas"]), ["rank"], line("- ", F.col("ref"), " ", F.col("text")))
    parts = joined(result["sections"], ["chunk"], line("### ", F.col("start"), " - ", F.col("end"), "\nTema aproximado: ", F.when(F.col("topic") == "", "N/D").otherwise(F.col("topic")), "\n\n", F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("- "), s, F.lit("\n"))), "")))
    kind = F.when(F.col("kind") == "known", "conocida").otherwise("posible/desconocida")
    tool_lines = line("## ", F.col("name"), "\n\n- Categoría: ", F.col("category"), "\n- Procedencia: ", kind, "\n- Menciones: ", F.col("n").cast("string"), "\n- Descripción: ", F.coalesce("description", F.lit("")), "\n")
    tool_text = joined(result["tools"], ["rank"], tool_lines)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.struct("name", F.col("n").alias("count"), "description", "category", "kind").alias("t"))))
    tool_json = result["tools"].groupBy("video_id").agg(F.to_json(F.transform(listed, lambda x: x["t"]), {"ignoreNullFields": "false", "pretty": "true"}).alias("text"))
    from ..functions.timecode import seconds

    score = lambda c: F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("N/D"))
    linked = result["concepts"].join(urls, "video_id", "left").withColumn("refs", F.array_join(F.transform("timestamps", lambda t: reference(t, F.col("url"), seconds(t))), ", "))
    concept_lines = line("## ", F.col("name"), "\n\n- Puntuación: ", score("score"), "\n- Menciones: ", F.col("n").cast("string"), "\n- Frecuencia: ", score("frequency"), "\n- Distribución: ", score("distribution"), "\n- Asociación: ", F.when(F.col("association").isNull(), "N/D").otherwise(score("association")), "\n- Referencias: ", F.col("refs"), "\n")
    concept_text = joined(linked, ["rank"], concept_lines)
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.struct("name", "score", F.col("n").alias("count"), F.col("frequency").alias("frequency_score"), F.col("distribution").alias("distribution_score"), F.col("association").alias("association_score"), "timestamps").alias("c"))))
    concept_json = result["concepts"].groupBy("video_id").agg(F.to_json(F.transform(ranked, lambda x: x["c"]), {"ignoreNullFields": "false", "pretty": "true"}).alias("text"))
    asked = stamped(result["questions"])
    order = F.array_position(F.array(F.lit("basicas"), F.lit("comprension"), F.lit("practicas")), F.col("category")).alias("place")
    asked = asked.withColumn("place", order)
    title = F.when(F.col("category") == "basicas", "Básicas").when(F.col("category") == "comprension", "Comprensión").otherwise("Prácticas")
    question_lines = line(F.when(F.col("rank") == 1, line("\n## ", title, "\n\n")).otherwise(""), F.col("rank").cast("string"), ". ", F.col("question"), "\n   - Respuesta: ", F.col("answer"), "\n   - Referencia: ", F.col("ref"))
    question_text = joined(asked, ["place", "rank"], question_lines)
    key_text = joined(asked.withColumn("n", F.row_number().over(_by("video_id", "place", "rank"))).where("n <= 8"), ["place", "rank"], line("- ", F.col("question"), " [", code(F.col("second")), "]"))
    cards = stamped(result["cards"])
    card_text = joined(cards, ["card"], line("Q: ", F.col("question"), "\nA: ", F.col("answer"), "\nReferencia: ", F.col("ref"), "\nTags: ", F.col("tags"), "\n"))
    channel = videos.select("video_id", F.col("channel"))
    anki = anki_card(result["cards"].withColumn("ts", code(F.col("second"))).join(urls, "video_id", "left").join(channel, "video_id", "left"))
    anki_text = joined(anki, ["card"], F.concat_ws(",", csv_field(F.col("front")), csv_field(F.col("back")), csv_field(F.col("tags"))), "\r\n")
    understood = joined(result["tools"].where("rank <= 8"), ["rank"], line("- ", F.col("name"), ": ", F.coalesce("description", F.lit(""))))
    chunks = _chunks(cues)
    named = {
        "lines": joined(cues, ["cue_index"], line("[", code(F.col("second")), "] ", F.col("text"))), "plain": joined(cues, ["cue_index"], F.col("text")), "blocks": joined(chunks, ["chunk"], line("## ", F.col("start"), " - ", F.col("end"), "\n\n", F.col("text"), "\n")),
        "words": words, "told": told, "parts": parts, "tools": tool_text, "tool_json": tool_json, "concepts": concept_text, "concept_json": concept_json, "questions": question_text, "keys": key_text, "cards": card_text, "anki": anki_text, "understood": understood,
    }
    wide = head
    for name, text in named.items():
        wide = wide.join(of(text, name), "video_id", "left")
    c = lambda name, default="": F.coalesce(name, F.lit(default))
    info = F.to_json(F.struct(F.col("video_id").alias("id"), "title", F.col("channel").alias("uploader"), "duration", F.col("url").alias("webpage_url"), F.col("subtitle").alias("source_subtitle"), F.struct(F.lit(3).alias("format_version"), F.lit(now).alias("generated_at")).alias("analysis")), {"ignoreNullFields": "false", "pretty": "true"})
    wide = wide.join(videos.select("video_id", info.alias("info")), "video_id", "left")
    none_tools, none_concepts = "No se detectaron herramientas conocidas.\n", "No se detectaron conceptos relevantes.\n"
    contents = {
        "info.json": F.col("info"), "transcript.txt": line(c("lines"), "\n"), "transcript_clean.txt": line(c("plain"), "\n"), "transcript_paragraphs.md": line("# Transcripción por bloques\n\n", c("blocks")),
        "summary.md": line("# Resumen de estudio: ", F.col("title"), "\n\n## Palabras clave\n\n", c("words"), "\n\n## Ideas importantes con timestamp\n\n", c("told"), "\n\n## Resumen por bloques\n\n", c("parts")),
        "tools.md": line("# Herramientas detectadas\n\n", c("tools", none_tools)), "tools.json": c("tool_json", "[]"), "concepts.md": line("# Conceptos detectados\n\n", c("concepts", none_concepts)), "concepts.json": c("concept_json", "[]"),
        "questions.md": line("# Preguntas de repaso\n", c("questions", "\nSin preguntas generadas."), "\n"), "flashcards.md": line("# Flashcards\n\n", c("cards")),
        "study_guide.md": line("# Guía de estudio: ", F.col("title"), "\n\n## 1. Qué debes entender\n\n", c("understood"), "\n\n## 2. Cómo estudiar el video\n\n1. Lee primero `summary.md`.\n2. Revisa `tools.md` para identificar herramientas.\n3. Revisa en `concepts.md` los conceptos ordenados y sus referencias temporales.\n4. Contesta `questions.md` sin mirar la transcripción.\n5. Repasa con `flashcards.md`.\n\n## 3. Preguntas clave\n\n", c("keys"), "\n"),
        "study.md": line("# Estudio consolidado: ", F.col("title"), "\n\n_Formato de análisis: 3_\n\n## Resumen\n\n### Palabras clave\n\n", c("words", "Sin palabras clave."), "\n\n### Ideas importantes\n\n", c("told", "Sin ideas generadas."), "\n\n## Herramientas\n\n", c("tools", none_tools), "\n## Conceptos\n\n", c("concepts", none_concepts), "\n## Preguntas\n", c("questions", "\nSin preguntas generadas."), "\n\n## Flashcards\n\n", c("cards")),
        "anki.csv": line("\ufeffFront,Back,Tags\r\n", c("anki"), "\r\n"),
    }
    rows = F.array(*[F.struct(F.lit(f).alias("file"), contents[f].alias("content")) for f in FILES])
    return wide.select("video_id", F.explode(rows).alias("x")).select("video_id", "x.*")


def _by(key: str, *order: str):
    from pyspark.sql import Window as W

    return W.partitionBy(key).orderBy(*order)


def _chunks(cues: DataFrame) -> DataFrame:
    from ..operators.captions import chunks

    return chunks(cues, ["video_id"], "cue_index", "second", "text")


def publish(files: DataFrame, folder: str) -> int:
    """Writes every file to folder/<video_id>/<file>, folder being one that all executors share: each goes to a name of its own beside
    its place and is then put there at once, so a task that is repeated or lost leaves no half file. All names and contents are checked
    before the first is put in its place. Returns their number."""
    plain = lambda c: F.coalesce((F.col(c) != "") & ~F.col(c).isin(".", "..") & ~F.contains(c, F.lit("/")) & ~F.contains(c, F.lit("\\")), F.lit(False))
    files = cut(files)
    bad = files.where(~plain("video_id") | ~plain("file")).limit(1).collect()
    if bad:
        raise ValueError(f"not a plain name: {bad[0].video_id!r}/{bad[0].file!r}")
    missing = files.where("content is null").limit(1).collect()
    if missing:
        raise VideoDataError(f"no content for {missing[0].video_id}/{missing[0].file}")
    twice = files.groupBy("video_id", "file").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"named twice: {twice[0].video_id}/{twice[0].file}")

    def write(rows: Iterator) -> Iterator[int]:
        import os
        import uuid

        n = 0
        for r in rows:
            for part in (r["video_id"], r["file"]):
                if not part or os.path.basename(part) != part or part in (".", ".."):
                    raise ValueError(f"not a plain name: {part!r}")
            where = os.path.join(folder, r["video_id"])
            os.makedirs(where, exist_ok=True)
            temp = os.path.join(where, f".{r['file']}.{uuid.uuid4().hex}.tmp")
            with open(temp, "w", encoding="utf-8", newline="") as f:
                f.write(r["content"])
                f.flush()
                os.fsync(f.fileno())
            os.replace(temp, os.path.join(where, r["file"]))
            n += 1
        yield n

    def write_batches(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"n": list(write(iter(f.to_dict("records"))))})

    try:
        return files.mapInPandas(write_batches, "n bigint").agg({"n": "sum"}).first()[0] or 0
    except PySparkException as e:
        raise ArtifactPublicationError(f"publication is incomplete, captions are untouched; put it right and run it again: {folder}") from e
