"""Review questions and flashcards with the exact source of each answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..plans.barrier import where_computed
from .concepts import by_rows
from .units import FRAGMENT

QUESTION = f"video_id string, category string, rank int, question string, second bigint, answer string, fragments array<{FRAGMENT}>"


def question_key(question: Column) -> Column:
    return F.array_join(T.all_matches(F.lower(question), L.WORD + "+"), " ")


def practical_sentence(text: Column) -> Column:
    """The first sentence that advises before it names a cause or condition; null without one."""
    def claim(s: Column) -> Column:
        for c in (L.CAUSES, L.CONDITIONS):
            s = F.split(s, r"(?iu)\s+" + T.any_of(c) + r"\s+", 2)[0]
        return s

    advice = "(?iu)" + T.EDGE + T.any_of(L.ADVICE) + T.END
    return F.get(F.filter(T.sentences(text), lambda s: claim(s).rlike(advice)), F.lit(0))


def sliced(df: DataFrame, part: str, out: str = "fragments") -> DataFrame:
    """df (text, fragments) with the fragments cut to the first occurrence of column part in text; rows without one go."""
    df = df.withColumn("_a", F.call_function("instr", F.col("text"), F.col(part)) - 1).where("_a >= 0").withColumn("_b", F.col("_a") + F.char_length(part))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FRAGMENT}>").alias("kept"))

    def step(s: Column, f: Column) -> Column:
        end = s["at"] + F.char_length(f["text"])
        lo, hi = F.greatest(F.col("_a"), s["at"]), F.least(F.col("_b"), end)
        cut = F.struct(
            f["cue_index"].alias("cue_index"), f["second"].alias("second"), (f["start"] + lo - s["at"]).cast("int").alias("start"), (f["start"] + hi - s["at"]).cast("int").alias("end"),
            F.substr(f["text"], (lo - s["at"] + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("text"),
        )
        return F.struct((end + 1).alias("at"), F.when(lo < hi, F.array_append(s["kept"], cut)).otherwise(s["kept"]).alias("kept"))

    return df.withColumn(out, F.aggregate("fragments", start, step)["kept"]).drop("_a", "_b")


def evidence_for(units: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, unit...): for each term the first unit that has it, one that says what it is before others."""
    says = F.col("text").rlike("(?iu)" + T.EDGE + T.any_of(L.IS_EXPLAINED_BY) + T.END)
    # A plain look first: a pattern made from a column is compiled anew for each pair.
    both = where_computed(units.withColumn("_low", F.lower("text")).join(terms, keys).where(F.contains("_low", F.lower("term"))), T.has_term(F.col("text"), F.col("term")))
    best = F.min_by(F.struct("position", "part", "second", "text", "fragments"), F.struct((~says).alias("x"), "position", "part"))
    return both.groupBy(*keys, "term").agg(best.alias("u")).select(*keys, "term", "u.*")


def explained_topics(units: DataFrame, concepts: DataFrame, keep: int = 9) -> DataFrame:
    """(video_id, position, part, ..., topic): the concept that each unit explains. Of a topic only the first `keep` units are
    kept: a question takes the first whose evidence is free, and no more than eight can be taken."""
    text = F.col("text")
    verb = F.regexp_instr(text, F.lit("(?iu)" + T.EDGE + T.any_of(L.EXPLAINS) + T.END))
    rows = where_computed(units.withColumn("verb", verb), F.col("verb") > 0).where(~text.rlike(r"(?iu)\s+" + T.any_of(L.CAUSES) + r"\s+"))
    lead = F.get(F.filter(T.all_matches(F.lower(text), L.WORD + "+"), lambda w: ~F.array_contains(T.listed(L.STOPWORDS), w)), F.lit(0))
    rows = rows.withColumn("lead", F.coalesce(lead, F.lit("")))
    both = rows.withColumn("_low", F.lower("text")).join(concepts.select("video_id", F.col("name").alias("topic"), F.col("rank").alias("c")), "video_id")
    both = both.where(F.contains("_low", F.lower("topic"))).withColumn("at", F.regexp_instr(text, T.term_pattern(F.col("topic")))).transform(lambda d: where_computed(d, F.expr("at > 0 and at + char_length(topic) <= verb")))
    action = F.col("lead").rlike("(?:ar|er|ir)$")
    both = both.where(~action | (F.col("topic") != F.col("lead")))
    size = F.size(F.split("topic", " "))
    # After an infinitive the earliest and then longest topic, otherwise the latest and then longest; the better ranked of equals.
    choice = F.min_by("topic", F.struct(F.when(action, F.col("at")).otherwise(-F.col("at")), -size, "c"))
    unit = ["video_id", "position", "part"]
    out = both.groupBy(*unit).agg(choice.alias("topic"), F.first("second").alias("second"), F.first("text").alias("text"), F.first("fragments").alias("fragments"))
    return out.withColumn("k", F.row_number().over(W.partitionBy("video_id", "topic").orderBy("position", "part"))).where(F.col("k") <= keep).drop("k")


def basic_questions(units: DataFrame, tools: DataFrame, concepts: DataFrame, limit: int = 10, wanted: int = 4) -> DataFrame:
    """What is explained about tools first, then about concepts; no topic and no evidence twice."""
    terms = tools.where("rank <= 4").select("video_id", F.col("name").alias("term"), "rank")
    shown = evidence_for(units, terms.select("video_id", "term"), ["video_id"]).join(terms, ["video_id", "term"])
    shown = shown.where(T.explains(F.col("text"), F.col("term"))).select("video_id", F.lit(0).alias("stage"), F.struct(F.col("rank").cast("bigint").alias("a"), F.lit(0).alias("b")).alias("o"), F.col("term").alias("topic"), "position", "part", "second", "text", "fragments")
    told = explained_topics(units, concepts).select("video_id", F.lit(1).alias("stage"), F.struct(F.col("position").alias("a"), F.col("part").alias("b")).alias("o"), "topic", "position", "part", "second", "text", "fragments")
    rows = shown.unionByName(told).withColumn("oa", F.col("o.a")).withColumn("ob", F.col("o.b")).drop("o")

    def chosen(held: list[tuple]) -> list[tuple]:
        asked, topics, sources, out = set(), set(), set(), []
        for video, stage, topic, position, part, second, text, fragments in held:
            source = position, part
            if source in sources or (stage and (len(out) >= wanted or topic in topics)):
                continue
            question = f"¿Qué se explica sobre {topic}?"
            if question.lower() not in asked and len(out) < limit:
                asked.add(question.lower())
                out.append((video, "basicas", len(out) + 1, question, second, text, fragments))
            topics.add(topic if stage else topic.lower())
            sources.add(source)
        return out

    def make() -> Callable[[tuple | None], list[tuple]]:
        held: list[tuple] = []

        def step(row: tuple | None) -> list[tuple]:
            nonlocal held
            out: list[tuple] = []
            if held and (row is None or row[0] != held[0][0]):
                out, held = chosen(held), []
            if row is not None:
                held.append(row)
            return out

        return step

    placed = rows.repartition("video_id").sortWithinPartitions("video_id", "stage", "oa", "ob")
    return by_rows(placed.select("video_id", "stage", "topic", "position", "part", "second", "text", "fragments"), make, QUESTION)


def _numbered(rows: DataFrame, category: str, limit: int) -> DataFrame:
    """The first of equal questions, in order of o, at most `limit`."""
    key = question_key(F.col("question"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("video_id", key).orderBy("o"))).where("k = 1")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy("o"))).where(F.col("rank") <= limit)
    return rows.select("video_id", F.lit(category).alias("category"), "rank", "question", "second", "answer", "fragments")


def questions(units: DataFrame, tools: DataFrame, concepts: DataFrame, ideas: DataFrame, limit: int = 10) -> DataFrame:
    """(video_id, category, rank, question, second, answer, fragments) in the categories basicas, comprension and practicas."""
    text = F.col("text")
    why = units.withColumn("question", F.coalesce(T.causal_question(text), T.conditional_question(text))).where("question is not null").where(practical_sentence(text).isNull())
    why = why.select("video_id", F.struct("position", "part").alias("o"), "question", "second", text.alias("answer"), "fragments")
    how = ideas.withColumn("part_text", practical_sentence(text)).where("part_text is not null")
    how = how.withColumn("back", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("rank")))).where("back <= 3")
    how = sliced(how, "part_text").select(
        "video_id", F.struct("position", "part").alias("o"), F.concat(F.lit("¿Qué recomendación o criterio práctico se presenta sobre "), T.question_topic(F.col("part_text")), F.lit("?")).alias("question"),
        F.try_element_at("fragments", F.lit(1))["second"].alias("second"), F.col("part_text").alias("answer"), "fragments",
    )
    return basic_questions(units, tools, concepts, limit).unionByName(_numbered(why, "comprension", limit)).unionByName(_numbered(how, "practicas", limit))


def flashcards(asked: DataFrame, tools: DataFrame) -> DataFrame:
    """(video_id, card, question, answer, second, fragments, tags): a card per question in order, tagged with the first
    tool that its question names."""
    order = F.row_number().over(W.partitionBy("video_id").orderBy("category", "rank"))
    cards = asked.withColumn("card", order)
    named = cards.select("video_id", "card", "question").join(tools, "video_id").where(F.contains(F.lower("question"), F.lower("name")))
    first = named.groupBy("video_id", "card").agg(F.min_by(F.struct("category", "kind", "name"), "rank").alias("t"))
    tags = F.when(F.col("t").isNull(), F.concat(F.lit("question review type::"), "category")).otherwise(F.concat_ws(" ", F.lit("tool"), "t.category", "t.kind", "t.name", F.concat(F.lit("type::"), "category")))
    return cards.join(first, ["video_id", "card"], "left").select("video_id", "card", "question", "answer", "second", "fragments", tags.alias("tags"))
