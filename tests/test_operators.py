"""Core operators on small inputs with results derived by hand, and invariants over whole tables."""

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from verbatlas.operators import captions, concepts, ideas, keywords, library, questions, search, subtitles, tools, units
from verbatlas.queries import QUERIES, SQL, timed_cues
from verbatlas.session import cut

CUES = "video_id string, cue_index bigint, second bigint, text string, core int"


def cues(spark, texts, step=3):
    return spark.createDataFrame([("v", i, i * step if isinstance(t, str) else t[0], t if isinstance(t, str) else t[1], 1) for i, t in enumerate(texts)], CUES)


def test_keywords_ties_go_by_first_place(spark):
    df = spark.createDataFrame([("a", "motor bomba motor filtro bomba 2024 de"), ("b", None), ("c", "")], "k string, t string")
    assert [(r.k, r.rank, r.term, r.n) for r in keywords.keywords(df, ["k"], "t", 2).orderBy("rank").collect()] == [("a", 1, "motor", 2), ("a", 2, "bomba", 2)]


def test_tools(spark):
    catalog = spark.createDataFrame([("Tmux", "d", "tool", ["tmx"]), ("ssh", "s", "tool", None)], "name string, description string, category string, aliases array<string>")
    df = spark.createDataFrame([(1, "usa tmux, TMX y SSH. pero ssh-agent no; GNU GNU MacBook MacBook MacBook node.JS node.JS", 0)], "k int, t string, o int")
    got = [(r.name, r.n, r.kind) for r in tools.tool_mentions(df, ["k"], "t", catalog, order="o").orderBy("rank").collect()]
    # "SSH." isn't counted: a dot belongs to the run.
    assert got == [("tmux", 2, "known"), ("MacBook", 3, "unknown"), ("GNU", 2, "unknown"), ("JS", 2, "unknown"), ("node.JS", 2, "unknown")]


def test_unknown_tools_of_all_texts(spark, sf_dir):
    """Texts in any script, against a plain pass with Python's words."""
    import re

    shapes = [r"\b[a-zA-Z][a-zA-Z0-9]*(?:[.-][a-zA-Z0-9]+)+\b", r"\b[A-Z]{2,8}\b", r"\b[A-Z][a-z]+(?:[A-Z][a-z0-9]+)+\b"]
    texts = ["El código usa GPIO, ¿GPIO? ÑGPIO éGPIO GPIOß _GPIO", "Größe: OpenScad – OpenScadé no, OpenScad.", "año node-red y node-red; node-redé"]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "source string, doc_id int, text string")
    assert sorted((r.name, r.n) for r in tools.unknown_tools(df, ["source"], "text", order="doc_id").collect()) == [("GPIO", 2), ("OpenScad", 2), ("node-red", 2)]
    counts = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null and text is not null").collect():
        for name in (m for x in shapes for m in re.findall(x, r.text)):
            counts[r.source.strip(" ").lower(), name] = counts.get((r.source.strip(" ").lower(), name), 0) + 1
    known = {r.name.lower() for r in spark.read.parquet(f"{sf_dir}/tools.parquet").collect() if r.name}
    out = {*known, *tools.L.STOPWORDS}
    want = {(*k, n) for k, n in counts.items() if n >= 2 and k[1] not in tools.L.IGNORED_CANDIDATES and k[1].lower().strip(".-") not in out}
    assert {tuple(r) for r in QUERIES["unknown_candidates"](spark, sf_dir).select("source", "name", "n").collect()} == want


def test_rolling_overlap(spark):
    got = captions.without_overlap(cues(spark, ["Hola a todos", "a todos, bienvenidos", "bienvenidos", (60, "bienvenidos"), "  ", (63, "otra cosa")])).orderBy("cue_index").collect()
    assert [(r.cue_index, r.text) for r in got] == [(0, "Hola a todos"), (1, "bienvenidos"), (3, "bienvenidos"), (5, "otra cosa")]


def endless(spark):
    """Cues that keep blocks out of step: captions without punctuation and one index missing, a caption shown again
    hundreds of times, a few sentences in turns for minutes."""
    words = [f"w{k} a{k} b{k} c{k} d{k}" for k in range(700)]
    rows = [("plain", k, 3 * k, t) for k, t in enumerate(words) if k != 11]
    rows += [("again", 0, 0, "a b c"), *[("again", k, 3 * k, "b c") for k in range(1, 400)], ("again", 400, 1200, "a b c d"), ("again", 401, 1203, "c d e.")]
    rows += [("turns", k, 4 * k, f"frase número {('uno', 'dos', 'tres')[k % 3]} sobre bombas {('verdes', 'rojas', 'azules')[k % 3]}.") for k in range(300)]
    return spark.createDataFrame(rows, "video_id string, cue_index int, second int, text string")


@pytest.mark.parametrize("operator", ["overlap", "units", "spoken", "windows"])
def test_blocks_change_nothing(spark, sf_dir, operator):
    """Long sequences cut into blocks give what one pass over them gives."""
    every = cut(timed_cues(spark, sf_dir).unionByName(endless(spark)))
    run = {"overlap": captions.without_overlap, "units": units.sentence_units, "spoken": lambda d, block: units.sentence_units(d, block, overlap=True), "windows": lambda d, block: units.windows(d, block=block)}[operator]
    few = every.where("cue_index < 60 and video_id > 'n' or video_id in ('again', 'plain') and cue_index < 410")
    for rows, blocks in ((every, [512]), (few, [2, 3, 7])):
        rows = cut(units.sentence_units(rows)) if operator == "windows" else rows
        whole, *parts = (sorted(map(str, run(rows, block=b).collect())) for b in (10**9, *blocks))
        assert all(p == whole for p in parts) and len(whole) > 50


def test_units(spark):
    got = units.sentence_units(cues(spark, ["El Dr. Paz usa la 3. 11 hoy. Luego", "sigue aquí", (60, "tras la pausa"), "[Música]", "uno", "dos", "tres", "cuatro", "cinco"])).orderBy("position", "part").collect()
    assert [(r.position, r.part, r.text) for r in got] == [
        (0, 0, "El Dr. Paz usa la 3. 11 hoy."), (0, 1, "Luego sigue aquí"), (2, 0, "tras la pausa"), (3, 0, "[Música]"), (4, 0, "uno dos tres cuatro"), (8, 0, "cinco"),
    ]
    assert all(units.is_source_of(r.text, r.fragments) for r in got)


def test_windows(spark):
    base = units.sentence_units(cues(spark, [f"Frase número {w} sobre un tema distinto {w}." for w in ("agua", "agua", "fuego", "tierra", "aire")]))
    got = [(r.position, r.text.count("Frase")) for r in units.windows(base).orderBy("position").collect()]
    assert got == [(0, 3), (4, 1)]
    assert [(r.position, r.text.count("Frase")) for r in units.windows(base, distinct=False).orderBy("position").collect()] == [(0, 3), (3, 2)]


def test_every_unit_is_its_source(spark, sf_dir):
    rows = timed_cues(spark, sf_dir)
    texts = {(r.video_id, r.cue_index): r.text for r in rows.collect()}
    for r in units.sentence_units(rows).collect():
        assert units.is_source_of(r.text, r.fragments) and all(texts[r.video_id, f.cue_index][f.start : f.end] == f.text for f in r.fragments)


def test_chunks(spark):
    got = captions.chunks(cues(spark, [(10, "a"), (299, "b"), (700, "c"), (20, "d")]), ["video_id"], "cue_index", "second", "text").orderBy("chunk").collect()
    assert [(r.start, r.end, r.text) for r in got] == [("00:00:00", "00:05:00", "a b"), ("00:10:00", "00:15:00", "c"), ("00:00:00", "00:05:00", "d")]


def test_ngrams_and_choice(spark):
    df = spark.createDataFrame([("k", 0, 5, "la base de datos, muy lenta")], "k string, unit int, second int, text string")
    got = {r.name: r.hinted for r in concepts.ngrams(df, ["k"]).collect()}
    assert set(got) == {"la", "base", "de", "datos", "muy", "lenta", "la base", "base de", "de datos", "la base de", "base de datos", "muy lenta"}
    assert got["base"] and got["base de"] and got["lenta"] and not got["datos"]
    # "ab" drives out "a" even though it then gives way to "abc".
    assert concepts.choose([("a", {"ab"}), ("abc", set()), ("ab", {"abc"}), ("d", set())], 9) == ["abc", "d"]
    assert concepts.choose([("x", set()), ("y", set())], 1) == ["x"]


def test_concepts(spark):
    text = ["La base de datos guarda pedidos.", "Una base de datos falla.", "El riego profundo ayuda."]
    base = units.sentence_units(cues(spark, text, step=30)).withColumn("unit", F.struct("position", "part"))
    got = {r.name: r for r in concepts.concepts(base, ["video_id"]).collect()}
    top = got["base de datos"]
    assert top.n == 2 and top.timestamps == ["00:00:00", "00:00:30"] and top.association == 1.0 and top.frequency == 1.0
    # Two of three bins: 0.45 + 0.25 * 2 / 3 + 0.30 + 0.08 + 0.12, at most 1.
    assert top.distribution == pytest.approx(0.666667) and top.score == 1.0
    assert "base" not in got and "datos" not in got and "riego profundo" in got


def test_concepts_of_large_keys_are_the_same(spark):
    """What is counted in parts gives what one pass over a key gives, also where the first best candidates don't suffice."""
    said = "El panel solar lento guarda energía; una bomba pequeña del jardín, la base de datos con índices y el riego profundo de raíces ayuda - no falla".split(" ")
    rows = [(f"v{v}", k, v, k * 7 % 40, " ".join(said[(k * 3 + v) % 9 : (k * 5 + v) % 9 + 9])) for v in range(3) for k in range(12 * (v + 1))]
    df = spark.createDataFrame([*rows, (None, 0, 0, 1, "sin clave")], "video_id string, p bigint, q int, second bigint, text string").select("video_id", F.struct("p", "q").alias("unit"), "second", "text")
    parts = df.withColumn("fragments", F.expr("array(struct(second as second, split_part(text, ' ', 1) as text), struct(second - 30 as second, substr(text, instr(text, ' ') + 1) as text))"))
    for units_of in (df, parts):
        whole = sorted(map(str, concepts.concepts(units_of, ["video_id"]).collect()))
        assert len(whole) > 20
        assert sorted(map(str, concepts.concepts(units_of, ["video_id"], many=20).collect())) == whole
        assert sorted(map(str, concepts.concepts(units_of, ["video_id"], many=0, first=3).collect())) == sorted(map(str, concepts.concepts(units_of, ["video_id"], first=3).collect())) == whole


def test_concepts_of_few_units_shuffle_no_ngrams(spark):
    """A key of few units is counted where its units are: the plan joins and sends no n-grams."""
    df = spark.createDataFrame([("v", k, k, "la base de datos guarda pedidos lentos") for k in range(5)], "video_id string, unit int, second bigint, text string")
    plan = concepts.concepts(df, ["video_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_ideas_stream_the_best_windows(spark, monkeypatch):
    """Windows aren't handed to pandas by video, and a video whose first best say the same is asked for more."""
    by_video = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: by_video(self, f, schema) if f.__module__ != ideas.__name__ else pytest.fail("windows go to pandas"))
    other = lambda w: f"El {w} guarda {w}res nuevos y {w}ción antigua sobre cada {w}do grande de {w}mente lenta."
    said = [(v, k, 0, k * 20, "La bomba dos mueve toda el agua limpia del jardín hacia el tanque alto de la casa vieja." if k < 9 else other("abcdefghijklmn"[k - 9] * 4)) for v, n in (("a", 14), ("b", 11)) for k in range(n)]
    df = spark.createDataFrame(said, "video_id string, position bigint, part int, second bigint, text string")
    df = df.withColumn("fragments", F.expr("array(struct(position as cue_index, second, 0 as start, length(text) as end, text))"))
    got = [sorted(map(str, ideas.ideas(df, limit=4, first=first).collect())) for first in (1, 3, 128)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 4 + 3


def test_basic_questions_stream(spark):
    """Questions are chosen row by row, a video after the other, without a frame for each video."""
    rows = [(v, k, 0, k, f"La base de datos sirve para guardar pedidos {k}.") for v in ("a", "b") for k in range(3)] + [("b", 9, 0, 9, "El riego profundo ayuda y permite raíces.")]
    df = spark.createDataFrame(rows, "video_id string, position bigint, part int, second bigint, text string")
    df = df.withColumn("fragments", F.expr("array(struct(position as cue_index, second, 0 as start, length(text) as end, text))"))
    named = spark.createDataFrame([("a", "base de datos", 1), ("c", "x", 1)], "video_id string, name string, rank int")
    found = spark.createDataFrame([(v, n, k) for v in ("a", "b") for k, n in enumerate(("base de datos", "riego profundo"), 1)], "video_id string, name string, rank int")
    asked = questions.basic_questions(df, named, found)
    assert sorted((r.video_id, r["rank"], r.question, r.second) for r in asked.collect()) == [
        ("a", 1, "¿Qué se explica sobre base de datos?", 0), ("b", 1, "¿Qué se explica sobre base de datos?", 0), ("b", 2, "¿Qué se explica sobre riego profundo?", 9),
    ]
    assert "InPandas" not in asked._jdf.queryExecution().toString()


def test_library(spark):
    entry = "id string, title string, channel string, duration double, url string, path string, tools array<string>, created_at string, updated_at string"
    old = spark.createDataFrame([("a", "A", None, 1.0, None, "p", ["x"], "c1", "u1"), ("b", "B", None, None, None, "p", [], None, None)], entry)
    new = spark.createDataFrame([("a", "A2", None, 1.0, None, "p", ["x"]), ("c", "C", None, None, None, "p", [])], entry.split(", created_at")[0])
    got = {r.id: (r.title, r.created_at, r.updated_at) for r in library.upsert(old, new, "now").collect()}
    assert got == {"a": ("A2", "c1", "now"), "b": ("B", None, None), "c": ("C", "now", "now")}
    found = spark.createDataFrame([("a", "A", None, 1.0, None, "p", None), ("b", "B!", None, None, None, "p", ["t"]), ("d", "D", None, None, None, "p", None)], entry.split(", created_at")[0])
    got = {r.id: (list(r.tools), r.created_at, r.updated_at) for r in library.rebuilt(found, old, "now").collect()}
    assert got == {"a": (["x"], "c1", "u1"), "b": (["t"], "now", "now"), "d": ([], "now", "now")}
    versions = spark.createDataFrame([("a", "old", None, 1.0, None, "p", [], "c", "2024-01-01T00:30:00+01:00"), ("a", "new", None, 1.0, None, "p", [], "c", "2024-01-01T00:00:00Z"), (None, "x", None, 1.0, None, "p", [], "c", None)], entry)
    assert [(r.id, r.title) for r in library.latest(versions).collect()] == [("a", "new")]


def test_a_change_without_a_path_is_no_lost_change(spark):
    entry = "id string, title string, channel string, duration double, url string, path string, tools array<string>, created_at string, updated_at string"
    old = spark.createDataFrame([("a", "A", None, 1.0, None, "p", [], "c1", "u1")], entry)
    new = spark.createDataFrame([("a", "A2", None, 1.0, None, None, []), ("n", "N", None, None, None, None, None)], entry.split(", created_at")[0])
    assert {r.id: (r.title, r.path, r.created_at, r.updated_at) for r in library.upsert(old, new, "now").collect()} == {"a": ("A2", None, "c1", "now"), "n": ("N", None, "now", "now")}


def test_search(spark):
    lines = spark.createDataFrame([("v", 0, "[00:00:01] Uno"), ("v", 1, "[00:00:02] dos 100%_"), ("v", 2, "sin tiempo"), ("w", 0, "[00:00:03] DOS")], "video_id string, line_no int, line string")
    names = spark.createDataFrame([("v", "V", 2), ("w", None, 1)], "id string, title string, place int")
    got = search.search(lines, "Dos", library=names, context=1).collect()
    assert [(r.video_id, r.title, r.timestamp, r.line, r.before, r.after) for r in got] == [("w", "w", "00:00:03", "DOS", [], []), ("v", "V", "00:00:02", "dos 100%_", ["[00:00:01] Uno"], ["sin tiempo"])]
    assert search.search(lines, "100%_", limit=1).count() == 1 and search.search(lines, "00:00:0", video_id="w").count() == 1 and search.search(lines, "nada").collect() == []


@pytest.mark.parametrize(
    "tracks,wanted,chosen",
    [
        ([("es", "automatic", False), ("es-419", "manual", False)], ["es"], "es-419"), ([("es", "manual", True), ("es-orig", "automatic", False)], ["es"], "es-orig"), ([("es-orig", "automatic", False), ("es", "automatic", False)], ["es"], "es"),
        ([("en", "manual", False), ("es", "automatic", True)], ["es"], "es"), ([("fr", "manual", False), ("es", "manual", False)], ["es", "fr"], "es"), ([("pt", "unknown", False), ("es", "unknown", False)], ["es"], "es"),
        ([("en", "unknown", False), ("en-GB", "manual", False), ("pt", "manual", False)], ["es"], "en-GB"), ([("it", "manual", False), ("pt", "manual", False)], ["es"], "pt"), ([("it", "manual", False)], [], "it"),
    ],
)
def test_subtitle_choice(spark, tracks, wanted, chosen):
    rows = [("v", f"d/v.{x}.vtt", x, kind, tr, None, k) for k, (x, kind, tr) in enumerate(tracks)]
    df = spark.createDataFrame(rows, "video_id string, path string, language string, kind string, is_translation boolean, source_language string, size bigint")
    assert subtitles.choose(df, wanted).first().language == chosen
    old = df.where(F.col("language") == tracks[-1][0]).withColumn("reason", F.lit(None).cast("string")).withColumn("path", F.regexp_replace("path", "^d/", "old/"))
    got = subtitles.choose(df, [], old).first()
    assert got.language == tracks[-1][0] and got.path.startswith("d/") and got.reason == subtitles.REASONS[0]


def test_translation_and_inventory(spark):
    url = lambda u: spark.range(1).select(subtitles.is_translation(F.lit("automatic"), F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit("es"), F.lit(u)).alias("v")).first().v
    assert url("https://x.example/?tlang=&tlang=es#tlang=") is True and url("https://x.example/#?tlang=es") is False
    assert url("https://x.example/?tlang=es") is True and url("https://x.example/?lang=es") is False
    listed = spark.createDataFrame([("v", "d/v.es.vtt", "es", "automatic", False, None), ("v", "d/v.es.vtt", "es", "manual", False, None), ("v", "d/gone.vtt", "fr", "manual", False, None)], "video_id string, path string, language string, kind string, is_translation boolean, source_language string")
    there = spark.createDataFrame([("v", "d/v.es.vtt", 5), ("v", "d/v.pt-BR.vtt", 6)], "video_id string, path string, size bigint")
    assert sorted((r.path, r.language, r.kind) for r in subtitles.inventory(listed, there).collect()) == [("d/v.es.vtt", "es", "manual"), ("d/v.pt-BR.vtt", "pt-BR", "unknown")]


def test_queries_and_sql_have_the_same_columns(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute("set TimeZone='UTC'")
    import glob
    import os

    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in SQL.items():
        want = db.sql(sql)
        got = QUERIES[name](spark, sf_dir)
        assert sorted(got.columns) == sorted(want.columns), name
        assert got.count() == len(want.fetchall()), name
