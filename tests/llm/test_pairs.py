import pytest

from verbatlas.llm import pairs as P
from verbatlas.session import cut

EN = ["the pump checks the amount of water before the winter comes", "the old printer stores a coat of paint in the cupboard", "a cheap sensor avoids the loose screws because of the wind", "the kitchen clock covers the missing pieces with a lot of patience"]
ES = ["la bomba revisa el consumo de agua antes de que llegue el invierno", "la impresora antigua guarda una capa de pintura en el armario", "un sensor barato evita los tornillos sueltos por culpa del viento", "el reloj de cocina cubre las piezas que faltan con mucha paciencia"]
ROW = "kind string, id bigint, video_id string, question string, answer string, defect string, language int"
LABEL = "video_id string, language string, kind string"


@pytest.mark.parametrize("answer", [None, "", "  ", "\n", "​", "&nbsp;", "<p></p>", "n/a", "N/D", "-", "...", "?", "[]", "(sin respuesta)", "TODO", "[b][/b]"])
def test_empty(answer):
    assert P.is_empty(answer)


def test_not_empty():
    assert not any(P.is_empty(x) for x in ("No", "42", "x > 3", "null pointers are checked first", "TODO lists help"))


def test_copied():
    q = "¿Por qué el panel de control mide la presión?"
    assert all(P.is_copied(q, a) for a in (q, q.upper(), "P: " + q, "Por que el panel de mide la presion", "el panel de control mide la presión", f"{q} {q}", f"<b>{q}</b>"))
    assert not any(P.is_copied(q, a) for a in ("El panel de control mide la presión para que no se caiga todo, y nadie sabe por qué.", "El panel", "Otra cosa es la presión"))
    assert not P.is_copied("", "x") and not P.is_copied("x", "")


def models():
    texts = [t.capitalize() + "." for t in EN + ES] * 8 + [f"{a.capitalize()}, {b}." for a, b in zip(EN, EN[1:])]
    refusals = ["I'm sorry, I can't help with that.", "No puedo responder a esa pregunta.", "Unfortunately I am unable to answer this question."] * 4
    return P.LanguageBayes.trained([("en", t) for t in EN] + [("es", t) for t in ES]), P.Endings(texts), P.Refusals(texts + refusals)


def test_defects_of_single_pairs():
    m = models()
    q = "Why does the far wall need a piece of cloth?"
    for answer, defect in [
        ("The pump checks the amount of water before the winter comes", None), ("The pump checks the amount of water before the", "truncated"), ("The pump checks the amount of wat", "truncated"),
        ("The pump checks the amount of water,", "truncated"), ("The pump checks the amount of water and (the", "truncated"), ("The old printer stores a coat of paint in the cup-", "truncated"),
        ("La bomba revisa el consumo de agua antes de que llegue el invierno.", "other_language"), ("The pump checks the amount of water (\"el consumo de agua\").", None),
        ("I can't help with that, ask an expert", "refusal"), ("I can't help with that", "refusal"), ("n/a", "empty"), (q.lower(), "copied"), ("The pump checks the amount of water " * 4000 + ".", None),
    ]:
        assert P.judge(q, answer, *m) == defect, answer[:80]
    assert P.judge(None, "The pump checks the amount of water before the winter comes.", *m) is None


@pytest.mark.parametrize("dots", ["…", "...", "..", " ...", "....", '..."'])
def test_a_word_cut_before_dots(dots):
    _, endings, _ = models()
    assert endings.is_truncated("The pump checks the amount of wat" + dots) and endings.is_truncated("The pump checks the amount of water before the" + dots)
    assert not endings.is_truncated("The pump checks the amount of water before the winter comes" + dots)
    # What a cut text ends in teaches no endings.
    cut = P.Endings([t.capitalize() + "." for t in EN] * 8 + ["The pump checks the amount of wat" + dots.strip(' "')] * 3)
    assert cut.is_truncated("The pump checks the amount of wat" + dots)


def test_counts_are_of_all_pairs(spark):
    """Long pairs count too, and counts added up over batches are those of all texts at once."""
    long = "The pump checks the amount of water before the winter comes. " * 100
    rows = [("q", k, "v", f"Why {t}?", a, "d", 1) for k, (t, a) in enumerate([(EN[0], long), (EN[1], None), (EN[2], "I can't help with that."), (ES[0], ES[1] + ".")])]
    got = P.counted(spark.createDataFrame(rows, ROW).repartition(3))
    answers = [r[4] for r in rows if r[4]]
    assert got == P.Endings.count(answers + [r[3] for r in rows]) + P.Refusals.count(answers)
    assert got["word", "pump"] == 101 and got["ends", "winter comes"] == 101 and got["refused", ""] == 1


def test_counts_that_are_not_held_are_looked_up(spark, sf_dir, monkeypatch):
    """Defects don't depend on how many counts the models hold."""
    q = spark.read.parquet(f"{sf_dir}/study_questions.parquet").selectExpr("'q' kind", "question_id id", "video_id", "question", "answer").limit(700)
    more = [("q", None, "v", "Why?", "The pump checks the amount of wat"), ("q", -1, "v", None, EN[0]), (None, -1, "v", "Why?", ES[0] + " y")]
    q = cut(q.unionByName(spark.createDataFrame(more, ", ".join(f"{c} {k}" for c, k in q.dtypes))))
    labels = spark.read.parquet(f"{sf_dir}/subtitles.parquet")
    whole = sorted(map(str, P.defects(q, labels).collect()))
    assert len({r.rpartition("defect=")[2] for r in whole}) > 3
    for most in (3, 100):
        monkeypatch.setattr(P, "MOST_COUNTS", most)
        got = P.counted(q)
        assert got.large == {"said", "ends", "word", "chars"} and len(got) <= 5 * most + 2 and len(got.chars) == most
        assert sorted(map(str, P.defects(q, labels).collect())) == whole


def test_neighbours_dont_count():
    """What a text is like doesn't depend on those judged along with it."""
    languages = models()[0]
    texts = [*EN, "", "x", *ES, ""]
    assert all((languages.logs(texts)[k] == languages.logs([t])[0]).all() for k, t in enumerate(texts))


def test_without_any_sample():
    none = P.LanguageBayes.trained([]), P.Endings([]), P.Refusals([])
    assert P.judge("Why?", "Because it is so.", *none) is None and P.judge("Why?", "", *none) == "empty"


def test_frames(spark):
    empty, labels = spark.createDataFrame([], ROW), spark.createDataFrame([("v", "en", "x"), (None, None, "y")], LABEL)
    assert P.defects(empty, labels).collect() == [] and P.defects(empty).collect() == []
    rows = [("q", k, "v", f"Why is it that {t}?", t.capitalize() + ".") for k, t in enumerate(EN * 5)] + [("q", 50, "v", "Why?", None), ("q", 50, "v", "Why?", None), ("q", None, None, None, "The pump"), ("card", 50, "v", None, None)]
    got = P.defects(spark.createDataFrame([(*r, "d", 1) for r in rows], ROW), labels).collect()
    assert len(got) == 20 + 3 and {(r.kind, r.id) for r in got if r.defect == "empty"} == {("q", 50), ("card", 50)}


def test_tables_have_few_defects_of_each_kind(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/study_questions.parquet").selectExpr("'q' kind", "question_id id", "video_id", "question", "answer")
    got = P.defects(q, spark.read.parquet(f"{sf_dir}/subtitles.parquet")).groupBy("defect").count().collect()
    n = {r.defect: r["count"] for r in got}
    assert n[None] > 0.7 * sum(n.values())
