import pytest
from pyspark.sql import functions as F

from verbatlas.functions import plain
from verbatlas.functions import text as T
from verbatlas.functions.timecode import code, seconds


def value(spark, expression, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("ts,want", [("00:01", 1), ("01:02:03", 3723), ("100:00:00.999", 360000), ("02:03.5", 123), (" 00:07 ", 7), ("--:--", None), ("", None), (None, None), ("7", None), ("1:2:3:4", None), ("a:b", None)])
def test_seconds(spark, ts, want):
    assert value(spark, seconds, ts) == want


def test_code(spark):
    assert [value(spark, lambda t, s=s: code(F.lit(s))) for s in (0, 59, 3723, 360000)] == ["00:00:00", "00:00:59", "01:02:03", "100:00:00"]


def test_terms_and_tokens(spark):
    assert value(spark, T.terms, "Node.js, el-servidor y _uno_ de 2024 á12-.") == ["node.js", "el-servidor", "uno", "2024", "á12"]
    assert sorted(value(spark, T.content_tokens, "El servidor guarda 2024 datos del servidor.")) == ["datos", "guarda", "servidor"]
    assert value(spark, T.content_tokens, "") == []


@pytest.mark.parametrize(
    "a,b,same",
    [("usa el puerto seguro", "usa el puerto seguro", True), ("no usa el puerto", "usa el puerto", False), ("usa 2 puertos libres", "usa 3 puertos libres", False), ("el muy muy rápido motor", "el muy rápido motor", False), ("", "", False)],
)
def test_similarity_in_and_outside_the_jvm(spark, a, b, same):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.similarity(F.col("a"), F.col("b")).alias("v")).first().v
    assert got == plain.similarity(a, b) and (got >= plain.NEAR) == same


def test_similarity_agrees_over_all_cues(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/cues.parquet").where("text is not null").select("text").distinct().limit(400).collect()]
    pairs = list(zip(texts, texts[1:]))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.similarity(F.col("a"), F.col("b")).alias("v")).collect()
    assert all(r.v == pytest.approx(plain.similarity(r.a, r.b)) for r in got)


def test_sentences(spark):
    long = "Una frase que tiene bastante más de cincuenta caracteres en total"
    assert value(spark, T.sentences, f"{long}. Corta. {long}!") == [f"{long}.", f"{long}!"]
    assert value(spark, T.sentences, f"{long} Ahora {long.lower()}") == [long, f"Ahora {long.lower()}"]
    assert value(spark, T.sentences, "  ") == []


@pytest.mark.parametrize(
    "text,noise",
    [("[Música]", True), ("", True), ("[aplausos] bueno", True), ("[risas] el motor auxiliar", False), ("Recuerden suscribirse al canal y activar las notificaciones", True), ("Suscribirse al canal", False),
     ("Un momento, voy a probar el micrófono", True), ("Probar el micrófono", False), ("No sé, pasamos a otra cosa", True), ("No sé qué decir", False)],
)
def test_noise(spark, text, noise):
    assert value(spark, T.is_noise, text) is noise


def test_fillers(spark):
    assert [value(spark, T.filler_penalty, x) for x in ("eh, mmm", "bueno bueno", "a ver, esto", "eh eh eh eh eh", "ehh hem")] == [2.5, 1.25, 1.25, 4.0, 0.0]


def test_questions(spark):
    assert value(spark, T.causal_question, "El motor se para porque falta agua") == "¿Por qué se afirma que el motor se para?"
    assert value(spark, T.causal_question, "SSH falla mucho hoy ya que no hay red") == "¿Por qué se afirma que SSH falla mucho hoy?"
    assert value(spark, T.causal_question, "Para porque sí") is None
    assert value(spark, T.conditional_question, "Riega la planta cuando haga calor") == "¿En qué situación se afirma que riega la planta?"
    assert value(spark, T.question_topic, "Conviene revisar el motor auxiliar y la bomba") == "revisar motor auxiliar"
    assert value(spark, T.question_topic, "el abono reduce la plaga") == "abono" and value(spark, T.question_topic, "de la que") == "este tema"


def test_explains(spark):
    term = lambda t: T.explains(t, F.lit("Tmux"))
    assert [value(spark, term, x) for x in ("Con tmux. se puede seguir", "Es mejor tmux", "tmux es útil porque sí", "tmux-x es otro", "usa tmux aquí")] == [True, False, False, False, False]
    assert value(spark, lambda t: T.has_term(t, F.lit("c++")), "usa C++ hoy") is True


def test_aliases(spark):
    assert value(spark, T.folded, "Ñandú  ÍNDICE, straße!") == "nandu indice strasse"
    assert value(spark, lambda t: T.contains_alias(t, F.lit("índice")), "El INDICE.") is True
    assert value(spark, lambda t: T.contains_alias(t, F.lit("ind")), "El INDICE.") is False and value(spark, lambda t: T.contains_alias(t, F.lit("?")), "a ? b") is False
    assert value(spark, lambda t: T.occurrences(t, F.lit("a b")), "a b a b, c a b") == 2
    groups = F.array(F.array(F.lit("x"), F.lit("agua")), F.array(F.lit("motor")))
    assert value(spark, lambda t: T.matches_groups(t, groups), "motor de agua") is True and value(spark, lambda t: T.matches_groups(t, groups), "motor") is False


def test_captions(spark):
    assert value(spark, T.caption_text, "&lt;b&gt;uno&nbsp;&amp;  dos</b><c.x>!") == "uno & dos!"
    merge = lambda *x: value(spark, lambda t: T.merged_lines(F.array(*[F.lit(y) for y in x])))
    assert merge("hola", "hola a todos", "hola", "otra") == "hola a todos otra"


@pytest.mark.parametrize(
    "url,want",
    [("https://v.example/w?v=1&t=9#x", "https://v.example/w?v=1&t=65#x"), ("http://v.example", "http://v.example?t=65"), ("https://v.example/w?a=&t=1&a=2", "https://v.example/w?a=&a=2&t=65"), ("ftp://v.example", None), (None, None)],
)
def test_urls(spark, url, want):
    assert value(spark, lambda t: T.url_at(t, F.lit(65)), url) == want


def test_small_ones(spark):
    assert [value(spark, lambda t, k=k: T.retry_seconds(F.lit(k))) for k in (0, 1, 2, 4, 9)] == [1, 1, 2, 8, 8]
    assert value(spark, T.version_parts, "2024.08.6rc1") == [2024, 8, 6, 1]
    assert [value(spark, lambda t, s=s: T.duration_label(F.lit(s).cast("double"))) for s in (None, 0, 61.9, 3661)] == ["N/D", "N/D", "1:01", "1:01:01"]


@pytest.mark.parametrize("text", ["caf&eacute; &#233; &#xE9;", "&amp;lt;b&gt;", "a &lt;b&gt;c&lt;/b&gt; d", "&notanentity; &#0; & &;", "&#128512; ok", "&ldquo;x&rdquo; &hellip; &nbsp;&#160;y", "5 &lt; 6 &euro;", None, ""])
def test_entities(spark, text):
    import html

    got = spark.createDataFrame([(text,)], "t string").select(T.unescaped(F.col("t"))).first()[0]
    want = None if text is None else html.unescape(text)
    assert got == (want if text != "&notanentity; &#0; & &;" else text)


@pytest.mark.parametrize("text,want", [("Ő ș ﬁn Ｆｕｌｌ ĳs", "o s fin full ijs"), ("Straße ÑANDÚ", "strasse nandu"), ("e\u0301 ﬀ", "e ff"), ("plain 12", "plain 12")])
def test_folding(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.folded(F.col("t"))).first()[0] == want


def test_aliases_are_normalised(spark):
    got = spark.createDataFrame([("El Gerd y gerdo usan CLOU.",)], "t string").select(T.with_aliases(F.col("t"), {"gerd|herder": "Herdr", "clou": "Claudio"})).first()[0]
    assert got == "El Herdr y gerdo usan Claudio."
