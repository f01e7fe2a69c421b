"""Two annotated transcripts of our own, analysed from caption file to metrics."""

import json

import pytest
from pyspark.sql import functions as F

from verbatlas.operators import quality as Q
from verbatlas.plans.analysis import analyze
from verbatlas.sources import files as S

VTT = """WEBVTT
Kind: captions
Language: es

1
00:00:01.000 --> 00:00:05.000
El compost maduro mejora la estructura del suelo y retiene agua

00:00:05.000 --> 00:00:09.000
El compost maduro mejora la estructura del suelo y retiene agua
porque alimenta la vida microscópica.

00:00:40.000 --> 00:00:46.000
<c>La base de datos relacional permite guardar los pedidos</c> de la tienda.

00:00:47.000 --> 00:00:52.000
Conviene revisar la base de datos relacional antes de cada cierre &amp; copiar los pedidos.

00:01:30.000 --> 00:01:32.000
[Música]
"""


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("vtt")
    (folder / "demo.es.vtt").write_text(VTT, encoding="utf-8")
    cues = S.read_vtt(spark, str(folder / "*.vtt"))
    catalog = spark.createDataFrame([("pedidos", "Lista de compras", "tool", ["compras"])], "name string, description string, category string, aliases array<string>")
    return analyze(cues, catalog)


def test_cues(result):
    got = [(r.cue_index, r.second, r.text) for r in result["cues"].orderBy("cue_index").collect()]
    assert got == [
        (0, 1, "El compost maduro mejora la estructura del suelo y retiene agua"), (1, 5, "porque alimenta la vida microscópica."),
        (2, 40, "La base de datos relacional permite guardar los pedidos de la tienda."), (3, 47, "Conviene revisar la base de datos relacional antes de cada cierre & copiar los pedidos."), (4, 90, "[Música]"),
    ]


def test_units_keep_their_source(result):
    got = result["units"].orderBy("position").collect()
    assert [(r.position, r.second) for r in got] == [(0, 1), (2, 40), (3, 47)]
    assert got[0].text == "El compost maduro mejora la estructura del suelo y retiene agua porque alimenta la vida microscópica."
    texts = {r.cue_index: r.text for r in result["cues"].collect()}
    for r in got:
        assert " ".join(f.text for f in r.fragments) == r.text
        assert all(texts[f.cue_index][f.start : f.end] == f.text for f in r.fragments)


def test_tools_concepts_questions(result):
    assert [(r.name, r.n, r.kind) for r in result["tools"].collect()] == [("pedidos", 1, "known")]
    names = {r.name: r for r in result["concepts"].collect()}
    assert "base de datos" in names or "datos relacional" in names
    assert all(0 <= r.score <= 1 and len(r.timestamps) == len(set(r.timestamps)) for r in names.values())
    asked = {(r.category, r.question) for r in result["questions"].collect()}
    assert ("comprension", "¿Por qué se afirma que el compost maduro mejora la estructura del suelo y retiene agua?") in asked
    assert any(c == "practicas" for c, _ in asked)
    for r in result["questions"].collect():
        assert " ".join(f.text for f in r.fragments) == r.answer
    cards = result["cards"].collect()
    assert len(cards) == len(asked) and all(c.tags.endswith(("basicas", "comprension", "practicas")) for c in cards)


def test_quality(spark, result, tmp_path):
    corpus = {"schema_version": 2, "cases": [{
        "id": "demo", "profile": "p", "vtt": "demo.es.vtt", "topics": [{"id": "a", "aliases": ["compost maduro"], "timestamps": ["00:00:01"]}, {"id": "b", "aliases": ["riego"], "timestamps": ["00:00:01"]}],
        "standalone_claims": [{"id": "c", "marker_groups": [["ESTRUCTURA", "forma"], ["suelo"]], "timestamps": ["00:00:01"]}], "noise_rules": [{"id": "n", "scope": "ideas", "aliases": ["música"], "max_occurrences": 0}],
        "question_targets": [{"id": "q", "category": "comprension", "prompt_groups": [["compost"]], "answer_groups": [["suelo"]], "timestamps": ["00:00:01", "00:00:05"]}],
        "concept_targets": [{"id": "k", "aliases": ["Cómpost maduro"], "timestamps": ["00:00:01"], "compound": True}, {"id": "z", "aliases": ["nada"], "timestamps": [], "compound": False}],
    }]}
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(corpus), encoding="utf-8")
    report = Q.evaluate(result, S.read_corpus(spark, str(path)))
    r = report.first()
    assert (r.topic_coverage, r.standalone_claim_coverage, r.noise_rule_violation_rate, r.useful_question_recall, r.summary_duplicate_rate) == (0.5, 1.0, 0.0, 1.0, 0.0)
    assert 0 < r.useful_question_precision < 1 and r.concept_coverage == 0.5 == r.concept_timestamp_recall / 2
    now = Q.long_metrics(report)
    assert Q.regressions(now, now).collect() == []
    better = now.withColumn("value", F.when(F.col("metric") == "topic_coverage", 0.9).otherwise(F.col("value")))
    assert {(x.location, x.metric, x.actual) for x in Q.regressions(now, better).collect()} == {("macro", "topic_coverage", 0.5), ("case:demo", "topic_coverage", 0.5)}
    with pytest.raises(Q.QualityCorpusError):
        Q.regressions(now, now.where("location = 'macro'"))
    path.write_text(json.dumps(corpus | {"schema_version": 3}), encoding="utf-8")
    with pytest.raises(Q.QualityCorpusError):
        S.read_corpus(spark, str(path))


def test_matching():
    assert Q.matching([(0, 0), (0, 1), (1, 0)]) == 2 and Q.matching([]) == 0 and Q.matching([(0, 0), (1, 0), (2, 0)]) == 1


def test_files(spark, result, tmp_path):
    from verbatlas.sources.artifacts import FILES, publish, study_files

    videos = spark.createDataFrame([("demo", "Un título", "Mi canal", 95.0, "https://v.example/w?v=demo&t=4", None)], "video_id string, title string, channel string, duration double, url string, subtitle struct<path:string,language:string>")
    files = study_files(result, videos, "2026-01-01T00:00:00+00:00")
    assert publish(files, str(tmp_path)) == len(FILES)
    read = lambda f: (tmp_path / "demo" / f).read_bytes().decode("utf-8")
    assert sorted(p.name for p in (tmp_path / "demo").iterdir()) == sorted(FILES)
    assert read("transcript.txt").startswith("[00:00:01] El compost maduro") and read("transcript.txt").endswith("\n")
    assert "- [00:00:01](https://v.example/w?v=demo&t=1) " in read("summary.md")
    assert read("anki.csv").startswith("﻿Front,Back,Tags\r\n") and "channel::Mi_canal" in read("anki.csv")
    assert json.loads(read("info.json"))["duration"] == 95.0 and json.loads(read("tools.json"))[0]["name"] == "pedidos"
    assert {c["name"] for c in json.loads(read("concepts.json"))} == {r.name for r in result["concepts"].collect()}
    with pytest.raises(Exception, match="plain name"):
        publish(spark.createDataFrame([("..", "x", "y")], "video_id string, file string, content string"), str(tmp_path))


def test_a_baseline_belongs_to_its_corpus(spark, tmp_path):
    import hashlib

    from verbatlas.errors import AppError, QualityCorpusError

    assert Q.digest(b"corpus", [("a", b"one"), ("b", b"two")]) == hashlib.sha256(b"corpusaonebtwo").hexdigest()
    rows = [("a", *[0.5] * len(Q.METRICS), 1, 2, 3), ("b", *[1.0] * len(Q.METRICS), 1, 2, 3)]
    report = spark.createDataFrame(rows, ["case_id", *Q.METRICS, "ideas", "questions", "concepts"])
    head = {"metric_version": 3, "corpus_schema_version": 2, "corpus_digest": "x", "analysis_format_version": 3}
    payload = Q.report_payload(report, **head)
    assert payload["cases"]["a"]["metrics"]["topic_coverage"] == 0.5 and payload["cases"]["b"]["ideas"] == 1 and payload["macro"]["concept_precision"] == 0.75
    Q.same_corpus(payload, json.loads(json.dumps(payload)))
    for wrong in ({"metric_version": 2}, {"corpus_digest": "y"}, {"cases": {"a": 1}}):
        with pytest.raises(QualityCorpusError):
            Q.same_corpus(payload, payload | wrong)
    assert issubclass(QualityCorpusError, AppError)


@pytest.mark.parametrize("change", [{"topics": []}, {"noise_rules": [{"id": "n", "scope": "titles", "aliases": ["x"], "max_occurrences": 0}]}, {"noise_rules": [{"id": "n", "scope": "ideas", "aliases": ["x"], "max_occurrences": -1}]}, {"question_targets": [{"id": "q", "category": "otras", "prompt_groups": [["x"]], "answer_groups": [["x"]], "timestamps": ["00:00:01"]}]}])
def test_corpora_are_checked(spark, tmp_path, change):
    from verbatlas.errors import QualityCorpusError

    case = {
        "id": "c", "profile": "p", "vtt": "c.vtt", "topics": [{"id": "t", "aliases": ["x"], "timestamps": ["00:00:01"]}], "standalone_claims": [{"id": "s", "marker_groups": [["x"]], "timestamps": ["00:00:01"]}],
        "noise_rules": [{"id": "n", "scope": "ideas", "aliases": ["x"], "max_occurrences": 0}], "question_targets": [{"id": "q", "category": "basicas", "prompt_groups": [["x"]], "answer_groups": [["x"]], "timestamps": ["00:00:01"]}],
        "concept_targets": [{"id": "k", "aliases": ["x"], "timestamps": ["00:00:01"], "compound": False}],
    }
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"schema_version": 2, "cases": [case]}))
    assert S.read_corpus(spark, str(path)).count() == 1
    path.write_text(json.dumps({"schema_version": 2, "cases": [case | change]}))
    with pytest.raises(QualityCorpusError):
        S.read_corpus(spark, str(path))


def test_nothing_is_published_unless_all_can_be(spark, tmp_path):
    from verbatlas.errors import ArtifactPublicationError, VideoDataError
    from verbatlas.sources.artifacts import publish

    rows = lambda *x: spark.createDataFrame(list(x), "video_id string, file string, content string")
    good = ("v", "a.md", "text")
    for bad, error in ((("v", "../b", "x"), ValueError), (("v", "", "x"), ValueError), (("v", "b.md", None), VideoDataError), (good, ValueError)):
        with pytest.raises(error):
            publish(rows(good, bad), str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    assert publish(rows(good), str(tmp_path)) == 1 and (tmp_path / "v" / "a.md").read_text() == "text"
    (tmp_path / "w").write_text("in the way of a folder")
    with pytest.raises(ArtifactPublicationError):
        publish(rows(("w", "a.md", "text")), str(tmp_path))
