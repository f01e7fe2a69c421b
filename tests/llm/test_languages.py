import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.llm import languages as L
from verbatlas.llm.profiles import Profiles, encode, grams, trained

TEXT = {
    "es": ["el motor auxiliar mide la presión de los tubos", "la impresora antigua guarda una capa de pintura", "cuando hay poca luz el huerto recoge las hojas", "nadie sabe muy bien por qué se cae todo"],
    "en": ["the spare engine measures the pressure in the pipes", "the old printer stores a coat of paint", "when there is little light the bed collects the leaves", "nobody really knows why it all falls over"],
    "de": ["der zweite motor misst den druck in den rohren", "der alte drucker speichert eine schicht farbe", "wenn es wenig licht gibt sammelt das beet die blätter", "keiner weiß so recht warum alles umfällt"],
}
SUB = "video_id string, language string, source_language string, is_translation boolean, first_cue int"
CUE = "video_id string, cue_index int, text string, language string, loaded_at timestamp"


@pytest.fixture(scope="module")
def model():
    return Profiles(TEXT)


def test_symbols_and_grams():
    symbols, starts = encode(["ab, c", "", "á"])
    assert symbols.tolist() == [0, 1, 2, 0, 3, 0, 0, 27] and starts.tolist() == [0, 5, 6]
    assert len(grams(symbols)) == len(symbols)


def test_distances_of_one_text_do_not_depend_on_its_neighbours(model):
    texts = [t for v in TEXT.values() for t in v] + ["", "?", "a", "🙂 text"]
    together = model.distances(texts)
    for k, t in enumerate(texts):
        assert (model.distances([t])[0] == together[k]).all(), t
    assert model.distances([]).shape == (0, 3)


def test_held_out_accuracy(spark, sf_dir):
    """Cues of tracks with a sound label, learnt on one half of the tracks and read on the other."""
    sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    label = L.language_of(F.col("language"))
    tracks = spark.read.parquet(f"{sf_dir}/subtitles.parquet").select("video_id", label.alias("lang")).where("lang is not null").distinct()
    rows = L.with_speech(spark.read.parquet(f"{sf_dir}/cues.parquet"), "text", "speech").join(tracks, "video_id").where("speech <> ''").select("video_id", "lang", "speech").collect()
    train = trained([tuple(r) for r in rows if r.video_id < "a"])
    test = [r for r in rows if r.video_id >= "a" and r.lang in train.languages]
    got = train.distances([r.speech for r in test]).argmin(axis=1)
    by_track = {}
    for r, k in zip(test, got):
        by_track.setdefault(r.video_id, []).append(train.languages[k] == r.lang)
    # Of the tracks whose label their cues bear out, hardly a cue is read in another language.
    sound = [v for v in by_track.values() if np.mean(v) > 0.8]
    assert sum(map(sum, sound)) / sum(map(len, sound)) > 0.99


def test_out_of_place(model):
    for lang, texts in TEXT.items():
        assert model.languages[int(model.out_of_place(" ".join(texts)).argmin())] == lang
    assert model.out_of_place("").tolist() == [1.0] * 3


def test_stretches():
    at = lambda s, least=5: L.stretches(np.array([int(c) for c in s]), least)
    assert at("") == [] and at("1111") == [] and at("11111") == [(0, 1)]
    assert at("1111122222") == [(0, 1), (5, 2)]
    assert at("111112222111") == [(0, 1)] and at("111222111") == [(0, 1)]
    assert at("2211111") == [(0, 1)] and at("1111122") == [(0, 1)]
    assert at("11111222233333") == [(0, 1), (9, 3)]


def track(video, langs):
    return [(video, i, TEXT[lang][i % 4], None, None) for i, lang in enumerate(langs)]


@pytest.mark.parametrize("block,overlap", [(4096, 256), (16, 8)])
def test_tracks(spark, model, block, overlap):
    rows = track("right", ["es"] * 30) + track("wrong", ["de"] * 8) + track("mixed", ["en"] * 20 + ["es"] * 25 + ["en"] * 5) + track("insert", ["es"] * 15 + ["de"] * 4 + ["es"] * 15) + track("short", ["es"] * 4)
    rows += [("right", 3, TEXT["es"][3], None, None), ("none", 1, None, None, None), ("none", 2, "[Música]", None, None), (None, 1, "x", None, None), ("right", None, "x", None, None), ("nosub", 1, "x", None, None)]
    subs = [("right", "ES-mx", None, None, 1), ("right", "ES-mx", None, None, 1), ("wrong", "English", "german", True, 1), ("mixed", "spa", None, False, 1), ("insert", " ", None, None, 1), ("short", None, None, None, 1), ("none", "xx", None, None, 1), (None, "es", None, None, 1)]
    cues, s = spark.createDataFrame(rows, CUE), spark.createDataFrame(subs, SUB)
    speech = L.with_speech(cues.select(F.col("video_id").alias("id"), F.col("cue_index").cast("bigint").alias("i"), "text").where("id is not null and i is not null"), "text", "speech").where("speech <> ''").drop("text")
    found = {(r.id, r.first_cue, r.last_cue, r.language, r.n_cues) for r in L.segments(speech, model, 5, block, overlap).collect()}
    assert found == {("right", 0, 29, "es", 30), ("wrong", 0, 7, "de", 8), ("mixed", 0, 19, "en", 20), ("mixed", 20, 44, "es", 25), ("mixed", 45, 49, "en", 5), ("insert", 0, 33, "es", 34)}
    got = L.track_languages(s, cues, model=model).collect()
    assert {(r.video_id, r.language, r.label_is, r.n_segments) for r in got} == {("right", "es", "right", 1), ("wrong", "de", "wrong", 1), ("mixed", "en", "right", 3), ("mixed", "es", "right", 3), ("insert", "es", "missing", 1)}
    assert all(0.5 <= r.confidence <= 1 for r in got)


def test_edges(spark):
    cues, subs = spark.createDataFrame([], CUE), spark.createDataFrame([], SUB)
    assert L.track_languages(subs, cues).collect() == []
    long = [("v", i, "el motor " * 20000, None, None) for i in range(6)]
    got = L.track_languages(spark.createDataFrame([("v", "es-ES", None, None, 1)], SUB), spark.createDataFrame(long, CUE)).collect()
    assert [(r.language, r.label_is) for r in got] == [("es", "right")]


def test_labels(spark):
    labels = ["es", "ES", "es-419", "es_MX", "Spanish", " español ", "Spanish (Latin America)", "ger", "Deutsch", "pt-BR", "und", "xx", "-", "", None, "mul", "est", "italiano"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(L.language_of(F.col("l"))).collect()]
    assert got == ["es"] * 7 + ["de", "de", "pt"] + [None] * 7 + ["it"]
