import json
import os

import pytest
from pyspark.sql import functions as F

from verbatlas import cli
from verbatlas.operators import captions
from verbatlas.plans import service
from verbatlas.sources import files as S
from verbatlas.streaming import live

VTT = "WEBVTT\n\n00:01.000 --> 00:04.000\nEl servidor tmux mantiene sesiones abiertas durante todo el día.\n\n00:06.000 --> 00:08.000\nOtra línea habla de la impresora.\n"


@pytest.fixture
def data(tmp_path):
    folder = tmp_path / "data" / "videos"
    for v in ("v1", "v2"):
        (folder / v).mkdir(parents=True)
        (folder / v / f"{v}.es.vtt").write_text(VTT, encoding="utf-8")
        (folder / v / "info.json").write_text(json.dumps({"id": v, "title": f"Video {v}", "uploader": None, "duration": 61, "webpage_url": "https://v.example/" + v}), encoding="utf-8")
    (folder / "v1" / "v1.en.vtt").write_text(VTT, encoding="utf-8")
    (folder / "bad").mkdir()
    (folder / "bad" / "info.json").write_text('{"id": 7}', encoding="utf-8")
    (folder / "none").mkdir()
    catalog = tmp_path / "catalog.json"
    catalog.write_text(json.dumps({"tools": [{"name": "Tmux", "description": "d", "category": "tool", "aliases": []}], "unknown_candidate_exclusions": []}), encoding="utf-8")
    return folder, tmp_path / "data" / "library.json", catalog


def test_from_captions_to_search(spark, data, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    folder, index, catalog = data
    assert cli.run(["analyze", str(folder), "--catalog", str(catalog), "--lang", "es"]) == 0
    assert json.loads((folder / "v1" / "info.json").read_text())["source_subtitle"]["language"] == "es"
    assert cli.run(["rebuild-library", str(folder), "--library", str(index)]) == 0
    out = capsys.readouterr().out
    assert "2 entries" in out and "bad: id" in out and "none: falta info.json" in out
    got = json.loads(index.read_text())["videos"]
    assert {(v["id"], tuple(v["tools"])) for v in got} == {("v1", ("tmux",)), ("v2", ("tmux",))}
    first = {v["id"]: v["updated_at"] for v in got}
    # Nothing changed, so nothing is updated.
    service.rebuild(spark, str(index), str(folder), "2030-01-01T00:00:00+00:00")
    assert {v["id"]: v["updated_at"] for v in json.loads(index.read_text())["videos"]} == first
    assert cli.run(["search", "IMPRESORA", "--library", str(index), "--limit", "1", "--context", "1"]) == 0
    out = capsys.readouterr().out
    assert "[00:00:06]" in out and "> Otra línea habla de la impresora." in out and "  [00:00:01] El servidor" in out
    assert cli.run(["list", "--library", str(index)]) == 0 and "1:01" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.run(["show", "nobody", "--library", str(index)])


def test_corrupt_library(spark, data):
    folder, index, _ = data
    index.parent.mkdir(exist_ok=True)
    assert S.read_library(spark, str(index)).collect() == []
    index.write_text('{"videos": [{"id": 7, "path": "p"}, {"id": "a", "path": "p", "duration": true}, {"id": "ok", "path": "p", "tools": ["x"]}]}')
    got = {r["index"]: r.reason for r in S.read_library(spark, str(index)).collect()}
    assert got == {0: "'id' debe ser texto no vacío", 1: "'duration' debe ser un número no negativo o null", 2: None}
    change = spark.createDataFrame([("z", "Z", None, 1.0, None, "p", [])], "id string, title string, channel string, duration double, url string, path string, tools array<string>")
    with pytest.raises(ValueError):
        service.upsert(spark, str(index), change)
    assert service.rebuild(spark, str(index), str(folder))[0] == 2
    assert any(".corrupt-" in f for f in os.listdir(index.parent))
    service.upsert(spark, str(index), change, "2031-01-01T00:00:00+00:00")
    assert [v["id"] for v in json.loads(index.read_text())["videos"]][0] == "z"
    index.write_text("{")
    with pytest.raises(ValueError):
        S.read_library(spark, str(index))


def test_arguments():
    for bad in (["search", "x", "--library", "l", "--limit", "0"], ["search", "x", "--library", "l", "--context", "-1"], []):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
    assert service.requested_languages(" es, en,, ") == ["es", "en"]


def test_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    from verbatlas.queries import timed_cues

    cues = timed_cues(spark, sf_dir).where("length(video_id) > 0")
    few = [r.video_id for r in cues.select("video_id").distinct().orderBy("video_id").limit(4).collect()]
    cues = cues.where(F.col("video_id").isin(few))
    source = tmp_path / "in"
    for k in range(2):  # two batches, each a stretch of every video
        cues.where((F.col("cue_index") < 20) == (k == 0)).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(cues.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = live.new_words(stream).writeStream.format("memory").queryName("live_words").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("live_words").collect()}
    want = {tuple(r) for r in captions.without_overlap(cues).collect()}
    assert got == want


def test_stream_sessions(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).where("user_id < 5")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = live.sessions(stream, ["user_id"], "ts", "6 hours", "1 hour").writeStream.format("memory").queryName("live_sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live_sessions").count() > 0
