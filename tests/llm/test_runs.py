import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatlas.functions.timecode import seconds
from verbatlas.llm.runs import collapse_runs, in_order, near_identical


def words(text):
    t = re.sub(r"<[^<>]*>", " ", html.unescape(text or "")).casefold()
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", t)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def start(ts):
    m = re.fullmatch(r"(?:(\d+):)?(\d+):(\d+)(\.\d*)?", (ts or "").strip())
    return m and int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])


def brute(cues):
    videos = {}
    for v, i, ts, text in sorted({c for c in cues if c[0] is not None and c[1] is not None}, key=lambda c: (c[0], c[1], c[2] or "", c[3] or "")):
        w, s = words(text), start(ts)
        if w and s is not None:
            videos.setdefault(v, {}).setdefault(i, (w, s))
    out = set()
    for v, at in videos.items():
        run, before = [], None
        for i in sorted(at):
            w, s = at[i]
            near = False
            if before is not None:
                p, ps = at[before]
                near = s - ps <= 15 and lcs(w, p) * 4 >= 3 * max(len(w), len(p)) and sorted(filter(str.isdigit, w)) == sorted(filter(str.isdigit, p))
            if not near:
                if len(run) > 1:
                    out.add((v, run[0], run[-1]))
                run = []
            run.append(i)
            before = i
        if len(run) > 1:
            out.add((v, run[0], run[-1]))
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_all_cues_against_brute_force(spark, sf_dir, block):
    cues = spark.read.parquet(f"{sf_dir}/cues.parquet")
    got = collapse_runs(cues, "video_id", "cue_index", seconds(F.col("ts")), "text", block=block).collect()
    want = brute([tuple(r) for r in cues.select("video_id", "cue_index", "ts", "text").collect()])
    assert len(got) == len(want) and {(r.video_id, r.first_cue, r.last_cue) for r in got} == want


SCHEMA = "video_id string, cue_index int, ts string, text string, k string, w int, run string"


def runs(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return [tuple(r)[:6] for r in collapse_runs(df, "video_id", "cue_index", seconds(F.col("ts")), "text", **more).orderBy("video_id", "first_cue").collect()]


def test_edges(spark):
    assert runs(spark, []) == []
    rows = [
        ("a", 0, "00:01", "<i>Él abrió la puerta</i>"), ("a", 0, "00:01", "<i>Él abrió la puerta</i>"), ("a", 1, None, "el abrio la puerta"), ("a", 2, "00:02", " "),
        ("a", 3, "00:03.900", "EL ABRIÓ LA PUERTA!"), ("a", 4, "00:19", "el abrio la puerta"), ("a", 5, "00:34", "el abrio la puerta"), ("a", 6, "00:35", None),
        (None, 1, "00:01", "x"), (None, 2, "00:01", "x"), ("b", None, "00:01", "x"), ("c", 1, "00:01", "page 1 of the book we read"), ("c", 2, "00:02", "page 2 of the book we read"),
    ]
    # 3 s to 19 s is more than 15 s apart, 19 s to 34 s is not.
    assert runs(spark, rows) == [("a", 0, 3, 2, 1, 2), ("a", 4, 5, 2, 19, 15)]
    assert runs(spark, rows, block=1) == runs(spark, rows)


def test_one_run_over_many_blocks_and_long_texts(spark):
    long = "a b c d e f g h " * 3000
    rows = [("v", i, f"00:{i:02d}", "same words again") for i in range(50)] + [("z", 0, "00:00", long), ("z", 1, "00:01", long + "tail")]
    assert runs(spark, rows, block=4) == [("v", 0, 49, 50, 0, 49), ("z", 0, 1, 2, 0, 1)]


def test_common_subsequence():
    assert in_order("a b c d".split(), "a c b d".split()) == 3
    assert in_order([], ["a"]) == 0
    assert near_identical("a b c d", "a b c x", 0.75) and not near_identical("a b c d", "a b x y", 0.75)
    assert not near_identical("take 1 of it now ok", "take 2 of it now ok", 0.75)
