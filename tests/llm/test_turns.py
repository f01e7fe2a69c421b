import pytest
from pyspark.sql import functions as F

from verbatlas.functions.timecode import seconds
from verbatlas.llm import turns as T

PEOPLE = [(1, "Subuklu", "Skabrazan", "Briojev"), (2, "Dehogrux", "Gitrifes", None), (3, "Sonja", "Skorr", "Ñandú")]
CUE = "video_id string, cue_index int, ts string, text string, speaker_id string, k int"
WHO = "speaker_id int, given_name string, family_name string, nickname string, text string"


def frames(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], CUE), spark.createDataFrame([(*p, "x") for p in PEOPLE], WHO)


def turns(spark, texts, block=4096, video="v"):
    cues, who = frames(spark, [(video, i, f"00:{i:02d}", t) for i, t in enumerate(texts)])
    return [(r.first_cue, r.speaker_id, r.text) for r in T.speaker_turns(cues, who, seconds(F.col("ts")), block).orderBy("turn").collect()]


def test_names():
    n = T.Names(PEOPLE)
    best = lambda x: [w for w, _ in n.match(x)]
    assert best("SUBUKLU") == best("Skabrazan Subuklu") == best("Dr. Skabrazan") == best("Briojev") == [1]
    assert best("nandu") == [3] and best("Subkulu") == [1] and best("Gitrfes") == [2] and best("Nota") == []
    assert best("D.G.") == [2] and best("S.S.") == [1, 3] and best("s.s.") == [] and n.match("Subuklu") == [(1, 1.0)]


def test_edits():
    assert [T.edits("kitten", x, 2) for x in ("kitten", "ikttn", "kittens", "sitting")] == [0, 2, 1, 3]


def test_turns_of_a_conversation(spark):
    got = turns(spark, [
        "nobody yet", "- still nobody", "Subuklu: Um, Hello there [MUSIC]", "<i>and more.</i>", "Subuklu Skabrazan — goes on", "Dehogrux: I answer. - SUBUKLU: No you do not",
        "(laughter)", ">> Yes, I do", None, "Note: this is important", "[Subuklu] Fine", "- ok then", "<v Dehogrux Gitrifes> mine again (pump)", "Skabrzan : last",
    ])
    assert got == [
        (2, 1, "Hello there and more. goes on"), (5, 2, "I answer."), (5, 1, "No you do not"), (7, 2, "Yes, I do Note: this is important"), (10, 1, "Fine"), (11, 2, "ok then mine again (pump)"), (13, 1, "last"),
    ]


@pytest.mark.parametrize("block", [2, 3, 7])
def test_blocks_change_nothing(spark, block):
    texts = [">> x", "Subuklu: a", "b", ">> c", "d", "e", "- f", "g", ">> h", "Dehogrux: i", "j", "k", ">> l", "m", "Subuklu: n", "o", "- p", "q"]
    assert turns(spark, texts, block) == turns(spark, texts)


def test_edges(spark):
    cues, who = frames(spark, [])
    assert T.speaker_turns(cues, who, seconds(F.col("ts"))).collect() == []
    rows = [("a", 1, None, "Subuklu: hi"), ("a", 1, None, "Subuklu: hi"), ("a", 1, "00:01", "Subuklu: hi"), (None, 1, "00:01", "Subuklu: hi"), ("a", None, "00:01", "Subuklu: hi"), ("b", 1, "00:01", ">> no labels"), ("c", 1, "x", "Dehogrux:"), ("d", 1, "00:02", "Subuklu: " + "word " * 50000)]
    cues, who = frames(spark, rows)
    got = {r.video_id: (r.turn, r.first_cue, r.start, r.speaker_id, r.text[:5]) for r in T.speaker_turns(cues, who, seconds(F.col("ts"))).collect()}
    assert got == {"a": (1, 1, 1, 1, "hi"), "c": (1, 1, None, 2, ""), "d": (1, 1, 2, 1, "word ")}


def test_initials_alone_name_a_speaker(spark):
    """D.S. may be Dora Sand or, reversed, Sven Dahl; nobody of them is named otherwise."""
    people = [(1, "Dora", "Sand", None), (2, "Sven", "Dahl", None), (3, "Paul", "Egger", None)]
    who = spark.createDataFrame([(*p, "x") for p in people], WHO)

    def starts(*texts):
        cues = spark.createDataFrame([("v", i, f"00:{i:02d}", t, "x", 1) for i, t in enumerate(texts)], CUE)
        return [(r.i, r.speaker_id) for r in T.turn_starts(cues, who, seconds(F.col("ts"))).orderBy("i", "k").collect()]

    assert T.Names(people).match("D.S.") == [(1, 0.9), (2, pytest.approx(0.7))]
    assert starts("Paul: a", "D.S.: b", "Paul: c") == [(0, 3), (1, 1), (2, 3)]
    assert starts("D.S.: a", "b", "Paul: c") == [(0, 1), (2, 3)]
    assert starts("Sven: a", "Paul: b", "D.S.: c") == [(0, 2), (1, 3), (2, 2)]  # another label says who is there


def test_found_labels_in_the_tables(spark, sf_dir):
    """Turns of all videos against a plain pass over each video."""
    cues = spark.read.parquet(f"{sf_dir}/cues.parquet")
    people = spark.read.parquet(f"{sf_dir}/speakers.parquet")
    got = {(r.id, r.i, r.speaker_id) for r in T.turn_starts(cues, people, seconds(F.col("ts"))).collect()}
    names = T.Names([tuple(r) for r in people.select("speaker_id", "given_name", "family_name", "nickname").collect()])
    want, videos = set(), {}
    for r in cues.select("video_id", "cue_index", "text").distinct().where("text is not null").orderBy("video_id", "cue_index").collect():
        videos.setdefault(r.video_id, []).extend((r.cue_index, who) for _, _, who in T.places(T.html.unescape(r.text), names))
    for v, found in videos.items():
        speakers = {who[0][0] for _, who in found if len(who) == 1}
        now = None
        for i, who in found:
            own = [(s, w) for w, s in who if w in speakers]
            nxt = max(own)[1] if own else (speakers - {now}).pop() if not who and now is not None and len(speakers) == 2 else now
            if nxt != now:
                want.add((v, i, nxt))
                now = nxt
    assert len(got ^ want) <= 0.005 * len(want)


def test_learning_keeps_labels_decisive():
    videos = [([({1: 1.0}, False, False, True), ({}, True, False, True), ({2: 1.0}, False, True, False), ({1: 1.0}, False, False, True)], [1, 2])] * 3
    w = T.learn(videos)
    for events, speakers in videos:
        assert T.decode(events, speakers, -1, w) == T.by_rule(events, speakers) == [1, 2, 2, 1]
