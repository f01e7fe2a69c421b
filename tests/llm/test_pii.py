import numpy as np
import pytest

from verbatlas.llm import pii as P

COMMON = set("the my name is call me on after six at in we look looks screen nobody when contact order part no ticket best pump thanks team since ship it to live page of pdf it was who fixed and".split())
KNOWN = P.Known({"ana", "torvil"}, {"kubra", "estrazon"}, COMMON)
MODEL = P.Model(KNOWN, {}, {})
DOC = "doc_id bigint, text string, kind string, value int"


def found(text, model=MODEL):
    return [(k, text[a:b]) for k, a, b in model.find(text)]


@pytest.mark.parametrize(
    "value",
    ["a.b+c@mail.co.example", "info-x&#64;y.invalid", "x9 (at) y-mail [dot] co [dot] example", "ana_b arroba mail punto test", "x7 AT mail[.]example", "A.B@MAIL.EXAMPLE"],
)
def test_emails(value):
    assert found(f"write to {value}, please") == [("email", value)]


@pytest.mark.parametrize("value", ["+1 (555) 010-4177", "+33 1 99 00 08 77", "030/23125-773", "(555) 555-0125", "555-0134", "1.555.010.4410", "07700900214", "06.39.98.02.06", "0034 412-91-42-07", "030 23125793"])
def test_phones(value):
    assert found(f"Call me on {value} after six.") == [("phone", value)]


@pytest.mark.parametrize("value", ["666-38-9472", "666 73 1030", "99461965Y", "99.372.100-W", "Z-9104924-B", "L13X36T43", "6 79 01 99 700 766 79"])
def test_identity_numbers(value):
    assert found(f"my ID, it is {value}!") == [("id_number", value)]


@pytest.mark.parametrize(
    "value",
    ["88 Preska Road, Flat 8, Fepraerheim 52257", "Calle Teigux 161, 3º B, 81125 Deidrorville", "21 rue de Miotirt", "44 rue du Bofil, 58095 Seseilkheim", "Priozindweg 143 b, 59250 Demaxville", "Stiobelstraße 159, 57056 Skikoskmora", "Rua Fiofa 39", "27 Veiruv Ave"],
)
def test_addresses(value):
    assert found(f"I live at {value}.\nA pump") == [("address", value)]


@pytest.mark.parametrize("value", ["Ana Kubra", "KUBRA, ANA", "ana estrazon", "Torvil H. Kubra", "Torvil Kubra-Estrazon", "Vlimpax Drogunel"])
def test_names(value):
    assert found(f"--\n{value}\n") == [("name", value)]
    assert found(f"My name is {value}!") == [("name", value)]


@pytest.mark.parametrize(
    "text",
    ["Thanks Ana!", "@Ana: ok.", "The Kubra pump.", "Order 4471-016-88 open", "Part no. 555-089-AX.", "ISBN 978-0-00-038000-0.", "Ticket #00755512.", "It was 26.03.2024 at 18:26.", "192.0.2.52.", "Firmware 7.83.0-rc2 build 20831204.", "nobody looks at the screen. The pump",
     "Chapter 70, Street Edition.", "Lane 12 is closed.", "http://wiki.example/p?id=17", "Screws 4x490, torque 49 Nm.", "", "Costs 1.231,00 EUR."],
)
def test_nothing(text):
    assert found(text) == []


def test_redaction_keeps_the_rest():
    text = "Call me on +33 1 99 00 08 77 or write to a@b.example.\n--\nAna Kubra"
    assert MODEL.redact(text) == "Call me on [PHONE] or write to [EMAIL].\n--\n[NAME]"
    assert MODEL.redact(None) is None and MODEL.redact("") == "" and MODEL.redact("no one") == "no one"


def test_em_finds_reliable_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    votes = np.zeros((4000, 3), int)
    for k, right in enumerate((0.95, 0.8, 0.6)):
        says = np.where(rng.random(4000) < right, truth, ~truth)
        votes[:, k] = np.where(rng.random(4000) < 0.7, np.where(says, 1, -1), 0)
    post, right, prior = P.em(votes)
    assert right == pytest.approx([0.95, 0.8, 0.6], abs=0.07) and prior == pytest.approx(0.4, abs=0.07)
    assert ((post > 0.5) == truth).mean() > 0.85


def test_frames(spark):
    names = spark.createDataFrame([("Ana", "given", 1), ("Kubra", "family", 1), (None, None, 1)], "name string, name_part string, doc_id int")
    empty = spark.createDataFrame([], DOC)
    assert P.personal_spans(empty, names).collect() == [] and P.redacted(empty, names).collect() == []
    rows = [(1, "Ana Kubra", "x", 1), (1, "Ana Kubra", "x", 1), (None, None, "x", 1), (3, "", "x", 1), (4, "the pump " * 100_000 + "a@b.example", "x", 1)]
    df = spark.createDataFrame(rows, DOC)
    got = P.personal_spans(df, names).collect()
    assert sorted((r.doc_id, r.kind, r.value) for r in got) == [(1, "name", "Ana Kubra")] * 2 + [(4, "email", "a@b.example")]
    out = P.redacted(df, names).collect()
    assert [r.kind for r in out] == ["x"] * 5 and out[0].text == "[NAME]" and out[2].text is None


def test_round_trip_over_the_tables(spark, sf_dir):
    """Redacted texts are the texts with every span's value put back."""
    docs, names = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/name_list.parquet")
    model = P.model_for(docs, names)
    spans = {}
    for r in P.personal_spans(docs, names, model).orderBy("doc_id", "start").collect():
        spans.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in P.redacted(docs, names, model).collect():
        t = r.text
        for s in spans.get(r.doc_id, []):
            t = t.replace(f"[{s.kind.upper()}]", s.value, 1)
        assert t == texts[r.doc_id]


def test_a_name_that_stands_often_is_no_common_word(spark):
    """A person in every third text, not in the list, keeps their names; copies and quotes make no word common."""
    words = ["the pump is on", "the lamp is off", "the door is open", "the roof is wet", "the wall is dry", "the tank is full"]
    texts = [f"{words[k % 6]} since day {'abcdefghij'[k % 10]}{'klmnopq'[k % 7]}" + ("\n--\nVlimpax Drogunel" if k % 3 == 0 else f"\n-- \nAna {'Xyzbcdfgh'[k % 9]}emu" if k % 7 == 1 else "") for k in range(210)]
    texts += ["Ask for Torfin Melgrud at the counter", *["> Ask for Torfin Melgrud at the counter"] * 5, *["Ask for Torfin Melgrud at the counter"] * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    common = P.common_words(df)
    assert {"the", "is", "since"} <= common and not {"vlimpax", "drogunel", "torfin", "melgrud"} & common
    names = spark.createDataFrame([("Ana", "given"), ("Kubra", "family")], "name string, name_part string")
    got = [(r.doc_id, r.value) for r in P.personal_spans(df, names).where("kind = 'name'").collect()]
    assert {d for d, v in got if v == "Vlimpax Drogunel"} == set(range(0, 210, 3))
    assert {d for d, v in got if v == "Torfin Melgrud"} == set(range(210, 221))


def test_a_common_word_is_a_vote():
    usual = P.Known(KNOWN.given, KNOWN.family, COMMON | {"rose"})
    (span,) = [s for s in P.propose("My name is Rose Kubra.", usual) if s.start == 11]
    assert span.kind == "name" and span.usual == 1
    assert found("Contact Ana Kubra") == [("name", "Ana Kubra")]
