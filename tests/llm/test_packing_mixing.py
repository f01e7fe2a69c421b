import random

import numpy as np
import pytest

from verbatlas.llm import packing as P
from verbatlas.llm.mixing import finish_of, mix
from verbatlas.llm.sizes import load, with_tokens

ITEM = "id bigint, n bigint, part string, size string"


def containers(spark, items, capacity):
    df = spark.createDataFrame([(k, n, "x", "y") for k, n in items], ITEM)
    return P.pack(df, "id", "n", capacity).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_items_in_containers(spark, seed):
    rng = random.Random(seed)
    items = [(k, min(900, int(rng.lognormvariate(4, 0.8)))) for k in range(3000)] + [(5000, 700), (5001, 256 * 3), (5002, 256 * 4 + 9)]
    got = containers(spark, items, 256)
    whole, load_of = {}, {}
    for r in got:
        assert r.size <= 256
        whole.setdefault(r.id, []).append(r)
        if r.size:
            load_of[r.container] = load_of.get(r.container, 0) + r.size
    assert len(whole) == len(items)
    for k, n in items:
        parts = whole[k]
        assert sum(r.size for r in parts) == n and len(parts) == max(1, -(-n // 256)) == parts[0].n_parts
    assert max(load_of.values()) <= 256
    total = sum(n for _, n in items)
    assert len(load_of) <= -(-total // 256) * 1.01 + 1
    assert sorted(load_of) == list(range(len(load_of)))


def test_pack_edges(spark):
    assert containers(spark, [], 8) == []
    got = containers(spark, [(1, None), (1, 0), (None, 3), (1, 5), (1, 5), (2, -4)], 8)
    assert sorted((r.size, r.container is None) for r in got) == [(0, True)] * 3 + [(3, False), (5, False), (5, False)]
    assert len({r.container for r in got if r.size}) == 2


def test_least_squares_finds_the_mixture():
    hist = np.zeros(101, int)
    hist[[60, 40, 30, 10]] = [50, 50, 30, 70]
    x = P.least_squares([{60: 1, 40: 1}, {30: 3, 10: 1}, {10: 10}], hist)
    assert x == pytest.approx([50, 10, 6], abs=0.01)
    assert P.greedy(hist, 100)[0] == ({60: 1, 40: 1}, 50)
    assert sum(t for _, t in P.plan(hist, 100)) == 66


REC = "id bigint, source string, n bigint, k string, size string, finish int, repeat int"
TARGET = "source string, target_share double, max_repeats int, id int"


def mixed(spark, records, targets, **more):
    r = spark.createDataFrame([(*x, "a", "b", 1, 2) for x in records], REC)
    t = spark.createDataFrame([(*x, 1) for x in targets], TARGET)
    return mix(r, t, key="id", source="source", size="n", **more)


def test_mix_against_a_fair_queue(spark):
    rng = random.Random(4)
    records = [(k, rng.choice([" A", "a", "a\t", "b", "c", None, "z"]), rng.randint(0, 50)) for k in range(900)]
    targets = [("a", 0.2, 1), ("B", 0.5, 3), ("c", 0.25, 1), ("none", 0.05, 9)]
    picks, report = mixed(spark, records, targets, buckets=8)
    picks, report = picks.collect(), {r.source: r for r in report.collect()}
    total = sum(n for _, _, n in records)
    assert total - 4 * 50 <= sum(r.size for r in picks) <= total
    assert [r.finish for r in picks] == sorted(r.finish for r in picks)
    seen = [(r.id, r.repeat) for r in picks]
    assert len(set(seen)) == len(seen)
    cap = {"a": 1, "b": 3, "c": 1}
    size = {s: sum(n for _, x, n in records if x and x.strip().lower() == s) for s in cap}
    for s, w in (("a", 0.2), ("b", 0.5), ("c", 0.25)):
        own = [r for r in picks if r.source == s]
        assert max(r.repeat for r in own) < cap[s]
        assert report[s].picked == sum(r.size for r in own) and report[s].available == size[s]
        assert report[s].short == (size[s] * cap[s] < w * total)
        # An unbroken prefix of the queue: every record not picked ends later than all that are.
        full = [r for r in own if r.repeat == 0]
        assert len({r.id for r in full}) == len(full)
    assert report["none"].short and report["none"].picked == 0
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_shares_are_met_while_sources_last(spark):
    records = [(k, "ab"[k % 2], 10) for k in range(2000)]
    _, report = mixed(spark, records, [("a", 0.8, 1), ("b", 0.2, 1)], budget=5000)
    assert {r.source: round(r.actual_share, 2) for r in report.collect()} == {"a": 0.8, "b": 0.2}


def test_mix_edges(spark):
    picks, report = mixed(spark, [], [("a", 1.0, 2)])
    assert picks.collect() == [] and [(r.short, r.actual_share) for r in report.collect()] == [(False, 0.0)]
    picks, report = mixed(spark, [(1, "a", None), (None, "a", 3), (None, "a", 3), (2, None, 4)], [("a", 1.0, None), ("A ", 1.0, 5), ("b", None, 1)])
    assert sorted((r.id, r.size) for r in picks.collect()) == [(None, 3), (None, 3)]
    assert {r.source: r.short for r in report.collect()} == {"a": True, "b": False}
    assert mixed(spark, [(1, "a", 1)], [])[0].collect() == []


def test_virtual_time():
    assert finish_of(10, [(0.5, 100), (0.5, 100)]) == pytest.approx(10)
    assert finish_of(10, [(0.5, 2), (0.5, 100)]) == pytest.approx(16)
    assert finish_of(1000, [(0.5, 2), (0.5, 100)]) == pytest.approx(200)


def test_tokens(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "hello world " * 20000), (4, "a" * 50000)], "id int, text string")
    got = {r.id: r.tokens for r in with_tokens(df).collect()}
    assert got[1] == 0 and got[2] is None and got[3] > 40000 and got[4] > 0
    text = "¿Qué pasa? L'été\n\n  12:30"
    assert load().decode(load().encode_ordinary(text)) == text
