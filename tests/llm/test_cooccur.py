import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from verbatlas.llm import cooccur as C

LIB = "id string, path string, tools array<string>, updated_at string, n string, a int"
CAT = "name string, aliases array<string>, n int"


def test_versions_names_and_nulls(spark):
    rows = [
        ("1", "p", ["Old"], "2024-01-01T00:00:00+00:00"), ("1", "p", [" Al ", "beta", "BETA", None, " "], "2024-01-01T00:30:00-01:00"), ("1", "p", ["x"], None),
        ("2", "p", None, None), ("2", "p", ["alpha"], "no time"), ("3", None, ["q"], None), (" ", "p", ["q"], None), (None, "p", ["q"], None), ("4", "\t", ["q"], None),
    ]
    lib = spark.createDataFrame([(*r, "n", 1) for r in rows], LIB)
    cat = spark.createDataFrame([("Alpha ", ["al", "ALF"], 1), ("beta", None, 1), (None, ["zz"], 1)], CAT)
    got = {r.id: r["items"] for r in C.canonical(C.latest_entries(lib), cat).collect()}
    assert got == {"1": ["alpha", "beta"], "2": ["alpha"]}


def test_empty(spark):
    lib, cat = spark.createDataFrame([], LIB), spark.createDataFrame([], CAT)
    assert C.surprising_pairs(C.canonical(C.latest_entries(lib), cat)).collect() == []


@pytest.mark.parametrize("chunk", [3, 256])
def test_counts_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rng = random.Random(3)
    names = [f"t{k}" for k in range(25)]
    baskets = [sorted(rng.sample(names, rng.choice([0, 1, 2, 3, 5, 20]))) for _ in range(400)]
    df = spark.createDataFrame([(str(k), b) for k, b in enumerate(baskets)], "id string, items array<string>")
    want = {p: n for p, n in Counter(p for b in baskets for p in itertools.combinations(b, 2)).items() if n >= 10}
    got = C.surprising_pairs(df, least=10).collect()
    assert {(r.a, r.b): r.n for r in got} == want
    single = Counter(t for b in baskets for t in b)
    for r in got:
        assert r.lift == pytest.approx(r.n * 400 / (single[r.a] * single[r.b])) and 0 <= r.q_value <= 1
    # The baskets are random, so hardly a pair is a discovery.
    assert sum(r.q_value < 0.01 for r in got) <= 2


def test_fit_keeps_both_margins():
    freq, items = np.array([2.0, 10, 40]), np.array([50.0, 8, 1])
    size, held = np.array([1.0, 2, 5]), np.array([50.0, 40, 18])
    x, y = C.fit(freq, items, size, held)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert (p * held).sum(1) == pytest.approx(freq, rel=1e-6) and (p * items[:, None]).sum(0) == pytest.approx(size, rel=1e-6)


def test_tail_against_exact_convolution():
    rng = np.random.default_rng(5)
    for _ in range(20):
        times, q = rng.integers(1, 60, 5).astype(float), rng.uniform(0.001, 0.3, 5)
        exact = np.ones(1)
        for t, p in zip(times, q):
            exact = np.convolve(exact, [math.comb(int(t), j) * p**j * (1 - p) ** (int(t) - j) for j in range(int(t) + 1)])
        for n in range(1, int(times.sum()), 7):
            tail = exact[n:].sum()
            if tail > 1e-60:
                got = C.log_tail(np.array([n]), q[None], times)[0]
                assert got == pytest.approx(math.log(min(tail, 1)), abs=0.06 + 0.02 * abs(math.log(min(tail, 1))))


def test_classes_are_bounded():
    v, w = C.classes([(k, 1) for k in range(1, 5000)], 100)
    assert len(v) <= 110 and (v * w).sum() == pytest.approx(sum(range(1, 5000)))
