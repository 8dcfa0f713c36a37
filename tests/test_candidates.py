"""Similarity joins against brute force over all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from transitframe.operators.candidates import containment_join, jaccard_join, ratio_join

WORDS = ["RUA", "AVENIDA", "DE", "DA", "SANTA", "LUCIA", "LUZIA", "JOSE", "JESUS", "OTACILIO", "TARCISIO", "A", "2", "45"]


def names(seed, n):
    rng = random.Random(seed)
    out = {"A", "AB", "RUA OTACILIO DE JESUS", "RUA TARCISIO DE JESUS"}
    while len(out) < n:
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.4:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice("ABCXZ19 ") + text[i + 1 :]
        out.add(" ".join(text.split()) or "A")
    return sorted(out)


@pytest.mark.parametrize("threshold,hot", [(0.82, 20_000), (0.82, 7), (0.5, 20_000)])
def test_ratio_join_loses_nothing(spark, threshold, hot):
    left, right = names(1, 120), names(2, 120)
    expected = {
        (a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= threshold
    }
    l = spark.createDataFrame([(x,) for x in left], "t string")
    r = spark.createDataFrame([(x,) for x in right], "t string")
    got = [(x.l_t, x.r_t) for x in ratio_join(l, r, "t", threshold, hot=hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


@pytest.mark.parametrize("threshold,hot", [(0.5, 20_000), (0.25, 5), (0.4, 20_000)])
def test_jaccard_join_loses_nothing(spark, threshold, hot):
    left, right = names(3, 100), names(4, 100)
    sets = {x: {w for w in x.split()} for x in left + right}
    expected = {
        (a, b)
        for a in left
        for b in right
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
    }
    l = spark.createDataFrame([(x, sorted(sets[x])) for x in left], "t string, w array<string>")
    r = spark.createDataFrame([(x, sorted(sets[x])) for x in right], "t string, w array<string>")
    got = [(x.l_t, x.r_t) for x in jaccard_join(l, r, "w", threshold, hot=hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_containment_join_loses_nothing(spark):
    rng = random.Random(5)
    base = names(6, 150)
    cut = {x[rng.randint(0, 3) : len(x) - rng.randint(0, 3)] for x in base}
    left, right = base, sorted(c for c in cut if c)
    expected = {
        (a, b)
        for a in left
        for b in right
        if len(a) >= 8 and (a in b or b in a) and min(len(a), len(b)) / max(len(a), len(b)) >= 0.70
    }
    l = spark.createDataFrame([(x,) for x in left], "t string")
    r = spark.createDataFrame([(x,) for x in right], "t string")
    got = [(x.l_t, x.r_t) for x in containment_join(l, r, "t").collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_grouped_joins_agree_for_small_and_large_groups(spark, monkeypatch):
    from transitframe.operators import candidates

    texts = names(7, 90)
    rows = [(i % 3, t, sorted(set(t.split()))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g int, t string, w array<string>")
    results = []
    for limit in (128, 10):
        monkeypatch.setattr(candidates, "_SMALL_GROUP", limit)
        ratio = {(r.g, r.l_t, r.r_t) for r in ratio_join(df, df, "t", 0.7, on=["g"]).collect()}
        overlap = {(r.g, r.l_t, r.r_t) for r in jaccard_join(df, df, "w", 0.4, on=["g"]).collect()}
        results.append((ratio, overlap))
    assert results[0] == results[1]
    expected = {
        (ga, a, b) for ga, a, _ in rows for gb, b, _ in rows if ga == gb and SequenceMatcher(None, a, b).ratio() >= 0.7
    }
    assert results[0][0] == expected
