"""Tiles of a similarity join: bounds against plain computations, tables cut into many tiles."""

import random
from difflib import SequenceMatcher

import numpy as np

from transitframe.functions.similarity import _common_subsequence
from transitframe.operators.candidates import ratio_candidates, ratio_join
from transitframe.operators.tiles import bounded_pairs

LETTERS = "AB Ç1€😀"


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["", "A", *("".join(rng.choice(LETTERS) for _ in range(rng.randint(0, longest))) for _ in range(n))]


def test_bounds_are_common_subsequences():
    a, b = texts(1, 60, 90), texts(2, 60, 150)  # some longer than a machine word on either side
    i, j, bound = bounded_pairs(a, b, np.full(len(a), 0.4), in_order=True)
    got = dict(zip(zip(i.tolist(), j.tolist()), bound.tolist(), strict=True))
    for x, s in enumerate(a):
        for y, t in enumerate(b):
            exact = 2 * _common_subsequence(s, t) / (len(s) + len(t)) if s or t else 1.0
            assert (exact >= 0.4 - 1e-9) == ((x, y) in got)
            assert (x, y) not in got or abs(got[x, y] - exact) < 1e-9


def test_shared_characters_count_repeats():
    i, j, bound = bounded_pairs(["AAB", "XY"], ["BAA", "AB", "Z"], np.array([0.7, 0.7]), in_order=False)
    assert [(x, y, round(z, 6)) for x, y, z in zip(i, j, bound, strict=True)] == [(0, 0, 1.0), (0, 1, 0.8)]


def test_tiles_lose_nothing(spark):
    left, right = sorted(set(texts(3, 150, 12))), sorted(set(texts(4, 150, 12)))
    l, r = (spark.createDataFrame([(x, k) for k, x in enumerate(side)], "t string, k int") for side in (left, right))
    expected = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= 0.6}
    for hot in (20_000, 60):
        got = [(p.l_t, p.r_t) for p in ratio_join(l, r, "t", 0.6, condition="l_k >= 0", hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_few_pairs_are_left_where_all_names_share_their_characters(spark):
    rng = random.Random(5)
    words = ["NORTE", "TENOR", "RETON", "TORNE", "ETNOR", "ROTEN"]
    names = sorted({" ".join(rng.choice(words) for _ in range(4)) for _ in range(150)})
    df = spark.createDataFrame([(x,) for x in names], "t string")
    exact = sum(SequenceMatcher(None, a, b).ratio() >= 0.82 for a in names for b in names)
    assert exact <= ratio_candidates(df, df, "t", 0.82).count() < 3 * exact + 100


def test_pairs_are_scored_once(spark):
    df = spark.createDataFrame([("RUA A",), ("RUA B",)], "t string")
    plan = ratio_join(df, df, "t", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
