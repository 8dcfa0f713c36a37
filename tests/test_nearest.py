"""The top-1 similarity join against brute force over all pairs of a small fixture."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from transitframe.functions import text as tx
from transitframe.operators import nearest
from transitframe.operators.candidates import ratio_candidates

WORDS = ["RUA", "AVENIDA", "SANTA", "LUCIA", "LUZIA", "SILVA", "SOL", "LUA", "MONTE", "CASTELO", "PENEDO", "BRASIL", "Z9", "QUADRA"]


def best_of(text, pool):
    """(score, candidate): highest ratio, least candidate; ``pool`` maps normalised texts to candidates."""
    scores = [(-SequenceMatcher(None, text, t).ratio(), c) for t, c in pool.items()]
    score, candidate = min(scores, default=(0, None))
    return (-score, candidate) if score < 0 else (0.0, None)


def random_names(seed, n):
    rng = random.Random(seed)
    names = []
    for _ in range(n):
        name = list(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))))
        for _ in range(rng.randint(0, 3)):
            name[rng.randrange(len(name))] = rng.choice("ABEIOZ1")
        names.append("".join(name))
    return names


def frame(spark, values, column):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def keys_of(spark, values):
    return {r.v: r.k for r in frame(spark, values, "v").withColumn("k", tx.norm_key("v")).collect()}


def test_closest_matches_brute_force(spark):
    names = [*random_names(1, 60), "RUA DO SOL", "ZZZ", "???", "", "Q", "R. do Sól", "0 0 0 0"]
    candidates = [*random_names(2, 80), "RUA DA LUA", "RUA DO SOL", "rua do sol", "ZEBRA"]
    keys = keys_of(spark, {*names, *candidates})
    pool = {}
    for c in sorted(candidates):
        pool.setdefault(keys[c], c)
    got = {r.name: (round(r.score, 9), r.candidate) for r in nearest.closest(frame(spark, names * 2, "name"), frame(spark, candidates * 2, "candidate")).collect()}
    assert len(got) == len(set(names))
    for name in set(names):
        score, candidate = best_of(keys[name], pool)
        assert got[name] == (round(score, 9), candidate), name


def test_nothing_to_find(spark):
    names = frame(spark, ["RUA A", None], "name")
    assert {tuple(r) for r in nearest.closest(names, frame(spark, [], "candidate")).collect()} == {("RUA A", None, 0.0), (None, None, 0.0)}
    assert {tuple(r) for r in nearest.closest(names, frame(spark, ["RUA A", None], "candidate")).collect()} == {("RUA A", "RUA A", 1.0), (None, None, 0.0)}
    assert nearest.closest(frame(spark, [], "name"), frame(spark, ["RUA A"], "candidate")).count() == 0


def test_bounds_hold_and_order_leaves_few_pairs(spark):
    names = frame(spark, random_names(3, 40), "name").distinct().withColumn("text", F.col("name"))
    pool = frame(spark, random_names(4, 60), "text").distinct().withColumn("candidate", F.col("text"))
    started = nearest.seeds(names, pool)
    pairs = ratio_candidates(started, pool, "text", 1e-6, floor="best").collect()
    for p in pairs:
        assert SequenceMatcher(None, p.l_text, p.r_text).ratio() <= p.bound + 1e-9
        assert p.bound >= p.l_best - 1e-9
    assert len(pairs) < 0.5 * names.count() * pool.count()


def test_unlisted_streets_get_a_candidate(spark):
    listed = spark.createDataFrame([("CENTRO", "RUA SANTA LUSIA"), ("CENTRO", "RUA DO SÓL"), ("FAROL", " RUA SANTA LUSIA "), ("FAROL", "")], "neighbourhood string, street string")
    itinerary = frame(spark, ["RUA SANTA LUCIA", "RUA DO SOL", "AVENIDA BRASIL", None], "street")
    got = {(r.neighbourhood, r.street): (r.candidate, round(r.score, 6)) for r in nearest.no_match_candidates(listed, itinerary).collect()}
    score = round(SequenceMatcher(None, "RUA SANTA LUSIA", "RUA SANTA LUCIA").ratio(), 6)
    assert got == {(n, "RUA SANTA LUSIA"): ("RUA SANTA LUCIA", score) for n in ("CENTRO", "FAROL")}
