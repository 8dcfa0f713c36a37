"""ER5: the most similar candidate of every name, whatever its score, as a top-1 join in order of upper bounds.

A name first gets a score to beat from one promising candidate (``seeds``). It then meets the candidates that share the
character keys of a level; pairs whose shared characters, length or edit distance cannot reach the score to beat are dropped
by built-in functions. Of the rest the pair of the highest bound is scored first, and only pairs whose bound is no lower than
that score are scored after it. No pair that could win is lost and nothing is capped.

Null names have no candidate; empty texts match empty texts; repeated rows count once; without candidates every name comes
back with a null candidate and score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitframe.functions import text as tx
from transitframe.functions.similarity import sequence_ratio
from transitframe.operators.candidates import ratio_candidates
from transitframe.operators.ordered import best_per_key
from transitframe.operators.reconcile import neighbourhood_issues
from transitframe.session import cut_lineage

_EPS = 1e-9
# lowest scores of the rounds: the higher, the fewer keys a text has; the last goes down to the lowest score to beat
LEVELS = (0.85, 0.7, 0.5, 0.3, 1e-6)


def _word_keys(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    split = F.filter(F.split(text, " "), lambda w: w != "")
    pairs = F.transform(split, lambda w, i: F.concat_ws(" ", w, F.get(split, i + 1)))
    return F.array_distinct(F.concat(split, pairs))


def _letter_keys(text: Column) -> Column:
    """Pairs of neighbouring characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def _promising(names: DataFrame, pool: DataFrame, keys) -> DataFrame:
    """(text, seed): of the candidates that share a key, one for each key and of the nearest length, the one of fewest
    edits for its length. The index has one row per key, with one candidate of each length: as many as there are lengths."""
    offered = pool.select("text", F.explode(keys(F.col("text"))).alias("_k"), F.length("text").alias("n"))
    index = offered.groupBy("_k", "n").agg(F.min("text").alias("one")).groupBy("_k").agg(F.collect_list(F.struct("n", "one")).alias("ones"))
    size = F.length("text")
    nearest = F.array_min(F.transform("ones", lambda x: F.struct(F.abs(x["n"] - size).alias("d"), x["one"].alias("one"))))
    met = names.select("text", F.explode(keys(F.col("text"))).alias("_k")).join(index, "_k").select("text", nearest["one"].alias("seed")).distinct()
    edits = F.levenshtein("text", "seed") / (F.length("text") + F.length("seed"))
    return met.groupBy("text").agg(F.min_by("seed", F.struct(edits, "seed")).alias("seed"))


def seeds(names: DataFrame, pool: DataFrame) -> DataFrame:
    """(name, text, best): each name with the score of one promising candidate, found by words, else by letters, else 0."""
    texts = cut_lineage(names.select("text").distinct())
    by_words = cut_lineage(_promising(texts, pool, _word_keys))
    by_letters = _promising(texts.join(by_words, "text", "left_anti"), pool, _letter_keys)
    scored = by_words.unionByName(by_letters).select("text", sequence_ratio("text", "seed").alias("best"))
    return names.join(scored, "text", "left").select("name", "text", F.coalesce("best", F.lit(0.0)).alias("best"))


def in_order_of_bounds(pairs: DataFrame, level: float) -> DataFrame:
    """Best scored pair of each ``l_name`` from ``level`` on: the pair of the highest bound first, then those it leaves open."""
    lead = pairs.groupBy("l_name").agg(F.max_by(F.struct("l_text", "r_text", "l_best"), F.struct("bound", "r_text")).alias("p"))
    # the floor is stored: Spark would otherwise score once for the filter and once for the column
    floors = cut_lineage(lead.select("l_name", F.greatest(sequence_ratio("p.l_text", "p.r_text"), "p.l_best").alias("floor")))
    late = pairs.join(floors, "l_name").filter(F.col("bound") >= F.col("floor") - _EPS)
    scored = late.withColumn("score", sequence_ratio("l_text", "r_text")).filter(F.col("score") >= level)
    return best_per_key(scored, ["l_name"], "score", ["r_candidate"], ["r_candidate"])


def closest(names: DataFrame, candidates: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(name, candidate, score) for each distinct ``name``; the least candidate among equal scores, null where none shares
    a character. Equal normalised texts are settled by an equi-join."""
    wanted = names.select("name").distinct()
    asked = wanted.filter(F.col("name").isNotNull()).withColumn("text", tx.norm_key("name"))
    pool = candidates.filter(F.col("candidate").isNotNull()).withColumn("text", tx.norm_key("candidate"))
    pool = cut_lineage(pool.groupBy("text").agg(F.min("candidate").alias("candidate")))
    equal = cut_lineage(asked.join(pool, "text").select("name", "candidate", F.lit(1.0).alias("score")))
    rest = seeds(asked.filter("text <> ''").join(equal, "name", "left_anti"), pool)
    found = equal
    for level in levels:
        rest = cut_lineage(rest)
        lowest = rest.agg(F.min("best")).first()[0]
        if lowest is None:
            break
        level = max(level, lowest)
        pairs = cut_lineage(ratio_candidates(rest, pool, "text", level, floor="best").select("l_name", "l_text", "l_best", "r_text", "r_candidate", "bound"))
        best = cut_lineage(in_order_of_bounds(pairs, level).select(F.col("l_name").alias("name"), F.col("r_candidate").alias("candidate"), "score"))
        found = found.unionByName(best)
        rest = rest.join(best, "name", "left_anti")
    return wanted.join(found, "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def no_match_candidates(listed: DataFrame, itinerary: DataFrame) -> DataFrame:
    """RC7: each listed street without a hit, with the most similar street of the itineraries and its score."""
    lost = cut_lineage(neighbourhood_issues(listed, itinerary).filter("issue = 'no_match'").select("neighbourhood", "street"))
    used = itinerary.select(tx.strip("street").alias("candidate")).filter("candidate <> ''")
    best = closest(lost.select(F.col("street").alias("name")), used)
    return lost.join(best, lost["street"] == best["name"]).select("neighbourhood", "street", "candidate", "score")
