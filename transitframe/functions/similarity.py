"""Similarity scores. Set scores are built-ins; sequence scores are small Arrow-batched UDFs that run
only on pairs a distributed candidate join has already produced."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaccard(a: Column, b: Column) -> Column:
    """SM1: share of common words, 0 when either side is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


@F.pandas_udf(DoubleType())
def sequence_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """SM2: Ratcliff-Obershelp ratio; the argument order matters."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() for a, b in zip(first, second, strict=True)], dtype="float64"
    )


# not a random score: Spark copies a deterministic function into the filter on its result and would score every pair twice
sequence_ratio = sequence_ratio.asNondeterministic()


def mixed_score(ratio: Column, token_share: Column) -> Column:
    """SM3: half sequence ratio, half token share."""
    return F.lit(0.5) * ratio + F.lit(0.5) * token_share


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    positions: dict[str, int] = {}
    for i, char in enumerate(a):
        positions[char] = positions.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for char in b:
        matched = state & positions.get(char, 0)
        state = ((state + matched) | (state - matched)) & full
    return len(a) - state.bit_count()


def _indel_percent(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common_subsequence(a, b) / total


def _window_percent(short: str, long: str) -> float:
    """Best insert/delete ratio of ``short`` with a window of ``long``: its length inside, shorter at both ends."""
    m, n = len(short), len(long)
    best = 0.0
    for end in range(1, n + m):
        window = long[max(0, end - m) : end]
        if 200.0 * min(m, len(window)) > best * (m + len(window)):
            best = max(best, _indel_percent(short, window))
    return best


def partial_percent(a: str, b: str) -> float:
    """The shorter text against its best window in the longer one; both ways for equal lengths."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_window_percent(a, b), _window_percent(b, a))
    return _window_percent(*sorted((a, b), key=len))


def _set_percent(a: set[str], b: set[str]) -> float:
    """Word sets: 100 if one holds the other, else the best of the common words against either side and side against side."""
    both, left, right = (" ".join(sorted(x)) for x in (a & b, a - b, b - a))
    if both and not (left and right):
        return 100.0
    whole = [f"{both} {x}" if both else x for x in (left, right)]
    scores = [_indel_percent(*whole)]
    if both:
        scores += [200.0 * len(both) / (len(both) + len(x)) for x in whole]
    return max(scores)


# Fixed values of the weighted ratio
PARTIAL_FROM, PARTIAL_UPTO = 1.5, 8.0
WORDS_SCALE, PARTIAL_SCALE, FAR_SCALE = 0.95, 0.9, 0.6


def weighted_percent(a: str, b: str) -> float:
    """Of texts about as long as one another the plain ratio or 0.95 of the best word ratio; where one is at least half as long
    again, 0.9 (0.6 beyond eight times) of the best window, with 0.95 for windows of words; a common word is a full window."""
    words_a, words_b = a.split(), b.split()
    if not words_a or not words_b:
        return 0.0
    sorted_a, sorted_b = " ".join(sorted(words_a)), " ".join(sorted(words_b))
    plain, far = _indel_percent(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if far < PARTIAL_FROM:
        return max(plain, WORDS_SCALE * max(_indel_percent(sorted_a, sorted_b), _set_percent(set(words_a), set(words_b))))
    scale = PARTIAL_SCALE if far <= PARTIAL_UPTO else FAR_SCALE
    if set(words_a) & set(words_b):
        words = 100.0
    else:
        words = max(partial_percent(sorted_a, sorted_b), partial_percent(" ".join(sorted(set(words_a))), " ".join(sorted(set(words_b)))))
    return max(plain, scale * partial_percent(a, b), scale * WORDS_SCALE * words)


@F.pandas_udf(DoubleType())
def weighted_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """SM4: 0-100 score, see ``weighted_percent``."""
    return pd.Series([weighted_percent(a, b) for a, b in zip(first, second, strict=True)], dtype="float64")


weighted_ratio = weighted_ratio.asNondeterministic()
