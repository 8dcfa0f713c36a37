"""Similarity joins without cross joins.

Each join derives, from the score definition, a condition every qualifying pair must meet, and turns
it into equi-join keys that lose no pair:

* ``ratio_join``       sequence ratio >= t bounds the characters two texts must share and their longest common
                       subsequence. Street names are made of few characters and words, so no key on them is selective:
                       groups meet directly, large ones and whole tables in the bounded tiles of ``tiles``;
* ``jaccard_join``     word-set overlap >= t, so the rarest words (prefix) share at least one;
* ``containment_join`` a contained text covering >= 70% of the longer one always covers its middle.

A pair is produced only at its first common key, so no ``distinct`` follows. Keys shared by very many
rows are cut into a grid of salted cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitframe.functions.similarity import jaccard, sequence_ratio
from transitframe.operators.tiles import TILE_ROWS, tile_pairs
from transitframe.rules import CONTAIN_MIN_LENGTH, CONTAIN_SHARE
from transitframe.session import cut_lineage, store

# Common-to-rare order of characters in street names; any fixed order is correct, this one is selective.
_COMMON_TO_RARE = " AEOSRINDMUTCLPVGHQBFZJXKWY1203456789"
_SENTINEL = (1 << 60) + 1
_HOT_KEY_ROWS = 20_000
# a left row meets at most this many right rows directly; larger groups go through similarity keys
_SMALL_GROUP = 128
# containment has a key per character and tiles start a Python group: up to groups of this size direct meeting in cells of
# ``_CELL_ROWS`` costs less, in bytes above all
_DIRECT_GROUP = 4_096
_CELL_ROWS = 2_000


def _character_tokens(text: Column) -> Column:
    """Numbered characters ('second A') as sortable longs, rarest first, plus one shared sentinel."""

    def numbered(char: Column) -> Column:
        place = F.call_function("instr", F.lit(_COMMON_TO_RARE), char)
        commonness = F.when(place == 0, F.lit(45)).otherwise(place)
        times = F.length(text) - F.length(F.replace(text, char, F.lit("")))
        return F.transform(
            F.sequence(F.lit(1), times),
            lambda n: (
                F.lit(1 << 20) - F.least(commonness + 6 * (n - 1), F.lit((1 << 20) - 1))
            ).cast("long") * F.lit(1 << 38)
            + F.ascii(char).cast("long") * F.lit(1 << 20)
            + n,
        )

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.concat(F.array_sort(F.flatten(F.transform(chars, numbered))), F.array(F.lit(_SENTINEL)))


def _grid_join(
    left: DataFrame, right: DataFrame, keys: list[str], condition: Column, hot: int, derived: tuple[dict[str, Column], dict[str, Column]] = ({}, {})
) -> DataFrame:
    """Equi-join on ``keys``; a key with more than ``hot`` rows becomes an n x n grid of cells.

    Left rows belong to one grid row and visit every column, right rows the other way round, so no
    task sees more than about ``hot`` rows of either side of one key. Columns ``derived`` for the condition are added behind
    the shuffle.
    """
    counts = (
        left.select(*keys).unionByName(right.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ).filter(F.col("_n") > hot)
    cells = counts.select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_cells"))
    spread = lambda own: F.pmod(F.xxhash64(F.col(own)), F.col("_cells")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))
    one = F.coalesce(F.col("_cells"), F.lit(1))
    l = left.join(cells, keys, "left").withColumn("_cells", one)
    l = l.withColumn("_row", spread("l_uid")).withColumn("_column", every).drop("_cells")
    r = right.join(cells, keys, "left").withColumn("_cells", one)
    r = r.withColumn("_column", spread("r_uid")).withColumn("_row", every).drop("_cells")
    on = [*keys, "_row", "_column"]
    # few bytes but much checking per key: keep every shuffle partition instead of merging small ones
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the hint: a written table is sized by its compressed bytes, which says little of rows with arrays of words or characters
    l, r = (df.repartition(parts, *on).withColumns(extra) for df, extra in ((l, derived[0]), (r, derived[1])))
    joined = l.hint("merge").join(r, on)
    return joined.filter(condition).drop("_row", "_column")


def _by_group_size(left: DataFrame, right: DataFrame, on: list[str], most: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Split both sides into groups (equal ``on``) with at most ``most`` right rows and the others."""
    large = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*on)
    large = cut_lineage(large)
    if large.isEmpty():  # nothing is shuffled to be split, and the joins that follow need not be merged
        return left, right, left.limit(0), right.limit(0)
    return (
        left.join(large, on, "left_anti"), right.join(large, on, "left_anti"),
        left.join(large, on, "left_semi"), right.join(large, on, "left_semi"),
    )


def _once(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Write both inputs once: they are read for key counts and again for the join. Those of groups are shuffled first and
    may be long, so they are written compressed; others keep their partitions."""
    write = store if on else cut_lineage
    stored = write(left)
    return stored, stored if right is left else write(right)


def _side(df: DataFrame, prefix: str, text: str, on: list[str]) -> DataFrame:
    """Rename the columns of one join side, except the equi-join columns."""
    return df.select(
        *[F.col(c).alias(c) if c in on else F.col(c).alias(f"{prefix}_{c}") for c in df.columns],
        F.col(text).alias(f"{prefix}_uid"),
    )


def ratio_candidates(
    left: DataFrame,
    right: DataFrame,
    text: str,
    threshold: float,
    on: list[str] | None = None,
    condition: Column | None = None,
    hot: int = _HOT_KEY_ROWS,
    word_order: bool = True,
    floor: str | None = None,
) -> DataFrame:
    """Every pair whose sequence ratio can reach ``threshold``, as ``l_*``/``r_*`` columns.

    With M matching characters and lengths m, n a ratio of t needs M >= t(m+n)/2. Hence: M cannot exceed the shared multiset
    of characters nor the longest common subsequence, and the edit distance cannot exceed (1-t)(m+n). All three hold for the
    exact score, none is an approximation.
    ``word_order=False`` bounds by shared characters alone, for scores that reorder words.
    ``floor`` names a left column with a higher threshold of the row's own (a score already found for it); the pairs then
    carry ``bound``, the highest ratio that the longest common subsequence allows.
    """
    on = on or []
    left, right = _once(left, right, on)
    tile_rows = min(hot, TILE_ROWS)

    def in_tiles(l: DataFrame, r: DataFrame) -> DataFrame:
        pairs = tile_pairs(_side(l, "l", text, on), _side(r, "r", text, on), text, on, threshold, floor, word_order, tile_rows)
        pairs = pairs if floor is not None else pairs.drop("bound")
        return (pairs if condition is None else pairs.filter(condition)).drop("l_uid", "r_uid")

    if not on or floor is not None:
        return in_tiles(left, right)

    tokens = tuple({f"{p}_tokens": _character_tokens(F.col(f"{p}_{text}"))} for p in "lr")
    a, b = F.col(f"l_{text}"), F.col(f"r_{text}")
    total = F.length(a) + F.length(b)
    fits = F.least(F.length(a), F.length(b)) * 2 >= F.lit(threshold) * total - F.lit(1e-9)
    fits = fits if condition is None else fits & condition
    shared = F.size(F.array_intersect("l_tokens", "r_tokens")) - 1
    enough = shared * 2 >= F.lit(threshold) * total - F.lit(1e-9)
    edits = F.call_function("levenshtein", a, b, F.floor((F.lit(1.0) - F.lit(threshold)) * total + F.lit(1e-9)).cast("int"))
    # a case keeps its order, so that the cheap tests spare the others
    close = F.when(~fits, False).when(edits < 0, False).otherwise(enough) if word_order else fits & enough
    small_l, small_r, large_l, large_r = _by_group_size(left, right, on, _DIRECT_GROUP)
    direct = _grid_join(_side(small_l, "l", text, on), _side(small_r, "r", text, on), on, close, _CELL_ROWS, tokens)
    return direct.drop("l_tokens", "r_tokens", "l_uid", "r_uid").unionByName(in_tiles(large_l, large_r))


def ratio_join(
    left: DataFrame,
    right: DataFrame,
    text: str,
    threshold: float,
    on: list[str] | None = None,
    condition: Column | None = None,
    right_first: bool = False,
    hot: int = _HOT_KEY_ROWS,
) -> DataFrame:
    """Pairs with sequence ratio (SM2) >= ``threshold`` and their ``score``."""
    pairs = ratio_candidates(left, right, text, threshold, on, condition, hot)
    first, second = (f"r_{text}", f"l_{text}") if right_first else (f"l_{text}", f"r_{text}")
    return pairs.withColumn("score", sequence_ratio(first, second)).filter(F.col("score") >= threshold)


def _signature(words: Column, p: str) -> dict[str, Column]:
    """One bit of 64 per word of a set, its size, and how many of its words share a bit with another of its words."""
    bits = F.aggregate(words, F.lit(0).cast("long"), lambda seen, w: seen.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))
    return {f"{p}_bits": bits, f"{p}_count": F.size(words), f"{p}_loose": F.size(words) - F.bit_count(bits)}


def _can_overlap(threshold: float) -> Column:
    """Whether the signatures allow an overlap of ``threshold``: common words have common bits, except those that share one.

    An overlap of t needs t / (1 + t) of both sizes' sum in common. No pair that has it is lost.
    """
    common = F.bit_count(F.col("l_bits").bitwiseAND(F.col("r_bits"))) + F.least("l_loose", "r_loose")
    return common >= (F.col("l_count") + F.col("r_count")) * F.lit(threshold / (1.0 + threshold)) - F.lit(1e-9)


def jaccard_join(
    left: DataFrame,
    right: DataFrame,
    words: str,
    threshold: float,
    on: list[str] | None = None,
    condition: Column | None = None,
    hot: int = _HOT_KEY_ROWS,
) -> DataFrame:
    """Pairs whose word sets (array column ``words``) overlap by at least ``threshold`` (SM1)."""
    on = on or []
    left, right = _once(left, right, on)
    able = _can_overlap(threshold)

    def exploded(df: DataFrame) -> DataFrame:
        return df.select(F.explode(words).alias("_w"))

    frequency = (
        exploded(left).unionByName(exploded(right)).groupBy("_w").agg(F.count(F.lit(1)).alias("_f"))
    )

    def prepare(df: DataFrame, p: str) -> DataFrame:
        side = renamed(df, p).withColumn(f"{p}_uid", F.to_json(F.struct(*[c if c in on else f"{p}_{c}" for c in df.columns])))
        # rank the few words of each distinct set by global rarity; bounded by the words of one name
        sets = side.select(F.col(f"{p}_{words}").alias("_set")).distinct()
        ranked = (
            sets.withColumn("_w", F.explode("_set"))
            .join(frequency, "_w")
            .groupBy("_set")
            .agg(F.array_sort(F.collect_list(F.struct("_f", "_w"))).alias("_ranked"))
        )
        size = F.size("_set")
        needed = F.ceil(size * F.lit(threshold) - F.lit(1e-9))
        prefix = F.slice(F.transform("_ranked", lambda s: s["_w"]), F.lit(1), (size - needed + 1).cast("int"))
        prefixes = ranked.select("_set", prefix.alias(f"{p}_prefix"))
        return (
            side.join(prefixes, side[f"{p}_{words}"] == prefixes["_set"])
            .drop("_set")
            .withColumn("_key", F.explode(f"{p}_prefix"))
        )

    first_key = F.get(F.array_intersect("l_prefix", "r_prefix"), 0) == F.col("_key")
    kept = able & first_key if condition is None else condition & able & first_key

    def through_keys(l: DataFrame, r: DataFrame) -> DataFrame:
        pairs = _grid_join(prepare(l, "l"), prepare(r, "r"), [*on, "_key"], kept, hot)
        return pairs.drop("_key", "l_prefix", "r_prefix", "l_uid", "r_uid")

    def renamed(df: DataFrame, p: str) -> DataFrame:
        side = df.select(*[F.col(c) if c in on else F.col(c).alias(f"{p}_{c}") for c in df.columns])
        return side.withColumns(_signature(F.col(f"{p}_{words}"), p))

    if on:
        small_l, small_r, large_l, large_r = _by_group_size(left, right, on, _SMALL_GROUP)
        direct = renamed(small_l, "l").hint("merge").join(renamed(small_r, "r"), on)
        direct = direct.filter(able if condition is None else condition & able)
        pairs = direct.unionByName(through_keys(large_l, large_r))
    else:
        pairs = through_keys(left, right)
    pairs = pairs.drop(*[f"{p}{c}" for p in "lr" for c in ("_bits", "_count", "_loose")])
    return pairs.withColumn("score", jaccard(F.col(f"l_{words}"), F.col(f"r_{words}"))).filter(F.col("score") >= threshold)


_LONG = 20


def _middle(text: Column) -> Column:
    """Piece from the middle of a text that any contained text covering 70% of it must include."""
    size = F.length(text)
    piece = F.when(size >= _LONG, F.lit(8)).otherwise(F.lit(4))
    return F.substring(text, F.floor((size - piece) / 2).cast("int") + 1, piece)


def _pieces(text: Column) -> Column:
    """All pieces a contained text can offer to longer texts it may cover."""
    size = F.length(text)

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    short = F.when((size >= 4) & (size < _LONG), grams(4)).otherwise(F.array().cast("array<string>"))
    long = F.when((size >= 8) & (size >= _LONG * CONTAIN_SHARE), grams(8)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(short, long))


def containment_join(
    left: DataFrame, right: DataFrame, text: str, on: list[str] | None = None, hot: int = _HOT_KEY_ROWS
) -> DataFrame:
    """SM5: pairs where one text contains the other and is at most 1/0.7 as long; left has >= 8 characters."""
    on = on or []
    left, right = _once(left, right, on)
    left = left.filter(F.length(text) >= CONTAIN_MIN_LENGTH)
    a, b = F.col(f"l_{text}"), F.col(f"r_{text}")
    share = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)) >= CONTAIN_SHARE
    b_inside = (F.length(a) > F.length(b)) & share & F.contains(a, b)
    a_inside = (F.length(b) >= F.length(a)) & share & F.contains(b, a)

    def through_pieces(left: DataFrame, right: DataFrame) -> DataFrame:
        l, r = _side(left, "l", text, on), _side(right, "r", text, on)
        keys = [*on, "_piece"]
        inside_right = _grid_join(
            l.withColumn("_piece", F.explode(_pieces(a))),
            r.filter(F.length(b) >= CONTAIN_MIN_LENGTH).withColumn("_piece", _middle(b)),
            keys, a_inside, hot,
        )
        inside_left = _grid_join(
            l.withColumn("_piece", _middle(a)), r.withColumn("_piece", F.explode(_pieces(b))), keys, b_inside, hot
        )
        return inside_right.unionByName(inside_left).drop("_piece")

    if not on:
        return through_pieces(left, right).drop("l_uid", "r_uid")
    small_l, small_r, large_l, large_r = _by_group_size(left, right, on, _DIRECT_GROUP)
    direct = _grid_join(_side(small_l, "l", text, on), _side(small_r, "r", text, on), on, b_inside | a_inside, _CELL_ROWS)
    return direct.unionByName(through_pieces(large_l, large_r)).drop("l_uid", "r_uid")
