"""Joins between route tables (JN*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitframe.functions import codes
from transitframe.functions import text as tx
from transitframe.functions import values
from transitframe.operators.ordered import first_wins, global_ordinal, last_wins
from transitframe.rules import NO_CODE_GROUP


def geometry_with_itinerary(itinerary_lines: DataFrame, geometry: DataFrame) -> DataFrame:
    """JN1: per itinerary line, the geometry entry of each direction by comparison key.

    ``geometry(line_name, direction, path_id, n_points, ord)``; the last entry of a repeated name wins.
    """
    keyed = geometry.filter(F.col("line_name") != "").withColumn("key", tx.norm_key("line_name"))
    latest = last_wins(keyed, ["key", "direction"], ["ord"], ["path_id", "n_points"])
    both = latest.groupBy("key").agg(
        *[
            F.max(F.when(F.col("direction") == d, F.struct("path_id", "n_points"))).alias(d)
            for d in ("ida", "volta")
        ]
    )
    joined = itinerary_lines.withColumn("key", tx.norm_key("line_name")).join(both, "key", "left")
    return joined.select(
        "line_name",
        *[F.coalesce(F.col(f"{d}.n_points"), F.lit(0)).alias(f"{d}_points") for d in ("ida", "volta")],
        *[(F.coalesce(F.col(f"{d}.n_points"), F.lit(0)) == 0).alias(f"missing_{d}") for d in ("ida", "volta")],
    )


def lines_with_timetable(lines: DataFrame, timetable: DataFrame, key: str = "prefix4") -> DataFrame:
    """JN2/SK4: departures keyed by line id, by four-digit prefix or by full code."""
    code = codes.code_dialect("line_name", "prefix4") if key == "prefix4" else codes.line_code("line_name")
    return lines.select("line_id", code.alias("line_code")).join(timetable, "line_code")


def zip_by_position(points: DataFrame, addresses: DataFrame, point_order: list[str], address_order: list[str]) -> DataFrame:
    """JN3: pair the n-th point with the n-th address; stops at the shorter table."""
    left = global_ordinal(points, point_order, "ordinal")
    right = global_ordinal(addresses, address_order, "ordinal")
    return left.join(right, "ordinal")


def reuse_codes(manual: DataFrame, system: DataFrame) -> DataFrame:
    """JN5: code and match of the same street on the same line and direction, else none and 'manual'."""
    on = ["line_code", "direction", "key"]
    known = first_wins(
        system.withColumn("key", tx.norm_key("street")).filter(F.col("key") != ""), on, ["line_id", "seq"], ["street_code", "match"]
    ).withColumn("found", F.lit(True))
    return (
        manual.withColumn("key", tx.norm_key("street"))
        .join(known, on, "left")
        .select(
            *[c for c in manual.columns if c not in ("street_code", "match")],
            "street_code",
            F.when(F.col("found"), F.col("match")).otherwise("manual").alias("match"),
            F.coalesce("found", F.lit(False)).alias("reused"),
        )
    )


def registry_codes(neighbourhood: DataFrame, registry: DataFrame) -> DataFrame:
    """JN6: registry codes of every neighbourhood street by comparison key (1:n), one row per code, null when unmatched;
    with the number of codes and the first registry spelling of the key."""
    keyed = registry.withColumn("key", tx.norm_key("street"))
    totals = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_codes"), F.min_by("street", "ord").alias("registry_street"))
    codes_of = keyed.select("key", F.col("street_code").alias("registry_code")).join(totals, "key")
    return neighbourhood.withColumn("key", tx.norm_key("street")).join(codes_of, "key", "left").select(
        *neighbourhood.columns, "registry_code", "n_codes", "registry_street"
    )


def unused_registry(registry: DataFrame, neighbourhood: DataFrame) -> DataFrame:
    """JN6: registry rows whose street no neighbourhood lists."""
    used = neighbourhood.select(tx.norm_key("street").alias("key")).distinct()
    return registry.withColumn("key", tx.norm_key("street")).join(used, "key", "left_anti").drop("key")


def neighbourhood_of_code(streets: DataFrame, code_neighbourhood: DataFrame) -> DataFrame:
    """JN7: neighbourhood by street code; streets without a known code fall in one sentinel group."""
    return streets.join(code_neighbourhood, "street_code", "left").withColumn(
        "neighbourhood", F.coalesce("neighbourhood", F.lit(NO_CODE_GROUP))
    )


def names_from_two_sources(codes_table: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """JN8: line name from the first source that has a non-empty one, else the empty string."""
    a = first.select("line_code", F.col("line_name").alias("_a"))
    b = second.select("line_code", F.col("line_name").alias("_b"))
    return codes_table.join(a, "line_code", "left").join(b, "line_code", "left").select(
        "line_code", F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit("")), F.lit("")).alias("line_name")
    )


def locate_pairs(pairs: DataFrame, itinerary: DataFrame) -> DataFrame:
    """JN9: where each spelling of a duplicate pair is used; pairs used nowhere drop out.

    ``pairs(pair_id, street_a, street_b)`` -> one row per pair, side, line and direction.
    """
    sides = pairs.select(
        "pair_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("street_a").alias("street")),
                                     F.struct(F.lit("b").alias("side"), F.col("street_b").alias("street")))).alias("s"),
    ).select("pair_id", "s.side", "s.street", F.upper("s.street").alias("key"))
    usage = itinerary.select(F.upper("street").alias("key"), "line_name", "direction")
    return sides.join(usage, "key").select("pair_id", "side", "street", "line_name", "direction")


def resolve_cache(points: DataFrame, cache: DataFrame) -> DataFrame:
    """JN11/GE13: address of each point from the rounded-coordinate cache, null when it must be looked up."""
    keyed = points.withColumn("key", values.cache_key(F.col("lat"), F.col("lon")))
    return keyed.join(cache, "key", "left")


def cache_misses(points: DataFrame, cache: DataFrame) -> DataFrame:
    """JN11: distinct keys still to be geocoded."""
    keyed = points.select(values.cache_key(F.col("lat"), F.col("lon")).alias("key"))
    return keyed.distinct().join(cache, "key", "left_anti")
