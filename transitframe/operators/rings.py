"""GE10-GE11: boundary rings from ways, for the ways of all relations at once.

Ends that meet at a point are paired; a pairing is a "next way" pointer for each direction a way can be walked in.
Pointer doubling finds the closed walks and every way's place in its ring, in a number of rounds that is the logarithm
of the longest ring. A relation of any size is spread over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitframe.session import cut_lineage

_STATE = ["relation", "way_ord", "flip"]


def _next_states(ways: DataFrame) -> DataFrame:
    """relation, way_ord, flip (1: walked backwards), next_way, next_flip (null where nothing follows)."""
    ends = ways.select("relation", "way_ord", F.posexplode(F.array(F.get("path", F.lit(0)), F.element_at("path", -1))).alias("end", "point"))
    at_point = Window.partitionBy("relation", "point").orderBy("way_ord", "end")
    paired = ends.withColumn("pair", F.floor((F.row_number().over(at_point) - 1) / 2))
    other = paired.select("relation", "point", "pair", F.col("way_ord").alias("next_way"), F.col("end").alias("next_flip"))
    mates = paired.join(other, ["relation", "point", "pair"]).where("way_ord <> next_way")
    # a walk leaves by the last point, or by the first when flipped, and enters the next way at the paired end
    leaving = mates.select("relation", "way_ord", (1 - F.col("end")).alias("flip"), "next_way", "next_flip")
    states = ways.select("relation", "way_ord", F.explode(F.array(F.lit(0), F.lit(1))).alias("flip"))
    return states.join(leaving, _STATE, "left")


def _ahead(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` beside the values of the state its pointer names."""
    there = df.select("relation", F.col("way_ord").alias("next_way"), F.col("flip").alias("next_flip"), *[c.alias(a) for a, c in columns.items()])
    return df.join(there, ["relation", "next_way", "next_flip"], "left")


def _closed_walks(states: DataFrame) -> DataFrame:
    """State columns with ``least``: the least state of the closed walk it lies on; null on open chains."""
    walk = cut_lineage(states.withColumns({"least": F.struct("way_ord", "flip"), "moved": F.lit(True)}))
    while walk.where("moved").take(1):
        both = _ahead(walk, {"far_way": F.col("next_way"), "far_flip": F.col("next_flip"), "far_least": F.col("least")})
        least = F.least("least", "far_least")
        moved = F.col("next_way").isNotNull() & ((least != F.col("least")) | F.col("far_way").isNull())
        walk = cut_lineage(both.select(*_STATE, F.col("far_way").alias("next_way"), F.col("far_flip").alias("next_flip"), least.alias("least"), moved.alias("moved")))
    return walk.select(*_STATE, F.when(F.col("next_way").isNotNull(), F.col("least")).alias("least"))


def _steps_to_last(states: DataFrame) -> DataFrame:
    """``states`` whose walks end: with ``last`` (the last state) and ``steps`` to it."""
    ends = F.col("next_way").isNull()
    walk = states.withColumns({"steps": F.when(ends, 0).otherwise(1).cast("long"), "last": F.when(ends, F.struct("way_ord", "flip")).otherwise(F.struct(F.col("next_way").alias("way_ord"), F.col("next_flip").alias("flip")))})
    walk = cut_lineage(walk)
    while walk.where("next_way is not null").take(1):
        both = _ahead(walk, {"far_way": F.col("next_way"), "far_flip": F.col("next_flip"), "far_steps": F.col("steps"), "far_last": F.col("last")})
        walk = cut_lineage(both.select(
            *_STATE, "least", F.col("far_way").alias("next_way"), F.col("far_flip").alias("next_flip"),
            (F.col("steps") + F.coalesce("far_steps", F.lit(0))).alias("steps"), F.coalesce("far_last", "last").alias("last")))
    return walk.select(*_STATE, "least", "steps", "last")


def assemble_rings(ways: DataFrame) -> DataFrame:
    """GE10: every way's place in the ring or open chain it belongs to.

    ``ways(relation, way_ord, path array<struct<lon,lat>>)``, ``way_ord`` unique in its relation. Gives relation,
    ring_ord (the least way of the ring, which is walked forwards), position, way_ord, path (turned as walked), closed.
    """
    single = F.get("path", F.lit(0)) == F.element_at("path", -1)
    states = cut_lineage(_next_states(ways.where(~single)))
    cycles = _closed_walks(states)
    states = states.join(cycles, _STATE)
    # of the two directions of a closed walk keep the one with the least way forwards, and open it there
    states = states.where("least is null or least.flip = 0")
    opens = F.col("least") == F.struct("way_ord", "flip")
    states = states.withColumns({c: F.when(F.coalesce(opens, F.lit(False)), None).otherwise(F.col(c)) for c in ("next_way", "next_flip")})
    placed = _steps_to_last(states)
    walks = placed.groupBy("relation", "last").agg(F.min(F.struct("way_ord", "flip")).alias("first"), F.count("*").alias("n"))
    placed = placed.join(walks, ["relation", "last"]).where("first.flip = 0")
    closed = F.col("least").isNotNull()
    position = F.when(closed, (F.col("n") - F.col("steps")) % F.col("n")).otherwise(F.col("n") - 1 - F.col("steps"))
    turned = F.when(F.col("flip") == 1, F.reverse("path")).otherwise(F.col("path"))
    joined = placed.join(ways, ["relation", "way_ord"]).select("relation", F.col("first.way_ord").alias("ring_ord"), position.alias("position"), "way_ord", turned.alias("path"), closed.alias("closed"))
    alone = ways.where(single).select("relation", F.col("way_ord").alias("ring_ord"), F.lit(0).cast("long").alias("position"), "way_ord", "path", F.lit(True).alias("closed"))
    return joined.unionByName(alone)


def ring_vertices(pieces: DataFrame) -> DataFrame:
    """relation, ring_ord, closed, position, step, lon, lat: the vertices in order, joints once."""
    rows = pieces.select("relation", "ring_ord", "closed", "position", F.posexplode("path").alias("step", "point"))
    return rows.where("position = 0 or step > 0").select("relation", "ring_ord", "closed", "position", "step", "point.lon", "point.lat")


def largest_closed_ring(pieces: DataFrame) -> DataFrame:
    """GE11: relation, ring_ord, n_points, area of the closed ring of most area with at least four vertices; the first among equals.

    Shoelace terms add up way by way, so a ring is never gathered.
    """
    ahead = F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))
    terms = F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), ahead, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    cross = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    rings = pieces.where("closed").groupBy("relation", "ring_ord").agg((F.sum(F.size("path") - 1) + 1).alias("n_points"), (F.abs(F.sum(cross)) / 2).alias("area"))
    best = rings.where("n_points >= 4").groupBy("relation").agg(F.min_by(F.struct("ring_ord", "n_points", "area"), F.struct(-F.col("area"), F.col("ring_ord"))).alias("best"))
    return best.select("relation", "best.*")
