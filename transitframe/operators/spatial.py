"""Geospatial operators (GE*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitframe import rules
from transitframe.functions import geo
from transitframe.operators import cells
from transitframe.operators.ordered import neighbour, running_sum

_SEQ_BLOCK = 10_000


def segments(points: DataFrame, keys: list[str]) -> DataFrame:
    """WN1: consecutive vertex pairs with their distance, by an equi-join on the dense ``seq``."""
    pairs = neighbour(points.select(*keys, "seq", "lat", "lon"), keys, {"lat": "lat2", "lon": "lon2"})
    return pairs.filter(F.col("lat2").isNotNull()).withColumn(
        "km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    )


def point_counts(points: DataFrame, keys: list[str]) -> DataFrame:
    """M7: vertices of each path."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))


def reversed_paths(points: DataFrame, keys: list[str]) -> DataFrame:
    """A1: the same vertices numbered from the other end; ``seq`` is dense from 0."""
    counted = points.join(point_counts(points, keys), keys)
    return counted.withColumn("seq", F.col("n_points") - 1 - F.col("seq")).drop("n_points")


def path_lengths(points: DataFrame, keys: list[str]) -> DataFrame:
    """GE2: length of each path in km at two decimals; single points have length 0."""
    counted = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    lengths = segments(points, keys).groupBy(*keys).agg(F.sum("km").alias("km"))
    return counted.join(lengths, keys, "left").withColumn("km", F.round(F.coalesce("km", F.lit(0.0)), 2))


def line_lengths(lengths: DataFrame, line_key: str = "line_id") -> DataFrame:
    """GE2: both directions and the total, the total summed from rounded parts."""
    by = {d: F.coalesce(F.max(F.when(F.col("direction") == d, F.col("km"))), F.lit(0.0)) for d in rules.DIRECTIONS}
    both = lengths.groupBy(line_key).agg(*[c.alias(f"km_{d}") for d, c in by.items()])
    return both.withColumn("km_total", F.round(F.col("km_ida") + F.col("km_volta"), 2))


def resample(points: DataFrame, keys: list[str], spacing_m: float = 25.0) -> DataFrame:
    """GE3/GE4: vertices every ``spacing_m`` Web-Mercator metres along each path, end point appended.

    Every segment emits its own samples from the running length at its start, so paths of any length are
    spread over tasks. Paths of one vertex or zero length come back unchanged.
    """
    x, y = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat"))
    projected = points.select(*keys, "seq", "lat", "lon", x.alias("x"), y.alias("y"))
    pairs = neighbour(projected, keys, {"x": "x2", "y": "y2", "lat": "lat2", "lon": "lon2"}).filter("x2 is not null")
    pairs = pairs.withColumn("metres", F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2)))
    along = running_sum(pairs, keys, ["seq"], F.floor(F.col("seq") / _SEQ_BLOCK), "metres", "upto")
    totals = along.groupBy(*keys).agg(
        F.max("upto").alias("length"), F.max("seq").alias("last_seq"),
        F.max_by(F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon")), "seq").alias("end"),
    )
    moving = totals.filter(F.col("length") > 0)
    start = F.col("upto") - F.col("metres")
    space = F.lit(float(spacing_m))
    first = F.ceil(start / space - F.lit(1e-12)).cast("long")
    last = (F.ceil(F.col("upto") / space - F.lit(1e-12)) - 1).cast("long")
    samples = (
        along.join(moving.select(*keys, "length"), keys)
        .filter((F.col("metres") > 0) & (last >= first))
        .withColumn("step", F.explode(F.sequence(first, last)))
        .filter(F.col("step") * space < F.col("length"))
        .withColumn("share", (F.col("step") * space - start) / F.col("metres"))
        .select(
            *keys, F.col("step").alias("seq"),
            geo.lat_of(F.col("y") + (F.col("y2") - F.col("y")) * F.col("share")).alias("lat"),
            geo.lon_of(F.col("x") + (F.col("x2") - F.col("x")) * F.col("share")).alias("lon"),
        )
    )
    ends = moving.select(
        *keys, F.ceil(F.col("length") / space - F.lit(1e-12)).cast("long").alias("seq"), F.col("end.lat"), F.col("end.lon")
    )
    still = points.join(moving.select(*keys), keys, "left_anti").select(*keys, F.col("seq").cast("long"), "lat", "lon")
    return samples.unionByName(ends).unionByName(still)


def zone_of_points(points: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """GE5/GE6: first zone in list order that contains the point, else the outside label.

    One left equi-join with the leaf cells of the zones (``cells.polygon_index``); points are never regrouped. ``cell`` is
    the side of the largest cells, near the size of a small zone. Spark broadcasts the cells only while their measured size
    is below its threshold. Points without coordinates lie outside.
    """
    index = cells.polygon_index(zones.select("zone_ord", "zone_name", F.array(F.array("ring")).alias("parts")), cell, first_only=True)
    held = F.transform(cells.shapes_at(F.col("lon"), F.col("lat"), strict=False), lambda z: F.struct(z["zone_ord"], z["zone_name"]))
    return (
        cells.with_entries(points, index)
        .withColumn("zone_name", F.coalesce(F.array_min(held)["zone_name"], F.lit(rules.OUTSIDE_ZONES)))
        .drop("_entries")
    )


def boxes_of_points(points: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """JN10: ``boxes``, the number of zones whose bounding box holds the point, edges included."""
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    boxed = zones.select(F.array_min(lon).alias("w"), F.array_max(lon).alias("e"), F.array_min(lat).alias("s"), F.array_max(lat).alias("n"))
    boxed = boxed.withColumn("_cx", F.explode(F.sequence(cells.cell_of(F.col("w"), cell), cells.cell_of(F.col("e"), cell))))
    boxed = boxed.withColumn("_cy", F.explode(F.sequence(cells.cell_of(F.col("s"), cell), cells.cell_of(F.col("n"), cell))))
    index = boxed.groupBy("_cx", "_cy").agg(F.collect_list(F.struct("w", "e", "s", "n")).alias("_boxes"))
    holding = F.filter("_boxes", lambda b: F.col("lon").between(b["w"], b["e"]) & F.col("lat").between(b["s"], b["n"]))
    placed = points.withColumns({"_cx": cells.cell_of(F.col("lon"), cell), "_cy": cells.cell_of(F.col("lat"), cell)})
    counted = F.when(F.col("_boxes").isNull(), 0).otherwise(F.size(holding)).cast("long")
    return placed.join(index, ["_cx", "_cy"], "left").withColumn("boxes", counted).drop("_cx", "_cy", "_boxes")


def zone_share(points: DataFrame, zones: DataFrame, cell: float, line_key: str = "line_id") -> DataFrame:
    """GE8/AG6/WN10: points per line and zone and their percent of the line total."""
    counts = zone_of_points(points, zones, cell).groupBy(line_key, "zone_name").agg(F.count(F.lit(1)).alias("points"))
    totals = counts.groupBy(line_key).agg(F.sum("points").alias("total"))
    return counts.join(totals, line_key).withColumn("percent", F.round(F.col("points") * 100.0 / F.col("total"), 4))


def shapes_containing(points: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """GE7: every (point, shape) hit for shapes with holes and several parts.

    ``shapes(zone_ord, zone_name, parts array<array<array<struct<lon,lat>>>>)``. A point is in a shape if it is inside the
    outer ring and in no hole of some part.
    """
    index = cells.polygon_index(shapes, cell)
    held = cells.shapes_at(F.col("lon"), F.col("lat"), strict=True)
    hits = cells.with_entries(points, index).withColumn("_hit", F.explode(held)).drop("_entries")
    return hits.withColumns({"zone_ord": F.col("_hit.zone_ord"), "zone_name": F.col("_hit.zone_name")}).drop("_hit")


def nearest_terminal(points: DataFrame, terminals: DataFrame, radius_m: float) -> DataFrame:
    """GE9: nearest terminal within ``radius_m`` (ground metres) of each point, null when there is none; the least name
    among equals. Points meet the few terminals of their leaf cell (``cells.site_index``) in one join."""
    index = cells.site_index(terminals, radius_m, max(radius_m / 55_000.0, 1e-4))
    metres = lambda t: geo.haversine_km(F.col("lat"), F.col("lon"), t["lat"], t["lon"]) * 1000
    nearest = F.array_min(F.transform("_entries", lambda t: F.struct(metres(t).alias("metres"), t["name"].alias("terminal"))))
    found = cells.with_entries(points, index).withColumn("_near", nearest).drop("_entries")
    within = F.col("_near.metres") < radius_m
    return found.withColumns({"terminal": F.when(within, F.col("_near.terminal")), "metres": F.when(within, F.col("_near.metres"))}).drop("_near")


def terminal_or_zone(points: DataFrame, terminals: DataFrame, zones: DataFrame, radius_m: float, cell: float) -> DataFrame:
    """GE9: the nearest terminal, else the zone, else nothing."""
    placed = zone_of_points(nearest_terminal(points, terminals, radius_m), zones, cell)
    outside = F.col("zone_name") == rules.OUTSIDE_ZONES
    return placed.withColumn(
        "kind", F.when(F.col("terminal").isNotNull(), "terminal").when(~outside, "zone")
    ).withColumn("place", F.when(F.col("terminal").isNotNull(), F.col("terminal")).when(~outside, F.col("zone_name")))


def best_geocoder_feature(features: DataFrame) -> DataFrame:
    """GE12: per query the first polygonal feature of the highest-priority address type."""
    priority = F.array_position(F.array(*[F.lit(t) for t in rules.GEOCODER_TYPES]), F.col("address_type"))
    usable = features.filter((priority > 0) & F.col("geometry_type").isin("Polygon", "MultiPolygon"))
    columns = [c for c in features.columns if c != "query"]
    return usable.groupBy("query").agg(
        F.min_by(F.struct(*columns), F.struct(priority, "ord")).alias("_f")
    ).select("query", "_f.*")
