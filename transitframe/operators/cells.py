"""Adaptive cells over the plane (a quadtree): where many edges or sites meet, a cell is cut in four, and again.

An index is a table with one row per leaf cell and a short array of entries, built level by level. Points look their leaf
up by an equi-join, so they are never regrouped. Cells of level ``n`` have the side ``cell / 2**n``; dividing by a power of
two is exact, so cells nest exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitframe.functions import geo
from transitframe.session import cut_lineage

#: a cell with more entries than this is cut in four, down to the deepest level
ENTRIES = 64
DEEPEST = 10
#: degrees by which the extent of an edge is widened, far above rounding and far below a cell
_EPS = 1e-9
_NODE = ["_cx", "_cy"]


class Index(NamedTuple):
    """``leaves(_level, _cx, _cy, _entries)``; ``depths(_cx, _cy, _depth)`` of the first-level cells that are cut, or None."""

    leaves: DataFrame
    depths: DataFrame | None
    cell: float


def cell_of(value: Column, cell: float, level: int | Column = 0) -> Column:
    scale = F.lit(float(2**level)) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    return F.floor(value / F.lit(cell) * scale).cast("long")


def _children(nodes: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct((F.col("_cx") * 2 + i).alias("x"), (F.col("_cy") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)])
    return nodes.select(F.explode(pairs).alias("_c")).select(F.col("_c.x").alias("_cx"), F.col("_c.y").alias("_cy"))


def build(entries_at: Callable[[int, DataFrame | None, DataFrame | None], DataFrame], gather: Callable[[DataFrame], DataFrame], cell: float) -> Index:
    """``entries_at(level, cells, parents)`` gives the entries (``_cx``, ``_cy``, ``_weight``, …) of the named cells from the
    entries of the level above; ``gather`` makes them one row a cell with the array ``_entries``. The number of levels depends
    on how dense the densest cell is, not on the rows."""
    leaves, cuts, wanted, parents = None, None, None, None
    for level in range(DEEPEST + 1):
        entries = cut_lineage(entries_at(level, wanted, parents))
        full = entries.groupBy(*_NODE).agg(F.sum("_weight").alias("_n")).filter(F.col("_n") > ENTRIES).select(*_NODE)
        full = cut_lineage(full) if level < DEEPEST else full.limit(0)
        here = gather(entries.join(full, _NODE, "left_anti"))
        if wanted is not None:  # a cut cell has four parts, also empty ones
            here = wanted.join(full, _NODE, "left_anti").join(here, _NODE, "left")
        here = here.withColumn("_level", F.lit(level))
        leaves = here if leaves is None else leaves.unionByName(here)
        if full.isEmpty():
            break
        roots = full.select(*[F.shiftright(c, level).alias(c) for c in _NODE], F.lit(level + 1).alias("_depth"))
        cuts = roots if cuts is None else cuts.unionByName(roots)
        wanted, parents = cut_lineage(_children(full)), entries.join(full, _NODE, "left_semi")
    depths = None if cuts is None else cut_lineage(cuts.groupBy(*_NODE).agg(F.max("_depth").alias("_depth")))
    return Index(cut_lineage(leaves), depths, cell)


def with_entries(points: DataFrame, index: Index) -> DataFrame:
    """Every point (``lon``, ``lat``) once, with the array ``_entries`` of its leaf, null where there is none."""
    at = {"_cx": cell_of(F.col("lon"), index.cell), "_cy": cell_of(F.col("lat"), index.cell)}
    if index.depths is None:
        return points.withColumns(at).join(index.leaves.drop("_level"), _NODE, "left").drop(*_NODE)
    # a point of a cut cell asks at every level, but only its leaf answers
    placed = points.withColumns(at).join(index.depths, _NODE, "left")
    asked = placed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.coalesce("_depth", F.lit(0)))))
    asked = asked.withColumns({"_cx": cell_of(F.col("lon"), index.cell, F.col("_level")), "_cy": cell_of(F.col("lat"), index.cell, F.col("_level"))})
    answered = asked.join(index.leaves.withColumn("_leaf", F.lit(True)), ["_level", *_NODE], "left")
    return answered.filter(F.col("_depth").isNull() | F.col("_leaf")).drop("_level", "_depth", "_leaf", *_NODE)


# --- polygons ------------------------------------------------------------------------------------------


def _edges(shapes: DataFrame) -> DataFrame:
    """One row per edge (1 to 2) of every ring, with the vertices before and after it (0 and 3)."""
    rings = (
        shapes.withColumn("_shape", F.monotonically_increasing_id())
        .select("_shape", "zone_ord", "zone_name", F.posexplode("parts").alias("_part", "_rings"))
        .select("_shape", "zone_ord", "zone_name", "_part", F.posexplode("_rings").alias("_ring", "_path"))
        .filter(F.size("_path") > 0)
    )
    path, size = F.col("_path"), F.size("_path")

    def turned(n: int) -> Column:  # the ring from its n-th vertex on
        start = F.pmod(F.lit(n), size)
        return F.concat(F.slice(path, start + 1, size), F.slice(path, 1, start))

    vertices = F.arrays_zip(*[turned(n).alias(f"v{n + 1}") for n in (-1, 0, 1, 2)])
    rows = rings.select("_shape", "zone_ord", "zone_name", "_part", "_ring", F.explode(vertices).alias("_v"))
    return rows.select(
        "_shape", "zone_ord", "zone_name", "_part", "_ring",
        *[F.col(f"_v.v{n}.{c}").alias(f"{axis}{n}") for n in range(4) for c, axis in (("lon", "x"), ("lat", "y"))],
    )


def _reach(a: int, b: int, side: float, outward) -> Column:
    """West (``F.least``) or east (``F.greatest``) end, as a longitude, of the part of edge a-b inside the row ``_cy``."""
    xa, ya, xb, yb = F.col(f"x{a}"), F.col(f"y{a}"), F.col(f"x{b}"), F.col(f"y{b}")
    low = F.greatest(F.least(ya, yb), F.col("_cy") * F.lit(side) - F.lit(_EPS))
    high = F.least(F.greatest(ya, yb), (F.col("_cy") + 1) * F.lit(side) + F.lit(_EPS))
    at = lambda y: xa + (xb - xa) * ((y - ya) / (yb - ya))
    return F.when(ya == yb, outward(xa, xb)).otherwise(outward(at(low), at(high)))


def polygon_index(shapes: DataFrame, cell: float, first_only: bool = False) -> Index:
    """Index of ``shapes(zone_ord, zone_name, parts array<array<array<struct<lon,lat>>>>)`` for points in polygons.

    A leaf holds, per ring, the edges that run through it and whether an odd number of other edges lies east of its bottom.
    Above the bottom that number's parity changes only at a vertex where an edge of the leaf meets an edge east of it; the
    edge is marked there. So a point counts the edges of its leaf alone, with the crossing rule and rounding of the whole ring.

    ``first_only``: in a leaf that lies wholly inside a zone, zones later in order are left out, because they cannot be first.
    Null shapes, empty rings and vertices without coordinates hold no point.
    """
    edges = cut_lineage(_edges(shapes))
    ring = ["_shape", "zone_ord", "zone_name", "_part", "_ring"]

    def entries_at(level: int, cells: DataFrame | None, _: DataFrame | None) -> DataFrame:
        side = cell / 2**level
        low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
        rows = edges.withColumn("_cy", F.explode(F.sequence(cell_of(low, cell, level), cell_of(high, cell, level))))
        if cells is not None:
            rows = rows.join(cells.select("_cy").distinct(), "_cy", "left_semi")
        west = lambda a, b: cell_of(_reach(a, b, side, F.least) - F.lit(_EPS), cell, level)
        rows = rows.withColumns({"_west": west(1, 2), "_east": cell_of(_reach(1, 2, side, F.greatest) + F.lit(_EPS), cell, level)})
        turns = {
            "t1": (west(0, 1) > F.col("_cx")) & (cell_of(F.col("y1"), cell, level) == F.col("_cy")),
            "t2": (west(2, 3) > F.col("_cx")) & (cell_of(F.col("y2"), cell, level) == F.col("_cy")),
        }
        near = rows.withColumn("_cx", F.explode(F.sequence("_west", "_east")))
        near = near if cells is None else near.join(cells, _NODE, "left_semi")
        edge = F.struct("x1", "y1", "x2", "y2", *[v.alias(k) for k, v in turns.items()])
        near = near.select(*_NODE, *ring, edge.alias("_edge"), F.lit(False).alias("_odd"))
        # cells with an odd number of edges east of their bottom: every second gap between those edges' west ends
        ends = rows.filter(cell_of(low, cell, level) < F.col("_cy")).groupBy(*ring, "_cy", "_west").agg((F.count(F.lit(1)) % 2).alias("_odd")).filter("_odd = 1")
        # one row per cell of the row at most, whatever the number of edges
        order = Window.partitionBy(*ring, "_cy").orderBy("_west")
        gaps = ends.select(*ring, "_cy", F.lag("_west").over(order).alias("_from"), (F.col("_west") - 1).alias("_to"), F.row_number().over(order).alias("_n")).filter("_n % 2 = 0")
        if cells is None:
            inner = gaps.withColumn("_cx", F.explode(F.sequence("_from", "_to")))
        else:
            inner = gaps.join(cells, "_cy").filter(F.col("_cx").between(F.col("_from"), F.col("_to")))
        inner = inner.select(*_NODE, *ring, F.lit(None).cast(near.schema["_edge"].dataType).alias("_edge"), F.lit(True).alias("_odd"))
        found = near.unionByName(inner).withColumn("_weight", F.col("_edge").isNotNull().cast("int"))
        if not first_only:
            return found
        covered = found.groupBy(*_NODE, *ring).agg(F.sum("_weight").alias("_n")).filter("_n = 0").groupBy(*_NODE).agg(F.min("zone_ord").alias("_cover"))
        return found.join(covered, _NODE, "left").filter("_cover is null or zone_ord <= _cover").drop("_cover")

    def gather(entries: DataFrame) -> DataFrame:
        per_ring = entries.groupBy(*_NODE, *ring).agg(F.max("_odd").alias("_odd"), F.collect_list("_edge").alias("_edges"))
        return per_ring.groupBy(*_NODE).agg(F.collect_list(F.struct(*ring, "_odd", "_edges")).alias("_entries"))

    return build(entries_at, gather, cell)


def shapes_at(lon: Column, lat: Column, strict: bool) -> Column:
    """Array of (zone_ord, zone_name) of the shapes of ``_entries`` that hold the point; ``strict`` selects the crossing rule."""

    def odd(entry: Column) -> Column:
        crosses = geo.crosses_strict if strict else geo.crosses
        passed = (lambda y: y <= lat) if strict else (lambda y: y < lat)
        n = F.size(F.filter(entry["_edges"], lambda e: crosses(lon, lat, e["x1"], e["y1"], e["x2"], e["y2"])))
        n = n + F.size(F.filter(entry["_edges"], lambda e: e["t1"] & passed(e["y1"])))
        n = n + F.size(F.filter(entry["_edges"], lambda e: e["t2"] & passed(e["y2"])))
        return (n + entry["_odd"].cast("int")) % 2 == 1

    inside = F.filter("_entries", odd)
    hole = lambda outer, h: (h["_ring"] > 0) & (h["_shape"] == outer["_shape"]) & (h["_part"] == outer["_part"])
    kept = F.filter(inside, lambda z: (z["_ring"] == 0) & ~F.exists(inside, lambda h: hole(z, h)))
    named = F.transform(kept, lambda z: F.struct(z["_shape"].alias("shape"), z["zone_ord"].alias("zone_ord"), z["zone_name"].alias("zone_name")))
    return F.array_distinct(named)


# --- sites ---------------------------------------------------------------------------------------------


def site_index(sites: DataFrame, radius_m: float, cell: float) -> Index:
    """Index of ``sites(name, lat, lon)`` for the nearest site within ``radius_m`` of a point.

    A site stays in a cell only if it can be nearest to, and within reach of, some point of the cell: with the distances d to
    the middle of the cell and h from there to a corner, d <= radius + h and d <= least d + 2h. Cutting a cell shrinks h, so
    what stays is bounded by the geometry, not by the number of sites. Of the sites of one place only the least name can be
    found; the others would fill its cells at every level. Sites without coordinates are never found.
    """
    located = sites.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min(F.struct("name")).alias("_s"))
    located = located.select("_s.name", "lat", "lon")
    reach = radius_m / 110_000.0
    reach_lon = F.lit(reach) / F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(89.0))))

    def entries_at(level: int, cells: DataFrame | None, parents: DataFrame | None) -> DataFrame:
        side = cell / 2**level
        if cells is None:
            spread = located.withColumn("_cx", F.explode(F.sequence(cell_of(F.col("lon") - reach_lon, cell), cell_of(F.col("lon") + reach_lon, cell))))
            spread = spread.withColumn("_cy", F.explode(F.sequence(cell_of(F.col("lat") - reach, cell), cell_of(F.col("lat") + reach, cell))))
        else:
            quarters = F.explode(F.array(*[F.struct((F.col("_cx") * 2 + i).alias("x"), (F.col("_cy") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)]))
            spread = parents.select("name", "lat", "lon", quarters.alias("_q")).select("name", "lat", "lon", F.col("_q.x").alias("_cx"), F.col("_q.y").alias("_cy"))
        mid_lat, mid_lon = (F.col("_cy") + 0.5) * F.lit(side), (F.col("_cx") + 0.5) * F.lit(side)
        corners = [geo.haversine_km(mid_lat, mid_lon, mid_lat + F.lit(dy * side), mid_lon + F.lit(side / 2)) for dy in (-0.5, 0.5)]
        # a hundredth more covers rounding and the curvature of a cell
        half = F.greatest(*corners) * 1010 + 0.001
        measured = spread.withColumns({"_d": geo.haversine_km(mid_lat, mid_lon, F.col("lat"), F.col("lon")) * 1000, "_h": half})
        measured = measured.filter(F.col("_d") <= F.col("_h") + radius_m)
        least = measured.groupBy(*_NODE).agg(F.min("_d").alias("_least"))
        kept = measured.join(least, _NODE).filter(F.col("_d") <= F.col("_least") + F.col("_h") * 2)
        return kept.select(*_NODE, "name", "lat", "lon", F.lit(1).alias("_weight"))

    gather = lambda e: e.groupBy(*_NODE).agg(F.collect_list(F.struct("name", "lat", "lon")).alias("_entries"))
    return build(entries_at, gather, cell)
