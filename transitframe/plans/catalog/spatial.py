"""Geospatial queries (GE, WN1, AG6)."""

from pyspark.sql import functions as F

from transitframe.functions import geo
from transitframe.operators import rings, spatial
from transitframe.plans import domain as d
from transitframe.plans import oracles as o
from transitframe.plans.catalog import query

CELL = 0.02

_ZONED = """z AS (SELECT p.event_id, min(zone_ord) AS zone_ord FROM raw_points p LEFT JOIN (
  SELECT event_id, zone_ord FROM raw_points, zone_edges WHERE lat > least(y1, y2) AND lat <= greatest(y1, y2) AND lon <= greatest(x1, x2) AND (x1 = x2 OR lon <= (lat - y1) * (x2 - x1) / (y2 - y1) + x1)
  GROUP BY event_id, zone_ord HAVING count(*) % 2 = 1) h USING (event_id) GROUP BY 1),
zoned AS (SELECT event_id, COALESCE(n_name, 'FORA DAS ZONAS') AS zone_name FROM z LEFT JOIN nation ON n_nationkey = zone_ord)"""


@query("GE1_haversine", o.sql(f"SELECT event_id, round({o.haversine('lat', 'lon', '-9.6e0', '-35.7e0')}, 6) AS km FROM raw_points", "raw_points"))
def ge1(spark, sf):
    return d.raw_points(spark, sf).select("event_id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(-9.6), F.lit(-35.7)), 6).alias("km"))


_SEGMENTS = f"""s AS (SELECT line_key, direction, seq, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM route_points WINDOW w AS (PARTITION BY line_key, direction ORDER BY seq)),
k AS (SELECT *, {o.haversine('lat', 'lon', 'lat2', 'lon2')} AS km FROM s)"""


@query("WN1_segment_lengths", o.sql(f"AND_WITH {_SEGMENTS} SELECT line_key, direction, seq, round(km, 6) AS km FROM k WHERE lat2 IS NOT NULL", "route_points"))
def wn1(spark, sf):
    return spatial.segments(d.route_points(spark, sf), ["line_key", "direction"]).select("line_key", "direction", "seq", F.round("km", 6).alias("km"))


_LENGTHS = f"""AND_WITH {_SEGMENTS}, t AS (SELECT line_key, direction, count(*) AS n_points, round(COALESCE(sum(km), 0), 2) AS km FROM k GROUP BY ALL)"""


@query("GE2_path_lengths", o.sql(f"{_LENGTHS} SELECT * FROM t", "route_points"))
def ge2(spark, sf):
    return spatial.path_lengths(d.route_points(spark, sf), ["line_key", "direction"])


@query("GE2_line_lengths", o.sql(f"""{_LENGTHS} SELECT line_key, COALESCE(max(km) FILTER (direction = 'ida'), 0) AS km_ida, COALESCE(max(km) FILTER (direction = 'volta'), 0) AS km_volta,
  round(COALESCE(max(km) FILTER (direction = 'ida'), 0) + COALESCE(max(km) FILTER (direction = 'volta'), 0), 2) AS km_total FROM t GROUP BY 1""", "route_points"))
def ge2_lines(spark, sf):
    return spatial.line_lengths(spatial.path_lengths(d.route_points(spark, sf), ["line_key", "direction"]), "line_key")


_X, _Y = "radians({0}) * 6378137.0e0", "ln(tan(radians({0}) / 2 + 0.7853981633974483e0)) * 6378137.0e0"


@query("GE3_resample", o.sql(f"""
AND_WITH m AS (SELECT *, {_X.format('lon')} AS x, {_Y.format('lat')} AS y FROM route_points), s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM m WINDOW w AS (PARTITION BY line_key, direction ORDER BY seq)),
t AS (SELECT line_key, direction, sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))) AS len, count(*) AS n FROM s GROUP BY ALL)
SELECT line_key, direction, CASE WHEN COALESCE(len, 0) > 0 THEN (ceil(len / 2000 - 1e-12) + 1)::BIGINT ELSE n END AS n_points FROM t""", "route_points"))
def ge3(spark, sf):
    sampled = spatial.resample(d.route_points(spark, sf), ["line_key", "direction"], 2000.0)
    return sampled.groupBy("line_key", "direction").agg(F.count(F.lit(1)).alias("n_points"))


_LAT, _LON = "degrees(atan(exp(({0}) / 6378137.0e0)) * 2 - 1.5707963267948966e0)", "degrees(({0}) / 6378137.0e0)"


@query("GE4_resample_collection", o.sql(f"""
AND_WITH m AS (SELECT *, {_X.format('lon')} AS x, {_Y.format('lat')} AS y FROM route_points),
s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM m WINDOW w AS (PARTITION BY line_key, direction ORDER BY seq)),
g AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS metres FROM s WHERE x2 IS NOT NULL),
a AS (SELECT *, sum(metres) OVER (PARTITION BY line_key, direction ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto FROM g),
t AS (SELECT line_key, direction, max(upto) AS len, arg_max(lat2, seq) AS end_lat, arg_max(lon2, seq) AS end_lon FROM a GROUP BY ALL HAVING max(upto) > 0),
p AS (SELECT a.*, len, unnest(generate_series(ceil((upto - metres) / 500 - 1e-12)::BIGINT, ceil(upto / 500 - 1e-12)::BIGINT - 1)) AS step FROM a JOIN t USING (line_key, direction) WHERE metres > 0),
f AS (SELECT *, (step * 500.0e0 - (upto - metres)) / metres AS share FROM p WHERE step * 500 < len)
SELECT line_key, direction, step AS seq, round({_LAT.format('y + (y2 - y) * share')}, 7) AS lat, round({_LON.format('x + (x2 - x) * share')}, 7) AS lon FROM f
UNION ALL SELECT line_key, direction, ceil(len / 500 - 1e-12)::BIGINT, round(end_lat, 7), round(end_lon, 7) FROM t
UNION ALL SELECT line_key, direction, seq, round(lat, 7), round(lon, 7) FROM route_points r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.line_key = r.line_key AND t.direction = r.direction)""", "route_points"))
def ge4(spark, sf):
    sampled = spatial.resample(d.route_points(spark, sf), ["line_key", "direction"], 500.0)
    return sampled.select("line_key", "direction", "seq", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("GE5_GE6_zone_of_points", o.sql(f"AND_WITH {_ZONED} SELECT event_id, zone_name FROM zoned", "raw_points", "zone_edges"))
def ge6(spark, sf):
    return spatial.zone_of_points(d.raw_points(spark, sf), d.zones(spark, sf), CELL).select("event_id", "zone_name")


@query("JN10_points_in_boxes", o.sql("""
AND_WITH b AS (SELECT zone_ord, min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM zone_edges GROUP BY 1) SELECT event_id, count(zone_ord) AS boxes FROM raw_points LEFT JOIN b ON lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY 1""",
       "raw_points", "zone_edges"))
def jn10(spark, sf):
    return spatial.boxes_of_points(d.raw_points(spark, sf), d.zones(spark, sf), CELL).select("event_id", "boxes")


@query("GE7_shapes_with_holes", o.sql("""
AND_WITH e AS (SELECT zone_ord, x1, y1, x2, y2, 0 AS ring FROM zone_edges UNION ALL SELECT zone_ord, cx + (x1 - cx) / 2, cy + (y1 - cy) / 2, cx + (x2 - cx) / 2, cy + (y2 - cy) / 2, 1
  FROM zone_edges JOIN (SELECT n_nationkey AS zone_ord, -35.7e0 - (1e-2 + 2e-2 * (n_nationkey // 5)) AS cx, -9.5e0 - (1e-2 + 2e-2 * (n_nationkey % 5)) AS cy FROM nation) USING (zone_ord)),
h AS (SELECT event_id, zone_ord, ring FROM raw_points, e WHERE (y2 > lat) <> (y1 > lat) AND lon < (x1 - x2) * (lat - y2) / (y1 - y2) + x2 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT event_id, zone_ord FROM h WHERE ring = 0 EXCEPT SELECT event_id, zone_ord FROM h WHERE ring = 1""", "raw_points", "zone_edges"))
def ge7(spark, sf):
    key = F.col("zone_ord")
    cy = F.lit(-9.5) - (F.lit(0.01) + F.lit(0.02) * (key % 5))
    cx = F.lit(-35.7) - (F.lit(0.01) + F.lit(0.02) * F.floor(key / 5))
    hole = F.transform("ring", lambda p: F.struct((cx + (p["lon"] - cx) / 2).alias("lon"), (cy + (p["lat"] - cy) / 2).alias("lat")))
    shapes = d.zones(spark, sf).select("zone_ord", "zone_name", F.array(F.array("ring", hole)).alias("parts"))
    return spatial.shapes_containing(d.raw_points(spark, sf), shapes, CELL).select("event_id", "zone_ord")


@query("GE8_zone_share", o.sql(f"""
AND_WITH {_ZONED}, c AS (SELECT line_key, zone_name, count(*) AS points FROM raw_points JOIN zoned USING (event_id) GROUP BY ALL)
SELECT *, sum(points) OVER (PARTITION BY line_key)::BIGINT AS total, round(points * 100.0e0 / sum(points) OVER (PARTITION BY line_key), 4) AS percent FROM c""", "raw_points", "zone_edges"))
def ge8(spark, sf):
    return spatial.zone_share(d.raw_points(spark, sf), d.zones(spark, sf), CELL, "line_key")


@query("AG6_points_per_zone", o.sql(f"AND_WITH {_ZONED} SELECT zone_name, count(*) AS points FROM zoned GROUP BY 1", "raw_points", "zone_edges"))
def ag6(spark, sf):
    return spatial.zone_of_points(d.raw_points(spark, sf), d.zones(spark, sf), CELL).groupBy("zone_name").agg(F.count(F.lit(1)).alias("points"))


@query("GE9_terminal_or_zone", o.sql(f"""
AND_WITH {_ZONED}, dist AS (SELECT event_id, name, {o.haversine('p.lat', 'p.lon', 't.lat', 't.lon')} * 1000 AS m FROM raw_points p, terminals t), n AS (SELECT event_id, arg_min(name, (m, name)) AS terminal FROM dist WHERE m < 300 GROUP BY 1)
SELECT event_id, CASE WHEN terminal IS NOT NULL THEN 'terminal' WHEN zone_name <> 'FORA DAS ZONAS' THEN 'zone' END AS kind, COALESCE(terminal, nullif(zone_name, 'FORA DAS ZONAS')) AS place FROM zoned LEFT JOIN n USING (event_id)""",
       "raw_points", "zone_edges", "terminals"))
def ge9(spark, sf):
    placed = spatial.terminal_or_zone(d.raw_points(spark, sf), d.terminals(spark, sf), d.zones(spark, sf), 300.0, CELL)
    return placed.select("event_id", "kind", "place")


def boundary_ways(spark, sf):
    """Boundary ways per supplier: a five-corner ring in three pieces, for some a square in two and an open chain; pieces shuffled and turned."""
    key = F.col("s_suppkey").cast("double")
    at = lambda x, y: F.struct((key + x).alias("lon"), F.lit(y).cast("double").alias("lat"))
    corner = [at(i % 5, float((i * i) % 7 if i < 5 else 0)) for i in range(6)]
    side = (F.col("s_suppkey") % 5 + 1).cast("double")
    square = [at(10.0, 0.0), at(F.lit(10.0) + side, 0.0), F.struct((key + 10.0 + side).alias("lon"), side.alias("lat")), F.struct((key + 10.0).alias("lon"), side.alias("lat"))]
    way = lambda place, *points: F.struct(F.lit(place).alias("way_ord"), F.array(*points).alias("path"))
    ring = F.array(way(2, *corner[0:3]), way(0, corner[3], corner[2]), way(1, *corner[3:6]))
    second = F.array(way(4, square[0], square[3], square[2]), way(3, *square[0:3]))
    chain = F.array(way(6, at(52.0, 0.0), at(51.0, 1.0)), way(5, at(50.0, 0.0), at(51.0, 1.0)))
    none = F.slice(ring, 1, 0)
    ways = F.concat(ring, F.when(F.col("s_suppkey") % 2 == 0, second).otherwise(none), F.when(F.col("s_suppkey") % 3 == 0, chain).otherwise(none))
    return d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("relation"), F.explode(ways).alias("w")).select("relation", "w.way_ord", "w.path")


@query("GE10_assemble_rings", """
SELECT s_suppkey AS relation, 0 AS ring_ord, TRUE AS closed, position, step, (s_suppkey + x)::DOUBLE AS lon, y::DOUBLE AS lat FROM supplier,
  (VALUES (0, 0, 3, 2), (0, 1, 2, 4), (1, 1, 1, 1), (1, 2, 0, 0), (2, 1, 4, 2), (2, 2, 3, 2)) v(position, step, x, y)
UNION ALL SELECT s_suppkey, 3, TRUE, position, step, (s_suppkey + 10 + dx * (s_suppkey % 5 + 1))::DOUBLE, (dy * (s_suppkey % 5 + 1))::DOUBLE FROM supplier,
  (VALUES (0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 1, 1), (1, 1, 0, 1), (1, 2, 0, 0)) v(position, step, dx, dy) WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 5, FALSE, position, step, (s_suppkey + x)::DOUBLE, y::DOUBLE FROM supplier,
  (VALUES (0, 0, 50, 0), (0, 1, 51, 1), (1, 1, 52, 0)) v(position, step, x, y) WHERE s_suppkey % 3 = 0""")
def ge10(spark, sf):
    return rings.ring_vertices(rings.assemble_rings(boundary_ways(spark, sf)))


_AREA = " + ".join(f"({i} * {((i + 1) % 5) ** 2 % 7} - {(i + 1) % 5} * {i * i % 7})" for i in range(5))


@query("GE11_largest_closed_ring", f"""
SELECT relation, arg_max(ring_ord, (area, -ring_ord)) AS ring_ord, max(area) AS area FROM (
  SELECT s_suppkey AS relation, 0 AS ring_ord, abs({_AREA}) / 2.0e0 AS area FROM supplier
  UNION ALL SELECT s_suppkey, 3, pow(s_suppkey % 5 + 1, 2)::DOUBLE FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1""")
def ge11(spark, sf):
    found = rings.largest_closed_ring(rings.assemble_rings(boundary_ways(spark, sf)))
    return found.select("relation", "ring_ord", F.round("area", 6).alias("area"))


@query("GE12_best_geocoder_feature", """
SELECT o_custkey AS query, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey)) AS feature_id FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1""")
def ge12(spark, sf):
    kinds = F.when(F.col("o_orderstatus") == "F", "suburb").when(F.col("o_orderstatus") == "O", "neighbourhood").otherwise("quarter")
    shape = F.when(F.col("o_orderkey") % 3 == 0, "Point").when(F.col("o_orderkey") % 3 == 1, "Polygon").otherwise("MultiPolygon")
    features = d.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("feature_id"), kinds.alias("address_type"), shape.alias("geometry_type")
    )
    return spatial.best_geocoder_feature(features).select("query", "feature_id")
