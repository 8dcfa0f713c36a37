"""Lookup layer (Q) and orderings (SO)."""

from pyspark.sql import functions as F

from transitframe.functions import codes
from transitframe.operators import lookup, numbering
from transitframe.plans import domain as d
from transitframe.plans import oracles as o
from transitframe.plans.catalog import query

_N = "named_itinerary"
_PREFIX4 = "regexp_extract(line_name, '^(\\d{4})', 1)"


@query("Q1_list_lines", o.sql("""
SELECT line_id, line_name, COALESCE(bool_or(p.direction = 'ida'), FALSE) AS has_ida, COALESCE(bool_or(p.direction = 'volta'), FALSE) AS has_volta,
  line_key IN (SELECT line_key FROM itinerary) AS has_itinerary FROM lines LEFT JOIN (SELECT DISTINCT line_key, direction FROM raw_points) p USING (line_key) GROUP BY ALL""",
       "lines", "raw_points", "itinerary"))
def q1(spark, sf):
    return lookup.list_lines(d.lines(spark, sf), d.with_line(d.raw_points(spark, sf), spark, sf), d.named_itinerary(spark, sf))


@query("Q2_line_detail", o.sql("SELECT line_id, direction, seq, street, street_code, match FROM named_itinerary WHERE line_id = 'ln-5b5341a911'", _N))
def q2(spark, sf):
    return lookup.line_streets(d.named_itinerary(spark, sf), "ln-5b5341a911")


@query("Q3_metadata", o.sql(f"""
SELECT (SELECT count(DISTINCT line_id) FROM lines) AS total_lines, (SELECT count(DISTINCT {o.n1('street')}) FROM itinerary) AS total_streets""", "lines", "itinerary"))
def q3(spark, sf):
    return lookup.metadata(d.lines(spark, sf), d.itinerary(spark, sf))


@query("Q4_suggest", o.sql(f"""
SELECT DISTINCT {o.n1('street')} AS street_key FROM itinerary WHERE {o.n1('street')} LIKE '%OLD PLATE%' ORDER BY 1 LIMIT 10""", "itinerary"))
def q4(spark, sf):
    return lookup.suggest(d.itinerary(spark, sf), "óld plate")


_HITS = "SELECT * FROM street_index WHERE contains(norm_street, 'LARGE RING') ORDER BY key_ord, occ_ord LIMIT 100"


@query("Q5_street_search", o.sql(f"SELECT line_id, line_name, direction, norm_street, street_code FROM ({_HITS})", "street_index"))
def q5(spark, sf):
    return lookup.search_streets(lookup.street_index(d.named_itinerary(spark, sf)), "large ring")


@query("Q5_street_search_all", o.sql("SELECT line_id, line_name, direction, norm_street, street_code FROM street_index WHERE contains(norm_street, 'RING')", "street_index"))
def q5_all(spark, sf):
    return lookup.search_streets(lookup.street_index(d.named_itinerary(spark, sf)), "ring", limit=None)


def _at(hits: str, code: str) -> str:
    return o.sql(f"""
AND_WITH h AS ({hits}), t AS (SELECT line_code, direction, array_to_string(list_sort(list(hhmm)), ',') AS near_times FROM timetable
  WHERE day_type = 'dia_util' AND abs(minute_of_day - 600) <= 240 GROUP BY ALL)
SELECT line_id, line_name, h.direction, norm_street, street_code, near_times FROM h JOIN t ON t.line_code = {code} AND t.direction = h.direction""", "street_index", "timetable")


@query("Q6_street_search_at", _at(_HITS, _PREFIX4))
def q6(spark, sf):
    index = lookup.street_index(d.named_itinerary(spark, sf))
    return lookup.search_streets_at(index, d.timetable(spark, sf), "large ring", "10:00", window=240)


@query("Q6_street_search_at_all", _at("SELECT * FROM street_index WHERE contains(norm_street, 'RING')", o.line_code("line_name")))
def q6_all(spark, sf):
    index = lookup.street_index(d.named_itinerary(spark, sf))
    return lookup.search_streets_at(index, d.timetable(spark, sf), "ring", "10:00", window=240, limit=None, key="full")


@query("Q7_search_by_code", o.sql("SELECT line_id, line_name, direction, street FROM named_itinerary WHERE street_code = '00100'", _N))
def q7(spark, sf):
    return lookup.search_by_code(d.named_itinerary(spark, sf), "00100")


@query("Q8_line_timetable", o.sql(f"""
AND_WITH c AS (SELECT line_id, {_PREFIX4} AS line_code FROM lines WHERE {_PREFIX4} IN (SELECT line_code FROM timetable)),
s AS (SELECT * FROM c, (VALUES ('dia_util'), ('sabado'), ('domingo')) a(day_type), (VALUES ('ida'), ('volta')) b(direction))
SELECT line_id, s.day_type, s.direction, COALESCE(array_to_string(list_sort(list(hhmm) FILTER (hhmm IS NOT NULL)), ','), '') AS times
FROM s LEFT JOIN timetable t ON t.line_code = s.line_code AND t.day_type = s.day_type AND t.direction = s.direction GROUP BY line_id, s.day_type, s.direction""",
       "lines", "timetable"))
def q8(spark, sf):
    rows = lookup.line_timetable(d.lines(spark, sf), d.timetable(spark, sf))
    return rows.withColumn("times", F.array_join("times", ","))


_FEATURES = """
SELECT line_id, line_name, direction, 1 AS place, seq, round(lon, 6) AS lon, round(lat, 6) AS lat FROM named_points WHERE {0}
UNION ALL SELECT DISTINCT line_id, line_name, direction, place, 0, NULL, NULL FROM named_points, (VALUES (0), (2)) v(place) WHERE {0}"""


def _feature_vertices(features):
    """The fragments with their vertices read back from the text."""
    xy = F.from_json(F.ltrim("fragment", F.lit(",")), "array<double>")
    vertex = F.when(F.col("place") == 1, xy)
    return features.withColumn("xy", vertex).select(
        "line_id", "line_name", "direction", "place", "seq", F.round(F.get("xy", 0), 6).alias("lon"), F.round(F.get("xy", 1), 6).alias("lat"))


@query("Q9_geojson_all", o.sql(_FEATURES.format("direction = 'ida'"), "named_points"))
def q9(spark, sf):
    return _feature_vertices(lookup.geojson_features(d.named_points(spark, sf), "ida"))


@query("Q10_geojson_line", o.sql(_FEATURES.format("line_id = 'ln-5b5341a911'"), "named_points"))
def q10(spark, sf):
    return _feature_vertices(lookup.geojson_features(d.named_points(spark, sf), "ambos", ["ln-5b5341a911"]))


@query("Q11_geojson_lines", o.sql(_FEATURES.format("line_id IN ('ln-5b5341a911', 'ln-7a6052dc01')"), "named_points"))
def q11(spark, sf):
    return _feature_vertices(lookup.geojson_features(d.named_points(spark, sf), None, ["ln-5b5341a911", "ln-7a6052dc01"]))


@query("Q12_terminals", o.sql("SELECT name, lat, lon FROM terminals", "terminals"))
def q12(spark, sf):
    return d.terminals(spark, sf).orderBy("name")


@query("Q13_lines_named", o.sql("SELECT line_id, line_name FROM lines WHERE contains(lower(line_name), 'nation 1')", "lines"))
def q13(spark, sf):
    return lookup.lines_named(d.lines(spark, sf), "Nation 1")


@query("Q14_hits_by_line", o.sql("""
SELECT line_id, line_name, count(*) OVER (PARTITION BY line_id) AS n_hits, direction, street_code, norm_street
FROM street_index WHERE contains(norm_street, 'LARGE RING')""", "street_index"))
def q14(spark, sf):
    return lookup.group_hits(lookup.search_streets(lookup.street_index(d.named_itinerary(spark, sf)), "large ring", limit=None))


_CODED = f"""
SELECT neighbourhood, street, CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS code FROM (
  SELECT *, row_number() OVER (ORDER BY {o.n4('neighbourhood')}, neighbourhood, {o.n4('street')}, street) AS n
  FROM (SELECT DISTINCT neighbourhood, trim(street) AS street FROM neighbourhood_streets WHERE trim(street) <> ''))"""


@query("Q15_browse_neighbourhoods", o.sql(f"""
AND_WITH coded AS ({_CODED}) SELECT neighbourhood, code, street FROM coded
WHERE contains(upper({o.fold('neighbourhood')}), 'NATION_1') OR contains(upper({o.fold('street')}), 'NATION_1') OR contains(code, 'NATION_1')""", "neighbourhood_streets"))
def q15(spark, sf):
    coded = numbering.neighbourhood_codes(d.neighbourhood_streets(spark, sf))
    return lookup.browse_neighbourhoods(coded, "nátion_1")


@query("Q16_browse_registry", o.sql(f"""
SELECT street_code, street, street_original, ord FROM registry WHERE contains(upper({o.fold('street')}), 'PRACA') OR contains(upper({o.fold('street_original')}), 'PRACA')
ORDER BY ord LIMIT 300""", "registry"))
def q16(spark, sf):
    return lookup.browse_registry(d.registry(spark, sf), "praça")


@query("Q17_active_without_turnstile", o.sql("SELECT code, name, service, company FROM active_lines WHERE service <> 'CATRACA DE SOLO'", "active_lines"))
def q17(spark, sf):
    return lookup.active_without_turnstile(d.active_lines(spark, sf)).select("code", "name", "service", "company")


@query("Q18_pending_names", o.sql("SELECT id AS line_id, name AS line_name FROM dictionary WHERE regexp_matches(upper(name), 'FALTA|PRECISA|REVISAR|TODO|FIXME')", "dictionary"))
def q18(spark, sf):
    return lookup.pending_names(d.dictionary(spark, sf).select(F.col("id").alias("line_id"), F.col("name").alias("line_name")))


@query("Q19_stop_sequence", o.sql("""
SELECT line_key, direction, stop_name, CASE WHEN direction = 'ida' THEN position ELSE -position END AS sort_position, round(lat, 6) AS lat FROM stops, (VALUES ('ida'), ('volta')) b(direction)
WHERE COALESCE(lat, 0) <> 0 AND COALESCE(lon, 0) <> 0""", "stops"))
def q19(spark, sf):
    return lookup.stop_sequence(d.stops(spark, sf)).select("line_key", "direction", "stop_name", "sort_position", F.round("lat", 6).alias("lat"))


@query("Q20_timetable_tab", o.sql("SELECT line_code, direction, hhmm FROM timetable WHERE day_type = 'sabado'", "timetable"))
def q20(spark, sf):
    return lookup.timetable_tab(d.timetable(spark, sf), "sabado").select("line_code", "direction", "hhmm")


@query("SO1_line_number_order", o.sql("SELECT line_name, COALESCE(TRY_CAST(regexp_extract(line_name, '^(\\d+)', 1) AS BIGINT), 999999) AS sort_number FROM lines", "lines"))
def so1(spark, sf):
    return numbering.by_line_number(d.lines(spark, sf)).select("line_name", codes.sort_number("line_name").alias("sort_number"))


@query("SO2_night_lines_last", o.sql("""
SELECT line_name, CAST(regexp_extract(upper(line_name), '^(M)?0*(\\d+)\\s*-?\\s*([A-Z])?\\b', 2) AS BIGINT) + CASE WHEN line_name LIKE 'M%' THEN 1000000 ELSE 0 END AS sort_number,
  CASE regexp_extract(upper(line_name), '^(M)?0*(\\d+)\\s*-?\\s*([A-Z])?\\b', 3) WHEN '' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS suffix_rank FROM lines""", "lines"))
def so2(spark, sf):
    key = codes.night_aware_sort("line_name")
    return numbering.by_line_number_night_last(d.lines(spark, sf)).select("line_name", key["number"].alias("sort_number"), key["suffix_rank"].alias("suffix_rank"))


@query("SO3_service_order", o.sql("""
SELECT code, service, CASE service WHEN 'CONVENCIONAL' THEN 0 WHEN 'CATRACA DE SOLO' THEN 1 WHEN 'MADRUGADAO' THEN 2 WHEN 'INTEGRACAO' THEN 3 WHEN 'LINHA CIDADA' THEN 4 ELSE 99 END AS rank FROM active_lines""", "active_lines"))
def so3(spark, sf):
    return numbering.by_service(d.active_lines(spark, sf)).select("code", "service", codes.service_rank("service").cast("int").alias("rank"))


@query("SO5_accent_free_order", o.sql(f"SELECT part_key, street, {o.n4('street')} AS sort_text FROM streets", "streets"))
def so5(spark, sf):
    from transitframe.functions import text as tx

    return numbering.ignoring_accents(d.streets(spark, sf), "street").select("part_key", "street", tx.norm_ascii("street").alias("sort_text"))


@query("SO6_top_with_rest", o.sql("""
AND_WITH c AS (SELECT street, count(*) AS uses FROM itinerary GROUP BY 1), t AS (SELECT street, uses, NULL::BIGINT AS more FROM c ORDER BY uses DESC, street LIMIT 30)
SELECT * FROM t UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM c) - 30 WHERE (SELECT count(*) FROM c) > 30""", "itinerary"))
def so6(spark, sf):
    counts = d.itinerary(spark, sf).groupBy("street").agg(F.count(F.lit(1)).alias("uses"))
    return numbering.top_with_rest(counts, [F.desc("uses"), "street"], 30)


@query("SO7_limited_registry", o.sql("SELECT street_code, street FROM registry ORDER BY ord LIMIT 300", "registry"))
def so7(spark, sf):
    return lookup.browse_registry(d.registry(spark, sf), "").select("street_code", "street")
