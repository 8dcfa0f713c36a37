"""Joins (JN), aggregations (AG), windows (WN) and reconciliation (RC)."""

from pyspark.sql import functions as F

from transitframe.functions import codes
from transitframe.functions import text as tx
from transitframe.functions import values
from transitframe.operators import aggregates, joins, numbering, ordered, reconcile, spatial
from transitframe.plans import domain as d
from transitframe.plans import oracles as o
from transitframe.plans.catalog import query
from transitframe.plans.catalog.lookups import _CODED

_N = "named_itinerary"


def geometry(spark, sf):
    """Path entries per line name and direction, with repeated and differently written names."""
    pts = d.raw_points(spark, sf).groupBy("line_key", "direction").agg(F.count(F.lit(1)).alias("n_points"))
    named = pts.join(d.lines(spark, sf).select("line_key", "line_name"), "line_key")
    again = named.filter("line_key % 3 = 0").withColumns({"line_name": F.lower("line_name"), "n_points": F.col("n_points") + 1, "copy": F.lit(1)})
    return named.withColumn("copy", F.lit(0)).unionByName(again).select(
        "line_name", "direction", F.concat_ws("-", "line_key", "direction").alias("path_id"), "n_points", F.struct("copy", "line_key").alias("ord")
    )


@query("JN1_geometry_with_itinerary", o.sql(f"""
AND_WITH p AS (SELECT line_key, direction, count(*) AS n FROM raw_points GROUP BY ALL),
k AS (SELECT {o.n2('line_name')} AS key, direction, arg_max(n + CASE WHEN line_key % 3 = 0 THEN 1 ELSE 0 END, (CASE WHEN line_key % 3 = 0 THEN 1 ELSE 0 END, line_key)) AS n FROM p JOIN lines USING (line_key) GROUP BY ALL)
SELECT line_name, COALESCE(a.n, 0) AS ida_points, COALESCE(b.n, 0) AS volta_points, COALESCE(a.n, 0) = 0 AS missing_ida, COALESCE(b.n, 0) = 0 AS missing_volta
FROM lines LEFT JOIN k a ON a.key = {o.n2('line_name')} AND a.direction = 'ida' LEFT JOIN k b ON b.key = {o.n2('line_name')} AND b.direction = 'volta'""", "lines", "raw_points"))
def jn1(spark, sf):
    return joins.geometry_with_itinerary(d.lines(spark, sf).select("line_name"), geometry(spark, sf))


@query("JN2_lines_with_timetable", o.sql(f"""
SELECT line_id, day_type, direction, hhmm FROM lines l JOIN timetable t ON t.line_code = {o.line_code('line_name')}""", "lines", "timetable"))
def jn2(spark, sf):
    return joins.lines_with_timetable(d.lines(spark, sf), d.timetable(spark, sf), "full").select("line_id", "day_type", "direction", "hhmm")


@query("JN3_zip_by_position", o.sql("""
AND_WITH p AS (SELECT event_id, row_number() OVER (ORDER BY line_key, direction, event_id) AS n FROM raw_points),
a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS n FROM orders) SELECT event_id, o_orderkey FROM p JOIN a USING (n)""", "raw_points"))
def jn3(spark, sf):
    points = d.raw_points(spark, sf).select("line_key", "direction", "event_id")
    rows = d.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return joins.zip_by_position(points, rows, ["line_key", "direction", "event_id"], ["o_custkey", "o_orderkey"]).select("event_id", "o_orderkey")


@query("JN5_reuse_codes", o.sql(f"""
AND_WITH k AS (SELECT line_code, direction, {o.n2('street')} AS key, arg_min({{'c': street_code, 'm': match}}, (line_id, seq)) AS v FROM named_itinerary WHERE line_code IS NOT NULL GROUP BY ALL)
SELECT m.line_code, m.line_key, m.direction, m.seq, m.street, v.c AS street_code, CASE WHEN v IS NULL THEN 'manual' ELSE v.m END AS match, v IS NOT NULL AS reused
FROM manual_itinerary m LEFT JOIN k ON k.line_code = m.line_code AND k.direction = m.direction AND k.key = {o.n2('m.street')}""", "manual_itinerary"))
def jn5(spark, sf):
    manual = d.manual_itinerary(spark, sf).select("line_code", "line_key", "direction", "seq", "street")
    system = d.named_itinerary(spark, sf).select("line_code", "line_id", "direction", "seq", "street", "street_code", "match")
    return joins.reuse_codes(manual, system)


@query("JN6_registry_codes", o.sql(f"""
AND_WITH r AS (SELECT {o.n2('street')} AS key, street_code AS registry_code, ord, street FROM registry),
n AS (SELECT key, count(*) AS n_codes, arg_min(street, ord) AS registry_street FROM r GROUP BY 1),
c AS (SELECT DISTINCT neighbourhood, street FROM neighbourhood_streets)
SELECT neighbourhood, c.street, registry_code, n_codes, registry_street FROM c LEFT JOIN r ON r.key = {o.n2('c.street')} LEFT JOIN n ON n.key = r.key""", "neighbourhood_streets", "registry"))
def jn6(spark, sf):
    return joins.registry_codes(d.neighbourhood_streets(spark, sf).distinct(), d.registry(spark, sf))


@query("JN6_unused_registry", o.sql(f"""
SELECT street_code, street FROM registry WHERE {o.n2('street')} NOT IN (SELECT {o.n2('street')} FROM neighbourhood_streets WHERE neighbourhood < 'NATION_2')""", "registry", "neighbourhood_streets"))
def jn6_unused(spark, sf):
    return joins.unused_registry(d.registry(spark, sf), d.neighbourhood_streets(spark, sf).filter("neighbourhood < 'NATION_2'")).select("street_code", "street")


_CODE_NEIGHBOURHOOD = """SELECT CASE WHEN length(part_key::VARCHAR) < 5 THEN lpad(part_key::VARCHAR, 5, '0') ELSE part_key::VARCHAR END AS street_code,
  arg_max(n_name, (l_orderkey, l_linenumber, l_suppkey)) AS neighbourhood FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN streets ON l_partkey = part_key GROUP BY 1"""


def code_neighbourhood(spark, sf):
    places = d.table(spark, sf, "supplier").join(d.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = d.table(spark, sf, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(codes.zero_padded(F.col("l_partkey"), 5).alias("street_code"), F.col("n_name").alias("neighbourhood"), "l_orderkey", "l_linenumber", "l_suppkey")
    return ordered.last_wins(rows, ["street_code"], ["l_orderkey", "l_linenumber", "l_suppkey"], ["neighbourhood"])


def listed_streets(spark, sf):
    """Distinct coded streets with their neighbourhood, as the published list has them."""
    return joins.neighbourhood_of_code(aggregates.street_codes(d.named_itinerary(spark, sf)), code_neighbourhood(spark, sf))


_LISTED = f"""cn AS ({_CODE_NEIGHBOURHOOD}), sc AS (SELECT street, arg_min(street_code, (ord, d, seq)) FILTER (street_code IS NOT NULL) AS street_code FROM named_itinerary GROUP BY 1),
listed AS (SELECT sc.street, sc.street_code, COALESCE(neighbourhood, 'SEM CODIGO') AS neighbourhood FROM sc LEFT JOIN cn USING (street_code))"""


@query("JN7_neighbourhood_of_code", o.sql(f"AND_WITH {_LISTED} SELECT * FROM listed", _N))
def jn7(spark, sf):
    return listed_streets(spark, sf)


@query("JN8_names_from_two_sources", o.sql("""
SELECT line_code, COALESCE(CASE WHEN line_key % 2 = 0 THEN nullif(name, '') END, CASE WHEN line_key % 3 = 0 THEN nullif(name, '') END, '') AS line_name
FROM (SELECT line_key::VARCHAR AS line_code, line_key, CASE WHEN line_key % 4 = 0 THEN '' ELSE line_name END AS name FROM lines)""", "lines"))
def jn8(spark, sf):
    named = d.lines(spark, sf).select(
        F.col("line_key").cast("string").alias("line_code"), F.when(F.col("line_key") % 4 == 0, "").otherwise(F.col("line_name")).alias("line_name"), "line_key"
    )
    return joins.names_from_two_sources(named.select("line_code"), named.filter("line_key % 2 = 0"), named.filter("line_key % 3 = 0"))


@query("JN9_locate_pairs", o.sql("""
AND_WITH s AS (SELECT part_key AS pair_id, 'a' AS side, street FROM streets UNION ALL SELECT part_key, 'b', manual_street FROM streets)
SELECT pair_id, side, s.street, line_name, direction FROM s JOIN manual_copy m ON upper(m.street) = upper(s.street)""", "streets", "manual_copy"))
def jn9(spark, sf):
    pairs = d.streets(spark, sf).select(F.col("part_key").alias("pair_id"), F.col("street").alias("street_a"), F.col("manual_street").alias("street_b"))
    return joins.locate_pairs(pairs, d.manual_copy(spark, sf))


def geocode_cache(spark, sf):
    key = values.cache_key(F.col("lat"), F.col("lon"))
    points = d.raw_points(spark, sf).filter("event_id % 4 <> 1").select(key.alias("key"), "event_id")
    return points.groupBy("key").agg(F.concat(F.lit("Rua "), F.min("event_id").cast("string")).alias("address"))


_CACHE = "cache AS (SELECT round(lat, 6)::VARCHAR || ',' || round(lon, 6)::VARCHAR AS key, 'Rua ' || min(event_id) AS address FROM raw_points WHERE event_id % 4 <> 1 GROUP BY 1)"


@query("JN11_resolve_cache", o.sql(f"AND_WITH {_CACHE} SELECT event_id, address FROM raw_points LEFT JOIN cache ON key = round(lat, 6)::VARCHAR || ',' || round(lon, 6)::VARCHAR", "raw_points"))
def jn11(spark, sf):
    return joins.resolve_cache(d.raw_points(spark, sf), geocode_cache(spark, sf)).select("event_id", "address")


@query("GE13_geocode_stage", o.sql(f"AND_WITH {_CACHE} SELECT DISTINCT round(lat, 6)::VARCHAR || ',' || round(lon, 6)::VARCHAR AS key FROM raw_points WHERE key NOT IN (SELECT key FROM cache)", "raw_points"))
def ge13(spark, sf):
    return joins.cache_misses(d.raw_points(spark, sf), geocode_cache(spark, sf))


@query("JN13_alias_join", o.sql(f"""
SELECT line_key, CASE code WHEN '0003A' THEN '0003' WHEN '0013A' THEN '0013' WHEN '0023A' THEN '0023' ELSE code END AS code FROM (SELECT line_key, line_code AS code FROM lines)""", "lines"))
def jn13(spark, sf):
    aliases = {"0003A": "0003", "0013A": "0013", "0023A": "0023"}
    return d.lines(spark, sf).select("line_key", codes.with_alias(codes.line_code("line_name"), aliases).alias("code"))


@query("AG1_points_by_line", o.sql("SELECT line_id, direction, count(*) AS n_points, round(sum(lat * seq), 6) AS ordered_sum FROM named_points GROUP BY ALL", "named_points"))
def ag1(spark, sf):
    from transitframe.plans.publish import line_documents

    docs = line_documents(d.lines(spark, sf), d.named_points(spark, sf), d.named_itinerary(spark, sf)).filter("place in (1, 5)")
    lat = F.get(F.from_json(F.ltrim("fragment", F.lit(",")), "array<double>"), 0)
    direction = F.when(F.col("place") == 1, "ida").otherwise("volta")
    return docs.groupBy("line_id", direction.alias("direction")).agg(F.count(F.lit(1)).alias("n_points"), F.round(F.sum(lat * F.col("seq")), 6).alias("ordered_sum"))


@query("AG2_distinct_streets", o.sql("SELECT key, street, street_code, match, occurrences FROM distinct_streets", "distinct_streets"))
def ag2(spark, sf):
    return aggregates.distinct_streets(d.named_itinerary(spark, sf)).drop("first_seen")


@query("AG2_street_usages", o.sql(f"SELECT {o.n2('street')} AS key, line_name, direction, count(*) AS times FROM named_itinerary GROUP BY ALL", _N))
def ag2_usages(spark, sf):
    return aggregates.street_usages(d.named_itinerary(spark, sf))


@query("AG3_street_codes", o.sql("SELECT street, arg_min(street_code, (ord, d, seq)) FILTER (street_code IS NOT NULL) AS street_code FROM named_itinerary GROUP BY 1", _N))
def ag3(spark, sf):
    return aggregates.street_codes(d.named_itinerary(spark, sf))


@query("AG4_match_mix", o.sql("SELECT match, count(*) AS occurrences, round(count(*) * 100.0e0 / sum(count(*)) OVER (), 4) AS percent FROM itinerary GROUP BY 1", "itinerary"))
def ag4(spark, sf):
    return aggregates.match_mix(d.itinerary(spark, sf))


@query("AG5_match_statistics", o.sql("""
SELECT count(*) AS total, count(*) FILTER (match <> 'nao_encontrado') AS matched, count(*) FILTER (match = 'nao_encontrado') AS unmatched,
  round(count(*) FILTER (match <> 'nao_encontrado') * 100.0e0 / count(*), 4) AS matched_percent FROM itinerary""", "itinerary"))
def ag5(spark, sf):
    return aggregates.match_statistics(d.itinerary(spark, sf))


@query("AG7_spellings_per_code", o.sql("""
AND_WITH x AS (SELECT DISTINCT street_code, street FROM (SELECT part_key // 3 AS street_code, street FROM itinerary)) SELECT x.street_code::VARCHAR AS street_code, street, n AS n_spellings FROM x
JOIN (SELECT street_code, count(*) AS n FROM x GROUP BY 1 HAVING count(*) > 1) USING (street_code)""", "itinerary"))
def ag7(spark, sf):
    shared = d.itinerary(spark, sf).withColumn("street_code", F.floor(F.col("part_key") / 3).cast("string"))
    return aggregates.spellings_per_code(shared)


@query("AG8_lines_per_street", o.sql("SELECT DISTINCT street, split_part(line_name, ' - ', 1) AS line FROM named_itinerary", _N))
def ag8(spark, sf):
    return aggregates.lines_per_street(d.named_itinerary(spark, sf))


@query("AG9_review_totals", o.sql(f"""
AND_WITH {_LISTED}, dup AS (SELECT street_code FROM listed WHERE street_code IS NOT NULL GROUP BY 1 HAVING count(DISTINCT street) > 1)
SELECT neighbourhood, grouping(neighbourhood) AS is_total, count(*) AS streets, count(*) FILTER (street_code IN (SELECT street_code FROM dup)) AS duplicates,
  count(*) FILTER (street_code IS NULL) AS without_code FROM listed GROUP BY ROLLUP (neighbourhood)""", _N))
def ag9(spark, sf):
    return aggregates.review_totals(listed_streets(spark, sf)).withColumn("is_total", F.col("is_total").cast("long"))


@query("AG10_neighbourhood_counts", o.sql(f"AND_WITH {_LISTED} SELECT neighbourhood, count(*) AS streets FROM listed GROUP BY 1 ORDER BY streets DESC, neighbourhood LIMIT 10", _N))
def ag10(spark, sf):
    return aggregates.neighbourhood_counts(listed_streets(spark, sf))


@query("AG11_service_cube", o.sql("SELECT company, service, count(*) AS lines, grouping_id(company, service) AS level FROM active_lines GROUP BY CUBE (company, service)", "active_lines"))
def ag11(spark, sf):
    return aggregates.service_cube(d.active_lines(spark, sf))


@query("AG12_occurrences", o.sql(f"SELECT street, {o.n2('street')} AS key, count(*) AS occurrences FROM itinerary GROUP BY ALL", "itinerary"))
def ag12(spark, sf):
    return aggregates.occurrences(d.itinerary(spark, sf))


@query("AG14_stop_counts", o.sql("SELECT line_key, count(*) AS stops FROM stops GROUP BY 1", "stops"))
def ag14(spark, sf):
    return aggregates.stop_counts(d.stops(spark, sf), ["line_key"])


def company_figures(spark, sf):
    o_ = d.table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("company"), F.lit("trips").alias("metric"), F.lit(1).cast("long").alias("base"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(1)).cast("long").alias("extra"),
    )
    return o_.groupBy("year", "company", "metric").agg(
        F.sum("base").alias("base"), F.when(F.col("company") == "1-URGENT", F.sum("extra")).alias("company_extra")
    )


@query("AG15_company_year", """
WITH f AS (SELECT year(o_orderdate) AS year, o_orderpriority AS company, count(*) AS base, CASE WHEN o_orderpriority = '1-URGENT' THEN count(*) FILTER (o_orderkey % 5 = 0) END AS ce FROM orders GROUP BY 1, 2),
y AS (SELECT year, sum(base) AS base, max(base + COALESCE(ce, 0)) AS big FROM f GROUP BY 1), e AS (SELECT year(o_orderdate) AS year, count(*) AS extra FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) % 2 = 0 GROUP BY 1)
SELECT y.year::INTEGER AS year, 'trips' AS metric, base::BIGINT AS base, COALESCE(extra, 0) AS extra, (base + COALESCE(extra, 0))::BIGINT AS total, (SELECT max(big) FROM y) AS scale_max FROM y LEFT JOIN e USING (year)""")
def ag15(spark, sf):
    extras = d.table(spark, sf, "orders").filter("o_orderstatus = 'P' and year(o_orderdate) % 2 = 0").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("extra")
    ).withColumn("metric", F.lit("trips"))
    return aggregates.company_year(company_figures(spark, sf), extras)


@query("AG15_metrics_by_company", """
SELECT o_orderpriority AS company, year(o_orderdate)::INTEGER AS year, sum(o_custkey)::BIGINT AS passengers, count(*) AS trips, count(DISTINCT o_custkey) AS fleet FROM orders GROUP BY 1, 2""")
def ag15_metrics(spark, sf):
    by = d.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("company"), F.year("o_orderdate").alias("year"))
    wide = by.agg(F.sum("o_custkey").alias("passengers"), F.count(F.lit(1)).alias("trips"), F.count_distinct("o_custkey").alias("fleet"))
    figures = wide.unpivot(["company", "year"], ["passengers", "trips", "fleet"], "metric", "base").withColumn("company_extra", F.lit(None).cast("long"))
    return aggregates.metrics_by_company(figures)


@query("AG16_departures_per_day", o.sql("""
SELECT line_code, count(*) FILTER (day_type = 'dia_util') AS dia_util, count(*) FILTER (day_type = 'sabado') AS sabado, count(*) FILTER (day_type = 'domingo') AS domingo FROM timetable GROUP BY 1""", "timetable"))
def ag16(spark, sf):
    return aggregates.departures_per_day(d.timetable(spark, sf))


@query("AG17_code_totals", o.sql("SELECT count(*) AS extracted, count(DISTINCT street_code) AS unique_codes, (SELECT count(*) FROM part) AS declared, count(*) = (SELECT count(*) FROM part) AS complete FROM registry", "registry"))
def ag17(spark, sf):
    declared = d.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("declared"))
    return aggregates.code_totals(d.registry(spark, sf), declared)


@query("AG18_bounding_box", o.sql("SELECT line_key, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon FROM raw_points GROUP BY 1", "raw_points"))
def ag18(spark, sf):
    box = aggregates.bounding_box(d.raw_points(spark, sf), ["line_key"])
    return box.select("line_key", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query("AG19_duplicate_codes", o.sql("""
AND_WITH c AS (SELECT substr(line_code, 1, 3) AS line_code, line_name FROM lines WHERE line_code IS NOT NULL) SELECT line_code, line_name, n AS entries FROM c
JOIN (SELECT line_code, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1) USING (line_code)""", "lines"))
def ag19(spark, sf):
    # codes cut to three digits so that entries share them
    return aggregates.duplicate_line_codes(d.lines(spark, sf).withColumn("line_code", F.substring("line_code", 1, 3)))


@query("AG20_line_numbers", o.sql("""
SELECT number, arg_min(line_name, ord) AS full_name, trim(replace(arg_min(line_name, ord), number, '')) AS name FROM (SELECT *, nullif(regexp_extract(line_name, '^(\\d+)', 1), '') AS number FROM lines) WHERE number IS NOT NULL GROUP BY number""", "lines"))
def ag20(spark, sf):
    return aggregates.line_numbers(d.lines(spark, sf))


@query("WN2_carry_forward", """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations""")
def wn2(spark, sf):
    talk = d.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return ordered.carry_forward(talk, ["conv_id"], ["turn"], {"last_user_turn": F.when(F.col("role") == "user", F.col("turn"))})


@query("WN3_repeated_streets", o.sql(f"""
AND_WITH k AS (SELECT line_name, direction, {o.n2('street')} AS key, street, seq, seq - lag(seq) OVER (PARTITION BY line_name, direction, {o.n2('street')} ORDER BY seq) = 1 AS adj FROM named_itinerary)
SELECT line_name, direction, key, count(*) AS times, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(street, seq) AS street, COALESCE(bool_or(adj), FALSE) AS adjacent FROM k GROUP BY ALL HAVING count(*) > 1""", _N))
def wn3(spark, sf):
    return aggregates.repeated_streets(d.named_itinerary(spark, sf))


@query("WN4_neighbourhood_codes", o.sql(_CODED, "neighbourhood_streets"))
def wn4(spark, sf):
    return numbering.neighbourhood_codes(d.neighbourhood_streets(spark, sf))


@query("WN5_proposed_codes", o.sql("""
SELECT neighbourhood, street, CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS code FROM (
  SELECT *, row_number() OVER (ORDER BY neighbourhood, street) AS n FROM (SELECT DISTINCT neighbourhood, street FROM neighbourhood_streets))""", "neighbourhood_streets"))
def wn5(spark, sf):
    return numbering.proposed_codes(d.neighbourhood_streets(spark, sf).distinct())


@query("WN6_street_ids", o.sql("SELECT row_number() OVER (ORDER BY street) AS id, street FROM (SELECT DISTINCT street FROM itinerary)", "itinerary"))
def wn6(spark, sf):
    return numbering.street_ids(d.itinerary(spark, sf).select("street"))


@query("WN7_best_candidate", """
SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""")
def wn7(spark, sf):
    orders = d.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordered.best_per_key(orders, ["o_custkey"], "o_totalprice", ["o_orderkey"], ["o_orderkey"])


@query("WN8_first_and_last_wins", o.sql(f"""
SELECT {o.n2('street')} AS key, arg_min(street, (ord, d, seq)) AS first_street, arg_max(street, (ord, d, seq)) AS last_street FROM named_itinerary GROUP BY 1""", _N))
def wn8(spark, sf):
    keyed = d.named_itinerary(spark, sf).select(tx.norm_key("street").alias("key"), "street", "ord", F.when(F.col("direction") == "ida", 0).otherwise(1).alias("d"), "seq")
    first = ordered.first_wins(keyed, ["key"], ["ord", "d", "seq"], ["street"]).withColumnRenamed("street", "first_street")
    last = ordered.last_wins(keyed, ["key"], ["ord", "d", "seq"], ["street"]).withColumnRenamed("street", "last_street")
    return first.join(last, "key")


@query("WN10_percent_of_group", """
SELECT o_custkey, o_orderkey, round(o_totalprice * 100.0e0 / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS percent FROM orders""")
def wn10(spark, sf):
    orders = d.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    totals = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return orders.join(totals, "o_custkey").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100.0 / F.col("total"), 6).alias("percent"))


@query("WN11_unique_sheet_names", o.sql("""
SELECT region, line_key, CASE WHEN n = 1 THEN base ELSE substr(base, 1, 31 - length(' (' || n || ')')) || ' (' || n || ')' END AS sheet
FROM (SELECT region, line_key, substr(replace(substr(line_name, strpos(line_name, ' - ') + 3), '/', '-'), 1, 31) AS base, row_number() OVER (PARTITION BY region, substr(replace(substr(line_name, strpos(line_name, ' - ') + 3), '/', '-'), 1, 31) ORDER BY line_key) AS n FROM lines)""", "lines"))
def wn11(spark, sf):
    title = F.expr("substring(line_name, locate(' - ', line_name) + 3)")
    entries = d.lines(spark, sf).select("region", "line_key", F.col("line_key").alias("ord"), title.alias("title"))
    return numbering.unique_sheet_names(entries, ["region"]).select("region", "line_key", "sheet")


def official_codes(spark, sf):
    return d.active_lines(spark, sf).select("code")


def system_codes(spark, sf):
    return d.lines(spark, sf).select(codes.code_dialect("line_name", "hyphen_suffix").alias("code"))


@query("RC1_two_way", o.sql("""
AND_WITH a AS (SELECT DISTINCT line_code AS k FROM lines WHERE line_code IS NOT NULL), t AS (SELECT DISTINCT line_code AS k FROM timetable)
SELECT COALESCE(a.k, t.k) AS line_code, CASE WHEN a.k IS NOT NULL AND t.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'only_system' ELSE 'only_timetable' END AS status FROM a FULL JOIN t ON a.k = t.k""", "lines", "timetable"))
def rc1(spark, sf):
    return reconcile.two_way(d.lines(spark, sf), d.timetable(spark, sf), "line_code", "system", "timetable")


@query("RC2_version_diff", """
WITH x AS (SELECT o_custkey AS k, bool_or(o_orderkey % 2 = 0) AS old, bool_or(o_orderkey % 3 = 0) AS new, FALSE AS cat FROM orders GROUP BY 1
  UNION ALL SELECT c_custkey, FALSE, FALSE, TRUE FROM customer WHERE c_custkey % 4 <> 0),
f AS (SELECT k, bool_or(old) AS old, bool_or(new) AS new, bool_or(cat) AS cat FROM x GROUP BY 1)
SELECT k, CASE WHEN new AND NOT old THEN 'added' WHEN old AND NOT new THEN 'removed' WHEN old AND new THEN 'kept' ELSE 'missing' END AS change,
  CASE WHEN new AND cat THEN 'both' WHEN new THEN 'only_map' WHEN cat THEN 'only_catalogue' ELSE 'neither' END AS catalogue_status FROM f WHERE old OR new OR cat""")
def rc2(spark, sf):
    orders = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    catalogue = d.table(spark, sf, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"))
    return reconcile.version_diff(orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 3 = 0"), catalogue, "k")


@query("RC3_active_against_system", o.sql("""
AND_WITH a AS (SELECT code, arg_max({'n': name, 's': service, 'c': company}, ord) AS v FROM active_lines WHERE service <> 'CATRACA DE SOLO' GROUP BY 1),
s AS (SELECT upper(regexp_extract(line_name, '^(\\S+)', 1)) AS code, arg_max(line_name, ord) AS line_name FROM lines WHERE line_key % 5 <> 2 GROUP BY 1)
SELECT COALESCE(a.code, s.code) AS code, CASE WHEN v IS NOT NULL AND line_name IS NOT NULL THEN 'both' WHEN line_name IS NOT NULL THEN 'only_system'
  WHEN a.code LIKE '00%' THEN 'excluded' ELSE 'missing' END AS status, v.n AS name, v.s AS service, v.c AS company, line_name FROM a FULL JOIN s ON a.code = s.code""", "active_lines", "lines"))
def rc3(spark, sf):
    exclusions = official_codes(spark, sf).filter("code like '00%'").distinct().withColumn("reason", F.lit("fora do projeto"))
    return reconcile.active_against_system(d.active_lines(spark, sf), d.lines(spark, sf).filter("line_key % 5 <> 2"), exclusions)


@query("RC4_active_against_system_aliased", o.sql("""
AND_WITH a AS (SELECT regexp_replace(code, '-', '') AS code, arg_max(name, ord) AS active_name FROM active_lines GROUP BY 1),
s AS (SELECT line_code AS code, line_name FROM lines WHERE line_code IS NOT NULL AND line_key % 5 <> 2)
SELECT COALESCE(a.code, s.code) AS code, CASE WHEN line_name IS NULL THEN 'new' WHEN active_name IS NULL THEN 'gone' ELSE 'both' END AS status, active_name, line_name FROM a FULL JOIN s ON a.code = s.code""", "active_lines", "lines"))
def rc4(spark, sf):
    return reconcile.active_against_system_aliased(d.active_lines(spark, sf), d.lines(spark, sf).filter("line_key % 5 <> 2"))


@query("RC5_base_tolerant_diff", o.sql("""
AND_WITH a AS (SELECT DISTINCT code FROM active_lines), m AS (SELECT DISTINCT substr(code, 1, 4) AS code FROM active_lines WHERE line_key % 3 <> 0 UNION SELECT '9' || substr(code, 2, 3) || '-B' FROM active_lines WHERE line_key % 50 = 0),
s AS (SELECT DISTINCT code FROM active_lines WHERE line_key % 4 <> 0 UNION SELECT substr(code, 1, 4) || '-Z' FROM active_lines WHERE line_key % 40 = 0),
fm AS (SELECT code FROM a WHERE code NOT IN (SELECT code FROM m) AND (substr(code, 1, 4) NOT IN (SELECT substr(code, 1, 4) FROM m) OR contains(code, '-'))),
fs AS (SELECT code FROM a WHERE code NOT IN (SELECT code FROM s) AND (substr(code, 1, 4) NOT IN (SELECT substr(code, 1, 4) FROM s) OR contains(code, '-')))
SELECT COALESCE(fm.code, fs.code) AS code, CASE WHEN fm.code IS NOT NULL AND fs.code IS NOT NULL THEN 'missing_both' WHEN fm.code IS NOT NULL THEN 'missing_manual' ELSE 'missing_system' END AS status FROM fm FULL JOIN fs ON fm.code = fs.code
UNION ALL SELECT code, 'extra_manual' FROM m WHERE code NOT IN (SELECT code FROM a) AND NOT (substr(code, 1, 4) IN (SELECT substr(code, 1, 4) FROM a) AND NOT contains(code, '-'))
UNION ALL SELECT code, 'extra_system' FROM s WHERE code NOT IN (SELECT code FROM a) AND NOT (substr(code, 1, 4) IN (SELECT substr(code, 1, 4) FROM a) AND NOT contains(code, '-'))""", "active_lines"))
def rc5(spark, sf):
    active = d.active_lines(spark, sf).select("code", "line_key")
    manual = active.filter("line_key % 3 <> 0").select(F.substring("code", 1, 4).alias("code")).unionByName(
        active.filter("line_key % 50 = 0").select(F.concat(F.lit("9"), F.substring("code", 2, 3), F.lit("-B")).alias("code"))
    )
    system = active.filter("line_key % 4 <> 0").select("code").unionByName(
        active.filter("line_key % 40 = 0").select(F.concat(F.substring("code", 1, 4), F.lit("-Z")).alias("code"))
    )
    return reconcile.base_tolerant_diff(active, manual, system)


@query("RC6_inventory_coverage", o.sql("""
AND_WITH f AS (SELECT code, bool_or(a) AS a, bool_or(x) AS x, bool_or(y) AS y FROM (SELECT code, TRUE AS a, FALSE AS x, FALSE AS y FROM active_lines UNION ALL
  SELECT line_key::VARCHAR, FALSE, line_key % 2 = 0, line_key % 3 = 0 FROM lines WHERE line_key % 6 IN (0, 2, 3, 4) UNION ALL SELECT code, FALSE, line_key % 5 <> 0, line_key % 7 <> 0 FROM active_lines) GROUP BY 1)
SELECT code, CASE WHEN NOT a AND x AND y THEN 'extra_both' WHEN NOT a AND x THEN 'extra_first' WHEN NOT a THEN 'extra_second' WHEN NOT x AND NOT y THEN 'missing_both' WHEN NOT x THEN 'missing_first' WHEN NOT y THEN 'missing_second' ELSE 'covered' END AS status FROM f""", "active_lines", "lines"))
def rc6(spark, sf):
    active = d.active_lines(spark, sf)
    lines = d.lines(spark, sf).select(F.col("line_key").cast("string").alias("code"), "line_key")
    first = lines.filter("line_key % 2 = 0").select("code").unionByName(active.filter("line_key % 5 <> 0").select("code"))
    second = lines.filter("line_key % 3 = 0").select("code").unionByName(active.filter("line_key % 7 <> 0").select("code"))
    return reconcile.inventory_coverage(active, first, second)


@query("RC7_neighbourhood_issues", o.sql(f"""
AND_WITH r AS (SELECT neighbourhood, trim(street) AS street, {o.n2('street')} AS key FROM neighbourhood_streets), u AS (SELECT DISTINCT street, {o.n2('street')} AS key FROM manual_copy),
uk AS (SELECT key, min(street) AS other FROM u GROUP BY 1)
SELECT CASE WHEN other IS NOT NULL THEN 'accent_only' ELSE 'no_match' END AS issue, neighbourhood, street, other FROM (SELECT DISTINCT * FROM r WHERE street NOT IN (SELECT street FROM u)) LEFT JOIN uk USING (key)
UNION ALL SELECT 'not_listed', NULL, street, NULL FROM u WHERE key NOT IN (SELECT key FROM r)
UNION ALL SELECT 'several_neighbourhoods', NULL, key, count(DISTINCT neighbourhood)::VARCHAR FROM r GROUP BY key HAVING count(DISTINCT neighbourhood) > 1""", "neighbourhood_streets", "manual_copy"))
def rc7(spark, sf):
    return reconcile.neighbourhood_issues(d.neighbourhood_streets(spark, sf), d.manual_copy(spark, sf))


def _compare_sql(shape):
    return o.sql(f"""
AND_WITH j AS (SELECT COALESCE(m.line_name, s.line_name) AS line_name, COALESCE(m.direction, s.direction) AS direction, {shape('m.street')} AS a, {shape('s.street')} AS b FROM manual_itinerary m
  FULL JOIN named_itinerary s ON m.line_name = s.line_name AND m.direction = s.direction AND m.seq = s.seq)
SELECT line_name, direction, count(a) AS left_streets, count(b) AS right_streets, count(*) FILTER (a IS DISTINCT FROM b) AS differences,
  CASE WHEN count(a) = 0 THEN 'only_right' WHEN count(b) = 0 THEN 'only_left' WHEN count(*) FILTER (a IS DISTINCT FROM b) = 0 THEN 'equal' ELSE 'different' END AS status FROM j GROUP BY ALL""",
                 "manual_itinerary", _N)


@query("RC8_equal_itineraries", _compare_sql(lambda x: x))
def rc8(spark, sf):
    return reconcile.compare_itineraries(d.manual_itinerary(spark, sf), d.named_itinerary(spark, sf), ["line_name", "direction"])


@query("RC9_equal_ignoring_accents", _compare_sql(o.n2))
def rc9(spark, sf):
    return reconcile.compare_itineraries(d.manual_itinerary(spark, sf), d.named_itinerary(spark, sf), ["line_name", "direction"], normalised=True)


@query("RC9_spelling_variants", o.sql(f"""
AND_WITH c AS (SELECT street, {o.n2('street')} AS key, count(*) AS times FROM itinerary GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY key) AS spellings FROM c QUALIFY spellings > 1""", "itinerary"))
def rc9_variants(spark, sf):
    return reconcile.spelling_variants(d.itinerary(spark, sf))


_STATUS = f"""e AS (SELECT id, substr(name, 1, 5) AS code, {o.n2("regexp_replace(substr(name, 7), ' 0000$', '')")} AS key FROM dictionary WHERE name NOT LIKE 'REVISAR:%'),
st AS (SELECT *, CASE WHEN street_code IS NOT NULL AND street_code NOT IN (SELECT code FROM e) THEN 'code_not_in_dictionary' WHEN street_code IS NOT NULL THEN 'coded'
  WHEN key IN (SELECT key FROM e) THEN 'no_code_in_dictionary' ELSE 'no_code_not_in_dictionary' END AS status FROM distinct_streets)"""


@query("RC10_codes_outside_dictionary", o.sql(f"AND_WITH {_STATUS} SELECT key, street, street_code, occurrences, status FROM st", "distinct_streets", "dictionary"))
def rc10(spark, sf):
    return reconcile.codes_outside_dictionary(aggregates.distinct_streets(d.named_itinerary(spark, sf)), d.dictionary(spark, sf))


@query("RC11_union_first", o.sql("""
SELECT street, arg_min(origin, (src, part_key)) AS origin FROM (SELECT street, part_key, 'short' AS origin, 0 AS src FROM streets UNION ALL SELECT manual_street, part_key, 'full', 1 FROM streets) GROUP BY 1""", "streets"))
def rc11(spark, sf):
    s = d.streets(spark, sf)
    parts = [s.select("street", "part_key", F.lit("short").alias("origin")), s.select(F.col("manual_street").alias("street"), "part_key", F.lit("full").alias("origin"))]
    return reconcile.union_first(parts, "street", ["part_key"]).select("street", "origin")


@query("RC12_street_coverage", o.sql(f"""
AND_WITH r AS (SELECT {o.n2('street')} AS key, max(street_code) AS rc, min(street) AS rs FROM itinerary WHERE part_key % 3 <> 0 GROUP BY 1),
s AS (SELECT street, max(CASE WHEN part_key % 4 = 0 THEN street_code END) AS c, count(*) AS uses FROM itinerary GROUP BY 1)
SELECT street, CASE WHEN COALESCE(c, rc) IS NOT NULL THEN 'with_code' WHEN rs IS NOT NULL THEN 'reference_without_code' ELSE 'unmatched' END AS status, COALESCE(c, rc) AS street_code, uses FROM s LEFT JOIN r ON r.key = {o.n2('street')}""", "itinerary"))
def rc12(spark, sf):
    it = d.itinerary(spark, sf)
    new = it.withColumn("street_code", F.when(F.col("part_key") % 4 == 0, F.col("street_code")))
    return reconcile.street_coverage(new, it.filter("part_key % 3 <> 0"))


@query("RC12_line_contexts", o.sql(f"""
AND_WITH r AS (SELECT DISTINCT {o.n2('street')} AS key FROM named_itinerary WHERE part_key % 3 <> 0),
c AS (SELECT DISTINCT street FROM named_itinerary WHERE part_key % 4 = 0 AND street_code IS NOT NULL)
SELECT street, trim(split_part(line_name, ' - ', 1)) || '/' || upper(direction) AS context, count(*) AS uses FROM named_itinerary
WHERE street NOT IN (SELECT street FROM c) AND {o.n2('street')} NOT IN (SELECT key FROM r) GROUP BY ALL""", _N))
def rc12_contexts(spark, sf):
    it = d.named_itinerary(spark, sf)
    new = it.withColumn("street_code", F.when(F.col("part_key") % 4 == 0, F.col("street_code")))
    return reconcile.line_contexts(reconcile.street_coverage(new, it.filter("part_key % 3 <> 0")), it)
