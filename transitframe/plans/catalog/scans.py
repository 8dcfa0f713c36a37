"""Readers and report parsers (SC) over documents that Spark derives from the tables."""

from pyspark.sql import functions as F

from transitframe.functions import codes
from transitframe.plans import domain as d
from transitframe.plans import oracles as o
from transitframe.plans import publish
from transitframe.plans.catalog import query
from transitframe.plans.catalog.merging import scratch
from transitframe.plans.catalog.texts import _STREET_RULES, _replace_chain
from transitframe.operators.ordered import number_rows
from transitframe.sources import files, kml, reports, words, writers

_CODE = "CASE WHEN length(part_key::VARCHAR) < 5 THEN lpad(part_key::VARCHAR, 5, '0') ELSE part_key::VARCHAR END"


def _lines(df, doc, page, line_no, text):
    return df.select(doc.alias("doc"), page.cast("int").alias("page"), line_no.cast("long").alias("line_no"), text.alias("text"))


def noise(spark, sf):
    """Lines of the free-text documents, which no pattern accepts."""
    return _lines(d.document_lines(spark, sf), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit(0), F.col("line_no"), F.col("text"))


# --- line documents -----------------------------------------------------------------------------------


def _maps(spark, name, lines, lists, closing, first='{"ida":'):
    """One JSON text per line, ``{name: {"ida": …, "volta": …}}`` (or what ``first`` opens), written as fragments and read back as rows ``value``."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("line_name").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    opening = F.concat(F.lit("{"), quoted, F.lit(":" + first + lists[0][0]))
    skeleton = [opening, *[F.lit(before) for before, _ in lists[1:]], F.lit(closing + "\n")]
    path = scratch(spark, name)
    writers.write_line_documents(publish.fragments(lines, skeleton, [entries for _, entries in lists]), path)
    return spark.read.text(path).filter("trim(value) <> ''")


def line_maps(spark, sf):
    """One JSON map document per line with geometry and streets of both directions."""
    points, it = d.named_points(spark, sf), d.named_itinerary(spark, sf)
    return _maps(spark, "line-maps", d.lines(spark, sf).select("line_id", "line_name"), [
        ('{"coordenadas":[', publish.point_entries(points, "ida")), ('],"ruas":[', publish.street_entries(it, "ida")),
        (']},"volta":{"coordenadas":[', publish.point_entries(points, "volta")), ('],"ruas":[', publish.street_entries(it, "volta")),
    ], "]}}}")


@query("SC1_unified_map", o.sql("""
SELECT line_id, direction, (SELECT count(*) FROM named_points p WHERE p.line_id = i.line_id AND p.direction = i.direction) AS points, count(*) AS streets, count(street_code) AS coded FROM named_itinerary i GROUP BY ALL""", "named_itinerary", "named_points"))
def sc1(spark, sf):
    _, points, streets = files.read_unified(line_maps(spark, sf))
    p = points.groupBy("line_id", "direction").agg(F.count(F.lit(1)).alias("points"))
    s = streets.groupBy("line_id", "direction").agg(F.count(F.lit(1)).alias("streets"), F.count("street_code").alias("coded"))
    return s.join(p, ["line_id", "direction"], "left").na.fill(0, ["points"])


@query("SC3_manual_map", o.sql("SELECT line_name, direction, seq, street FROM manual_copy", "manual_copy"))
def sc3(spark, sf):
    manual = d.manual_copy(spark, sf)
    # positions are renumbered by the arrays, so keep the original ones in the text; lists start where their first entry is
    entry = F.regexp_extract(F.to_json(F.struct(F.concat_ws("|", "seq", "street").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    entries = manual.select(F.col("line_key").cast("string").alias("line_id"), "direction", F.col("seq").alias("place"), entry.alias("entry"))
    rows = number_rows(entries, ["line_id", "direction"], ["place"], F.floor(F.col("place") / 10_000), start=0)
    lines = manual.select(F.col("line_key").cast("string").alias("line_id"), "line_name").distinct()
    side = lambda x: rows.filter(F.col("direction") == x).select("line_id", "seq", "entry")
    documents = _maps(spark, "manual-maps", lines, [("[", side("ida")), ('],"volta":[', side("volta"))], "]}}")
    back = files.read_manual(documents)
    parts = F.split("street", r"\|", 2)
    return back.select("line_name", "direction", parts[0].cast("long").alias("seq"), parts[1].alias("street"))


@query("SC4_timetable_map", o.sql("SELECT line_code, day_type, direction, hhmm, minute_of_day, count(*) AS departures FROM timetable GROUP BY ALL", "timetable"))
def sc4(spark, sf):
    t = d.timetable(spark, sf).withColumnsRenamed({"line_code": "line_name"}).withColumn("line_id", F.col("line_name"))
    entries = number_rows(
        t.select("line_id", "line_name", "day_type", "direction", "event_id", F.to_json(F.array("hhmm")).alias("entry")),
        ["line_id", "day_type", "direction"], ["event_id"], F.floor(F.col("event_id") / 100_000), start=0,
    ).withColumn("entry", F.regexp_extract("entry", r"^\[(.*)\]$", 1))
    of = lambda day, x: entries.filter((F.col("day_type") == day) & (F.col("direction") == x)).select("line_id", "seq", "entry")
    texts = ['{"dia_util":{"ida":[', '],"volta":[', ']},"sabado":{"ida":[', '],"volta":[', ']},"domingo":{"ida":[', '],"volta":[']
    sides = [(day, x) for day in ("dia_util", "sabado", "domingo") for x in ("ida", "volta")]
    lists = [(text, of(*side)) for text, side in zip(texts, sides, strict=True)]
    documents = _maps(spark, "timetables", t.select("line_id", "line_name").distinct(), lists, "]}}}", "")
    return files.read_timetable(documents).groupBy("line_code", "day_type", "direction", "hhmm", "minute_of_day").agg(F.count(F.lit(1)).alias("departures"))


@query("SC5_catalogue_array", "SELECT CASE WHEN length(c_custkey::VARCHAR) < 4 THEN lpad(c_custkey::VARCHAR, 4, '0') ELSE c_custkey::VARCHAR END AS line_code, c_name AS line_name FROM customer")
def sc5(spark, sf):
    path = scratch(spark, "catalogue")
    rows = d.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("codigo"), F.concat(F.lit(" "), "c_name").alias("nome"))
    # arrays of at most a thousand records per document
    arrays = rows.groupBy(F.floor(F.col("codigo").cast("long") / 1000).alias("k")).agg(F.to_json(F.collect_list(F.struct("codigo", "nome"))).alias("value"))
    arrays.repartition("k").write.partitionBy("k").text(path)
    return files.read_catalogue(spark, f"{path}/*")


def _arrays(spark, name, rows, key):
    """JSON arrays of about a thousand records each, one per file."""
    path = scratch(spark, name)
    columns = [c for c in rows.columns if c != key]
    arrays = rows.groupBy(F.floor(F.col(key) / 1000).alias("k")).agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value"))
    arrays.repartition("k").write.partitionBy("k").text(path)
    return f"{path}/*"


@query("SC5_dictionary_array", o.sql("SELECT id, name FROM dictionary", "dictionary"))
def sc5_dictionary(spark, sf):
    rows = d.dictionary(spark, sf).withColumn("key", F.col("id"))
    return files.read_dictionary(spark, _arrays(spark, "dictionary", rows, "key"))


@query("SC5_terminals_array", o.sql("SELECT name, lat, lon FROM terminals", "terminals"))
def sc5_terminals(spark, sf):
    rows = d.terminals(spark, sf).select(F.col("name").alias("nome"), "lat", "lon", F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("key"))
    return files.read_terminals(spark, _arrays(spark, "terminals", rows, "key"))


def _zone_features(spark, sf):
    ring = F.array(F.transform("ring", lambda p: F.array(p["lon"], p["lat"])))
    return d.zones(spark, sf).select("zone_ord", F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("zone_name").alias("name"), F.col("zone_name").alias("nome")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"),
    ).alias("feature"))


_ZONES = "SELECT zone_name, 7 AS n_points, round(max(x1), 6) AS east FROM zone_edges GROUP BY 1"


def _ring_summary(df):
    return df.select("zone_name", F.size("ring").alias("n_points"), F.round(F.array_max(F.transform("ring", lambda p: p["lon"])), 6).alias("east"))


def _zone_files(spark, sf):
    path = scratch(spark, "zones")
    docs = _zone_features(spark, sf).select("zone_ord", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array("feature").alias("features"))).alias("value"))
    docs.repartition("zone_ord").write.partitionBy("zone_ord").text(path)
    return f"{path}/*"


@query("SC6_zone_files", o.sql(_ZONES, "zone_edges"))
def sc6(spark, sf):
    return _ring_summary(files.read_zone_dir(spark, _zone_files(spark, sf)))


@query("SC6_shapes", o.sql("SELECT zone_name, 1 AS parts FROM zone_edges GROUP BY 1", "zone_edges"))
def sc6_shapes(spark, sf):
    return files.read_shapes(spark, _zone_files(spark, sf)).select("zone_name", F.size("parts").alias("parts"))


@query("SC7_zone_collection", o.sql(_ZONES, "zone_edges"))
def sc7(spark, sf):
    path = scratch(spark, "zone-collection")
    features = _zone_features(spark, sf).groupBy(F.floor(F.col("zone_ord") / 100).alias("k")).agg(F.collect_list("feature").alias("features"))
    features.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(path)
    return _ring_summary(files.read_zone_collection(spark, path))


# --- KML ------------------------------------------------------------------------------------------------


def _write_xml(spark, name, rows):
    """Well-formed documents, one per value of ``k`` (a bounded chunk of rows): ``rows(k, text)``."""
    path = scratch(spark, name)
    frame = rows.select("k").distinct().select(
        "k", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("<kml><Document>").alias("t")), F.struct(F.lit(2).alias("o"), F.lit("</Document></kml>").alias("t")))).alias("e")
    ).select("k", "e.o", F.col("e.t").alias("text"))
    whole = rows.select("k", F.lit(1).alias("o"), "text").unionByName(frame)
    whole.repartition("k").sortWithinPartitions("k", "o").select("k", "text").write.partitionBy("k").text(path)
    return f"{path}/*"


def _path_texts(spark, sf):
    """Coordinate text per line and direction: a placemark holds its whole path."""
    vertex = F.struct("seq", F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.lit("0")).alias("t"))
    paths = d.route_points(spark, sf).groupBy("line_key", "direction").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(vertex)), lambda v: v["t"]), " ").alias("coords")
    )
    return paths.join(d.lines(spark, sf).select("line_key", "line_name", "line_code"), "line_key")


def _placemark(name):
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><LineString><coordinates>"), F.col("coords"), F.lit("</coordinates></LineString></Placemark>"))


def _path_summary(paths):
    return paths.select("line_name", "direction", F.size("points").alias("n_points"), F.round(F.get("points", 0)["lat"], 6).alias("first_lat"))


_PATH_SQL = "SELECT line_name, direction, count(*)::INTEGER AS n_points, round(arg_min(lat, seq), 6) AS first_lat FROM named_points {} GROUP BY ALL"


@query("SC8_line_folders", o.sql(_PATH_SQL.format(""), "named_points"))
def sc8(spark, sf):
    side = F.concat(F.lit("<Folder><name>"), F.upper("direction"), F.lit("</name>"), _placemark(F.lit("x")), F.lit("</Folder>"))
    folders = _path_texts(spark, sf).groupBy("line_key", "line_name").agg(F.array_join(F.sort_array(F.collect_list(side)), "").alias("sides"))
    text = F.concat(F.lit("<Folder><name> "), "line_name", F.lit("</name>"), "sides", F.lit("</Folder>"))
    path = _write_xml(spark, "kml-a", folders.select(F.floor(F.col("line_key") / 100).alias("k"), text.alias("text")))
    return _path_summary(kml.read_line_folders(spark, path))


def _direction_folders(spark, sf):
    # folders of at most 200 lines
    marks = _path_texts(spark, sf).groupBy("direction", F.floor(F.col("line_key") / 100).alias("k")).agg(
        F.array_join(F.collect_list(_placemark(F.col("line_name"))), "").alias("marks")
    )
    return _write_xml(spark, "kml-b", marks.select("k", F.concat(F.lit("<Folder><name>"), F.upper("direction"), F.lit("</name>"), "marks", F.lit("</Folder>")).alias("text")))


@query("SC9_direction_folders", o.sql("SELECT line_code, line_name, direction, count(*)::INTEGER AS n_points FROM named_points WHERE line_code IS NOT NULL GROUP BY ALL", "named_points"))
def sc9(spark, sf):
    paths = kml.read_direction_folders(spark, _direction_folders(spark, sf))
    return paths.select("line_code", "line_name", "direction", F.size("points").alias("n_points"))


@query("SC9_allowed_codes", o.sql("SELECT line_name, direction, count(*)::INTEGER AS n_points FROM named_points WHERE substr(line_name, 1, 4) IN ('0001', '0002', 'M005') GROUP BY ALL", "named_points"))
def sc9_allowed(spark, sf):
    paths = kml.read_direction_folders(spark, _direction_folders(spark, sf), "map_suffix", ["0001", "0002", "M005"])
    return paths.select("line_name", "direction", F.size("points").alias("n_points"))


@query("SC13_all_lines", o.sql(_PATH_SQL.replace("direction, ", "").format("") .replace("GROUP BY ALL", "GROUP BY line_name, direction"), "named_points"))
def sc13(spark, sf):
    rows = kml.read_all_lines(spark, _direction_folders(spark, sf))
    return rows.select(F.col("name").alias("line_name"), F.size("points").alias("n_points"), F.round(F.get("points", 0)["lat"], 6).alias("first_lat"))


def _point_mark(name):
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><Point><coordinates>"), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",0</coordinates></Point></Placemark>"))


@query("SC10_points", o.sql("SELECT stop_name AS name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM stops WHERE lat IS NOT NULL", "stops"))
def sc10(spark, sf):
    marks = d.stops(spark, sf).filter("lat is not null").select(F.floor(F.col("position") / 10_000).alias("k"), _point_mark(F.col("stop_name")).alias("text"))
    path = _write_xml(spark, "kml-points", marks)
    return kml.read_points(spark, path).select("name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SC11_terminal_folder", o.sql("SELECT name, lat, lon FROM terminals", "terminals"))
def sc11(spark, sf):
    marks = d.terminals(spark, sf).groupBy(F.floor(F.regexp_extract("name", r"(\d+)", 1).cast("long") / 1000).alias("k")).agg(F.array_join(F.collect_list(_point_mark(F.col("name"))), "").alias("m"))
    path = _write_xml(spark, "kml-terminals", marks.select("k", F.concat(F.lit("<Folder><name>Terminal</name>"), "m", F.lit("</Folder>")).alias("text")))
    return kml.read_terminal_folder(spark, path)


@query("SC12_zone_folder", o.sql(_ZONES, "zone_edges"))
def sc12(spark, sf):
    ring = F.array_join(F.transform(F.slice("ring", 1, 6), lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string"), F.lit("0"))), " ")
    mark = F.concat(F.lit("<Placemark><name>"), "zone_name", F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    rows = d.zones(spark, sf).select(F.floor(F.col("zone_ord") / 100).alias("k"), F.concat(F.lit("<Folder><name>ZONAS</name>"), mark, F.lit("</Folder>")).alias("text"))
    path = _write_xml(spark, "kml-zones", rows)
    return _ring_summary(kml.read_zone_folder(spark, path))


@query("SC13_geometry_census", o.sql("""
SELECT 'LineString' AS geometry, count(*) AS placemarks FROM (SELECT DISTINCT line_key, direction FROM raw_points) UNION ALL SELECT 'Point', count(*) FROM stops WHERE lat IS NOT NULL UNION ALL SELECT 'Outro', count(*) FROM nation""", "raw_points", "stops"))
def sc13_census(spark, sf):
    lines = _path_texts(spark, sf).select(F.floor(F.col("line_key") / 100).alias("k"), _placemark(F.col("line_name")).alias("text"))
    stops = d.stops(spark, sf).filter("lat is not null").select(F.floor(F.col("position") / 10_000).alias("k"), _point_mark(F.col("stop_name")).alias("text"))
    others = d.table(spark, sf, "nation").select(F.lit(0).cast("long").alias("k"), F.concat(F.lit("<Placemark><name>"), "n_name", F.lit("</name></Placemark>")).alias("text"))
    return kml.geometry_census(spark, _write_xml(spark, "kml-census", lines.unionByName(stops).unionByName(others)))


# --- reports ----------------------------------------------------------------------------------------------


def registry_report(spark, sf):
    p = F.col("part_key")
    text = F.concat_ws(" ", codes.zero_padded(p, 5), "street", F.lpad((p % 900).cast("string"), 4, "0"), F.lit("0001"))
    rows = _lines(d.streets(spark, sf), F.lit("registry"), F.floor(p / 50), p % 50, text)
    return rows.unionByName(noise(spark, sf))


@query("SC14_registry_lines", o.sql(f"SELECT {_CODE} AS street_code, street AS street_original, {_replace_chain('street', _STREET_RULES)} AS street FROM streets", "streets"))
def sc14(spark, sf):
    return reports.registry_lines(registry_report(spark, sf)).select("street_code", "street_original", "street")


@query("SC14_official_streets", o.sql(f"""
SELECT DISTINCT {_CODE} AS street_code, {_replace_chain('upper(street)', _STREET_RULES)} AS street FROM streets UNION
SELECT {_CODE}, {_replace_chain('upper(street)', _STREET_RULES)} || ' ' || lpad((part_key % 900)::VARCHAR, 4, '0') FROM streets""", "streets"))
def sc14_official(spark, sf):
    return reports.official_streets(registry_report(spark, sf))


@query("SC14_master_codes", o.sql(f"SELECT {_CODE} AS street_code, manual_street AS street FROM streets", "streets"))
def sc14_master(spark, sf):
    # two entries per text line, as running text
    p = F.col("part_key")
    entry = F.concat_ws(" ", codes.zero_padded(p, 5), "manual_street", F.lit("0000 0001"))
    pairs = d.streets(spark, sf).groupBy(F.floor(p / 2).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_key", entry.alias("t")))), lambda s: s["t"]), " ").alias("text"))
    return reports.master_codes(_lines(pairs, F.lit("master"), F.floor(F.col("k") / 50), F.col("k") % 50, F.col("text")))


@query("SC14_declared_total", "SELECT 'registry' AS doc, count(*) AS declared FROM part")
def sc14_total(spark, sf):
    total = d.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n")).select(F.format_number("n", 0).alias("t"))
    row = total.select(F.lit("registry").alias("doc"), F.lit(9999).alias("page"), F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("TOTAL: "), F.replace("t", F.lit(","), F.lit("."))).alias("text"))
    return reports.declared_total(registry_report(spark, sf).unionByName(row))


def itinerary_report(spark, sf):
    it = d.named_itinerary(spark, sf)
    mark = F.when(F.col("seq") == 0, F.concat(F.upper("direction"), F.lit(" "))).otherwise("")
    text = F.concat(mark, F.lpad((F.col("seq") % 1000).cast("string"), 3, "0"), F.lit(" "), F.coalesce("street_code", F.lit("00000")), F.lit(" "), "street")
    page = F.when(F.col("direction") == "ida", 1).otherwise(2)
    rows = _lines(it, F.col("line_id"), page, F.col("seq"), text)
    titles = _lines(d.lines(spark, sf), F.col("line_id"), F.lit(0), F.lit(0), F.concat(F.lit("Linha: "), "line_name"))
    totals = _lines(d.lines(spark, sf), F.col("line_id"), F.lit(3), F.lit(0), F.lit("Sub-Total 010 00000 X"))
    early = _lines(d.lines(spark, sf), F.col("line_id"), F.lit(0), F.lit(1), F.lit("001 00001 RUA ANTES DO SENTIDO"))
    return rows.unionByName(titles).unionByName(totals).unionByName(early)


@query("SC15_itinerary_lines", o.sql("SELECT line_id AS doc, line_name, direction, (seq % 1000)::INTEGER AS seq, COALESCE(street_code, '00000') AS street_code, street FROM named_itinerary", "named_itinerary"))
def sc15(spark, sf):
    return reports.itinerary_lines(itinerary_report(spark, sf)).select("doc", "line_name", "direction", "seq", "street_code", "street")


@query("SC15_running_itinerary", o.sql("SELECT line_id AS doc, direction, lpad((seq % 1000)::VARCHAR, 3, '0') AS seq, COALESCE(street_code, '00000') AS street_code, manual_street AS street FROM named_itinerary", "named_itinerary"))
def sc15_running(spark, sf):
    it = d.named_itinerary(spark, sf)
    mark = F.when(F.col("seq") == 0, F.upper("direction")).otherwise("")
    entry = F.concat(F.lpad((F.col("seq") % 1000).cast("string"), 3, "0"), F.lit(" "), F.coalesce("street_code", F.lit("00000")), mark, F.lit(" "), "manual_street")
    page = F.when(F.col("direction") == "ida", 1).otherwise(2)
    # three entries per text
    texts = it.groupBy("line_id", page.alias("page"), F.floor(F.col("seq") / 3).alias("k")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("t")))), lambda s: s["t"]), " ").alias("text")
    )
    rows = reports.running_itinerary(_lines(texts, F.col("line_id"), F.col("page"), F.col("k"), F.col("text")))
    return rows.select("doc", "direction", "seq", "street_code", "street")


def timetable_report(spark, sf):
    """Per line code a report: a stray time, two sections, three day blocks each, one departure per row."""
    t = d.timetable(spark, sf)
    day_rank = F.when(F.col("day_type") == "dia_util", 1).when(F.col("day_type") == "sabado", 2).otherwise(3)
    page = F.when(F.col("direction") == "ida", 1).otherwise(2)
    block = F.lit(1_000_000_000_000)
    times = _lines(t, F.col("line_code"), page, day_rank * block + F.col("event_id") + 1, F.col("hhmm"))
    codes_ = t.select("line_code").distinct()
    heads = [(0, -1, "hdr 05:00")]
    for p, text in ((1, "TERMINAL INICIAL - IDA"), (2, "PONTO FINAL - VOLTA")):
        heads.append((p, 0, text))
        heads += [(p, i * 1_000_000_000_000, label) for i, label in ((1, "Dia Útil"), (2, "Sábado"), (3, "Domingo"))]
    head = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).cast("long").alias("n"), F.lit(x).alias("x")) for p, n, x in heads]))
    rows = codes_.select("line_code", head.alias("h"))
    return times.unionByName(_lines(rows, F.col("line_code"), F.col("h.p"), F.col("h.n"), F.col("h.x")))


@query("SC16_timetable_lines", o.sql("SELECT line_code AS doc, day_type, direction, hhmm, count(*) AS departures FROM timetable GROUP BY ALL", "timetable"))
def sc16(spark, sf):
    rows = reports.timetable_lines(timetable_report(spark, sf))
    return rows.groupBy("doc", "day_type", "direction", "hhmm").agg(F.count(F.lit(1)).alias("departures"))


@query("SC17_timetable_lenient", o.sql("SELECT DISTINCT line_code AS doc, day_type, direction, hhmm FROM timetable UNION SELECT DISTINCT line_code, 'dia_util', 'ida', '05:00' FROM timetable", "timetable"))
def sc17(spark, sf):
    return reports.timetable_lines_lenient(timetable_report(spark, sf))


@query("SC18_timetable_cells", o.sql("SELECT DISTINCT line_code AS doc, day_type, direction, hhmm FROM timetable", "timetable"))
def sc18(spark, sf):
    t = d.timetable(spark, sf)
    days, sides = ("dia_util", "sabado", "domingo"), ("ida", "volta")
    col = F.when(F.col("day_type") == "dia_util", 0).when(F.col("day_type") == "sabado", 2).otherwise(4) + F.when(F.col("direction") == "ida", 0).otherwise(1)
    body = t.select(F.col("line_code").alias("doc"), F.lit(0).alias("table"), (F.col("event_id") + 1).alias("row"), col.alias("col"), F.col("hhmm").alias("text"))
    labels = {"dia_util": "DIA ÚTIL", "sabado": "SÁBADO", "domingo": "DOMINGO"}
    head = F.explode(F.array(*[F.struct(F.lit(i * 2 + j).alias("col"), F.lit(f"{labels[day]} {side.upper()}").alias("text")) for i, day in enumerate(days) for j, side in enumerate(sides)]))
    header = t.select("line_code").distinct().select(F.col("line_code").alias("doc"), F.lit(0).alias("table"), F.lit(0).cast("long").alias("row"), head.alias("h")).select("doc", "table", "row", "h.col", "h.text")
    return reports.timetable_cells(body.unionByName(header))


def active_report(spark, sf):
    """The official list as report text: company pages, service blocks, one line per row."""
    a = d.active_lines(spark, sf).join(d.lines(spark, sf).select("line_key", "segment", "region"), "line_key")
    page = F.pmod(F.xxhash64("region"), F.lit(1_000_000))
    rank = F.pmod(F.xxhash64("segment"), F.lit(1000))
    block = F.lit(1_000_000_000_000)
    raw = F.element_at(F.create_map(*[F.lit(x) for kv in d.SEGMENT_SERVICE.items() for x in kv]), F.col("segment"))
    rows = _lines(a, F.lit("oso"), page, (rank + 1) * block + F.col("line_key") + 1, F.concat("code", F.lit("- - "), "name", F.lit(" 6825- RADIAL 01/01/2026 X")))
    companies = _lines(a.select("region", "company").distinct(), F.lit("oso"), page, F.lit(0), F.concat(F.lit("Empresa: "), "company", F.lit("    pagina 1")))
    services = _lines(a.select("region", "segment").distinct(), F.lit("oso"), page, (rank + 1) * block, F.concat(F.lit("Tipo Serviço: "), raw))
    return rows.unionByName(companies).unionByName(services).unionByName(noise(spark, sf))


@query("SC19_active_lines", o.sql("SELECT code, name, '6825' AS order_no, service, company FROM active_lines", "active_lines"))
def sc19(spark, sf):
    return reports.active_lines(active_report(spark, sf)).select("code", "name", "order_no", "service", "company")


@query("SC19_active_lines_short", o.sql("SELECT code, count(DISTINCT name) >= 1 AS named FROM active_lines GROUP BY 1", "active_lines"))
def sc19_short(spark, sf):
    return reports.active_lines_short(active_report(spark, sf)).select("code", (F.length("name") > 0).alias("named"))


@query("SC20_neighbourhood_lines", o.sql(f"SELECT {_CODE} AS street_code, 'BAIRRO ' || translate((part_key % 25)::VARCHAR, '0123456789', 'ABCDEFGHIJ') AS neighbourhood FROM streets", "streets"))
def sc20(spark, sf):
    p = F.col("part_key")
    name = F.when(p < 25, F.concat(F.lit("BAIRRO "), F.translate((p % 25).cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(" "))).otherwise("")
    rows = _lines(d.streets(spark, sf), F.lit("bairros"), p % 25, F.floor(p / 25), F.concat(name, codes.zero_padded(p, 5), F.lit(" "), "street", F.lit(" 0000 0001")))
    totals = _lines(d.streets(spark, sf).filter(p < 25), F.lit("bairros"), p, F.lit(1_000_000_000), F.lit("Sub-Total: 10"))
    return reports.neighbourhood_lines(rows.unionByName(totals))


def listing_words(spark, sf):
    """Stop listings as positioned words: one document per line, forty stops per page, header on the first page."""
    s = d.stops(spark, sf).filter("lat is not null and lat <> 0").join(d.lines(spark, sf).select("line_key", "line_name"), "line_key")
    page = (F.floor(F.col("position") / 400) + 1).cast("int")
    top = F.lit(100.0) + (F.col("position") % 400) * 10
    coordinate = lambda c: F.replace(F.format_string("%.6f", F.col(c)), F.lit("."), F.lit(","))
    cells = [(10.0, F.lit("PONTO")), (40.0, F.col("position").cast("string")), (110.0, F.lit("ABR")), (230.0, F.lit("RUA")), (260.0, F.col("position").cast("string")),
             (605.0, F.col("position").cast("string")), (655.0, F.lit("40")), (715.0, coordinate("lat")), (775.0, coordinate("lon"))]
    # the coordinates stand two points lower, still in the row; every fifth address goes on in a row of its own
    word = lambda x, down, t: F.struct(F.lit(x).alias("x0"), F.lit(down).alias("down"), t.alias("text"))
    row = F.array(*[word(x, 2.0 if x > 700 else 0.0, t) for x, t in cells])
    more = F.when(F.col("position") % 5 == 1, F.array(word(240.0, 5.0, F.lit("FUNDOS")))).otherwise(F.slice(row, 1, 0))
    placed = s.select(F.col("line_key").cast("string").alias("doc"), page.alias("page"), top.alias("top"), F.explode(F.concat(row, more)).alias("w"))
    stop_words = placed.withColumn("top", F.col("top") + F.col("w.down"))
    active = F.when(F.col("line_key") % 3 == 0, "Não").otherwise("Sim")
    head = [(10.0, F.lit("Atendimento Principal: Sim Linha:")), (10.5, F.col("line_name"))], [(10.0, F.concat(F.lit("Nome Ida: IDA "), F.col("line_key").cast("string")))], \
        [(10.0, F.concat(F.lit("Ativo: "), active))], [(10.0, F.lit("Nome Volta: VOLTA"))], [(10.0, F.lit("Nome Nome Abrev. Endereço Ordem"))]
    header = F.explode(F.array(*[F.struct(F.lit(10.0 + 10 * i).alias("top"), F.lit(x).alias("x0"), t.alias("text")) for i, row in enumerate(head) for x, t in row]))
    docs = s.select("line_key", "line_name").distinct().select(F.col("line_key").cast("string").alias("doc"), F.lit(0).alias("page"), header.alias("h"))
    return stop_words.select("doc", "page", "top", "w.x0", "w.text").unionByName(docs.select("doc", "page", "h.top", "h.x0", "h.text"))


_STOPS_SQL = """
SELECT line_key::VARCHAR AS doc, line_name AS line, 'IDA ' || line_key AS name_ida, 'VOLTA' AS name_volta, stop_name AS name, 'ABR' AS abbreviation, 'RUA ' || position{} AS address, position::INTEGER AS position, 40 AS speed_limit, round(lat, 6) AS lat, round(lon, 6) AS lon
FROM stops JOIN lines USING (line_key) WHERE lat IS NOT NULL AND lat <> 0 AND line_key % 3 <> 0"""


def _stop_rows(df):
    return df.select(
        "doc", "line", "name_ida", "name_volta", "name", "abbreviation", "address", "position", "speed_limit", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


@query("SC21_stop_listing_rounded_rows", o.sql(_STOPS_SQL.format(""), "stops", "lines"))
def sc21a(spark, sf):
    return _stop_rows(words.stop_listing(listing_words(spark, sf), "A"))


@query("SC21_stop_listing_gap_rows", o.sql(_STOPS_SQL.format(" || CASE WHEN position % 5 = 1 THEN ' FUNDOS' ELSE '' END"), "stops", "lines"))
def sc21b(spark, sf):
    return _stop_rows(words.stop_listing(listing_words(spark, sf), "B"))


def file_names(spark, sf):
    k = F.col("line_key")
    prefix = F.when(k % 3 == 0, "HORARIO_").when(k % 3 == 1, "itinerario_").otherwise("linha_")
    date = F.when(k % 2 == 0, "_20260101").otherwise("_20260202")
    names = d.lines(spark, sf).select(F.concat(F.lit("/data/"), prefix, codes.zero_padded(k, 4), date, F.lit(".pdf")).alias("path"))
    return names.unionByName(names.limit(1).select(F.lit("/data/IntinerarioPorVia.pdf").alias("path")))


@query("SC22_inventory_codes", o.sql("SELECT DISTINCT CASE WHEN length(line_key::VARCHAR) < 4 THEN lpad(line_key::VARCHAR, 4, '0') ELSE line_key::VARCHAR END AS code FROM lines", "lines"))
def sc22(spark, sf):
    return files.inventory_codes(file_names(spark, sf))


@query("SC22_list_files", "SELECT n_nationkey::VARCHAR AS zone, 1 AS files FROM nation")
def sc22_files(spark, sf):
    found = files.list_files(spark, _zone_files(spark, sf))
    return found.groupBy(F.regexp_extract("path", "zone_ord=([0-9]+)/", 1).alias("zone")).agg(F.count(F.lit(1)).alias("files"))


@query("SC23_latest_file", "SELECT code, '/data/horario_' || code || '_' || day || '.pdf' AS path FROM (SELECT CASE WHEN length(user_id::VARCHAR) < 4 THEN lpad(user_id::VARCHAR, 4, '0') ELSE user_id::VARCHAR END AS code, max(strftime(ts, '%Y%m%d')) AS day FROM events GROUP BY 1)")
def sc23(spark, sf):
    path = F.concat(F.lit("/data/horario_"), codes.zero_padded(F.col("user_id"), 4), F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit(".pdf"))
    return files.latest_file_per_code(d.table(spark, sf, "events").select(path.alias("path")))


@query("SC24_passenger_codes", """
SELECT DISTINCT CASE WHEN user_id % 7 = 0 THEN 'M' || CASE WHEN user_id < 1000 THEN lpad(user_id::VARCHAR, 3, '0') ELSE user_id::VARCHAR END ELSE lpad(user_id::VARCHAR, 4, '0') END AS line_code
FROM events WHERE event_type <> 'error' AND user_id < 10000""")
def sc24(spark, sf):
    # longer numbers are no line codes
    number = codes.zero_padded(F.col("user_id"), 3)
    cell = F.when(F.col("event_type") == "error", "total").when(F.col("user_id") % 7 == 0, F.concat(F.lit(" M"), number)).otherwise(number)
    return files.passenger_line_codes(d.table(spark, sf, "events").select(cell.alias("value")))


