"""Merge and publish jobs (MG) and the sinks checked by reading back (SK)."""

import uuid

from pyspark.sql import functions as F

from transitframe.functions import codes
from transitframe.operators import lookup, merge, ordered, resolve, spatial
from transitframe.plans import domain as d
from transitframe.plans import oracles as o
from transitframe.plans import publish
from transitframe.plans.catalog import query
from transitframe.plans.catalog.resolution import _ER11
from transitframe.plans.catalog.spatial import _LENGTHS
from transitframe.session import shared_folder, store
from transitframe.sources import files, writers

_N = "named_itinerary"


def scratch(spark, name):
    """A new folder in the shared checkpoint area."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def candidate_paths(spark, sf):
    """Placemarks with repeated codes: each line twice per direction, some copies deactivated or misnamed."""
    points = d.raw_points(spark, sf).groupBy("line_key", "direction").agg(F.count(F.lit(1)).alias("n_points"))
    first = points.join(d.lines(spark, sf).select("line_key", "line_name", "line_code"), "line_key").filter("line_code is not null")
    key = F.col("line_key")
    other_name = F.when(key % 7 == 0, F.concat("line_code", F.lit(" - TERMINAL RODOVIARIO"))).when(
        key % 5 == 0, F.concat("line_name", F.lit(" (DESATIVADO)"))
    ).otherwise(F.concat("line_name", F.lit(" Praia")))
    second = first.filter("line_key % 2 = 0").withColumns({"line_name": other_name, "n_points": F.col("n_points") + key % 3 - 1})
    both = first.withColumn("copy", F.lit(0)).unionByName(second.withColumn("copy", F.lit(1)))
    return both.select(
        "line_code", "direction", "line_name", F.concat_ws("-", "line_key", "direction", "copy").alias("path_id"), "n_points",
        F.struct("copy", "line_key").alias("ord"),
    )


def _dw(x):
    return o.words3(f"regexp_replace(replace(upper({x}), '(DESATIVADO)', ''), '^[^-]*- ', '')")


_PATHS = f"""p0 AS (SELECT line_key, direction, count(*) AS n FROM raw_points GROUP BY ALL), p1 AS (SELECT line_code, direction, line_name, line_key, n, 0 AS copy FROM p0 JOIN lines USING (line_key) WHERE line_code IS NOT NULL),
paths AS (SELECT * FROM p1 UNION ALL SELECT line_code, direction, CASE WHEN line_key % 7 = 0 THEN line_code || ' - TERMINAL RODOVIARIO' WHEN line_key % 5 = 0 THEN line_name || ' (DESATIVADO)' ELSE line_name || ' Praia' END, line_key, n + line_key % 3 - 1, 1 FROM p1 WHERE line_key % 2 = 0),
pw AS (SELECT *, {_dw('line_name')} AS w, contains(upper(line_name), '(DESATIVADO)') AS off FROM paths),
amb AS (SELECT DISTINCT a.line_code, a.direction FROM pw a JOIN pw b ON a.line_code = b.line_code AND a.direction = b.direction AND (a.copy, a.line_key) < (b.copy, b.line_key) WHERE {o.jaccard('a.w', 'b.w')} < 0.25),
res AS (SELECT line_code, direction, arg_min({{'name': line_name, 'id': line_key || '-' || direction || '-' || copy, 'n': n, 'copy': copy, 'k': line_key}}, (NOT off, -n, copy, line_key)) AS v, count(*) AS candidates FROM pw WHERE (line_code, direction) NOT IN (SELECT (line_code, direction) FROM amb) GROUP BY ALL),
pref AS (SELECT line_code, arg_min(v.name, (CASE WHEN contains(upper(v.name), '(DESATIVADO)') THEN 0 WHEN direction = 'ida' THEN 1 ELSE 2 END, v.copy, v.k)) AS line_name, max(v.id) FILTER (direction = 'ida') AS ida, max(v.id) FILTER (direction = 'volta') AS volta FROM res GROUP BY 1)"""


@query("MG1_resolve_duplicates", o.sql(f"AND_WITH {_PATHS} SELECT line_code, direction, v.name AS line_name, v.id AS path_id, v.n AS n_points, candidates FROM res", "raw_points", "lines"))
def mg1(spark, sf):
    return merge.resolve_duplicates(candidate_paths(spark, sf))[0].drop("ord")


@query("MG1_ambiguous", o.sql(f"AND_WITH {_PATHS} SELECT line_code, direction, line_name FROM paths WHERE (line_code, direction) IN (SELECT (line_code, direction) FROM amb)", "raw_points", "lines"))
def mg1_ambiguous(spark, sf):
    return merge.resolve_duplicates(candidate_paths(spark, sf))[1].select("line_code", "direction", "line_name")


@query("MG2_preferred_names", o.sql(f"AND_WITH {_PATHS} SELECT line_code, line_name, ida, volta FROM pref", "raw_points", "lines"))
def mg2(spark, sf):
    names = merge.preferred_names(merge.resolve_duplicates(candidate_paths(spark, sf))[0])
    return names.select("line_code", "line_name", F.col("ida.path_id").alias("ida"), F.col("volta.path_id").alias("volta"))


@query("MG3_should_rename", o.sql(f"""
AND_WITH {_PATHS} SELECT line_code, direction, line_key, contains(upper(line_name), '(DESATIVADO)') AND NOT contains(upper(l.old), '(DESATIVADO)') OR len({_dw('line_name')}) >= len({_dw('l.old')}) AS rename
FROM paths JOIN (SELECT line_key, line_name AS old FROM lines) l USING (line_key) WHERE copy = 1""", "raw_points", "lines"))
def mg3(spark, sf):
    copies = candidate_paths(spark, sf).filter("ord.copy = 1").withColumn("line_key", F.col("ord.line_key"))
    old = d.lines(spark, sf).select("line_key", F.col("line_name").alias("old"))
    return copies.join(old, "line_key").select("line_code", "direction", "line_key", codes.should_rename(F.col("old"), F.col("line_name")).alias("rename"))


def system_paths(spark, sf):
    """The system before synchronising: two thirds of the lines, half of them with the same geometry."""
    points = d.raw_points(spark, sf).groupBy("line_key", "direction").agg(F.count(F.lit(1)).alias("n_points"))
    kept = d.lines(spark, sf).filter("line_key % 3 <> 1").select("line_key", "line_name", "line_code")
    path = F.when(F.col("line_key") % 4 < 2, F.concat_ws("-", "line_key", "direction", F.lit(0))).otherwise("old")
    return points.join(kept, "line_key").select("line_code", "line_name", "direction", path.alias("path_id"), "n_points")


_SYNC = f"""{_PATHS}, sys AS (SELECT line_code, max(line_name) AS old_name, max(pid) FILTER (direction = 'ida') AS oi, max(pid) FILTER (direction = 'volta') AS ov
  FROM (SELECT line_code, line_name, direction, CASE WHEN line_key % 4 < 2 THEN line_key || '-' || direction || '-0' ELSE 'old' END AS pid FROM p0 JOIN lines USING (line_key) WHERE line_key % 3 <> 1 AND line_code IS NOT NULL) GROUP BY 1),
j AS (SELECT COALESCE(s.line_code, p.line_code) AS line_code, old_name, oi, ov, p.line_name AS new_name, ida, volta FROM sys s FULL JOIN pref p ON s.line_code = p.line_code),
c AS (SELECT *, CASE WHEN new_name IS NULL THEN 'system_only' WHEN old_name IS NULL THEN 'new' WHEN old_name = new_name THEN 'same_name'
  WHEN contains(upper(new_name), '(DESATIVADO)') AND NOT contains(upper(old_name), '(DESATIVADO)') OR len({_dw('new_name')}) >= len({_dw('old_name')}) THEN 'renamed' ELSE 'name_kept' END AS name_status FROM j)"""


@query("MG4_synchronise", o.sql(f"AND_WITH {_SYNC} SELECT line_code, CASE WHEN name_status IN ('new', 'renamed') THEN new_name ELSE old_name END AS line_name, COALESCE(ida, oi) AS ida_path, COALESCE(volta, ov) AS volta_path FROM c", "raw_points", "lines"))
def mg4(spark, sf):
    source = merge.preferred_names(merge.resolve_duplicates(candidate_paths(spark, sf))[0])
    return merge.synchronise(source, system_paths(spark, sf))[0]


@query("MG4_change_log", o.sql(f"""
AND_WITH {_SYNC} SELECT line_code, old_name, new_name, name_status, CASE WHEN ida IS NULL THEN 'none' WHEN old_name IS NULL THEN 'new' WHEN oi = ida THEN 'unchanged' ELSE 'updated' END AS ida_status,
  CASE WHEN volta IS NULL THEN 'none' WHEN old_name IS NULL THEN 'new' WHEN ov = volta THEN 'unchanged' ELSE 'updated' END AS volta_status FROM c WHERE new_name IS NOT NULL""", "raw_points", "lines"))
def mg4_log(spark, sf):
    source = merge.preferred_names(merge.resolve_duplicates(candidate_paths(spark, sf))[0])
    return merge.synchronise(source, system_paths(spark, sf))[1]


def mg5_outputs(spark, sf):
    merged = d.manual_itinerary(spark, sf).select("line_code", "line_name", "direction", "seq", "street", F.col("line_key").alias("ord"))
    system = d.named_itinerary(spark, sf).select("line_id", "line_code", "direction", "seq", "street", "street_code", "match")
    return merge.apply_itineraries(merged, system, d.lines(spark, sf).filter("line_key % 10 <> 6").select("line_id", "line_name"))


_MG5 = f"""w AS (SELECT line_code, line_name, line_key, count(DISTINCT direction) AS n FROM manual_itinerary WHERE line_code IS NOT NULL GROUP BY ALL HAVING count(DISTINCT direction) = 2),
u AS (SELECT line_code, arg_max(line_name, line_key) AS line_name FROM w WHERE line_code <> '0112' GROUP BY 1), t AS (SELECT line_id, line_code FROM lines WHERE line_code IS NOT NULL AND line_key % 10 <> 6),
fresh AS (SELECT t.line_id, direction, seq, street FROM manual_itinerary JOIN u USING (line_code, line_name) JOIN t USING (line_code)),
cmp AS (SELECT line_id, bool_or(a IS DISTINCT FROM b) AS changed FROM (SELECT COALESCE(f.line_id, s.line_id) AS line_id, f.street AS a, s.street AS b FROM fresh f FULL JOIN (SELECT * FROM named_itinerary WHERE line_id IN (SELECT line_id FROM fresh)) s
  ON f.line_id = s.line_id AND f.direction = s.direction AND f.seq = s.seq) GROUP BY 1)"""


@query("MG5_apply_log", o.sql(f"""
AND_WITH {_MG5} SELECT line_id AS entry, CASE WHEN changed THEN 'applied' ELSE 'unchanged' END AS outcome FROM cmp UNION ALL SELECT line_name, 'skipped' FROM w WHERE line_code = '0112'
UNION ALL SELECT line_name, 'no_system_line' FROM u WHERE line_code NOT IN (SELECT line_code FROM t)""", "manual_itinerary", "lines"))
def mg5_log(spark, sf):
    return mg5_outputs(spark, sf)[1]


@query("MG5_apply_itineraries", o.sql(f"""
AND_WITH {_MG5}, k AS (SELECT line_id, direction, {o.n2('street')} AS key, arg_min({{'c': street_code, 'm': match}}, seq) AS v FROM named_itinerary GROUP BY ALL)
SELECT f.line_id, f.direction, f.seq, f.street, v.c AS street_code, CASE WHEN v IS NULL THEN 'manual' ELSE v.m END AS match, v IS NOT NULL AS reused FROM fresh f LEFT JOIN k ON k.line_id = f.line_id AND k.direction = f.direction AND k.key = {o.n2('f.street')}
  WHERE f.line_id IN (SELECT line_id FROM cmp WHERE changed)
UNION ALL SELECT line_id, direction, seq, street, street_code, match, TRUE FROM named_itinerary WHERE line_id NOT IN (SELECT line_id FROM cmp WHERE changed)""", "manual_itinerary", "lines"))
def mg5(spark, sf):
    return mg5_outputs(spark, sf)[0]


def per_line_counts(spark, sf):
    points = d.raw_points(spark, sf).groupBy("line_key").agg(
        *[F.sum(F.when(F.col("direction") == x, 1).otherwise(0)).alias(f"{x}_points") for x in ("ida", "volta")]
    )
    streets = d.itinerary(spark, sf).groupBy("line_key").agg(
        *[F.sum(F.when(F.col("direction") == x, 1).otherwise(0)).alias(f"{x}_streets") for x in ("ida", "volta")]
    )
    return points, streets


@query("MG6_merge_new_lines", o.sql("""
AND_WITH p AS (SELECT line_key, count(*) FILTER (direction = 'ida') AS ip, count(*) FILTER (direction = 'volta') AS vp FROM raw_points GROUP BY 1), s AS (SELECT line_key, count(*) FILTER (direction = 'ida') AS i, count(*) FILTER (direction = 'volta') AS v FROM itinerary GROUP BY 1),
g AS (SELECT line_key, ip, vp FROM p WHERE line_key % 2 = 0), i AS (SELECT line_key, i, v FROM s WHERE line_key % 3 = 0), o AS (SELECT line_key, COALESCE(ip, 0) AS ip, COALESCE(vp, 0) AS vp, i, v FROM s LEFT JOIN p USING (line_key) WHERE line_key % 5 <> 0)
SELECT COALESCE(o.line_key, g.line_key)::VARCHAR AS line_code, CASE WHEN o.line_key IS NOT NULL THEN 'S' WHEN i.line_key IS NOT NULL THEN 'I' ELSE 'G' END AS line_name,
  CASE WHEN g.line_key IS NOT NULL THEN g.ip ELSE o.ip END AS ida_points, CASE WHEN g.line_key IS NOT NULL THEN g.vp ELSE o.vp END AS volta_points,
  CASE WHEN g.line_key IS NOT NULL AND COALESCE(i.i, 0) > 0 THEN i.i ELSE COALESCE(o.i, 0) END AS ida_streets, CASE WHEN g.line_key IS NOT NULL AND COALESCE(i.v, 0) > 0 THEN i.v ELSE COALESCE(o.v, 0) END AS volta_streets,
  CASE WHEN g.line_key IS NULL THEN 'kept' WHEN o.line_key IS NULL THEN 'new' ELSE 'updated' END AS outcome FROM o FULL JOIN g USING (line_key) LEFT JOIN i ON i.line_key = g.line_key""", "raw_points", "itinerary"))
def mg6(spark, sf):
    points, streets = per_line_counts(spark, sf)
    code = F.col("line_key").cast("string").alias("line_code")
    geometry = points.filter("line_key % 2 = 0").select(code, F.lit("G").alias("line_name"), "ida_points", "volta_points")
    itinerary = streets.filter("line_key % 3 = 0").select(code, F.lit("I").alias("line_name"), "ida_streets", "volta_streets")
    system = streets.join(points, "line_key", "left").filter("line_key % 5 <> 0").na.fill(0).select(
        code, F.lit("S").alias("line_name"), "ida_points", "volta_points", "ida_streets", "volta_streets"
    )
    return merge.merge_new_lines(geometry, itinerary, system)


@query("MG7_upsert_timetable", o.sql("""
AND_WITH n AS (SELECT * FROM timetable WHERE event_id % 2 = 0 AND line_code < '0050') SELECT line_code, day_type, direction, hhmm, 'current' AS source FROM timetable WHERE line_code NOT IN (SELECT line_code FROM n)
UNION ALL SELECT line_code, day_type, direction, hhmm, 'new' FROM n""", "timetable"))
def mg7(spark, sf):
    table = d.timetable(spark, sf).select("line_code", "day_type", "direction", "hhmm", "event_id")
    new = table.filter("event_id % 2 = 0 and line_code < '0050'")
    return merge.upsert_timetable(table, new).drop("event_id")


@query("MG8_publish_summary", o.sql(f"""{_LENGTHS}, q AS (SELECT line_key, COALESCE(max(km) FILTER (direction = 'ida'), 0) AS a, COALESCE(max(km) FILTER (direction = 'volta'), 0) AS b, bool_or(direction = 'ida') AS i, bool_or(direction = 'volta') AS v FROM t GROUP BY 1)
SELECT line_id, line_name, COALESCE(i, FALSE) AS has_ida, COALESCE(v, FALSE) AS has_volta, line_key IN (SELECT line_key FROM itinerary) AS has_itinerary, COALESCE(a, 0) AS km_ida, COALESCE(b, 0) AS km_volta, COALESCE(round(a + b, 2), 0) AS km_total
FROM lines LEFT JOIN q USING (line_key)""", "route_points", "lines", "itinerary"))
def mg8(spark, sf):
    tables = publish.publish(d.lines(spark, sf), d.named_points(spark, sf), d.named_itinerary(spark, sf), d.timetable(spark, sf))
    return tables["summary"]


@query("MG8_second_publish", o.sql(f"""
AND_WITH v AS (SELECT DISTINCT line_id, CASE WHEN line_key % 10 = 3 THEN 'v2' ELSE 'v1' END AS version FROM named_itinerary),
p AS (SELECT line_id, count(*) AS n FROM named_points GROUP BY 1), i AS (SELECT line_id, count(*) AS n FROM named_itinerary GROUP BY 1),
x AS (SELECT *, min(occ_ord) FILTER (version = 'v1') OVER (PARTITION BY norm_street) AS later FROM street_index JOIN v USING (line_id))
SELECT 'summary' AS part, line_id, 'v1' AS version, 1 AS amount, 0 AS renamed FROM lines
UNION ALL SELECT 'documents', line_id, COALESCE(version, 'v1'), COALESCE(p.n, 0) + COALESCE(i.n, 0), CASE WHEN version = 'v2' THEN i.n ELSE 0 END FROM lines LEFT JOIN v USING (line_id) LEFT JOIN p USING (line_id) LEFT JOIN i USING (line_id)
UNION ALL SELECT 'street_index', line_id, CASE WHEN bool_or(version = 'v2' OR key_ord <> later) THEN 'v2' ELSE 'v1' END, count(*), count(*) FILTER (version = 'v2') FROM x GROUP BY line_id
UNION ALL SELECT 'timetable', line_id, 'v1', count(*), 0 FROM lines JOIN timetable t ON t.line_code = {o.line_code('line_name')} GROUP BY ALL
UNION ALL SELECT 'features', line_id, 'v1', n, 0 FROM p""", _N, "named_points", "lines", "timetable", "street_index"))
def mg8_again(spark, sf):
    """All five tables after a second publish in which the streets of a tenth of the lines have new names. The index row of a
    street also changes on the lines that keep it, where its first occurrence was on a renamed line."""
    root = scratch(spark, "published")
    # both publishes read the same route tables, each several times
    lines, points, streets = (store(t) for t in (d.lines(spark, sf), d.named_points(spark, sf), d.named_itinerary(spark, sf)))
    timetable = d.timetable(spark, sf)
    renamed = streets.withColumn("street", F.when(F.col("line_key") % 10 == 3, F.concat("street", F.lit(" NOVA"))).otherwise(F.col("street")))
    writers.publish_tables(publish.publish(lines, points, streets, timetable), root, "v1")
    writers.publish_tables(publish.publish(lines, points, renamed, timetable), root, "v2")
    held = spark.read.parquet(f"{root}/manifest/v2").select("part", "line_id", "version")
    is_new = {"documents": F.col("fragment").contains(' NOVA"'), "street_index": F.col("norm_street").endswith(" NOVA")}
    entries = {"documents": F.col("place") % 2 == 1, "features": F.col("fragment").rlike(r"^,?\[-?[0-9]")}
    out = None
    for part in ("summary", "documents", "street_index", "timetable", "features"):
        rows = writers.read_published(spark, root, part).filter(entries.get(part, F.lit(True)))
        counted = rows.groupBy("line_id").agg(F.count(F.lit(1)).alias("amount"), F.sum(is_new.get(part, F.lit(False)).cast("long")).alias("renamed")).withColumn("part", F.lit(part))
        out = counted if out is None else out.unionByName(counted)
    return held.join(out, ["part", "line_id"], "left").na.fill(0, ["amount", "renamed"])


_MG9 = "last AS (SELECT line_code, arg_max(line_id, ord) AS line_id FROM lines WHERE line_code IS NOT NULL GROUP BY 1),\n" + _ER11.replace(
    "FROM named_itinerary) s", "FROM named_itinerary WHERE line_id IN (SELECT line_id FROM last)) s")


@query("MG9_merge_by_code", o.sql(f"""
AND_WITH {_MG9}, p AS (SELECT a.line_code, a.line_name, a.direction, a.seq, a.street AS manual, b.street AS system, b.seq AS bs, {o.jaccard('a.w', 'b.w')} AS score FROM mk a JOIN so b ON a.line_name = b.line_name AND a.direction = b.direction
  WHERE NOT EXISTS (SELECT 1 FROM sk WHERE sk.line_name = a.line_name AND sk.direction = a.direction AND sk.key = a.key)),
u AS (SELECT 'merged' AS kind, line_code, line_name, direction, seq, street, NULL AS system, NULL AS score FROM m
UNION ALL SELECT 'pair', line_code, line_name, direction, seq, arg_min(manual, (-score, bs)), arg_min(system, (-score, bs)), round(max(score), 6) FROM p WHERE score >= 0.4 GROUP BY line_code, line_name, direction, seq
UNION ALL SELECT DISTINCT 'extra', c.line_code, e.line_name, e.direction, e.seq, e.street, NULL, NULL FROM sk e JOIN (SELECT DISTINCT line_code, line_name FROM m) c USING (line_name)
  WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.line_name = e.line_name AND mk.direction = e.direction AND (mk.key = e.key OR {o.jaccard('mk.w', 'e.w')} >= 0.4)))
SELECT u.*, COALESCE(line_id, '') AS line_id FROM u LEFT JOIN last USING (line_code)""", "manual_itinerary", _N, "lines"))
def mg9(spark, sf):
    """The project's three outputs: merged streets, fuzzy pairs, streets of the system alone; the last line of a code stands for it."""
    manual = d.manual_itinerary(spark, sf).select("line_code", "line_name", "direction", "seq", "street").filter("line_code is not null")
    last = merge.last_line_per_code(d.lines(spark, sf))
    system = d.named_itinerary(spark, sf).join(last.select("line_id"), "line_id", "left_semi").select("line_code", "direction", "seq", "street")
    merged, pairs, extras = resolve.merge_with_system(manual, system)
    columns = ["line_code", "line_name", "direction", "seq", "street"]
    none = {"system": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}
    rows = merged.select(F.lit("merged").alias("kind"), *columns).withColumns(none)
    rows = rows.unionByName(extras.select(F.lit("extra").alias("kind"), *columns).withColumns(none))
    rows = rows.unionByName(pairs.withColumnRenamed("manual", "street").select(F.lit("pair").alias("kind"), *columns, "system", F.round("score", 6).alias("score")))
    return rows.join(last.select("line_code", "line_id"), "line_code", "left").withColumn("line_id", F.coalesce("line_id", F.lit("")))


@query("SK1_SC2_line_documents", o.sql("""
SELECT line_id, line_name, direction, 'point' AS kind, seq, CAST(round(lat * 1000000)::BIGINT AS VARCHAR) AS a, CAST(round(lon * 1000000)::BIGINT AS VARCHAR) AS b FROM named_points
UNION ALL SELECT line_id, line_name, direction, 'street', seq, street, street_code FROM named_itinerary""", "named_points", _N))
def sk1(spark, sf):
    path = scratch(spark, "line-documents")
    writers.write_line_documents(publish.line_documents(d.lines(spark, sf), d.named_points(spark, sf), d.named_itinerary(spark, sf)), path)
    docs = files.read_line_docs(spark, path)
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("long").cast("string")
    points = files.line_doc_points(docs).select("line_id", "line_name", "direction", F.lit("point").alias("kind"), F.col("seq").cast("long").alias("seq"), micro("lat").alias("a"), micro("lon").alias("b"))
    streets = files.line_doc_itinerary(docs).select("line_id", "line_name", "direction", F.lit("street").alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("street").alias("a"), F.col("street_code").alias("b"))
    return points.unionByName(streets)


@query("SK1_SC2_document_lengths", o.sql(f"""{_LENGTHS}, q AS (SELECT line_key, COALESCE(max(km) FILTER (direction = 'ida'), 0) AS a, COALESCE(max(km) FILTER (direction = 'volta'), 0) AS b FROM t GROUP BY 1)
SELECT line_id, line_name, COALESCE(a, 0) AS km_ida, COALESCE(b, 0) AS km_volta, COALESCE(round(a + b, 2), 0) AS km_total FROM lines LEFT JOIN q USING (line_key)""", "route_points", "lines", "itinerary"))
def sk1_lengths(spark, sf):
    path = scratch(spark, "line-documents")
    writers.write_line_documents(publish.line_documents(d.lines(spark, sf), d.named_points(spark, sf), d.named_itinerary(spark, sf)), path)
    docs = files.read_line_docs(spark, path)
    return docs.select(F.col("id").alias("line_id"), F.col("nome").alias("line_name"), F.col("ida.distancia_km").alias("km_ida"), F.col("volta.distancia_km").alias("km_volta"), F.col("distancia_km_total").alias("km_total"))


@query("SK2_summary_file", o.sql("SELECT line_id, line_name FROM lines", "lines"))
def sk2(spark, sf):
    path = scratch(spark, "summary")
    writers.write_summary(d.lines(spark, sf).select("line_id", "line_name"), path)
    return spark.read.schema("line_id string, line_name string").json(path)


@query("SK3_street_index", o.sql("SELECT norm_street, line_id, direction, street_code FROM street_index", "street_index"))
def sk3(spark, sf):
    path = scratch(spark, "street-index")
    writers.write_street_index(lookup.street_index(d.named_itinerary(spark, sf)), path)
    return spark.read.parquet(path).select("norm_street", "line_id", "direction", "street_code")


@query("SK4_timetable", o.sql(f"SELECT line_id, day_type, count(*) AS departures FROM lines JOIN timetable t ON t.line_code = {o.line_code('line_name')} GROUP BY ALL", "lines", "timetable"))
def sk4(spark, sf):
    from transitframe.operators import joins

    path = scratch(spark, "timetable")
    writers.write_timetable(joins.lines_with_timetable(d.lines(spark, sf), d.timetable(spark, sf), "full"), path)
    return spark.read.parquet(path).groupBy("line_id", "day_type").agg(F.count(F.lit(1)).alias("departures"))


_MICRO = "round(lat * 1000000)::BIGINT AS lat, round(lon * 1000000)::BIGINT AS lon"


@query("SK5_geojson_lines", o.sql(f"SELECT line_id, direction, seq, {_MICRO} FROM named_points", "named_points"))
def sk5(spark, sf):
    path = scratch(spark, "features")
    writers.write_feature_lines(lookup.geojson_features(d.named_points(spark, sf)), path)
    back = spark.read.schema(
        "geometry struct<coordinates:array<array<double>>>, properties struct<linha_id:string,sentido:string>"
    ).json(path)
    vertices = back.select(F.col("properties.linha_id").alias("line_id"), F.col("properties.sentido").alias("direction"), F.posexplode("geometry.coordinates").alias("seq", "p"))
    micro = lambda c: F.round(c * 1_000_000).cast("long")
    return vertices.select("line_id", "direction", F.col("seq").cast("long").alias("seq"), micro(F.get("p", 1)).alias("lat"), micro(F.get("p", 0)).alias("lon"))


@query("SK5_geojson_fragments", o.sql(f"SELECT row_number() OVER (ORDER BY line_name, line_id, direction, seq) AS place, seq = 0 AS opens, {_MICRO} FROM named_points", "named_points"))
def sk5_fragments(spark, sf):
    # one collection over many part files, read back in the order of the file
    points = d.named_points(spark, sf).select("line_id", "line_name", "direction", "seq", "lat", "lon")
    path = scratch(spark, "collection")
    writers.write_fragments(writers.geojson_fragments(points), ["line_name", "line_id", "direction", "seq"], path)
    vertex = writers.read_fragments(spark, path).withColumn("pair", F.regexp_extract("value", r"\[(-?[0-9][^\[\]]*)\]", 1)).filter("pair <> ''")
    numbered = ordered.global_ordinal(vertex, ["ordinal"], "place", 1)
    micro = lambda i: F.round(F.get(F.split("pair", ","), i).cast("double") * 1_000_000).cast("long")
    return numbered.select("place", F.col("value").contains('"Feature"').alias("opens"), micro(1).alias("lat"), micro(0).alias("lon"))


_KML_ORDER = ["folder", "sort_number", "sort_suffix", "line_name", "line_id", "seq"]
_SORTED = """s AS (SELECT *, CAST(regexp_extract(upper(line_name), '^(M)?0*(\\d+)\\s*-?\\s*([A-Z])?\\b', 2) AS BIGINT) + CASE WHEN line_name LIKE 'M%' THEN 1000000 ELSE 0 END AS n,
  CASE regexp_extract(upper(line_name), '^(M)?0*(\\d+)\\s*-?\\s*([A-Z])?\\b', 3) WHEN '' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS x FROM lines)"""


def _kml_back(spark, name, fragments):
    """The document written, read again and numbered in the order of the file."""
    path = scratch(spark, name)
    writers.write_fragments(fragments, _KML_ORDER, path)
    rows = ordered.global_ordinal(writers.kml_rows(writers.read_fragments(spark, path)), ["ordinal"], "place", 1)
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    return rows.select("place", "folder", "name", micro("lat").alias("lat"), micro("lon").alias("lon"), "n_points")


@query("SK6_SK7_kml_fragments", o.sql(f"""
AND_WITH {_SORTED} SELECT row_number() OVER (ORDER BY direction, n, x, line_name, line_id, seq) AS place, CASE direction WHEN 'ida' THEN 'IDA' ELSE 'VOLTA' END AS folder, line_name AS name,
  round(lat * 1000000)::BIGINT AS lat, round(lon * 1000000)::BIGINT AS lon, 1 AS n_points FROM route_points JOIN s USING (line_key)""", "route_points", "lines"))
def sk6(spark, sf):
    points = d.named_points(spark, sf).select("line_id", "line_name", "direction", "seq", "lat", "lon")
    return _kml_back(spark, "kml-lines", writers.kml_fragments(points))


@query("SK6_kml_points_and_zones", o.sql(f"""
AND_WITH {_SORTED}, i AS (SELECT *, max(seq) OVER (PARTITION BY line_key) - seq AS back FROM route_points WHERE direction = 'ida'),
u AS (SELECT 1 AS f, 'IDA' AS folder, n, x, line_name AS name, line_id, seq, lat, lon, 1 AS n_points FROM i JOIN s USING (line_key)
  UNION ALL SELECT 3, 'VOLTA', n, x, line_name, line_id, back, lat, lon, 1 FROM i JOIN s USING (line_key)
  UNION ALL SELECT 6, 'PONTOS', 0, 0, stop_name, '', 0, lat, lon, 1 FROM stops WHERE lat IS NOT NULL
  UNION ALL SELECT 8, 'ZONAS', zone_ord, 0, zone_name, '', 0, NULL, NULL, 7 FROM zone_edges GROUP BY ALL)
SELECT row_number() OVER (ORDER BY f, n, x, name, line_id, seq) AS place, folder, name, round(lat * 1000000)::BIGINT AS lat, round(lon * 1000000)::BIGINT AS lon, n_points FROM u""",
       "route_points", "lines", "stops", "zone_edges"))
def sk6_points(spark, sf):
    out = d.named_points(spark, sf).filter("direction = 'ida'").select("line_id", "line_name", "direction", "seq", "lat", "lon")
    back = spatial.reversed_paths(out, ["line_id", "line_name"]).withColumn("direction", F.lit("volta"))
    stops = d.stops(spark, sf).filter("lat is not null").select(F.col("stop_name").alias("name"), "lat", "lon")
    return _kml_back(spark, "kml-all", writers.kml_fragments(out.unionByName(back), stops, zones=d.zones(spark, sf)))


@query("SK8_workbooks", o.sql(f"SELECT 'EMPRESA ' || region AS company, substr(replace(line_name, '/', '-'), 1, 31) AS sheet, position, stop_name, {_MICRO} FROM stops JOIN lines USING (line_key)", "stops", "lines"))
def sk8(spark, sf):
    from transitframe.operators.numbering import unique_sheet_names

    lines = d.lines(spark, sf).join(d.stops(spark, sf).select("line_key").distinct(), "line_key", "left_semi")
    entries = lines.select(F.concat(F.lit("EMPRESA "), "region").alias("company"), "line_key", F.col("line_key").alias("ord"), F.col("line_name").alias("title"))
    sheets = d.stops(spark, sf).join(unique_sheet_names(entries, ["company"]).select("company", "line_key", "sheet"), "line_key")
    path = scratch(spark, "workbooks")
    writers.write_workbooks(sheets.select("company", "sheet", "position", "stop_name", "lat", "lon"), path)
    back = spark.read.schema("sheet string, position long, stop_name string, lat double, lon double, company string").option("header", True).csv(path)
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    return back.select("company", "sheet", "position", "stop_name", micro("lat").alias("lat"), micro("lon").alias("lon"))


@query("SK9_versions", o.sql("SELECT line_code, count(*) AS departures FROM timetable WHERE event_id % 2 = 0 GROUP BY 1", "timetable"))
def sk9(spark, sf):
    root = scratch(spark, "versions")
    table = d.timetable(spark, sf).select("line_code", "event_id")
    writers.publish_version(table, root, "v1")
    writers.publish_version(writers.read_current(spark, root).filter("event_id % 2 = 0"), root, "v2")
    return writers.read_current(spark, root).groupBy("line_code").agg(F.count(F.lit(1)).alias("departures"))


@query("SK10_report_rows", o.sql("SELECT rtrim(rpad(street_code, 8, ' ') || '  ' || rpad(street, 60, ' ')) AS value FROM registry", "registry"))
def sk10(spark, sf):
    return writers.report_rows(d.registry(spark, sf), {"street_code": 8, "street": 60})
