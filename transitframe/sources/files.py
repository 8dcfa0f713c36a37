"""JSON and GeoJSON readers (SC1-SC7, SC22-SC24).

Map keys are data, so maps stay ``map`` columns; every reader emits ``ord`` because order decides ties.
A single JSON document is one input row by nature of the format; at scale use one document per line or
per file (SC2), which splits freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitframe import rules
from transitframe.functions import codes
from transitframe.functions import text as tx
from transitframe.functions import values

_STREET = "struct<via:string,codigo:string,via_pdf:string,match:string>"
_SIDE = f"struct<coordenadas:array<array<double>>,ruas:array<{_STREET}>>"
UNIFIED_MAP = f"map<string,struct<ida:{_SIDE},volta:{_SIDE}>>"
LINE_DOC = (
    f"id string, nome string, ida struct<coordenadas:array<array<double>>,ruas:array<{_STREET}>,distancia_km:double>, "
    f"volta struct<coordenadas:array<array<double>>,ruas:array<{_STREET}>,distancia_km:double>, distancia_km_total double"
)
MANUAL_MAP = "map<string,struct<ida:array<string>,volta:array<string>>>"
_DAY = "struct<ida:array<string>,volta:array<string>>"
TIMETABLE_MAP = f"map<string,struct<nome:string,dia_util:{_DAY},sabado:{_DAY},domingo:{_DAY}>>"
ZONE_DOC = (
    "type string, features array<struct<type:string,properties:struct<name:string,nome:string>,"
    "geometry:struct<type:string,coordinates:string>>>"
)


def map_rows(documents: DataFrame, schema: str, key: str) -> DataFrame:
    """Entries of JSON maps (column ``value``) as rows (``ord``, key, ``value``), in document order."""
    entries = documents.select(F.posexplode(F.map_entries(F.from_json("value", schema))).alias("ord", "e"))
    return entries.select("ord", F.col("e.key").alias(key), F.col("e.value").alias("value"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as JSON documents in column ``value``."""
    return spark.read.text(path, wholetext=True)


def _sides(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "_side", F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(f"value.{d}").alias("data")) for d in rules.DIRECTIONS]))
    ).select(*df.drop("value").columns, "_side.direction", "_side.data")


def read_unified(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SC1: unified line maps as (lines, points, itinerary); ``documents`` from ``read_documents``."""
    raw = map_rows(documents, UNIFIED_MAP, "line_name").withColumn("line_id", codes.line_id("line_name"))
    lines = raw.select("line_id", "line_name", codes.line_code("line_name").alias("line_code"), "ord")
    sides = _sides(raw)
    keep = ["line_id", "line_name", "ord", "direction"]
    points = sides.select(*keep, F.posexplode("data.coordenadas").alias("seq", "p")).filter(F.size("p") >= 2).select(
        *keep, "seq", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon")
    )
    streets = sides.select(*keep, F.posexplode("data.ruas").alias("seq", "r")).select(
        *keep, "seq", F.col("r.via").alias("street"), F.col("r.codigo").alias("street_code"),
        F.coalesce("r.match", F.lit("")).alias("match"), F.col("r.via_pdf").alias("street_official"),
    )
    return lines, points, streets


def read_line_docs(spark: SparkSession, path: str) -> DataFrame:
    """SC2: published per-line documents."""
    return spark.read.schema(LINE_DOC).json(path)


def line_doc_points(docs: DataFrame) -> DataFrame:
    parts = [
        docs.select(F.col("id").alias("line_id"), F.col("nome").alias("line_name"), F.lit(d).alias("direction"),
                    F.posexplode(F.col(f"{d}.coordenadas")).alias("seq", "p"))
        for d in rules.DIRECTIONS
    ]
    return parts[0].unionByName(parts[1]).select(
        "line_id", "line_name", "direction", "seq", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon")
    )


def line_doc_itinerary(docs: DataFrame) -> DataFrame:
    parts = [
        docs.select(F.col("id").alias("line_id"), F.col("nome").alias("line_name"), F.lit(d).alias("direction"),
                    F.posexplode(F.col(f"{d}.ruas")).alias("seq", "r"))
        for d in rules.DIRECTIONS
    ]
    return parts[0].unionByName(parts[1]).select(
        "line_id", "line_name", "direction", "seq", F.col("r.via").alias("street"), F.col("r.codigo").alias("street_code"),
        F.coalesce("r.match", F.lit("")).alias("match"), F.col("r.via_pdf").alias("street_official"),
    )


def read_manual(documents: DataFrame) -> DataFrame:
    """SC3: hand-made itineraries (line -> direction -> street names)."""
    sides = _sides(map_rows(documents, MANUAL_MAP, "line_name"))
    return sides.select("ord", "line_name", "direction", F.posexplode("data").alias("seq", "street"))


def read_timetable(documents: DataFrame) -> DataFrame:
    """SC4: timetable map to one row per departure."""
    raw = map_rows(documents, TIMETABLE_MAP, "line_code")
    slots = [
        raw.select("ord", "line_code", F.col("value.nome").alias("line_name"), F.lit(day).alias("day_type"), F.lit(d).alias("direction"),
                   F.posexplode(F.col(f"value.{day}.{d}")).alias("seq", "hhmm"))
        for day in rules.DAY_TYPES for d in rules.DIRECTIONS
    ]
    out = slots[0]
    for slot in slots[1:]:
        out = out.unionByName(slot)
    return out.withColumn("minute_of_day", values.minutes("hhmm"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC5: a JSON array of flat records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json_array(spark, path, "codigo string, nome string")
    return rows.select(codes.code_dialect("codigo", "catalogue").alias("line_code"), tx.strip(F.coalesce("nome", F.lit(""))).alias("line_name"))


def read_terminals(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, "nome string, lat double, lon double").withColumnRenamed("nome", "name")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, "id long, name string")


def _ring(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def read_zone_dir(spark: SparkSession, path: str) -> DataFrame:
    """SC6: first feature of every GeoJSON file, polygons only, in file-name order."""
    docs = spark.read.schema(ZONE_DOC).json(path, multiLine=True).withColumn("file", F.input_file_name())
    feature = docs.select("file", F.get("features", 0).alias("f")).filter(F.col("f.geometry.type") == "Polygon")
    rings = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    return feature.select(
        F.col("file").alias("zone_ord"), F.coalesce("f.properties.name", "f.properties.nome").alias("zone_name"),
        F.transform(rings, _ring).alias("rings"),
    ).withColumn("ring", F.get("rings", 0))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """SC6 with parts and holes: Polygon and MultiPolygon as ``parts``."""
    docs = spark.read.schema(ZONE_DOC).json(path, multiLine=True).withColumn("file", F.input_file_name())
    feature = docs.select("file", F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(
        kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>")
    )
    return feature.select(
        F.col("file").alias("zone_ord"), F.coalesce("f.properties.name", "f.properties.nome").alias("zone_name"),
        F.transform(parts, lambda rings: F.transform(rings, _ring)).alias("parts"),
    ).filter("parts is not null")


def read_zone_collection(spark: SparkSession, path: str) -> DataFrame:
    """SC7: a FeatureCollection of zones, outer rings only, in list order."""
    docs = spark.read.schema(ZONE_DOC).json(path, multiLine=True)
    feature = docs.select(F.posexplode("features").alias("zone_ord", "f"))
    rings = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    return feature.select(
        "zone_ord", F.coalesce("f.properties.nome", "f.properties.name").alias("zone_name"), _ring(F.get(rings, 0)).alias("ring")
    )


def inventory_codes(paths: DataFrame) -> DataFrame:
    """SC22: line codes from document file names; ``paths(path)``."""
    stem = F.upper(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    bare = F.regexp_replace(stem, "^(INTINERARIOPORVIA-|ITINERARIO_|HORARIO_|LINHA_)", "")
    code = tx.strip(F.regexp_replace(bare, r"_\d{8}$", ""))
    return paths.select(code.alias("code")).distinct().filter(~F.col("code").isin(*rules.INVENTORY_JUNK))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File paths under a folder or glob without reading the contents."""
    return spark.read.format("binaryFile").load(path).select("path")


def latest_file_per_code(paths: DataFrame) -> DataFrame:
    """SC23: greatest path per code (names end in a date)."""
    name = F.element_at(F.split("path", "/"), -1)
    code = F.regexp_extract(name, r"^[a-z]+_(.+?)_\d{8}", 1)
    return paths.select("path", code.alias("code")).filter("code <> ''").groupBy("code").agg(F.max("path").alias("path"))


def passenger_line_codes(cells: DataFrame) -> DataFrame:
    """SC24: distinct line codes from the second column of a passenger table; ``cells(value)``."""
    code = tx.strip("value")
    valid = cells.select(code.alias("v")).filter(F.col("v").rlike(r"^M?\d{3,4}$"))
    padded = F.when(F.col("v").rlike(r"^\d+$"), F.lpad("v", 4, "0")).otherwise(F.col("v"))
    return valid.select(padded.alias("line_code")).distinct()
