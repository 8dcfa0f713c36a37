"""KML readers (SC8-SC13) on Spark's XML source with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitframe.functions import codes
from transitframe.functions import text as tx
from transitframe.functions import values

_LINE = "LineString:array<struct<coordinates:string>>"
_POINT = "Point:struct<coordinates:string>"
_POLYGON = "Polygon:array<struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>>"
_MULTI = f"MultiGeometry:struct<{_LINE},{_POLYGON}>"
_PLACEMARK = f"struct<name:string,{_LINE},{_POINT},{_POLYGON},{_MULTI}>"
_MARK_COLUMNS = ", ".join(["name string", *[t.replace(":", " ", 1) for t in (_LINE, _POINT, _POLYGON, _MULTI)]])
_FLAT_FOLDER = f"name string, Placemark array<{_PLACEMARK}>"
_NESTED_FOLDER = f"name string, Folder array<struct<name:string,Placemark:array<{_PLACEMARK}>>>"


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _ordered(df: DataFrame) -> DataFrame:
    """Input order of the rows: partition number and position within it (no shuffle)."""
    return df.withColumn("doc_ord", F.monotonically_increasing_id())


def _line_texts(placemark: str) -> Column:
    direct = F.coalesce(F.col(f"{placemark}.LineString"), F.array().cast("array<struct<coordinates:string>>"))
    nested = F.coalesce(F.col(f"{placemark}.MultiGeometry.LineString"), F.array().cast("array<struct<coordinates:string>>"))
    return F.concat(direct, nested)


def read_line_folders(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """SC8: line folder -> IDA/VOLTA folder -> line strings, as path rows with a points array.

    ``strict`` raises on coordinates that are not numbers or out of range, as the source job does.
    """
    folders = _ordered(_read(spark, path, "Folder", _NESTED_FOLDER)).filter(F.col("Folder").isNotNull())
    named = folders.withColumn("line_name", tx.strip("name")).filter(F.col("line_name") != "")
    sides = named.select("doc_ord", "line_name", F.posexplode("Folder").alias("side_ord", "side")).withColumn(
        "direction", F.lower(F.when(tx.strip("side.name").isin("IDA", "VOLTA"), tx.strip("side.name")))
    ).filter("direction is not null")
    marks = sides.select("doc_ord", "line_name", "side_ord", "direction", F.posexplode("side.Placemark").alias("mark_ord", "pm"))
    texts = marks.select(
        "doc_ord", "line_name", "side_ord", "direction", "mark_ord", F.posexplode(_line_texts("pm")).alias("part", "ls")
    ).filter(F.coalesce(F.length("ls.coordinates"), F.lit(0)) > 0)
    points = values.parse_coordinates("ls.coordinates", strict=strict)
    out = texts.select("line_name", "direction", "doc_ord", "side_ord", "mark_ord", "part", points.alias("points")).filter(F.size("points") > 0)
    return out.withColumn("points", values.checked_points(F.col("points"), F.col("line_name"))) if strict else out


def read_direction_folders(spark: SparkSession, path: str, dialect: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """SC9: IDA/VOLTA folder -> placemarks with a line code, as path rows.

    With ``dialect`` and ``allowed`` the code comes from that dialect and is limited to the list.
    """
    folders = _ordered(_read(spark, path, "Folder", _FLAT_FOLDER)).withColumn("side", F.upper(tx.strip("name")))
    marks = folders.filter(F.col("side").isin("IDA", "VOLTA")).select(
        F.lower("side").alias("direction"), "doc_ord", F.posexplode("Placemark").alias("mark_ord", "pm")
    )
    code = codes.line_code("line_name") if dialect is None else codes.code_dialect("line_name", dialect)
    named = marks.withColumn("line_name", tx.strip(F.coalesce("pm.name", F.lit("")))).filter(F.col("line_name") != "")
    coded = named.withColumn("line_code", code).filter(F.coalesce(F.col("line_code"), F.lit("")) != "")
    if allowed is not None:
        coded = coded.filter(F.col("line_code").isin(allowed))
    text = F.get(F.transform(_line_texts("pm"), lambda s: s["coordinates"]), 0)
    return coded.select(
        "line_code", "line_name", "direction", F.struct("doc_ord", "mark_ord").alias("ord"), values.parse_coordinates(text).alias("points")
    ).filter(F.size("points") > 0)


def explode_points(paths: DataFrame, keys: list[str]) -> DataFrame:
    """One row per vertex of a path table."""
    return paths.select(*keys, F.posexplode("points").alias("seq", "p")).select(*keys, "seq", "p.lat", "p.lon")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """SC10: point placemarks with name and range-checked coordinates."""
    marks = _ordered(_read(spark, path, "Placemark", _MARK_COLUMNS))
    marks = marks.filter(F.coalesce(F.length("Point.coordinates"), F.lit(0)) > 0)
    points = values.checked_points(values.parse_coordinates("Point.coordinates", strict=True), F.coalesce("name", F.lit("")))
    return marks.select("doc_ord", tx.strip(F.coalesce("name", F.lit(""))).alias("name"), F.get(points, 0).alias("p")).select(
        "doc_ord", "name", "p.lat", "p.lon"
    )


def read_terminal_folder(spark: SparkSession, path: str) -> DataFrame:
    """SC11: points of the 'terminal' folder, seven decimals, sorted by name."""
    folders = _read(spark, path, "Folder", _FLAT_FOLDER).filter(F.lower(tx.strip("name")) == "terminal")
    marks = folders.select(F.explode("Placemark").alias("pm")).filter("pm.Point.coordinates is not null")
    point = F.get(values.parse_coordinates("pm.Point.coordinates"), 0)
    return marks.select(tx.strip(F.coalesce("pm.name", F.lit(""))).alias("name"), point.alias("p")).filter("p is not null").select(
        "name", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon")
    ).orderBy("name")


def read_zone_folder(spark: SparkSession, path: str) -> DataFrame:
    """SC12: polygons of the 'ZONAS' folder as closed rings, in document order."""
    folders = _ordered(_read(spark, path, "Folder", _FLAT_FOLDER)).filter(F.col("name") == "ZONAS")
    marks = folders.select("doc_ord", F.posexplode("Placemark").alias("zone_ord", "pm"))
    outer = F.get(F.col("pm.Polygon"), 0)["outerBoundaryIs"]["LinearRing"]["coordinates"]
    points = F.transform(values.parse_coordinates(outer), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return marks.select("doc_ord", "zone_ord", F.col("pm.name").alias("zone_name"), values.close_ring(points).alias("ring"))


def read_all_lines(spark: SparkSession, path: str) -> DataFrame:
    """SC13: every line string at any depth."""
    marks = _ordered(_read(spark, path, "Placemark", _MARK_COLUMNS))
    texts = marks.select("doc_ord", tx.strip("name").alias("name"), F.posexplode(_line_texts_flat()).alias("part", "ls"))
    return texts.select("doc_ord", "name", "part", values.parse_coordinates("ls.coordinates").alias("points")).filter(F.size("points") > 0)


def _line_texts_flat() -> Column:
    none = F.array().cast("array<struct<coordinates:string>>")
    return F.concat(F.coalesce("LineString", none), F.coalesce("MultiGeometry.LineString", none))


def geometry_census(spark: SparkSession, path: str) -> DataFrame:
    """SC13: placemarks per geometry type with the code of their name."""
    kind = (
        F.when(F.col("LineString").isNotNull() | F.col("MultiGeometry.LineString").isNotNull(), "LineString")
        .when(F.col("MultiGeometry").isNotNull(), "MultiGeometry").when(F.col("Point").isNotNull(), "Point").otherwise("Outro")
    )
    return _read(spark, path, "Placemark", _MARK_COLUMNS).groupBy(kind.alias("geometry")).agg(F.count(F.lit(1)).alias("placemarks"))
