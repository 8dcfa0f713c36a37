"""Sinks (SK1-SK10).

Large single documents (GeoJSON, KML) are written as ordered text fragments: rows are range-partitioned
by position, so the part files read in name order form one valid document and no task holds it whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitframe import rules
from transitframe.functions import codes
from transitframe.operators.ordered import carry_forward, global_ordinal, neighbour
from transitframe.session import store


def _write_texts(fragments: DataFrame, keys: list[str], path: str) -> None:
    """Fragments of many documents, each document in order within one part file and ended by its own line end.

    Rows stream through the sort to the file; fragments are set apart by a blank, which JSON ignores.
    """
    ordered = fragments.repartition(*keys).sortWithinPartitions(*keys, "place", "seq")
    ordered.select("fragment").write.mode("errorifexists").option("lineSep", " ").text(path)


def write_line_documents(fragments: DataFrame, path: str) -> None:
    """SK1: the published documents, one JSON text a line; ``fragments`` from ``publish.line_documents``."""
    _write_texts(fragments, ["line_id"], path)


def write_summary(summary: DataFrame, path: str) -> None:
    """SK2: line summaries sorted by name across the part files."""
    summary.repartitionByRange("line_name").sortWithinPartitions("line_name").write.mode("errorifexists").json(path)


def write_street_index(index: DataFrame, path: str) -> None:
    """SK3: inverted index clustered by street key, so lookups read few row groups."""
    index.repartitionByRange("norm_street", "occ_ord").sortWithinPartitions("norm_street", "occ_ord").write.mode("errorifexists").parquet(path)


def write_timetable(departures: DataFrame, path: str) -> None:
    """SK4: departures keyed by line id."""
    departures.write.mode("errorifexists").partitionBy("day_type").parquet(path)


def write_feature_lines(fragments: DataFrame, path: str) -> None:
    """SK5: one GeoJSON Feature a line; ``fragments`` from ``lookup.geojson_features``."""
    _write_texts(fragments, ["line_id", "line_name", "direction"], path)


def _escape(value: Column) -> Column:
    text = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return text


def _fragments(points: DataFrame, keys: list[str], order: list[str], head: Column, vertex: Column, tail: Column, glue: str) -> DataFrame:
    """Vertices as text: the first of a path carries its opening, the last its closing."""
    linked = neighbour(points.withColumn("_one", F.lit(1)), keys, {"_one": "_more"})
    text = F.concat(
        F.when(F.col("seq") == 0, head).otherwise(F.lit(glue)), vertex, F.when(F.col("_more").isNull(), tail).otherwise(F.lit(""))
    )
    return linked.select(*order, text.alias("fragment"))


def geojson_fragments(points: DataFrame) -> DataFrame:
    """SK5: a FeatureCollection as fragments ordered by (line_name, line_id, direction, seq).

    ``points(line_id, line_name, direction, seq, lat, lon)`` with dense ``seq`` from 0.
    """
    keys = ["line_name", "line_id", "direction"]
    first = points.agg(F.min(F.struct(*keys)).alias("k")).first()["k"]  # one row
    properties = F.to_json(F.struct(
        F.col("line_id").alias("linha_id"), F.col("line_name").alias("linha_nome"), F.col("direction").alias("sentido")
    ))
    head = F.concat(
        F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"LineString","coordinates":[')
    )
    vertex = F.concat(F.lit("["), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    body = _fragments(points, keys, [*keys, "seq"], head, vertex, F.lit("]}}"), ",")
    opens_later = (F.col("seq") == 0) if first is None else (F.col("seq") == 0) & ~(
        (F.col("line_name") == first["line_name"]) & (F.col("line_id") == first["line_id"]) & (F.col("direction") == first["direction"])
    )
    marked = body.withColumn("fragment", F.when(opens_later, F.concat(F.lit(",\n"), "fragment")).otherwise(F.col("fragment")))
    spark = points.sparkSession
    opening = spark.createDataFrame([("", "", "", -1, '{"type":"FeatureCollection","features":[\n')], "line_name string, line_id string, direction string, seq long, fragment string")
    closing = spark.createDataFrame([("\U0010ffff", "", "", 0, "\n]}\n")], opening.schema)
    return opening.unionByName(marked.withColumn("seq", F.col("seq").cast("long"))).unionByName(closing)


def write_fragments(fragments: DataFrame, order: list[str], path: str) -> None:
    """Write ordered fragments as plain text; concatenated part files are the document."""
    ordered = fragments.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("fragment").write.mode("errorifexists").text(path)


def read_fragments(spark: SparkSession, path: str, out: str = "ordinal") -> DataFrame:
    """The fragments of a written document with their place in it: part files in name order, lines in file order."""
    line = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")
    )
    return global_ordinal(line, ["_file", "_block", "_line"], out).select(out, "value")


def kml_rows(fragments: DataFrame) -> DataFrame:
    """Content of a KML document read by ``read_fragments``: (ordinal, folder, name, lat, lon, n_points), one row per vertex of
    a path, per point and per polygon (its number of corners, no place), each with the folder and name carried to it."""
    value = F.col("value")
    folder = F.regexp_extract_all(value, F.lit("<Folder><name>([^<]*)</name>"))
    # a title stands in the opening line too, so names are those of placemarks
    name = F.regexp_extract(value, "<Placemark><name>([^<]*)</name>", 1)
    plain = F.replace(F.replace(F.replace(name, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    carried = carry_forward(fragments, [], ["ordinal"], {
        "folder": F.when(F.size(folder) > 0, F.element_at(folder, -1)), "name": F.when(value.contains("<Placemark>"), plain),
    })
    number = r"(-?[0-9][0-9.eE+-]*)"
    pairs = F.regexp_extract_all(value, F.lit(rf"{number},{number},0\b"), F.lit(0))
    polygon = value.contains("<Polygon>")
    place = lambda i: F.when(~polygon, F.get(F.split(F.get(pairs, 0), ","), i).cast("double"))
    found = carried.withColumns({"n_points": F.size(pairs), "lon": place(0), "lat": place(1)})
    return found.filter("n_points > 0").select("ordinal", "folder", "name", "lat", "lon", "n_points")


def _style(style_id: str, colour: str, size: float, kind: str) -> str:
    if kind == "point":
        return f'<Style id="{style_id}"><IconStyle><color>{colour}</color><scale>{size}</scale></IconStyle></Style>'
    return f'<Style id="{style_id}"><LineStyle><color>{colour}</color><width>{size}</width></LineStyle></Style>'


def kml_fragments(points: DataFrame, stops: DataFrame | None = None, title: str = "Mapa", zones: DataFrame | None = None) -> DataFrame:
    """SK6/SK7: KML with one folder per direction, placemarks in line order (SO2), optional folders of points and zones.

    ``points(line_id, line_name, direction, seq, lat, lon)``; ``stops(name, lat, lon)``, ``zones(zone_ord, zone_name, ring)``. Fragments are ordered
    by (folder, sort_number, sort_suffix, line_name, line_id, seq); styles come from the direction.
    """
    order = ["folder", "sort_number", "sort_suffix", "line_name", "line_id", "seq"]
    key = codes.night_aware_sort("line_name")
    placed = points.withColumns({
        "folder": F.when(F.col("direction") == "ida", 1).otherwise(3), "sort_number": key["number"].cast("long"), "sort_suffix": key["suffix_rank"],
    })
    style = F.when(F.col("direction") == "ida", rules.MAP_STYLES["ida"][0]).otherwise(rules.MAP_STYLES["volta"][0])
    head = F.concat(
        F.lit("<Placemark><name>"), _escape(F.col("line_name")), F.lit("</name><styleUrl>#"), style,
        F.lit("</styleUrl><LineString><tessellate>1</tessellate><coordinates>"),
    )
    vertex = F.concat(F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",0"))
    keys = ["folder", "sort_number", "sort_suffix", "line_name", "line_id", "direction"]
    body = _fragments(placed, keys, order, head, vertex, F.lit("</coordinates></LineString></Placemark>\n"), " ")
    styles = "".join(_style(*rules.MAP_STYLES[k], kind="line") for k in ("ida", "volta")) + _style(*rules.MAP_STYLES["points"], kind="point")
    frame = [
        (0, '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>' + title
         + f"</name>{styles}<Folder><name>IDA</name>\n"),
        (2, "</Folder><Folder><name>VOLTA</name>\n"), (4, "</Folder>\n"), (9, "</Document></kml>\n"),
    ]
    spark = points.sparkSession
    schema = "folder int, sort_number long, sort_suffix int, line_name string, line_id string, seq long, fragment string"
    parts = spark.createDataFrame([(f, 0, 0, "", "", 0, text) for f, text in frame], schema).unionByName(
        body.withColumn("seq", F.col("seq").cast("long"))
    )
    if stops is not None:
        mark = F.concat(
            F.lit("<Placemark><name>"), _escape(F.col("name")), F.lit(f"</name><styleUrl>#{rules.MAP_STYLES['points'][0]}</styleUrl><Point><coordinates>"),
            F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",0</coordinates></Point></Placemark>\n"),
        )
        rows = stops.select(
            F.lit(6).alias("folder"), F.lit(0).cast("long").alias("sort_number"), F.lit(0).alias("sort_suffix"),
            F.col("name").alias("line_name"), F.lit("").alias("line_id"), F.lit(0).cast("long").alias("seq"), mark.alias("fragment"),
        )
        frame = [(5, 0, 0, "", "", 0, "<Folder><name>PONTOS</name>\n"), (7, 0, 0, "", "", 0, "</Folder>\n")]
        parts = parts.unionByName(rows).unionByName(spark.createDataFrame(frame, schema))
    if zones is not None:
        rows = zone_placemarks(zones).select(
            F.lit(8).alias("folder"), F.col("zone_ord").cast("long").alias("sort_number"), F.lit(0).alias("sort_suffix"),
            F.col("zone_name").alias("line_name"), F.lit("").alias("line_id"), F.lit(0).cast("long").alias("seq"), "fragment",
        )
        frame = [(8, -(1 << 62), 0, "", "", 0, "<Folder><name>ZONAS</name>\n"), (8, 1 << 62, 0, "", "", 0, "</Folder>\n")]
        parts = parts.unionByName(rows).unionByName(spark.createDataFrame(frame, schema))
    return parts


def zone_placemarks(zones: DataFrame) -> DataFrame:
    """SK6: polygon placemark per zone; one zone ring is a short list."""
    ring = F.array_join(F.transform("ring", lambda p: F.concat(p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(",0"))), " ")
    _, colour, width = rules.MAP_STYLES["zones"]
    text = F.concat(
        F.lit("<Placemark><name>"), _escape(F.col("zone_name")),
        F.lit(f"</name><Style><LineStyle><color>{colour}</color><width>{width}</width></LineStyle><PolyStyle><color>{rules.ZONE_FILL}</color></PolyStyle></Style>"
              "<Polygon><tessellate>1</tessellate><outerBoundaryIs><LinearRing><coordinates>"),
        ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>\n"),
    )
    return zones.select("zone_ord", "zone_name", text.alias("fragment"))


def write_workbooks(sheets: DataFrame, path: str) -> None:
    """SK8: stops as CSV, a folder per company; rows in order of sheet name (from ``numbering.unique_sheet_names``) and position
    across its files, so that a company or sheet of any size is written by many tasks and small sheets share files."""
    order = ["company", "sheet", "position"]
    ordered = sheets.select("sheet", "position", *[c for c in sheets.columns if c not in ("sheet", "position")])
    written = ordered.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("company")
    # a cut name may end in a blank
    written.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def publish_version(df: DataFrame, root: str, version: str) -> str:
    """SK9: write a new version folder, then move the CURRENT pointer to it. Older versions stay as backups,
    and the version being read is never overwritten."""
    target = f"{root}/{version}"
    df.write.mode("errorifexists").parquet(target)
    spark = df.sparkSession
    pointer = spark.createDataFrame([(json.dumps({"version": version}),)], "value string")
    pointer.coalesce(1).write.mode("overwrite").text(f"{root}/CURRENT")
    return target


def read_current(spark, root: str) -> DataFrame:
    """SK9: read the published version."""
    pointer = json.loads(spark.read.text(f"{root}/CURRENT").first()["value"])
    return spark.read.parquet(f"{root}/{pointer['version']}")


def _digests(table: DataFrame) -> DataFrame:
    """(line_id, rows, digest) of a table: equal for equal rows in any order; combined before the shuffle."""
    columns = [F.col(c) for c in sorted(table.columns)]
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    mixed = F.bit_xor(F.xxhash64(F.lit("x"), *columns)).cast("string")
    return table.groupBy(F.col("line_id").cast("string").alias("line_id")).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", total, mixed).alias("digest"))


def _read_manifest(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.schema("line_id string, rows long, digest string, part string, version string").parquet(f"{root}/manifest/{version}")


def _manifest(spark: SparkSession, root: str) -> DataFrame | None:
    pointer = current_version(spark, root)
    return None if pointer is None else _read_manifest(spark, root, pointer)


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version that ``root`` points to, None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return json.loads(spark.read.text(f"{root}/CURRENT").first()["value"])["version"]


def publish_tables(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """MG8/SK9: several tables keyed by ``line_id`` published together as one version.

    The manifest names, for every table and line, the version that holds its rows. A line whose digest equals the published
    one keeps its entry and is not written again; a line that is gone loses its entry. The pointer moves last, so readers see
    all tables of one version, and an attempt that failed half-way is never seen. A null ``line_id`` counts as one line.
    """
    spark = next(iter(tables.values())).sparkSession
    before = _manifest(spark, root)
    folder = lambda name: f"{root}/{name}/version={version}"
    stored = {}
    for name, table in tables.items():  # read for the digests and, unless all lines are new, again for the rows
        if before is None:
            table.write.mode("errorifexists").parquet(folder(name))
        stored[name] = store(table) if before is not None else spark.read.parquet(folder(name))
    entries = None
    for name, table in stored.items():
        own = _digests(table).withColumn("part", F.lit(name))
        entries = own if entries is None else entries.unionByName(own)
    if before is None:
        entries = entries.withColumn("version", F.lit(version))
    else:
        old = before.select(F.col("part").alias("_part"), F.col("line_id").alias("_line"), F.col("digest").alias("_digest"), F.col("version").alias("_version"), F.col("rows").alias("_rows"))
        same = (F.col("part") == F.col("_part")) & F.col("line_id").eqNullSafe(F.col("_line")) & (F.col("digest") == F.col("_digest")) & (F.col("rows") == F.col("_rows"))
        entries = entries.join(old, same, "left").withColumn("version", F.coalesce("_version", F.lit(version))).select("part", "line_id", "rows", "digest", "version")
    # a folder per part and version, so that the size of a list of lines is known before it is joined
    entries.write.mode("errorifexists").partitionBy("part", "version").parquet(f"{root}/manifest/{version}")
    if before is not None:
        for name, table in stored.items():
            changed = table.join(_lines_of(spark, root, version, name, version), F.col("line_id").eqNullSafe(F.col("_line")), "left_semi")
            changed.write.mode("errorifexists").parquet(folder(name))
    pointer = spark.createDataFrame([(json.dumps({"version": version}),)], "value string")
    pointer.coalesce(1).write.mode("overwrite").text(f"{root}/CURRENT")


def _lines_of(spark: SparkSession, root: str, manifest: str, name: str, version: str) -> DataFrame:
    """The lines of a table that a manifest places in a version, as ``_line``."""
    entries = _read_manifest(spark, root, manifest)
    return entries.filter((F.col("part") == name) & (F.col("version") == version)).select(F.col("line_id").alias("_line"))


def read_published(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of ``publish_tables`` as of a version (the current one by default): the rows the manifest points to.

    Of each version's rows those are left out whose line has moved on since; the others are read as they lie."""
    version = version or current_version(spark, root)
    held = [r["version"] for r in _read_manifest(spark, root, version).filter(F.col("part") == name).select("version").distinct().collect()]
    out = None
    for one in sorted(held) or [version]:
        rows = spark.read.parquet(f"{root}/{name}/version={one}")
        if one != version:
            mine = _lines_of(spark, root, version, name, one).withColumnRenamed("_line", "_held")
            left = store(_lines_of(spark, root, one, name, one).join(mine, F.col("_line").eqNullSafe(F.col("_held")), "left_anti"))
            if not left.isEmpty():
                rows = rows.join(left, F.col("line_id").eqNullSafe(F.col("_line")), "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out


def report_rows(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """SK10: fixed-width text rows of a report table."""
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items()]
    return df.select(F.rtrim(F.concat_ws("  ", *cells)).alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    """SK10: tab-separated report."""
    df.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)
