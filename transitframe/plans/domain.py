"""Route tables derived from the star-schema test tables (see TESTDATA.md).

Pure DataFrame derivations: the route tables grow with the input tables. ``oracles.py`` holds the same
derivations as SQL for the correctness check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitframe.functions import codes, values
from transitframe.operators.ordered import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# codes have four digits and a letter: the series of keys from 10,000 on, without the letters of the first series
SERIES = "BCDEFGHIJKLNOPQRSTUVWXYZ"


def _series(key: Column) -> Column:
    return F.substring(F.lit(SERIES), ((F.floor(key / 10000) - 1) % len(SERIES) + 1).cast("int"), F.lit(1))


def _number(key: Column) -> Column:
    return F.lpad((key % 10000).cast("string"), 4, "0")


def _code_head(key: Column) -> Column:
    number = _number(key)
    return (
        F.when(key >= 10000, F.concat(number, F.lit(" "), _series(key)))
        .when(key % 10 == 3, F.concat(number, F.lit(" A")))
        .when(key % 11 == 5, F.concat(F.lit("M"), codes.zero_padded(key, 3)))
        .otherwise(number)
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """line_key, line_name, line_id, line_code, ord - one line per customer."""
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("c_custkey")
    tail = (
        F.when(key % 13 == 0, F.lit(" (DESATIVADO)")).when(key % 4 == 0, F.lit(" (Via Norte)")).otherwise(F.lit(""))
    )
    # codes repeat from 250,000 lines on; those are told apart by name, so names stay one-to-one with keys
    series = F.when(key >= 250_000, F.concat(F.lit(" SERIE "), F.floor((key - 10_000) / 240_000).cast("string"))).otherwise(F.lit(""))
    named = (
        table(spark, sf, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("line_key"),
            F.concat(
                _code_head(key), F.lit(" - "), F.col("r_name"), F.lit(" / "), F.replace("n_name", F.lit("_"), F.lit(" ")),
                series, tail,
            ).alias("line_name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("region"),
        )
    )
    return named.withColumns(
        {"line_id": codes.line_id("line_name"), "line_code": codes.line_code("line_name"), "ord": F.col("line_key")}
    )


def raw_points(spark: SparkSession, sf: str) -> DataFrame:
    """line_key, direction, event_id, ts, lat, lon without sequence numbers."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("line_key"),
        F.when(F.col("event_id") % 2 == 0, "ida").otherwise("volta").alias("direction"),
        "event_id",
        "ts",
        (F.lit(-9.5) - (F.col("value") % 100) / 1000).alias("lat"),
        (F.lit(-35.7) - (F.col("event_id") % 997) / 9970).alias("lon"),
    )


def route_points(spark: SparkSession, sf: str) -> DataFrame:
    """line_key, direction, seq (from 0), lat, lon."""
    return number_rows(
        raw_points(spark, sf), ["line_key", "direction"], ["ts", "event_id"], F.to_date("ts"), start=0
    ).select("line_key", "direction", "seq", "lat", "lon")


PREFIX_SHORT = ["AV.", "R.", "TRAV.", "PÇA.", "LAD."]
PREFIX_FULL = ["AVENIDA", "RUA", "TRAVESSA", "PRAÇA", "LADEIRA"]


def _pick(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index % len(options) + 1).cast("int"))


def streets(spark: SparkSession, sf: str) -> DataFrame:
    """Per part: the street as written on itineraries, as written by hand, its code and match tag."""
    part = F.col("p_partkey")
    accented = F.when(part % 5 == 0, F.translate("p_name", "aeo", "áêõ")).otherwise(F.col("p_name"))
    brand = F.when(part % 4 == 0, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise(F.lit(""))
    return table(spark, sf, "part").select(
        part.alias("part_key"),
        F.concat(_pick(PREFIX_SHORT, F.col("p_size")), F.lit(" "), "p_type", F.lit(" "), accented, brand).alias("street"),
        F.concat(_pick(PREFIX_FULL, F.col("p_size")), F.lit(" "), "p_type", F.lit(" "), F.upper("p_name")).alias("manual_street"),
        F.when(part % 7 != 0, codes.zero_padded(part, 5)).alias("street_code"),
        F.when(part % 7 == 0, "nao_encontrado")
        .when(part % 11 == 0, "fuzzy")
        .when(part % 3 == 0, "exato_global")
        .otherwise("exato")
        .alias("match"),
    )


def itinerary(spark: SparkSession, sf: str) -> DataFrame:
    """line_key, direction, seq (from 0), street, street_code, match, manual_street, part_key."""
    items = (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("line_key"),
            F.when(F.col("l_linenumber") % 2 == 1, "ida").otherwise("volta").alias("direction"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )
    )
    numbered = number_rows(
        items, ["line_key", "direction"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        F.floor(F.col("l_orderkey") / 100_000), start=0,
    )
    return numbered.join(streets(spark, sf), F.col("l_partkey") == F.col("part_key")).select(
        "line_key", "direction", "seq", "street", "street_code", "match", "manual_street", "part_key", "l_linenumber"
    )


def with_line(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Attach line_id, line_name, line_code and ord by line_key."""
    return df.join(lines(spark, sf).select("line_key", "line_id", "line_name", "line_code", "ord"), "line_key")


def named_itinerary(spark: SparkSession, sf: str) -> DataFrame:
    return with_line(itinerary(spark, sf), spark, sf)


def named_points(spark: SparkSession, sf: str) -> DataFrame:
    return with_line(route_points(spark, sf), spark, sf)


def manual_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-made itineraries of every line and street; three lines in four have another spelling."""
    return _hand_made(named_itinerary(spark, sf))


def manual_itinerary(spark: SparkSession, sf: str) -> DataFrame:
    """``manual_copy`` with the gaps that reconciling and merging are about: fewer lines, fewer streets in some."""
    source = named_itinerary(spark, sf).filter(F.col("line_key") % 9 != 0)
    return _hand_made(source.filter((F.col("line_key") % 4 == 1) | (F.col("l_linenumber") <= 5)))


def _hand_made(source: DataFrame) -> DataFrame:
    same = F.col("line_key") % 4 == 1
    return source.select(
        "line_key", "line_name", "line_code", "direction", "seq",
        F.when(same, F.col("street")).otherwise(F.col("manual_street")).alias("street"),
    )


def timetable(spark: SparkSession, sf: str) -> DataFrame:
    """line_code (four digits, from 10,000 lines on with the series), day_type, direction, hhmm, minute_of_day; one row per departure."""
    day, key = F.dayofweek("ts"), F.col("user_id")
    return table(spark, sf, "events").select(
        F.concat(_number(key), F.when(key >= 10000, _series(key)).otherwise("")).alias("line_code"),
        F.when(day == 1, "domingo").when(day == 7, "sabado").otherwise("dia_util").alias("day_type"),
        F.when(F.col("event_id") % 2 == 0, "ida").otherwise("volta").alias("direction"),
        F.date_format("ts", "HH:mm").alias("hhmm"),
        "event_id",
    ).withColumn("minute_of_day", values.minutes("hhmm"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """street_code, street (spelled out), street_original, ord."""
    part = F.col("part_key")
    return streets(spark, sf).select(
        codes.zero_padded(part, 5).alias("street_code"),
        F.col("manual_street").alias("street"),
        F.col("street").alias("street_original"),
        part.alias("ord"),
    )


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """zone_ord, zone_name, ring: one hexagon per nation, closed."""
    key = F.col("n_nationkey")
    lat0 = F.lit(-9.5) - (F.lit(0.01) + F.lit(0.02) * (key % 5))
    lon0 = F.lit(-35.7) - (F.lit(0.01) + F.lit(0.02) * F.floor(key / 5))
    corners = [(0.012, 0.0), (0.006, 0.0104), (-0.006, 0.0104), (-0.012, 0.0), (-0.006, -0.0104), (0.006, -0.0104), (0.012, 0.0)]
    ring = F.array(*[F.struct((lon0 + F.lit(dx)).alias("lon"), (lat0 + F.lit(dy)).alias("lat")) for dx, dy in corners])
    return table(spark, sf, "nation").select(key.cast("int").alias("zone_ord"), F.col("n_name").alias("zone_name"), ring.alias("ring"))


def terminals(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"),
        F.round(F.lit(-9.5) - (key * 7 % 1000) / 10000, 7).alias("lat"),
        F.round(F.lit(-35.7) - (key * 13 % 1000) / 10000, 7).alias("lon"),
    )


def stops(spark: SparkSession, sf: str) -> DataFrame:
    """line_key, position, stop_name, lat, lon; some coordinates missing or zero."""
    e = F.col("event_id")
    return (
        raw_points(spark, sf)
        .select(
            "line_key",
            e.alias("position"),
            F.concat(F.lit("PONTO "), e.cast("string")).alias("stop_name"),
            F.when(e % 10 == 0, None).when(e % 14 == 0, F.lit(0.0)).otherwise(F.col("lat")).alias("lat"),
            F.col("lon"),
        )
    )


SEGMENT_SERVICE = {
    "AUTOMOBILE": "CONVENCIONAL", "BUILDING": "INTEGRAÇÃO", "FURNITURE": "CATRACA DE", "HOUSEHOLD": "MADRUGADÃO",
    "MACHINERY": "LINHA CIDADÃ",
}


def active_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Official list: code spelled with hyphens, service type, company."""
    key = F.col("line_key")
    number = _number(key)
    code = (
        F.when(key >= 10000, F.concat(number, F.lit("-"), _series(key)))
        .when(key % 11 == 5, F.concat(number, F.lit("-M")))
        .when(key % 10 == 3, F.concat(number, F.lit("-A")))
        .otherwise(number)
    )
    service = codes.service_type(F.element_at(codes._literal_map(SEGMENT_SERVICE), F.col("segment")))
    return (
        lines(spark, sf)
        .select(
            code.alias("code"), F.upper("line_name").alias("name"), service.alias("service"),
            F.concat(F.lit("EMPRESA "), "region").alias("company"), "line_key", key.alias("ord"),
        )
    )


def neighbourhood_streets(spark: SparkSession, sf: str) -> DataFrame:
    """neighbourhood, street: streets served in a supplier's nation, with repeats and blank-padded names."""
    places = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("n_nationkey") % 3 == 0, F.translate("n_name", "AO", "ÁÕ")).otherwise(F.col("n_name"))
    return (
        table(spark, sf, "lineitem")
        .select("l_partkey", "l_suppkey", "l_orderkey")
        .join(places.select("s_suppkey", name.alias("neighbourhood")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(streets(spark, sf), F.col("l_partkey") == F.col("part_key"))
        .select(
            "neighbourhood",
            F.when(F.col("l_orderkey") % 6 == 0, F.concat(F.lit(" "), F.col("manual_street"), F.lit(" ")))
            .when(F.col("l_orderkey") % 6 == 1, F.col("street"))
            .otherwise(F.col("manual_street"))
            .alias("street"),
        )
    )


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """id, name: '00044 RUA X' or 'REVISAR: X' entries."""
    part = F.col("part_key")
    return streets(spark, sf).select(
        part.alias("id"),
        F.when(part % 10 == 9, F.concat(F.lit("REVISAR: "), "manual_street"))
        .when(part % 10 == 8, F.concat(codes.zero_padded(part, 5), F.lit(" "), "manual_street", F.lit(" 0000")))
        .otherwise(F.concat(codes.zero_padded(part, 5), F.lit(" "), "manual_street"))
        .alias("name"),
    )


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, line_no, text: the lines of the free-text documents."""
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    )
