"""Aggregations over route tables (AG*). Results stay flat: one row per member, never one growing array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitframe.functions import codes
from transitframe.functions import text as tx
from transitframe.functions import values
from transitframe.rules import DAY_TYPES


def _position() -> Column:
    return F.struct("ord", F.when(F.col("direction") == "ida", 0).otherwise(1).alias("d"), "seq")


def distinct_streets(itinerary: DataFrame) -> DataFrame:
    """AG2: one row per comparison key: first spelling, first code, first match, occurrences.

    Rows are combined per raw spelling first, so the key is computed once per spelling and a popular
    street never travels whole.
    """
    coded = F.when(F.length("street_code") > 0, F.col("_p"))
    per_spelling = (
        itinerary.withColumn("_p", _position())
        .groupBy("street")
        .agg(
            F.min("_p").alias("_p"),
            F.min_by("match", "_p").alias("match"),
            F.min_by("street_code", coded).alias("street_code"),
            F.min(coded).alias("_coded"),
            F.count(F.lit(1)).alias("occurrences"),
        )
        .withColumn("street", tx.strip("street"))
        .filter(F.col("street") != "")
        .withColumn("key", tx.norm_key("street"))
    )
    return per_spelling.groupBy("key").agg(
        F.min_by("street", "_p").alias("street"),
        F.min_by("street_code", "_coded").alias("street_code"),
        F.min_by("match", "_p").alias("match"),
        F.sum("occurrences").alias("occurrences"),
        F.min("_p").alias("first_seen"),
    )


def street_usages(itinerary: DataFrame) -> DataFrame:
    """AG2: where each key is used, one row per (key, line, direction)."""
    return itinerary.select(tx.norm_key("street").alias("key"), "line_name", "direction").groupBy(
        "key", "line_name", "direction"
    ).agg(F.count(F.lit(1)).alias("times"))


def street_codes(itinerary: DataFrame) -> DataFrame:
    """AG3: code per exact spelling, the first non-null one."""
    named = itinerary.withColumn("street", tx.strip("street")).filter(F.col("street") != "").withColumn("_p", _position())
    return named.groupBy("street").agg(
        F.min_by("street_code", F.when(F.col("street_code").isNotNull(), F.col("_p"))).alias("street_code")
    )


def match_mix(itinerary: DataFrame) -> DataFrame:
    """AG4: occurrences and percent per match type."""
    counts = itinerary.groupBy("match").agg(F.count(F.lit(1)).alias("occurrences"))
    total = Window.partitionBy()  # over a handful of match types
    return counts.withColumn("percent", F.round(F.col("occurrences") * 100.0 / F.sum("occurrences").over(total), 4))


def match_statistics(itinerary: DataFrame) -> DataFrame:
    """AG5: total, matched and unmatched with percent."""
    missing = F.sum(F.when(F.col("match") == "nao_encontrado", 1).otherwise(0))
    total = F.count(F.lit(1))
    return itinerary.agg(total.alias("total"), (total - missing).alias("matched"), missing.alias("unmatched")).withColumn(
        "matched_percent", F.when(F.col("total") > 0, F.round(F.col("matched") * 100.0 / F.col("total"), 4))
    )


def spellings_per_code(itinerary: DataFrame) -> DataFrame:
    """AG7: distinct (code, spelling) with the number of spellings of the code, only codes with several."""
    distinct = itinerary.filter(F.col("street_code").isNotNull()).select("street_code", "street").distinct()
    several = distinct.groupBy("street_code").agg(F.count(F.lit(1)).alias("n_spellings")).filter("n_spellings > 1")
    return distinct.join(several, "street_code")


def lines_per_street(itinerary: DataFrame) -> DataFrame:
    """AG8: distinct lines (code part of the name) using each exact street."""
    return itinerary.select(
        tx.strip("street").alias("street"), tx.strip(F.get(F.split("line_name", " - "), 0)).alias("line")
    ).filter(F.col("street") != "").distinct()


def review_totals(listed: DataFrame) -> DataFrame:
    """AG9: streets, duplicate-code streets and streets without code per neighbourhood, and overall."""
    several = listed.filter(F.col("street_code").isNotNull()).groupBy("street_code").agg(
        F.count_distinct("street").alias("n")
    ).filter("n > 1").select("street_code", F.lit(1).alias("dup"))
    return (
        listed.join(several, "street_code", "left")
        .rollup("neighbourhood")
        .agg(
            F.grouping("neighbourhood").alias("is_total"),
            F.count(F.lit(1)).alias("streets"),
            F.sum(F.coalesce("dup", F.lit(0))).alias("duplicates"),
            F.sum(F.when(F.col("street_code").isNull(), 1).otherwise(0)).alias("without_code"),
        )
    )


def neighbourhood_counts(listed: DataFrame, top: int = 10) -> DataFrame:
    """AG10: streets per neighbourhood, the largest first."""
    return listed.groupBy("neighbourhood").agg(F.count(F.lit(1)).alias("streets")).orderBy(
        F.desc("streets"), "neighbourhood"
    ).limit(top)


def service_cube(active: DataFrame) -> DataFrame:
    """AG11: lines by company and service with subtotals and the grand total."""
    return active.cube("company", "service").agg(
        F.count(F.lit(1)).alias("lines"), F.grouping_id().alias("level")
    )


def occurrences(itinerary: DataFrame) -> DataFrame:
    """AG12: occurrences per exact spelling with its comparison key."""
    return itinerary.filter(F.col("street") != "").groupBy("street").agg(F.count(F.lit(1)).alias("occurrences")).withColumn(
        "key", tx.norm_key("street")
    )


def spelling_difference(rows: DataFrame, keys: list[str]) -> DataFrame:
    """F16: how the spellings of one code differ, from three aggregates; ``rows(*keys, street)``.

    Texts all begin with the shortest one exactly if the least and the greatest text do.
    """
    norm = tx.norm_blank_punct(F.col("street"), squeeze=False)
    found = rows.select(*keys, norm.alias("norm")).groupBy(*keys).agg(
        F.min("norm").alias("least"), F.max("norm").alias("greatest"), F.min(F.struct(F.length("norm").alias("size"), F.col("norm").alias("text")))["text"].alias("shortest"))
    kind = (
        F.when(F.col("least") == F.col("greatest"), F.lit("ACENTO"))
        .when(F.startswith("least", "shortest") & F.startswith("greatest", "shortest"), F.lit("COMPLEMENTO"))
        .otherwise(F.lit("NOME DIFERENTE"))
    )
    return found.select(*keys, kind.alias("kind"))


def project_pairs(pairs: DataFrame) -> DataFrame:
    """AG13: fuzzy pairs of the whole project: distinct lines, best score and the spellings that have it, most used first."""
    return (
        pairs.withColumns({"key_m": tx.norm_key("manual"), "key_s": tx.norm_key("system")})
        .groupBy("key_m", "key_s")
        .agg(
            F.count_distinct("line").alias("lines"), F.max(F.round("score", 2)).alias("score"),
            F.min_by(F.struct("manual", "system"), F.struct(-F.col("score"), "manual", "system")).alias("best"),
        )
        .select("key_m", "key_s", "lines", "score", "best.manual", "best.system")
        .orderBy(F.desc("lines"), F.desc("score"), "key_m", "key_s")
    )


def stop_counts(stops: DataFrame, keys: list[str]) -> DataFrame:
    """AG14: stops per line or company."""
    return stops.groupBy(*keys).agg(F.count(F.lit(1)).alias("stops"))


def company_year(figures: DataFrame, extras: DataFrame) -> DataFrame:
    """AG15/M6: per year and metric the company sum, the year-level extra, the total, and the largest company
    value over all years for scaling. ``figures(year, company, metric, base, company_extra)``,
    ``extras(year, metric, extra)``."""
    total = values.with_extra(F.col("base"), F.col("company_extra"))
    per_year = figures.groupBy("year", "metric").agg(F.sum("base").alias("base"), F.max(total).alias("largest"))
    scale = per_year.groupBy("metric").agg(F.max("largest").alias("scale_max"))
    return (
        per_year.join(extras, ["year", "metric"], "left")
        .join(scale, "metric")
        .select(
            "year", "metric", "base", F.coalesce("extra", F.lit(0)).alias("extra"),
            values.with_extra(F.col("base"), F.col("extra")).alias("total"), "scale_max",
        )
    )


def metrics_by_company(figures: DataFrame) -> DataFrame:
    """AG15: passengers, trips and fleet side by side per company and year; ``figures`` as for ``company_year``."""
    total = values.with_extra(F.col("base"), F.col("company_extra"))
    return figures.groupBy("company", "year").pivot("metric", ["passengers", "trips", "fleet"]).agg(F.sum(total))


def departures_per_day(timetable: DataFrame) -> DataFrame:
    """AG16: departures per line and day type."""
    return timetable.groupBy("line_code").pivot("day_type", list(DAY_TYPES)).count().na.fill(0)


def code_totals(registry: DataFrame, declared: DataFrame) -> DataFrame:
    """AG17: extracted rows, distinct codes and the total the report declares."""
    rows = registry.select("street_code", F.lit(None).cast("long").alias("declared"))
    totals = declared.select(F.lit(None).cast("string").alias("street_code"), F.col("declared").cast("long").alias("declared"))
    return rows.unionByName(totals).agg(
        F.count("street_code").alias("extracted"),
        F.count_distinct("street_code").alias("unique_codes"),
        F.max("declared").alias("declared"),
    ).withColumn("complete", F.col("extracted") == F.col("declared"))


def bounding_box(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AG18: min/max latitude and longitude."""
    box = [f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)]
    return (points.groupBy(*keys) if keys else points).agg(*box)


def duplicate_line_codes(lines: DataFrame) -> DataFrame:
    """AG19: lines whose code is used by more than one entry."""
    repeated = lines.filter(F.col("line_code").isNotNull()).groupBy("line_code").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1")
    return lines.select("line_code", "line_name").join(repeated, "line_code")


def line_numbers(lines: DataFrame) -> DataFrame:
    """AG20: distinct leading numbers with the first name seen, sorted as integers."""
    numbered = lines.withColumn("number", codes.code_dialect("line_name", "leading_number")).filter("number is not null")
    first = numbered.groupBy("number").agg(F.min_by("line_name", "ord").alias("full_name"))
    return first.withColumn("name", tx.strip(F.replace("full_name", F.col("number"), F.lit("")))).orderBy(
        F.col("number").cast("long"), "number"
    )


def repeated_streets(itinerary: DataFrame) -> DataFrame:
    """WN3: streets repeated within one line and direction: positions and whether two are adjacent.

    Adjacency is an equi-join on (line, direction, key, seq+1), so a long line spreads over partitions.
    """
    keyed = itinerary.withColumn("key", tx.norm_key("street")).filter(F.col("key") != "").select(
        "line_name", "direction", "key", "street", "seq"
    )
    group = ["line_name", "direction", "key"]
    counts = keyed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("times"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min_by("street", "seq").alias("street"),
    ).filter("times > 1")
    adjacent = (
        keyed.select(*group, "seq")
        .join(keyed.select(*group, (F.col("seq") - 1).alias("seq")), [*group, "seq"], "left_semi")
        .select(*group).distinct().withColumn("adjacent", F.lit(True))
    )
    return counts.join(adjacent, group, "left").withColumn("adjacent", F.coalesce("adjacent", F.lit(False)))


