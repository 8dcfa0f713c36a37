"""Lookup layer: street search, autocomplete, timetables, GeoJSON features.

Tables: ``itinerary(line_id, line_name, ord, direction, seq, street, street_code)``,
``points(line_id, line_name, ord, direction, seq, lat, lon)``,
``timetable(line_code, day_type, direction, hhmm, minute_of_day)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitframe.functions import codes
from transitframe.functions import text as tx
from transitframe.rules import DAY_TYPES, DIRECTIONS, PENDING_KEYWORDS, TURNSTILE_TYPE


def _direction_rank() -> Column:
    return F.when(F.col("direction") == "ida", 0).otherwise(1)


def street_index(itinerary: DataFrame) -> DataFrame:
    """SK3: one row per (norm_street, line, direction) with the code of its first occurrence.

    ``occ_ord`` orders rows of one street, ``key_ord`` orders streets by first appearance. Both are
    partial aggregations, so a street used by most lines combines before the shuffle.
    """
    position = F.struct("ord", _direction_rank().alias("d"), "seq")
    occurrences = (
        itinerary.withColumn("norm_street", tx.norm_index("street"))
        .groupBy("norm_street", "line_id", "direction")
        .agg(
            F.min(position).alias("occ_ord"),
            F.min_by(F.struct("line_name", "street_code"), position).alias("_f"),
        )
        .select("norm_street", "line_id", "direction", "occ_ord", "_f.*")
    )
    keys = occurrences.groupBy("norm_street").agg(F.min("occ_ord").alias("key_ord"))
    return occurrences.join(keys, "norm_street")


def list_lines(lines: DataFrame, points: DataFrame, itinerary: DataFrame) -> DataFrame:
    """Q1: every line with what it has, sorted by name."""
    geometry = points.groupBy("line_id").agg(
        F.max(F.col("direction") == "ida").alias("has_ida"), F.max(F.col("direction") == "volta").alias("has_volta")
    )
    described = itinerary.select("line_id").distinct().withColumn("has_itinerary", F.lit(True))
    no = F.lit(False)
    return (
        lines.select("line_id", "line_name")
        .join(geometry, "line_id", "left")
        .join(described, "line_id", "left")
        .select(
            "line_id", "line_name",
            *[F.coalesce(c, no).alias(c) for c in ("has_ida", "has_volta", "has_itinerary")],
        )
        .orderBy("line_name", "line_id")
    )


def line_streets(itinerary: DataFrame, line_id: str) -> DataFrame:
    """Q2: ordered streets of one line; no rows when the line is unknown."""
    return itinerary.filter(F.col("line_id") == line_id).select("line_id", "direction", "seq", "street", "street_code", "match")


def metadata(lines: DataFrame, itinerary: DataFrame) -> DataFrame:
    """Q3: total lines and distinct indexed streets."""
    ids = lines.select("line_id", F.lit(None).cast("string").alias("key"))
    keys = itinerary.select(F.lit(None).cast("string").alias("line_id"), tx.norm_index("street").alias("key"))
    return ids.unionByName(keys).agg(
        F.count_distinct("line_id").alias("total_lines"), F.count_distinct("key").alias("total_streets")
    )


def suggest(itinerary: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Q4: distinct street keys containing the query, sorted, first ``limit``."""
    key = tx.norm_index("street").alias("street_key")
    wanted = tx.norm_index(F.lit(query))
    return (
        itinerary.select("street").distinct().select(key).filter((wanted != "") & F.contains("street_key", wanted))
        .distinct().orderBy("street_key").limit(limit)
    )


def search_streets(index: DataFrame, query: str, limit: int | None = 100, trim_query: bool = False) -> DataFrame:
    """Q5: (line, direction, street) rows whose street contains the query, in index order."""
    wanted = tx.norm_key(F.lit(query)) if trim_query else tx.norm_index(F.lit(query))
    hits = index.filter((wanted != "") & F.contains("norm_street", wanted))
    if limit is not None:
        hits = hits.orderBy("key_ord", "occ_ord").limit(limit)
    return hits.select("line_id", "line_name", "direction", "norm_street", "street_code")


def times_by_slot(departures: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted departure times per slot, repeats kept.

    Equal minutes are counted before the shuffle, so a slot sends at most 1,440 rows however many
    departures it has.
    """
    counted = departures.groupBy(*keys, "hhmm").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    slots = F.array_sort(F.collect_list(F.struct("hhmm", "_n")))
    return counted.groupBy(*keys).agg(F.flatten(F.transform(slots, lambda s: F.array_repeat(s["hhmm"], s["_n"]))).alias("times"))


def search_streets_at(
    index: DataFrame,
    timetable: DataFrame,
    query: str,
    time: str,
    day_type: str = "dia_util",
    window: int = 20,
    limit: int | None = 100,
    key: str = "prefix4",
    limit_after: bool = False,
) -> DataFrame:
    """Q6: Q5 hits whose line leaves within ``window`` minutes of ``time``.

    The limit applies before the time filter, as in the service; ``limit_after`` applies it afterwards.
    ``key`` joins on the four-digit prefix (service) or the full code (publisher).
    """
    hour, minute = (int(x) for x in time.split(":"))
    target = hour * 60 + minute
    hits = search_streets(index, query, None if limit_after else limit)
    code = codes.code_dialect("line_name", "prefix4") if key == "prefix4" else codes.line_code("line_name")
    due = timetable.filter((F.col("day_type") == day_type) & (F.abs(F.col("minute_of_day") - target) <= window))
    near = times_by_slot(due, ["line_code", "direction"]).withColumn("near_times", F.array_join("times", ",")).drop("times")
    found = hits.withColumn("line_code", code).filter(F.col("line_code") != "").join(near, ["line_code", "direction"])
    out = found.select("line_id", "line_name", "direction", "norm_street", "street_code", "near_times")
    if limit_after and limit is not None:
        out = out.orderBy("norm_street", "line_name", "direction").limit(limit)
    return out


def search_by_code(itinerary: DataFrame, street_code: str) -> DataFrame:
    """Q7: every itinerary row with this street code."""
    return itinerary.filter(F.col("street_code") == street_code).select("line_id", "line_name", "direction", "street")


def line_timetable(lines: DataFrame, timetable: DataFrame, line_id: str | None = None) -> DataFrame:
    """Q8: departures per line, day type and direction; missing combinations appear as empty lists."""
    chosen = lines if line_id is None else lines.filter(F.col("line_id") == line_id)
    chosen = chosen.select("line_id", codes.code_dialect("line_name", "prefix4").alias("line_code"))
    chosen = chosen.join(timetable.select("line_code").distinct(), "line_code", "left_semi")
    slots = chosen.withColumn("day_type", F.explode(F.array(*[F.lit(d) for d in DAY_TYPES]))).withColumn(
        "direction", F.explode(F.array(*[F.lit(d) for d in DIRECTIONS]))
    )
    times = times_by_slot(timetable, ["line_code", "day_type", "direction"])
    return slots.join(times, ["line_code", "day_type", "direction"], "left").select(
        "line_id", "day_type", "direction", F.coalesce("times", F.array().cast("array<string>")).alias("times")
    )


def geojson_features(points: DataFrame, direction: str | None = None, line_ids: list[str] | None = None) -> DataFrame:
    """Q9-Q11: GeoJSON LineString features, one per line and direction, as text fragments.

    Rows (line_id, line_name, direction, place, seq, fragment): the opening (place 0), a vertex each (1) and the closing (2);
    in order they are the feature's text. A path may have any length; ``seq`` is dense from 0.
    """
    wanted = (direction or "").strip().lower()
    if wanted not in {"", "ida", "volta", "ambos"}:
        raise ValueError("direction must be ida, volta or ambos")
    chosen = points if wanted in {"", "ambos"} else points.filter(F.col("direction") == wanted)
    if line_ids is not None:
        chosen = chosen.filter(F.col("line_id").isin(line_ids))
    keys = ["line_id", "line_name", "direction"]
    properties = F.to_json(F.struct(F.col("line_id").alias("linha_id"), F.col("line_name").alias("linha_nome"), F.col("direction").alias("sentido")))
    opening = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"LineString","coordinates":['))
    frame = F.array(F.struct(F.lit(0).alias("place"), opening.alias("fragment")), F.struct(F.lit(2).alias("place"), F.lit("]}}\n").alias("fragment")))
    ends = chosen.select(*keys).distinct().select(*keys, F.inline(frame)).select(*keys, "place", F.lit(0).cast("long").alias("seq"), "fragment")
    comma = F.when(F.col("seq") > 0, F.lit(",")).otherwise(F.lit(""))
    vertex = F.concat(comma, F.lit("["), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    return ends.unionByName(chosen.select(*keys, F.lit(1).alias("place"), F.col("seq").cast("long").alias("seq"), vertex.alias("fragment")))


def lines_named(lines: DataFrame, fragment: str) -> DataFrame:
    """Q13: lines whose name contains a fragment, ignoring case."""
    return lines.filter(F.contains(F.lower("line_name"), F.lit(fragment.lower()))).select("line_id", "line_name")


def group_hits(hits: DataFrame) -> DataFrame:
    """Q14: street hits beside the number of hits of their line, one row per hit."""
    counts = hits.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return hits.join(counts, "line_id").select("line_id", "line_name", "n_hits", "direction", "street_code", "norm_street")


def browse_neighbourhoods(streets: DataFrame, query: str = "", neighbourhood: str | None = None) -> DataFrame:
    """Q15: a neighbourhood stays whole when its own name matches, else only its matching streets."""
    chosen = streets if neighbourhood is None else streets.filter(F.col("neighbourhood") == neighbourhood)
    term = tx.norm_ascii(F.lit(query), compat=True)
    hit = (
        (term == "")
        | F.contains(tx.norm_ascii("neighbourhood", compat=True), term)
        | F.contains(tx.norm_ascii("street", compat=True), term)
        | F.contains("code", term)
    )
    return chosen.filter(hit)


def browse_registry(registry: DataFrame, query: str, limit: int | None = 300) -> DataFrame:
    """Q16: registry rows by code, spelled-out or original name, first ``limit`` in registry order."""
    term = tx.norm_ascii(F.lit(query), compat=True)
    hits = registry.filter(
        (term == "")
        | F.contains("street_code", term)
        | F.contains(tx.norm_ascii("street", compat=True), term)
        | F.contains(tx.norm_ascii("street_original", compat=True), term)
    )
    return hits if limit is None else hits.orderBy("ord").limit(limit)


def active_without_turnstile(active: DataFrame) -> DataFrame:
    """Q17: active lines except the turnstile service."""
    return active.filter(F.col("service") != TURNSTILE_TYPE)


def pending_names(lines: DataFrame) -> DataFrame:
    """Q18: line names that carry a pending-work keyword."""
    return lines.filter(F.upper("line_name").rlike("|".join(PENDING_KEYWORDS))).select("line_id", "line_name")


def stop_sequence(stops: DataFrame) -> DataFrame:
    """Q19: stops with usable coordinates in outbound order, and the reversed order for the return."""
    usable = stops.filter((F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lon", F.lit(0.0)) != 0))
    both = usable.withColumn("direction", F.explode(F.array(*[F.lit(d) for d in DIRECTIONS])))
    return both.withColumn("sort_position", F.when(F.col("direction") == "ida", F.col("position")).otherwise(-F.col("position")))


def timetable_tab(timetable: DataFrame, day_type: str = "dia_util", direction: str | None = None) -> DataFrame:
    """Q20: departures of one day tab, all directions unless one is chosen."""
    chosen = timetable.filter(F.col("day_type") == day_type)
    return chosen if direction is None else chosen.filter(F.col("direction") == direction)
