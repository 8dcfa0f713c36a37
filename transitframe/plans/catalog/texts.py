"""Scalar functions: text (N, F), time and number (T, M, A), similarity (SM)."""

from pyspark.sql import functions as F

from transitframe import rules
from transitframe.functions import codes, similarity, values
from transitframe.functions import text as tx
from transitframe.operators import aggregates, spatial
from transitframe.operators.ordered import neighbour
from transitframe.plans import domain as d
from transitframe.plans import oracles as o
from transitframe.plans.catalog import query
from transitframe.session import cut_lineage, once_per_value

_DOC = ("document_lines",)


def _doc_query(name, column, expression):
    @query(name, o.sql(f"SELECT doc_id, line_no, {expression('text')} AS value FROM document_lines", *_DOC))
    def run(spark, sf, column=column):
        return d.document_lines(spark, sf).select("doc_id", "line_no", column(F.col("text")).alias("value"))


_doc_query("N1_index_key", tx.norm_index, o.n1)
_doc_query("N2_comparison_key", tx.norm_key, o.n2)
_doc_query("N3_word_key", tx.norm_words, o.n3)
_doc_query("N4_ascii_key", tx.norm_ascii, o.n4)
_doc_query("N5_punctuated_key", tx.norm_keep_punct, o.n5)
_doc_query("F12_accent_score", lambda c: tx.accent_score(c).cast("long"), lambda x: f"CAST({o.accent_score(x)} AS BIGINT)")
_doc_query(
    "F8_without_parentheses", tx.strip_parentheses, lambda x: f"regexp_replace({x}, '\\(.*?\\)', '', 'g')"
)
_doc_query(
    "F5_relevant_words", lambda c: F.array_join(F.array_sort(tx.relevant_words(c)), " "),
    lambda x: f"array_to_string({o.words3(x)}, ' ')",
)
_doc_query(
    "F15_abbreviation_label", lambda c: tx.abbreviation_label(c, rules.ABBREVIATION_LABELS), lambda x: "CASE "
    + " ".join(f"WHEN regexp_matches({x}, {o.lit('(?i)' + p)}) THEN {o.lit(l)}" for p, l in rules.ABBREVIATION_LABELS if r"\b" not in p)
    + " ".join(
        f" WHEN regexp_matches({x}, {o.lit('(?i)' + p.replace(chr(92) + 'b', '(?:^|[^0-9A-Za-z_À-ɏ])'))}) THEN {o.lit(l)}"
        for p, l in rules.ABBREVIATION_LABELS if r"\b" in p
    ) + " END",
)


@query("F1_line_id", o.sql(f"SELECT line_key, {o.line_id('line_name')} AS id FROM lines", "lines"))
def f1(spark, sf):
    return d.lines(spark, sf).select("line_key", codes.line_id("line_name").alias("id"))


@query("F2_line_code", o.sql(f"SELECT line_key, {o.line_code('line_name')} AS code FROM lines", "lines"))
def f2(spark, sf):
    return d.lines(spark, sf).select("line_key", codes.line_code("line_name").alias("code"))


_DIALECTS = ("map_suffix", "map_plain", "prefix4", "hyphen_suffix", "active_list", "compact", "leading_number", "first_word")


@query("F3_code_dialects", o.sql("""
SELECT line_key,
  CASE WHEN regexp_extract(line_name, '^([A-Z]?\\d{3,4})(?:\\s+([A-Z])(?:[\\s\\-/]|$))?', 1) = '' THEN ''
       ELSE regexp_extract(line_name, '^([A-Z]?\\d{3,4})(?:\\s+([A-Z])(?:[\\s\\-/]|$))?', 1) || regexp_extract(line_name, '^([A-Z]?\\d{3,4})(?:\\s+([A-Z])(?:[\\s\\-/]|$))?', 2) END AS map_suffix,
  regexp_extract(line_name, '^([A-Z]?\\d{3,4})', 1) AS map_plain,
  regexp_extract(line_name, '^(\\d{4})', 1) AS prefix4,
  CASE WHEN regexp_matches(line_name, '^\\d{4}') THEN substr(line_name, 1, 4) ELSE line_name END AS hyphen_suffix,
  replace(upper(line_name), '-', '') AS active_list,
  regexp_replace(upper(line_name), '[- ]', '', 'g') AS compact,
  nullif(regexp_extract(line_name, '^(\\d+)', 1), '') AS leading_number,
  upper(regexp_extract(line_name, '^(\\S+)', 1)) AS first_word
FROM lines""", "lines"))
def f3(spark, sf):
    return d.lines(spark, sf).select("line_key", *[codes.code_dialect("line_name", x).alias(x) for x in _DIALECTS])


@query("F4_description", o.sql(f"""
SELECT line_key, {o.n2("regexp_replace(replace(substr(upper(line_name), strpos(line_name, ' - ')), '(DESATIVADO)', ''), '^[ /-]+', '')")} AS description
FROM lines""", "lines"))
def f4(spark, sf):
    return d.lines(spark, sf).select("line_key", codes.description("line_name").alias("description"))


def _replace_chain(x, rules_):
    for pattern, full in rules_:
        x = f"regexp_replace({x}, {o.lit(pattern)}, {o.lit(full)}, 'g')"
    return x


_STREET_RULES = [("^AV\\.\\s+", "AVENIDA "), ("^R\\.\\s+", "RUA "), ("^TRAV\\.\\s+", "TRAVESSA "), ("^PÇA\\.\\s+", "PRAÇA "), ("^LAD\\.\\s+", "LADEIRA ")]
_PLAIN_RULES = [("^AV\\.\\s+", "AVENIDA "), ("^R\\.\\s+", "RUA "), ("^TRAV\\.\\s+", "TRAVESSA "), ("^PÇA\\.\\s+", "PRACA "), ("^LAD\\.\\s+", "LADEIRA ")]


@query("F6_expand_abbreviations", o.sql(f"""
SELECT part_key, {_replace_chain('upper(street)', _STREET_RULES)} AS address, {_replace_chain('street', _STREET_RULES)} AS merge,
  {_replace_chain(o.n3('street'), [('^AV ', 'AVENIDA '), ('^R ', 'RUA '), ('^TRAV ', 'TRAVESSA '), ('^PCA ', 'PRACA '), ('^LAD ', 'LADEIRA '), (' ROD( |$)', ' RODOVIA\\1')])} AS code_match,
  {o.n5(_replace_chain('street', _PLAIN_RULES))} AS expansion,
  trim(regexp_replace(regexp_replace({o.fold_canonical('upper(' + _replace_chain('street', _PLAIN_RULES) + ')')}, '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS variants,
  {_replace_chain('street', _STREET_RULES)} AS registry
FROM streets""", "streets"))
def f6(spark, sf):
    profiles = ("address", "merge", "code_match", "expansion", "variants", "registry")
    streets = d.streets(spark, sf).select("part_key", "street")
    # the parts are one small file, so few tasks read them
    expanded = once_per_value(streets, "street", {p: codes.expand("street", p) for p in profiles})
    return streets.join(expanded, "street", "left").select("part_key", *profiles)


@query("F7_repair_extraction", o.sql("SELECT part_key, street || ' GUSTAVO SILVA' AS repaired FROM streets", "streets"))
def f7(spark, sf):
    # names with words split the way the extraction splits them
    split = F.regexp_replace(F.regexp_replace("street", r"^AV\. ", "A  V . "), r"^TRAV\. ", "TRA V.")
    broken = F.concat(split, F.lit(" GUSTA VO SILV A"))
    return d.streets(spark, sf).select("part_key", codes.repair_extraction(broken).alias("repaired"))


_ADDRESS = "CASE WHEN l_orderkey % 11 = 0 THEN '' WHEN l_orderkey % 11 = 1 THEN '120, ' || p_type || ', Brasil' ELSE 'Terminal ' || l_suppkey || ', ' || lower(manual_street) || ', MACEIÓ' END"


def addresses(spark, sf):
    """Full addresses derived from lineitem and part."""
    kind = F.col("l_orderkey") % 11
    text = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("120, "), "p_type", F.lit(", Brasil"))).otherwise(
        F.concat(F.lit("Terminal "), F.col("l_suppkey").cast("string"), F.lit(", "), F.lower("manual_street"), F.lit(", MACEIÓ"))
    )
    parts = d.streets(spark, sf).join(d.table(spark, sf, "part").select("p_partkey", "p_type"), F.col("part_key") == F.col("p_partkey"))
    return (
        d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(parts, F.col("l_partkey") == F.col("part_key")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("address"))
    )


@query("F9_street_of_address", o.sql("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 11 = 0 THEN 'RUA NÃO IDENTIFICADA' WHEN l_orderkey % 11 = 1 THEN p_type ELSE manual_street END AS street
FROM lineitem JOIN streets ON l_partkey = part_key JOIN part ON p_partkey = part_key""", "streets"))
def f9(spark, sf):
    return addresses(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", codes.street_of_address("address").alias("street"))


@query("F10_core_name", o.sql(f"""
SELECT part_key, trim(regexp_replace({o.n2('manual_street')}, '^((AVENIDA|RUA|TRAVESSA|LADEIRA)( |$))+', '')) AS core_report,
  trim(regexp_replace({o.n2('manual_street')}, '^((AVENIDA|RUA|TRAVESSA|LADEIRA|PRACA)( |$))+', '')) AS core_pairs FROM streets""", "streets"))
def f10(spark, sf):
    key = tx.norm_key("manual_street")
    return d.streets(spark, sf).select(
        "part_key", tx.core_name(key, rules.CORE_PREFIXES_REPORT).alias("core_report"), tx.core_name(key, rules.CORE_PREFIXES_PAIRS).alias("core_pairs")
    )


@query("F11_distinctive_tokens", o.sql(f"""
SELECT part_key, array_to_string(list_sort(list_distinct(list_filter(string_split({o.n2("street || ' ' || part_key || ' VII TRES B'")}, ' '),
  lambda w: regexp_matches(w, '^([0-9]+|[A-Z])$') OR w IN ('VII', 'TRES')))), '|') AS tokens FROM streets""", "streets"))
def f11(spark, sf):
    text = F.concat("street", F.lit(" "), F.col("part_key").cast("string"), F.lit(" VII TRES B"))
    tokens = tx.distinctive_tokens(tx.norm_key(text), rules.SPELLED_NUMBERS, rules.ROMAN_NUMERALS)
    return d.streets(spark, sf).select("part_key", F.array_join(tokens, "|").alias("tokens"))


@query("F13_dictionary_entries", o.sql("""
SELECT id, CASE WHEN name NOT LIKE 'REVISAR:%' THEN substr(name, 1, 5) END AS street_code,
  CASE WHEN name NOT LIKE 'REVISAR:%' THEN regexp_replace(substr(name, 7), ' 0000$', '') END AS street, name LIKE 'REVISAR:%' AS needs_review FROM dictionary""", "dictionary"))
def f13(spark, sf):
    return d.dictionary(spark, sf).select("id", tx.split_registry_name("name").alias("e")).select("id", "e.*")


@query("F14_service_type", o.sql(f"""
SELECT line_key, {o.service("upper(" + o._SEGMENT + ")")} AS service FROM lines""", "lines"))
def f14(spark, sf):
    raw = F.element_at(codes._literal_map(d.SEGMENT_SERVICE), F.col("segment"))
    return d.lines(spark, sf).select("line_key", codes.service_type(F.concat(F.lit(" "), F.lower(raw))).alias("service"))


@query("F16_difference_kind", o.sql(f"""
AND_WITH g AS (SELECT p_size, p_name, list_sort(list_distinct(list(street))) AS names FROM streets JOIN part ON part_key = p_partkey GROUP BY ALL),
n AS (SELECT *, list_transform(names, lambda s: trim(regexp_replace({o.fold_canonical('upper(s)')}, '[^A-Z0-9 ]', ' ', 'g'))) AS norms FROM g)
SELECT p_size, p_name, CASE WHEN len(list_distinct(norms)) = 1 THEN 'ACENTO'
  WHEN len(list_filter(norms, lambda x: NOT starts_with(x, list_sort(list_transform(norms, lambda t: {{'l': length(t), 't': t}}))[1].t))) = 0 THEN 'COMPLEMENTO'
  ELSE 'NOME DIFERENTE' END AS kind FROM n""", "streets"))
def f16(spark, sf):
    named = d.streets(spark, sf).join(d.table(spark, sf, "part").select("p_partkey", "p_size", "p_name"), F.col("part_key") == F.col("p_partkey"))
    return aggregates.spelling_difference(named.select("p_size", "p_name", "street"), ["p_size", "p_name"])


def following_streets(spark, sf):
    """Each itinerary street with the next one on its line and direction."""
    it = d.itinerary(spark, sf).select("line_key", "direction", "seq", "street", "street_code")
    return neighbour(it, ["line_key", "direction"], {"street": "next_street", "street_code": "next_code"}).filter("next_street is not null")


def following_forms(spark, sf, form):
    """Distinct (a, b): following streets in a form that is derived once per spelling, not twice per row."""
    pairs = cut_lineage(following_streets(spark, sf).select("street", "next_street").distinct())
    forms = once_per_value(d.streets(spark, sf), "street", {"form": form})
    for side, column in (("a", "street"), ("b", "next_street")):
        pairs = pairs.join(forms.select(F.col("street").alias(column), F.col("form").alias(side)), column)
    return pairs.select("a", "b").distinct()


_NEXT = """SELECT line_key, direction, seq, street, street_code, lead(street) OVER w AS next_street, lead(street_code) OVER w AS next_code
FROM itinerary WINDOW w AS (PARTITION BY line_key, direction ORDER BY seq)"""


@query("F17_pair_reason", o.sql(f"""
AND_WITH nx AS ({_NEXT}), k AS (SELECT *, {o.n2('street')} AS a, {o.n2('next_street')} AS b FROM nx WHERE next_street IS NOT NULL),
t AS (SELECT *, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM k),
s AS (SELECT *, len(list_intersect(ta, tb)) AS c FROM t)
SELECT line_key, direction, seq, CASE WHEN abs(length(a) - length(b)) <= 3 THEN 'diferença mínima de caracteres (possível typo)'
  WHEN c = len(ta) OR c = len(tb) THEN 'uma contém a outra (possível abreviação)' ELSE 'similaridade alta (90%)' END AS reason_report,
  CASE WHEN c = len(ta) AND c = len(tb) THEN 'mesmas palavras, ordem diferente' WHEN c = len(ta) OR c = len(tb) THEN 'uma contém a outra (possível abreviação)'
  WHEN abs(length(a) - length(b)) <= 4 THEN 'diferença minima de caracteres (possivel typo)' ELSE 'alta similaridade (90%)' END AS reason_pairs
FROM s""", "itinerary"))
def f17(spark, sf):
    a, b = F.col("a"), F.col("b")
    forms = once_per_value(d.streets(spark, sf), "street", {"key": tx.norm_key("street")})
    keyed = following_streets(spark, sf)
    for side, column in (("a", "street"), ("b", "next_street")):
        keyed = keyed.join(forms.select(F.col("street").alias(column), F.col("key").alias(side)), column)
    return keyed.select(
        "line_key", "direction", "seq",
        *[tx.pair_reason(a, b, a, b, F.lit(0.9), p).alias(f"reason_{p}") for p in ("report", "pairs")],
    )


@query("F18_pair_class", o.sql(f"""
AND_WITH nx AS ({_NEXT}) SELECT line_key, direction, seq, CASE WHEN street_code IS NOT NULL AND next_code IS NOT NULL THEN
  CASE WHEN street_code = next_code THEN 'MESMO_CODIGO' ELSE 'CODIGOS_DIFERENTES' END
  WHEN street_code IS NOT NULL THEN 'SUGERIR_A_PARA_B' WHEN next_code IS NOT NULL THEN 'SUGERIR_B_PARA_A' ELSE 'SEM_CODIGO' END AS pair_class
FROM nx WHERE next_street IS NOT NULL""", "itinerary"))
def f18(spark, sf):
    return following_streets(spark, sf).select("line_key", "direction", "seq", tx.pair_class(F.col("street_code"), F.col("next_code")).alias("pair_class"))


@query("F19_names_for_files", o.sql(f"""
SELECT line_key, lower(replace({o.fold('line_name')}, ' ', '-')) AS slug, substr(regexp_replace({o.fold('line_name')}, '[\\\\/*?:"<>|]', '-', 'g'), 1, 80) AS file_name,
  substr(regexp_replace(line_name, '[\\\\/*?:\\[\\]]', '-', 'g'), 1, 31) AS sheet_name FROM lines""", "lines"))
def f19(spark, sf):
    return d.lines(spark, sf).select(
        "line_key", tx.slug("line_name").alias("slug"), tx.safe_file_name("line_name").alias("file_name"), tx.safe_sheet_name("line_name").alias("sheet_name")
    )


@query("F19_title_case", o.sql("""
SELECT part_key, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN regexp_matches(s[i], '[a-z]') AND (i = 1 OR NOT regexp_matches(s[i - 1], '[a-z0-9_]')) THEN upper(s[i]) ELSE s[i] END), '') AS title
FROM (SELECT part_key, lower(street) AS s FROM streets)""", "streets"))
def f19_title(spark, sf):
    return d.streets(spark, sf).select("part_key", tx.title_case("street").alias("title"))


@query("F20_split_option", o.sql("""
SELECT line_key, CASE WHEN regexp_matches(line_name, '^[\\dM]{3,5}\\s*-\\s*.+$') THEN regexp_extract(line_name, '^([\\dM]{3,5})', 1) ELSE 'SEMCODIGO' END AS code,
  CASE WHEN regexp_matches(line_name, '^[\\dM]{3,5}\\s*-\\s*.+$') THEN regexp_replace(line_name, '^[\\dM]{3,5}\\s*-\\s*', '') ELSE line_name END AS name FROM lines""", "lines"))
def f20(spark, sf):
    e = tx.split_option("line_name")
    return d.lines(spark, sf).select("line_key", e["line_code"].alias("code"), e["line_name"].alias("name"))


@query("T1_minutes", o.sql("SELECT event_id, minute_of_day FROM timetable", "timetable"))
def t1(spark, sf):
    return d.timetable(spark, sf).select("event_id", values.minutes("hhmm").alias("minute_of_day"))


@query("T2_valid_time", """
SELECT event_id, CASE WHEN event_id % 30 <= 23 AND event_id % 70 <= 59 THEN lpad((event_id % 30)::VARCHAR, 2, '0') || ':' || lpad((event_id % 70)::VARCHAR, 2, '0') END AS hhmm FROM events""")
def t2(spark, sf):
    e = F.col("event_id")
    return d.table(spark, sf, "events").select("event_id", values.valid_time((e % 30).cast("string"), (e % 70).cast("string")).alias("hhmm"))


_TIMES_TEXT = "strftime(ts, '%H:%M') || ' x ' || strftime(ts + INTERVAL 90 MINUTE, '%H:%M') || ' 29:10 ' || strftime(ts, '%H:%M')"


@query("T3_times_in_text", f"""
SELECT event_id, array_to_string(list_sort(list_distinct([strftime(ts, '%H:%M'), strftime(ts + INTERVAL 90 MINUTE, '%H:%M')])), ',') AS times FROM events""")
def t3(spark, sf):
    time = F.date_format("ts", "HH:mm")
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 90 MINUTES"), "HH:mm")
    text = F.concat_ws(" ", time, F.lit("x"), later, F.lit("29:10"), time)
    return d.table(spark, sf, "events").select("event_id", F.array_join(values.times_in(text), ",").alias("times"))


@query("T4_times_near", f"""
SELECT event_id, array_to_string(list_filter([strftime(ts, '%H:%M'), strftime(ts + INTERVAL 90 MINUTE, '%H:%M')], lambda t: abs({o.minutes('t')} - 600) <= 120), ',') AS times FROM events""")
def t4(spark, sf):
    times = F.array(F.date_format("ts", "HH:mm"), F.date_format(F.col("ts") + F.expr("INTERVAL 90 MINUTES"), "HH:mm"))
    return d.table(spark, sf, "events").select("event_id", F.array_join(values.times_near(times, 600, 120), ",").alias("times"))


@query("M1_decimal_comma", "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN round(value, 2) END AS number, CASE WHEN event_id % 9 <> 0 THEN trunc(round(value, 2))::INTEGER ELSE 0 END AS whole FROM events")
def m1(spark, sf):
    text = F.when(F.col("event_id") % 9 == 0, "x").otherwise(F.replace(F.round("value", 2).cast("string"), F.lit("."), F.lit(",")))
    return d.table(spark, sf, "events").select(
        "event_id", values.decimal_comma(text).alias("number"), values.int_or_zero(F.replace(text, F.lit(","), F.lit("."))).alias("whole")
    )


def _coordinate_text():
    point = F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.lit("0"))
    return F.concat_ws(" ", point, F.lit("bad"), F.lit("1,x"), point)


@query("M2_parse_coordinates", o.sql("SELECT event_id, 2 AS n_points, round(lat, 6) AS lat, round(lon, 6) AS lon FROM raw_points", "raw_points"))
def m2(spark, sf):
    parsed = d.raw_points(spark, sf).select("event_id", values.parse_coordinates(_coordinate_text()).alias("p"))
    return parsed.select("event_id", F.size("p").alias("n_points"), F.round(F.get("p", 1)["lat"], 6).alias("lat"), F.round(F.get("p", 1)["lon"], 6).alias("lon"))


@query("M3_range_check", o.sql("SELECT event_id, abs(lat * (1 + event_id % 20)) <= 90 AND abs(lon * (1 + event_id % 7)) <= 180 AS valid FROM raw_points", "raw_points"))
def m3(spark, sf):
    e = F.col("event_id")
    return d.raw_points(spark, sf).select("event_id", values.in_range(F.col("lat") * (1 + e % 20), F.col("lon") * (1 + e % 7)).alias("valid"))


@query("M4_swap_axes", o.sql("SELECT event_id, 1 AS n_points, round(lon, 6) AS first, round(lat, 6) AS second FROM raw_points", "raw_points"))
def m4(spark, sf):
    swapped = values.swap_axes(F.array(F.array("lat", "lon"), F.array("lat")))
    return d.raw_points(spark, sf).select("event_id", swapped.alias("s")).select(
        "event_id", F.size("s").alias("n_points"), F.round(F.get("s", 0)[0], 6).alias("first"), F.round(F.get("s", 0)[1], 6).alias("second")
    )


@query("M5_cache_key", o.sql("SELECT event_id, round(lat, 6)::VARCHAR || ',' || round(lon, 6)::VARCHAR AS key FROM raw_points", "raw_points"))
def m5(spark, sf):
    return d.raw_points(spark, sf).select("event_id", values.cache_key(F.col("lat"), F.col("lon")).alias("key"))


@query("M6_base_plus_extra", "SELECT event_id, user_id + CASE WHEN event_id % 3 = 0 THEN 5 ELSE 0 END AS total FROM events")
def m6(spark, sf):
    extra = F.when(F.col("event_id") % 3 == 0, F.lit(5))
    return d.table(spark, sf, "events").select("event_id", values.with_extra(F.col("user_id"), extra).alias("total"))


@query("M7_point_count", o.sql("SELECT line_key, direction, count(*) AS n_points FROM route_points GROUP BY ALL", "route_points"))
def m7(spark, sf):
    return spatial.point_counts(d.route_points(spark, sf), ["line_key", "direction"])


@query("A1_reverse_path", o.sql("""
SELECT line_key, direction, count(*) OVER (PARTITION BY line_key, direction) - 1 - seq AS seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM route_points""", "route_points"))
def a1(spark, sf):
    back = spatial.reversed_paths(d.route_points(spark, sf), ["line_key", "direction"])
    return back.select("line_key", "direction", "seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("A2_close_ring", o.sql("SELECT zone_ord, 7 AS n_points, round(min(x1), 6) AS west FROM zone_edges GROUP BY zone_ord", "zone_edges"))
def a2(spark, sf):
    open_ring = F.slice("ring", 1, 6)
    closed = values.close_ring(F.when(F.col("zone_ord") % 2 == 0, open_ring).otherwise(F.col("ring")))
    return d.zones(spark, sf).select("zone_ord", closed.alias("r")).select(
        "zone_ord", F.size("r").alias("n_points"), F.round(F.array_min(F.transform("r", lambda p: p["lon"])), 6).alias("west")
    )


@query("SM1_word_overlap", o.sql(f"""
AND_WITH nx AS ({_NEXT}) SELECT line_key, direction, seq, round({o.jaccard(o.words3('street'), o.words3('next_street'))}, 6) AS score FROM nx WHERE next_street IS NOT NULL""", "itinerary"))
def sm1(spark, sf):
    score = similarity.jaccard(F.col("a"), F.col("b"))
    worded = following_streets(spark, sf).withColumns({"a": tx.relevant_words("street"), "b": tx.relevant_words("next_street")})
    return worded.select("line_key", "direction", "seq", F.round(score, 6).alias("score"))


@query("SM2_sequence_ratio")
def sm2(spark, sf):
    pairs = following_forms(spark, sf, tx.norm_key("street"))
    return pairs.select("a", "b", F.round(similarity.sequence_ratio("a", "b"), 6).alias("score"))


@query("SM3_mixed_score")
def sm3(spark, sf):
    pairs = following_forms(spark, sf, tx.norm_blank_punct("street"))
    pairs = pairs.withColumns({"ta": tx.content_tokens(F.col("a"), rules.STOPWORDS), "tb": tx.content_tokens(F.col("b"), rules.STOPWORDS)})
    overlap = similarity.jaccard(F.col("ta"), F.col("tb"))
    return pairs.select("a", "b", F.round(similarity.mixed_score(similarity.sequence_ratio("a", "b"), overlap), 6).alias("score"))


@query("SM4_weighted_ratio")
def sm4(spark, sf):
    pairs = following_forms(spark, sf, codes.expand("street", "address"))
    return pairs.select("a", "b", F.round(similarity.weighted_ratio("a", "b"), 4).alias("score"))
