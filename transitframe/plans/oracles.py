"""The domain derivations and scalar rules as SQL, for checking results on another engine."""

from __future__ import annotations

from transitframe import rules
from transitframe.functions import text as tx
from transitframe.plans.domain import PREFIX_FULL, PREFIX_SHORT, SEGMENT_SERVICE


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"translate(replace({x}, 'ß', 'ss'), {lit(tx.FOLD_SOURCE + tx.MARKS)}, {lit(tx.FOLD_TARGET)})"


def fold_canonical(x: str) -> str:
    return f"translate({x}, {lit(tx.CANON_SOURCE + tx.MARKS)}, {lit(tx.CANON_TARGET)})"


def strip(x: str) -> str:
    return f"trim({x}, {lit(tx.WHITESPACE)})"


def n1(x: str) -> str:
    return f"regexp_replace({strip(f'upper({fold(x)})')}, '[^A-Z0-9]+', ' ', 'g')"


def n2(x: str) -> str:
    return f"trim({n1(x)})"


def n3(x: str) -> str:
    cleaned = f"regexp_replace({strip(f'upper({fold(x)})')}, '[^\\pL\\pM\\pN\\p{{Pc}}\\s]', ' ', 'g')"
    return strip(f"regexp_replace({cleaned}, '\\s+', ' ', 'g')")


def n4(x: str) -> str:
    return strip(f"upper(regexp_replace({fold_canonical(x)}, '[^\\x00-\\x7F]', '', 'g'))")


def n5(x: str) -> str:
    return f"regexp_replace({fold_canonical(strip(f'upper(replace({x},{lit(chr(223))},{lit(chr(115)*2)}))'))}, '\\s+', ' ', 'g')"


def words3(x: str) -> str:
    """Distinct words of at least three characters of the comparison key."""
    return f"list_sort(list_distinct(list_filter(string_split({n2(x)}, ' '), lambda w: length(w) >= 3)))"


def line_code(x: str) -> str:
    up = f"upper({strip(x)})"
    pattern = "'^([A-Z]{0,2})(\\d{1,4})(?:\\s*-{0,2}\\s*([A-Z]))?(?:[\\s\\-/]|$)'"
    g = [f"regexp_extract({up}, {pattern}, {i})" for i in (1, 2, 3)]
    return f"CASE WHEN {g[1]} <> '' THEN lpad({g[1]}, 4, '0') || CASE WHEN {g[0]} <> '' THEN {g[0]} ELSE {g[2]} END END"


def line_id(x: str) -> str:
    return f"'ln-' || substr(sha1({n1(x)}), 1, 10)"


def accent_score(x: str) -> str:
    return f"(length({x}) - length(translate({x}, {lit(tx.FOLD_SOURCE + tx.MARKS + ''.join(tx.EXPANSIONS))}, '')))"


def minutes(x: str) -> str:
    return f"(CAST(split_part({x}, ':', 1) AS INTEGER) * 60 + CAST(split_part({x}, ':', 2) AS INTEGER))"


def jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {common}::DOUBLE / (len({a}) + len({b}) - {common}) END"


def haversine(a1: str, o1: str, a2: str, o2: str) -> str:
    h = (
        f"(pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2}))"
        f" * pow(sin((radians({o2}) - radians({o1})) / 2), 2))"
    )
    return f"(2 * 6371.0e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _pick(options: list[str], index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} % {len(options)} = {i} THEN {lit(o)}" for i, o in enumerate(options)) + " END"


def service(x: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({x}, {lit(p)}) THEN {lit(v)}" for p, v in rules.SERVICE_PREFIXES) + f" ELSE {x} END"


_SEGMENT = "CASE segment " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in SEGMENT_SERVICE.items()) + " END"
_CORNERS = [(1.2e-2, 0.0), (6e-3, 1.04e-2), (-6e-3, 1.04e-2), (-1.2e-2, 0.0), (-6e-3, -1.04e-2), (6e-3, -1.04e-2)]

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), f"""
SELECT *, {line_id('line_name')} AS line_id, {line_code('line_name')} AS line_code, line_key AS ord FROM (
  SELECT c_custkey AS line_key, c_mktsegment AS segment, r_name AS region,
    CASE WHEN c_custkey >= 10000 THEN lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' ' || substr('BCDEFGHIJKLNOPQRSTUVWXYZ', ((c_custkey // 10000 - 1) % 24 + 1)::INTEGER, 1)
         WHEN c_custkey % 10 = 3 THEN lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' A'
         WHEN c_custkey % 11 = 5 THEN 'M' || CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END
         ELSE lpad((c_custkey % 10000)::VARCHAR, 4, '0') END
    || ' - ' || r_name || ' / ' || replace(n_name, '_', ' ')
    || CASE WHEN c_custkey >= 250000 THEN ' SERIE ' || ((c_custkey - 10000) // 240000)::VARCHAR ELSE '' END
    || CASE WHEN c_custkey % 13 = 0 THEN ' (DESATIVADO)' WHEN c_custkey % 4 = 0 THEN ' (Via Norte)' ELSE '' END AS line_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""),
    "raw_points": ((), """
SELECT user_id AS line_key, CASE WHEN event_id % 2 = 0 THEN 'ida' ELSE 'volta' END AS direction, event_id, ts,
  -9.5e0 - (value % 100) / 1000 AS lat, -35.7e0 - (event_id % 997) / 9970.0e0 AS lon FROM events"""),
    "route_points": (("raw_points",), """
SELECT line_key, direction, row_number() OVER (PARTITION BY line_key, direction ORDER BY ts, event_id) - 1 AS seq, lat, lon FROM raw_points"""),
    "named_points": (("route_points", "lines"), """
SELECT p.*, line_id, line_name, line_code, ord FROM route_points p JOIN lines USING (line_key)"""),
    "streets": ((), f"""
SELECT p_partkey AS part_key,
  {_pick(PREFIX_SHORT, 'p_size')} || ' ' || p_type || ' ' || CASE WHEN p_partkey % 5 = 0 THEN translate(p_name, 'aeo', 'áêõ') ELSE p_name END
    || CASE WHEN p_partkey % 4 = 0 THEN ' (' || p_brand || ')' ELSE '' END AS street,
  {_pick(PREFIX_FULL, 'p_size')} || ' ' || p_type || ' ' || upper(p_name) AS manual_street,
  CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN length(p_partkey::VARCHAR) < 5 THEN lpad(p_partkey::VARCHAR, 5, '0') ELSE p_partkey::VARCHAR END END AS street_code,
  CASE WHEN p_partkey % 7 = 0 THEN 'nao_encontrado' WHEN p_partkey % 11 = 0 THEN 'fuzzy' WHEN p_partkey % 3 = 0 THEN 'exato_global' ELSE 'exato' END AS match
FROM part"""),
    "itinerary": (("streets",), """
SELECT line_key, direction, seq, street, street_code, match, manual_street, part_key, l_linenumber FROM (
  SELECT o_custkey AS line_key, CASE WHEN l_linenumber % 2 = 1 THEN 'ida' ELSE 'volta' END AS direction, l_partkey, l_linenumber,
    row_number() OVER (PARTITION BY o_custkey, l_linenumber % 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN streets ON l_partkey = part_key"""),
    "named_itinerary": (("itinerary", "lines"), """
SELECT i.*, line_id, line_name, line_code, ord, CASE WHEN direction = 'ida' THEN 0 ELSE 1 END AS d FROM itinerary i JOIN lines USING (line_key)"""),
    "manual_copy": (("named_itinerary",), """
SELECT line_key, line_name, line_code, direction, seq, ord, d, CASE WHEN line_key % 4 = 1 THEN street ELSE manual_street END AS street FROM named_itinerary"""),
    "manual_itinerary": (("named_itinerary",), """
SELECT line_key, line_name, line_code, direction, seq, ord, d, CASE WHEN line_key % 4 = 1 THEN street ELSE manual_street END AS street
FROM named_itinerary WHERE line_key % 9 <> 0 AND (line_key % 4 = 1 OR l_linenumber <= 5)"""),
    "timetable": ((), f"""
SELECT *, {minutes('hhmm')} AS minute_of_day FROM (
  SELECT lpad((user_id % 10000)::VARCHAR, 4, '0') || CASE WHEN user_id >= 10000 THEN substr('BCDEFGHIJKLNOPQRSTUVWXYZ', ((user_id // 10000 - 1) % 24 + 1)::INTEGER, 1) ELSE '' END AS line_code,
    CASE dayofweek(ts) WHEN 0 THEN 'domingo' WHEN 6 THEN 'sabado' ELSE 'dia_util' END AS day_type,
    CASE WHEN event_id % 2 = 0 THEN 'ida' ELSE 'volta' END AS direction, strftime(ts, '%H:%M') AS hhmm, event_id FROM events)"""),
    "registry": (("streets",), """
SELECT CASE WHEN length(part_key::VARCHAR) < 5 THEN lpad(part_key::VARCHAR, 5, '0') ELSE part_key::VARCHAR END AS street_code,
  manual_street AS street, street AS street_original, part_key AS ord FROM streets"""),
    "zone_edges": ((), "SELECT zone_ord, zone_name, x1, y1, x2, y2 FROM (SELECT n_nationkey AS zone_ord, n_name AS zone_name, "
                   "-9.5e0 - (1e-2 + 2e-2 * (n_nationkey % 5)) AS lat0, -35.7e0 - (1e-2 + 2e-2 * (n_nationkey // 5)) AS lon0 FROM nation) z, LATERAL (VALUES "
                   + ", ".join(
                       f"(lon0 + ({a[0]!r}::DOUBLE), lat0 + ({a[1]!r}::DOUBLE), lon0 + ({b[0]!r}::DOUBLE), lat0 + ({b[1]!r}::DOUBLE))"
                       for a, b in zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]], strict=True)
                   ) + ") e(x1, y1, x2, y2)"),
    "terminals": ((), """
SELECT s_name AS name, round(-9.5e0 - (s_suppkey * 7 % 1000) / 10000.0e0, 7) AS lat, round(-35.7e0 - (s_suppkey * 13 % 1000) / 10000.0e0, 7) AS lon FROM supplier"""),
    "stops": (("raw_points",), """
SELECT line_key, event_id AS position, 'PONTO ' || event_id AS stop_name,
  CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 14 = 0 THEN 0.0e0 ELSE lat END AS lat, lon FROM raw_points"""),
    "active_lines": (("lines",), f"""
SELECT lpad((line_key % 10000)::VARCHAR, 4, '0') || CASE WHEN line_key >= 10000 THEN '-' || substr('BCDEFGHIJKLNOPQRSTUVWXYZ', ((line_key // 10000 - 1) % 24 + 1)::INTEGER, 1) WHEN line_key % 11 = 5 THEN '-M' WHEN line_key % 10 = 3 THEN '-A' ELSE '' END AS code,
  upper(line_name) AS name, {service(_SEGMENT)} AS service, 'EMPRESA ' || region AS company, line_key, line_key AS ord
FROM lines"""),
    "neighbourhood_streets": (("streets",), """
SELECT CASE WHEN n_nationkey % 3 = 0 THEN translate(n_name, 'AO', 'ÁÕ') ELSE n_name END AS neighbourhood,
  CASE WHEN l_orderkey % 6 = 0 THEN ' ' || manual_street || ' ' WHEN l_orderkey % 6 = 1 THEN street ELSE manual_street END AS street
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN streets ON l_partkey = part_key"""),
    "dictionary": (("streets",), """
SELECT part_key AS id, CASE WHEN part_key % 10 = 9 THEN 'REVISAR: ' || manual_street
  ELSE CASE WHEN length(part_key::VARCHAR) < 5 THEN lpad(part_key::VARCHAR, 5, '0') ELSE part_key::VARCHAR END || ' ' || manual_street
    || CASE WHEN part_key % 10 = 8 THEN ' 0000' ELSE '' END END AS name
FROM streets"""),
    "document_lines": ((), """
SELECT doc_id, source, generate_subscripts(t, 1) - 1 AS line_no, unnest(t) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS t FROM documents)"""),
    "street_index": (("named_itinerary",), f"""
SELECT norm_street, line_id, direction, occ_ord, line_name, street_code, min(occ_ord) OVER (PARTITION BY norm_street) AS key_ord FROM (
  SELECT {n1('street')} AS norm_street, line_id, direction, min((ord, d, seq)) AS occ_ord, arg_min(line_name, (ord, d, seq)) AS line_name,
    arg_min({{'c': street_code}}, (ord, d, seq)).c AS street_code FROM named_itinerary GROUP BY ALL)"""),
    "distinct_streets": (("named_itinerary",), f"""
SELECT {n2('street')} AS key, arg_min(street, (ord, d, seq)) AS street, arg_min(street_code, (ord, d, seq)) FILTER (street_code IS NOT NULL) AS street_code,
  arg_min(match, (ord, d, seq)) AS match, count(*) AS occurrences, min((ord, d, seq)) AS first_seen
FROM (SELECT * REPLACE ({strip('street')} AS street) FROM named_itinerary) WHERE street <> '' GROUP BY 1"""),
}


def sql(body: str, *ctes: str) -> str:
    """``body`` preceded by the derivations it names and whatever they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in ctes:
        visit(name)
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][1].strip()})" for name in ordered)
    # a body with its own CTEs continues the list
    glue = ",\n" if body.lstrip().startswith("AND_WITH ") else "\n"
    return f"WITH {head}{glue}{body.lstrip().removeprefix('AND_WITH ')}"
