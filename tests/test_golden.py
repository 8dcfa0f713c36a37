"""Golden values and small state machines (values as stated in FIXTURES.md)."""

import json
import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from transitframe import rules
from transitframe.functions import codes, geo, similarity, values
from transitframe.functions import text as tx
from transitframe.operators import aggregates, joins, lookup, merge, numbering, ordered, reconcile, resolve, rings, spatial
from transitframe.sources import files, kml, reports, writers


def one(spark, column, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [x[0] for x in df.select(column).collect()]


@pytest.mark.parametrize(
    "name,line_id",
    [
        ("1000 A - Trapiche / Pontal", "ln-001692156d"),
        ("4006 - T.I Benedito Bentes / Mocambo", "ln-295355acfc"),
        ("0707 - Graciliano Ramos / Ponta Verde", "ln-62720f2f88"),
        ("0805 - T.I. Benedito Bentes / Guaxuma", "ln-9caa9f66ec"),
        ("0603 - Vergel / Mirante", "ln-f77e049d9b"),
    ],
)
def test_line_id(spark, name, line_id):
    assert one(spark, codes.line_id("v"), name) == [line_id]


def test_line_codes(spark):
    names = ["0027 - VILA", "M001 - VILA", "0001-M - VILA", "0612 A - VILA", "0209 - C DAS ALMAS/VERGEL", "TERMINAL", "12/34", "0033 Jose Tenorio"]
    assert one(spark, codes.line_code("v"), *names) == ["0027", "0001M", "0001M", "0612A", "0209C", None, "0012", "0033"]
    assert one(spark, codes.with_alias(codes.line_code("v"), rules.ALIAS_APPLY), "0209 - C DAS ALMAS/V") == ["0209"]


def test_normalisation(spark):
    assert one(spark, tx.norm_key("v"), "1° ROTATÓRIA - JARDIM ROYAL") == ["1 ROTATORIA JARDIM ROYAL"]
    assert one(spark, tx.norm_index("v"), "VERGEL(STº EDUARDO)") == ["VERGEL STO EDUARDO "]
    assert one(spark, tx.norm_key("v"), "VERGEL(STº EDUARDO)") == ["VERGEL STO EDUARDO"]


def test_normalisation_equals_unicode_definition(spark):
    def plain(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).upper().strip()
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s).split())

    rng = random.Random(11)
    pool = "abcXYZ 09.-/()ãçéÍôüñÀßºª½ﬁ…™́ ǆ№ＡＺ"
    samples = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    assert one(spark, tx.norm_key("v"), *samples) == [plain(s) for s in samples]


def test_address(spark):
    got = one(
        spark, codes.street_of_address("v"), "Terminal Integrado, Rua Quarenta e Três, Benedito Bentes, Maceió", "", "12, Brasil, Conjunto Feliz", "5, 6"
    )
    assert got == ["RUA QUARENTA E TRÊS", rules.UNKNOWN_STREET, "CONJUNTO FELIZ", "5"]


def test_expansion_profiles(spark):
    assert one(spark, codes.expand("v", "registry"), "AV.DR. JOSÉ T.I. X", "R JOAO") == ["AVENIDA DOUTOR JOSÉ TERMINAL INTEGRADO X", "RUA JOAO"]
    assert one(spark, codes.expand("v", "code_match"), "Av. Pres. Kennedy") == ["AVENIDA PRESIDENTE KENNEDY"]
    assert one(spark, codes.expand("v", "merge"), "t.i benedito", "CONJ. STº ANTONIO") == ["TERMINAL INTEGRADO benedito", "CONJUNTO SANTO ANTONIO"]
    assert one(spark, codes.expand("v", "address"), "Pça. Dr. Souza", "A V . Brasil") == ["PRAÇA DOUTOR SOUZA", "AVENIDA BRASIL"]


def test_title_case_after_accent(spark):
    assert one(spark, tx.title_case("v"), "RUA JOSÉ DA SILVA (VILA)") == ["Rua José Da Silva (Vila)"]


def test_sequence_ratio_trap(spark):
    df = spark.createDataFrame([("RUA OTACILIO DE JESUS", "RUA TARCISIO DE JESUS")], "a string, b string")
    got = df.select(similarity.sequence_ratio("a", "b")).first()[0]
    assert got == SequenceMatcher(None, "RUA OTACILIO DE JESUS", "RUA TARCISIO DE JESUS").ratio() and round(got, 2) == 0.90


def test_weighted_percent():
    assert similarity.weighted_percent("RUA A", "RUA A") == 100.0
    assert similarity.weighted_percent("LIMA RUA", "RUA LIMA") == 95.0


# --- published sample documents ---------------------------------------------------------------------------


def fixture_streets(spark):
    rows = [
        ("00642", "RUA DO COMÉRCIO"), ("00642", "RUA DO CRUZEIRO"), ("00050", "AVENIDA MONTE CASTELO"), ("00050", "TRAVESSA MONTE CASTELO"),
        ("00162", "AVENIDA MUNIZ FALCAO"), ("00162", "AVENIDA MUNIZ FALCÃO"), ("06653", "RUA PERIMETRAL 2"), ("06653", "RUA PERIMETRAL 4"), ("06653", "RUA PERIMETRAL 5"),
        ("00001", "RUA UNICA"),
    ]
    return spark.createDataFrame([(c, s, i, "ida", 0) for i, (c, s) in enumerate(rows)], "street_code string, street string, ord int, direction string, seq int")


def test_spellings_and_canonical(spark):
    from transitframe.plans import quality

    kinds = {r.street_code: r.kind for r in quality.same_code_different_names(fixture_streets(spark)).collect()}
    assert kinds == {"00642": "NOME DIFERENTE", "00050": "NOME DIFERENTE", "00162": "ACENTO", "06653": "NOME DIFERENTE"}
    manual = spark.createDataFrame([("Rua do Comercio",)], "street string")
    rule = {r.street_code: (r.rule, r.canonical) for r in resolve.canonical_by_code(fixture_streets(spark), manual).collect()}
    assert rule["00642"] == ("manual", "RUA DO COMÉRCIO") and rule["00162"] == ("accent", "AVENIDA MUNIZ FALCÃO") and rule["06653"] == ("pending", None)


def test_company_totals(spark):
    base = [(2022, "CIMA", 28174), (2022, "REAL", 67270), (2022, "SFRA", 27752), (2026, "CIMA", 21521), (2026, "REAL", 55303), (2026, "SFRA", 24091)]
    rows = [(y, c, "passengers", v, None) for y, c, v in base] + [(2026, c, "trips", v, None) for c, v in (("CIMA", 397), ("REAL", 731), ("SFRA", 287))]
    figures = spark.createDataFrame(rows, "year int, company string, metric string, base long, company_extra long")
    extras = spark.createDataFrame([(2026, "trips", 200)], "year int, metric string, extra long")
    got = {(r.year, r.metric): r.total for r in aggregates.company_year(figures, extras).collect()}
    assert got == {(2022, "passengers"): 123196, (2026, "passengers"): 100915, (2026, "trips"): 1615}


def test_timetable_state_machine(spark):
    texts = ["hdr 05:00", "TERMINAL INICIAL", "09:00", "Dia Util", "05:00 05:30", "Sábado", "06:00", "PONTO FINAL", "07:00", "Domingo", "08:00"]
    lines = spark.createDataFrame([("d", i // 4, i, t) for i, t in enumerate(texts)], "doc string, page int, line_no int, text string")
    got = [(r.day_type, r.direction, r.hhmm) for r in reports.timetable_lines(lines).orderBy("page", "line_no", "pos").collect()]
    assert got == [("dia_util", "ida", "05:00"), ("dia_util", "ida", "05:30"), ("sabado", "ida", "06:00"), ("domingo", "volta", "08:00")]


def test_times(spark):
    assert one(spark, F.array_join(values.times_in("v"), ","), "08:10 x 07:00 25:10 08:10") == ["07:00,08:10"]


# --- ordered operators ----------------------------------------------------------------------------------------


def test_one_document_with_sparse_line_numbers_is_carried_in_even_runs(spark):
    """All rows in one document, line numbers 5,000 apart: runs of equal size, the state passes through all of them."""
    n = 40_000
    lines = spark.range(n).select(F.lit("d").alias("doc"), (F.col("id") % 3 * 0 + 1).alias("page"), (F.col("id") * 5000).alias("line_no"), F.col("id").alias("i"))
    sizes = sorted(r["count"] for r in ordered.segments(lines, ["doc"], ["page", "line_no"]).groupBy("_part").count().collect())
    assert len(sizes) > 1 and sizes[-1] < 4 * sizes[len(sizes) // 2]
    state = ordered.carry_forward(lines, ["doc"], ["page", "line_no"], {"a": F.when(F.col("i") == 7, "first"), "b": F.when(F.col("i") % 9000 == 0, F.col("i"))})
    wrong = state.filter(~F.col("a").eqNullSafe(F.when(F.col("i") >= 7, "first")) | (F.col("b") != F.floor(F.col("i") / 9000) * 9000))
    assert state.count() == n and wrong.count() == 0


def test_block_operators_match_plain_loops(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, None, "a", "b"]), rng.random()) for g in range(3) for i in range(57)]
    df = spark.createDataFrame(rows, "g int, t int, s string, v double")
    block = F.floor(F.col("t") / 10)
    carried = {(r.g, r.t): r.e for r in ordered.carry_forward(df, ["g"], ["t"], {"e": F.col("s")}).collect()}
    summed = {(r.g, r.t): r.c for r in ordered.running_sum(df, ["g"], ["t"], block, "v", "c").collect()}
    numbered = {(r.g, r.t): r.n for r in ordered.number_rows(df.filter("t % 2 = 0"), ["g"], ["t"], block, "n").collect()}
    for g in range(3):
        last, total, n = None, 0.0, 0
        for _, t, s, v in [r for r in rows if r[0] == g]:
            last, total = s or last, total + v
            assert carried[(g, t)] == last and abs(summed[(g, t)] - total) < 1e-9
            if t % 2 == 0:
                assert numbered[(g, t)] == n
                n += 1


def test_global_ordinal(spark):
    df = spark.range(0, 500, numPartitions=7).select((F.col("id") * 37 % 500).alias("k"))
    got = {r.k: r.n for r in ordered.global_ordinal(df, ["k"], "n", start=1).collect()}
    assert got == {k: k + 1 for k in range(500)}


def test_unique_sheet_names_follow_the_sequential_rule(spark):
    titles = ["X", "X", "X (2)", "X", "X (3)", "X (2)", "", "linha", "Y" * 40, "Y" * 31, "a/b", "a-b", "X"]
    used, expected = set(), []
    for title in titles:
        base = "".join("-" if c in "\\/*?:[]" else c for c in title).strip()[:31] or "linha"
        name, n = base, 2
        while name in used:
            suffix = f" ({n})"
            name, n = base[: 31 - len(suffix)] + suffix, n + 1
        used.add(name)
        expected.append(name)
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(titles)], "company string, ord int, title string")
    got = [r.sheet for r in numbering.unique_sheet_names(df, ["company"]).orderBy("ord").collect()]
    assert got == expected


# --- clusters, duplicates, geometry --------------------------------------------------------------------------------


def greedy(names):
    words = {n: {w for w in n.split() if len(w) >= 3} for n in names}

    def alike(a, b):
        return bool(words[a] and words[b]) and len(words[a] & words[b]) / len(words[a] | words[b]) >= 0.5

    used, out = set(), {}
    for i, a in enumerate(names):
        if a in used:
            continue
        group = [a] + [b for b in names[i + 1 :] if b not in used and alike(a, b)]
        if len(group) > 1:
            used.update(group)
            out[a] = sorted(group)
    return out


def test_clusters_match_the_greedy_rule(spark):
    rng = random.Random(8)
    vocabulary = ["ALFA", "BETA", "GAMA", "DELTA", "EPSILON", "ZETA"]
    names = list(dict.fromkeys(" ".join(rng.sample(vocabulary, rng.randint(1, 4))) for _ in range(70)))
    df = spark.createDataFrame([(n, i, "ida", 0) for i, n in enumerate(names)], "street string, ord int, direction string, seq int")
    got = {}
    for r in resolve.similar_name_clusters(df).collect():
        got.setdefault(r.leader, []).append(r.street)
    assert {k: sorted(v) for k, v in got.items()} == greedy(names)


def test_ambiguous_groups_match_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = ["ALFA", "BETA", "GAMA", "DELTA", "EPSILON", "ZETA", "ETA1"]
    rows = []
    for g in range(60):
        shared = rng.sample(vocabulary, 3)
        for i in range(rng.randint(1, 5)):
            rows.append((f"{g:04d}", "ida", f"{g:04d} - " + " ".join(shared[: rng.randint(0, 3)] + rng.sample(vocabulary, rng.randint(0, 3))), f"p{g}-{i}", 5, i))
    df = spark.createDataFrame(rows, "line_code string, direction string, line_name string, path_id string, n_points int, ord int")

    def words(name):
        return {w for w in name.split(" - ", 1)[1].split() if len(w) >= 3}

    expected = set()
    for code in {r[0] for r in rows}:
        sets = [words(r[2]) for r in rows if r[0] == code]
        pairs = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
        if any((len(a & b) / len(a | b) if a and b else 0.0) < 0.25 for a, b in pairs):
            expected.add(code)
    assert {r.line_code for r in merge.ambiguous_groups(df).collect()} == expected


def test_ring_contains_matches_ray_casting(spark):
    rng = random.Random(6)
    ring = [(rng.randint(0, 10), rng.randint(0, 10)) for _ in range(9)]
    points = [(rng.randint(0, 20) / 2, rng.randint(0, 20) / 2) for _ in range(300)]

    def inside(x, y):
        odd, n = False, len(ring)
        for i in range(n):
            (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
            if min(y1, y2) < y <= max(y1, y2) and x <= max(x1, x2) and (x1 == x2 or x <= (y - y1) * (x2 - x1) / (y2 - y1) + x1):
                odd = not odd
        return odd

    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "lon double, lat double")
    shape = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring])
    got = [r[0] for r in df.select(geo.ring_contains(F.col("lon"), F.col("lat"), shape)).collect()]
    assert got == [inside(x, y) for x, y in points]


def test_zone_share_first_zone_wins(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    zones = spark.createDataFrame([(0, "A", square(0.0, 2.0)), (1, "B", square(1.0, 3.0))], "zone_ord int, zone_name string, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([("l", 1.5, 1.5), ("l", 2.5, 2.5), ("l", 9.0, 9.0), ("l", 0.5, 0.5)], "line_id string, lon double, lat double")
    got = {r.zone_name: (r.points, r.percent) for r in spatial.zone_share(points, zones, 0.7).collect()}
    assert got == {"A": (2, 50.0), "B": (1, 25.0), rules.OUTSIDE_ZONES: (1, 25.0)}


def test_resample_matches_definition(spark):
    import math

    path = [(-9.60, -35.70), (-9.601, -35.70), (-9.601, -35.703), (-9.605, -35.71)]
    r = rules.MERCATOR_RADIUS_M
    xy = [(math.radians(lon) * r, math.log(math.tan(math.radians(lat) / 2 + math.pi / 4)) * r) for lat, lon in path]
    steps = [math.dist(a, b) for a, b in zip(xy, xy[1:])]
    length, expected, at = sum(steps), [], 0.0
    while at < length:
        rest, i = at, 0
        while rest > steps[i]:
            rest -= steps[i]
            i += 1
        x, y = (xy[i][k] + (xy[i + 1][k] - xy[i][k]) * rest / steps[i] for k in (0, 1))
        expected.append((math.degrees(2 * math.atan(math.exp(y / r)) - math.pi / 2), math.degrees(x / r)))
        at += 25.0
    expected.append(path[-1])
    rows = [("l", i, lat, lon) for i, (lat, lon) in enumerate(path)] + [("one", 0, 1.0, 2.0), ("same", 0, 3.0, 4.0), ("same", 1, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "line string, seq int, lat double, lon double")
    got = spatial.resample(df, ["line"]).orderBy("line", "seq").collect()
    main = [(x.lat, x.lon) for x in got if x.line == "l"]
    assert len(main) == len(expected) and all(abs(a - b) < 1e-9 for p, q in zip(main, expected) for a, b in zip(p, q))
    assert [(x.line, x.lat) for x in got if x.line != "l"] == [("one", 1.0), ("same", 3.0), ("same", 3.0)]


def test_street_cascade(spark):
    registry = spark.createDataFrame(
        [("00001", "AV. FERNANDES LIMA", 0), ("00002", "RUA DO SOL (CENTRO)", 1), ("00003", "PARQUE RODOLFO LINS PIRULITO", 2), ("00004", "RUA BARAO DE PENEDO", 3)],
        "street_code string, street string, ord int",
    )
    coded = spark.createDataFrame([("0001", "volta", "R. DA PAZ", "00009", 0), ("0001", "ida", "RUA SANTA LUCIA", "00010", 1)], "line_num string, direction string, street string, street_code string, ord int")
    asked = ["RUA DA PAZ", "AVENIDA FERNANDES LIMA", "RUA DO SOL", "PARQUE RODOLFO LINS PIRULIT", "RUA SANTA LUSIA", "RUA BARAO DE PENEDOS", "XYZ"]
    queries = spark.createDataFrame([("0001", "ida", s) for s in asked] + [("", "ida", "RUA BARAO DE PENED")], "line_num string, direction string, street string")
    got = {(r.line_num, r.street): (r.street_code, r.match) for r in resolve.resolve_streets(queries, coded, registry).collect()}
    assert got[("0001", "RUA DA PAZ")] == ("00009", "exato")
    assert got[("0001", "AVENIDA FERNANDES LIMA")] == ("00001", "exato_global")
    assert got[("0001", "RUA DO SOL")] == ("00002", "exato_sem_complemento")
    assert got[("0001", "RUA SANTA LUSIA")] == ("00010", "fuzzy")
    assert got[("0001", "PARQUE RODOLFO LINS PIRULIT")] == ("00003", "fuzzy_global")  # the line has streets of its own
    assert got[("0001", "RUA BARAO DE PENEDOS")] == ("00004", "fuzzy_global")
    assert got[("", "RUA BARAO DE PENED")] == ("00004", "contem")
    assert got[("0001", "XYZ")] == (None, "nao_encontrado")


def test_street_search_and_window(spark):
    rows = [("l1", "0001 - A", 0, "ida", 0, "AV. FERNANDES LIMA", "7"), ("l1", "0001 - A", 0, "ida", 1, "Av Fernandes Lima", "8"), ("l2", "0002 - B", 1, "volta", 0, "AV. FERNANDES LIMA", None)]
    itinerary = spark.createDataFrame(rows, "line_id string, line_name string, ord int, direction string, seq int, street string, street_code string")
    index = lookup.street_index(itinerary)
    assert {(r.line_id, r.street_code) for r in lookup.search_streets(index, "fernandes lima").collect()} == {("l1", "7"), ("l2", None)}
    assert lookup.search_streets(index, "").count() == 0
    timetable = spark.createDataFrame([("0001", "dia_util", "ida", "05:10", 310), ("0002", "dia_util", "ida", "05:10", 310)], "line_code string, day_type string, direction string, hhmm string, minute_of_day int")
    got = lookup.search_streets_at(index, timetable, "lima", "05:00").collect()
    assert [(r.line_id, r.near_times) for r in got] == [("l1", "05:10")]
    with pytest.raises(ValueError):
        lookup.geojson_features(itinerary, "norte")


# --- sources and sinks ------------------------------------------------------------------------------------------------


def test_unified_map_keeps_order_and_last_duplicate(spark):
    text = '{"B - x": {"ida": {"coordenadas": [[1, 2], [3], [4, 5]], "ruas": [{"via": "R. A", "codigo": null, "match": "exato"}]}}, "A - y": {"volta": {"coordenadas": [], "ruas": []}}}'
    lines, points, streets = files.read_unified(spark.createDataFrame([(text,)], "value string"))
    assert [r.line_name for r in lines.orderBy("ord").collect()] == ["B - x", "A - y"]
    assert [(r.seq, r.lat, r.lon) for r in points.orderBy("seq").collect()] == [(0, 1.0, 2.0), (2, 4.0, 5.0)]
    assert [(r.street, r.street_code, r.match) for r in streets.collect()] == [("R. A", None, "exato")]


def test_kml_round_trip(spark, tmp_path):
    rows = [("l1", "0002 - BAR & COL", "ida", 0, -9.5, -35.7), ("l1", "0002 - BAR & COL", "ida", 1, -9.6, -35.8), ("l2", "M001 - NOR", "volta", 0, -9.1, -35.1), ("l3", "0001 - ALTO", "ida", 0, -9.2, -35.2)]
    points = spark.createDataFrame(rows, "line_id string, line_name string, direction string, seq int, lat double, lon double")
    order = ["folder", "sort_number", "sort_suffix", "line_name", "line_id", "seq"]
    writers.write_fragments(writers.kml_fragments(points), order, str(tmp_path / "parts"))
    parts = sorted((tmp_path / "parts").glob("part-*"))
    document = tmp_path / "map.kml"
    document.write_text("".join(p.read_text(encoding="utf-8") for p in parts), encoding="utf-8")
    paths = kml.read_direction_folders(spark, str(document)).orderBy("ord").collect()
    assert [(p.line_code, p.direction, [(v.lat, v.lon) for v in p.points]) for p in paths] == [
        ("0001", "ida", [(-9.2, -35.2)]), ("0002", "ida", [(-9.5, -35.7), (-9.6, -35.8)]), ("0001M", "volta", [(-9.1, -35.1)]),
    ]
    assert paths[1].line_name == "0002 - BAR & COL"


def test_geojson_fragments_form_one_document(spark, tmp_path):
    rows = [("l1", "B", "ida", 0, 1.0, 2.0), ("l1", "B", "ida", 1, 3.0, 4.0), ("l2", "A", "volta", 0, 5.0, 6.0)]
    points = spark.createDataFrame(rows, "line_id string, line_name string, direction string, seq int, lat double, lon double")
    writers.write_fragments(writers.geojson_fragments(points), ["line_name", "line_id", "direction", "seq"], str(tmp_path / "g"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "g").glob("part-*")))
    features = json.loads(text)["features"]
    assert [(f["properties"]["linha_nome"], f["geometry"]["coordinates"]) for f in features] == [("A", [[6.0, 5.0]]), ("B", [[2.0, 1.0], [4.0, 3.0]])]


def test_out_of_range_coordinates_raise(spark, tmp_path):
    path = tmp_path / "a.kml"
    path.write_text("<kml><Document><Folder><name>L</name><Folder><name>IDA</name><Placemark><LineString><coordinates>200,1,0</coordinates></LineString></Placemark></Folder></Folder></Document></kml>")
    with pytest.raises(Exception, match="out of range"):
        kml.read_line_folders(spark, str(path)).collect()
    assert kml.read_line_folders(spark, str(path), strict=False).count() == 1


def test_versions_and_compare(spark, tmp_path):
    df = spark.createDataFrame([("a", "ida", 0, "X"), ("a", "ida", 1, "Y")], "line string, direction string, seq int, street string")
    writers.publish_version(df, str(tmp_path / "v"), "1")
    writers.publish_version(writers.read_current(spark, str(tmp_path / "v")).filter("seq = 0"), str(tmp_path / "v"), "2")
    assert writers.read_current(spark, str(tmp_path / "v")).count() == 1
    status = reconcile.compare_itineraries(df, writers.read_current(spark, str(tmp_path / "v")), ["line"]).first()
    assert (status.status, status.differences) == ("different", 1)


def test_reuse_codes_keeps_null_codes(spark):
    system = spark.createDataFrame([("c", "l", "ida", 0, "R. Ã", None, "exato")], "line_code string, line_id string, direction string, seq int, street string, street_code string, match string")
    manual = spark.createDataFrame([("c", "ida", 0, "R. A"), ("c", "ida", 1, "NOVA")], "line_code string, direction string, seq int, street string")
    got = [(r.street, r.street_code, r.match, r.reused) for r in joins.reuse_codes(manual, system).orderBy("seq").collect()]
    assert got == [("R. A", None, "exato", True), ("NOVA", None, "manual", False)]


def test_rings_from_shuffled_ways(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for relation in range(40):
        n = rng.choice([3, 5, 9, 40])
        ring = [(float(relation), float(i)) for i in range(n)]
        cuts = sorted(rng.sample(range(n), rng.randint(2, n)))
        closed = relation % 4 != 0
        ways = [[ring[(a + k) % n] for k in range((b - a) % n + 1 or n + 1)] for a, b in zip(cuts, cuts[1:] + cuts[:1])]
        ways = ways if closed or len(ways) < 3 else ways[1:]
        closed = closed or len(cuts) < 3
        ways = [w[::-1] if rng.random() < 0.5 else w for w in ways]
        rng.shuffle(ways)
        want[relation] = (closed, sorted({p for w in ways for p in w}))
        rows += [(relation, i, [{"lon": x, "lat": y} for x, y in w]) for i, w in enumerate(ways)]
    rows.append((99, 7, [{"lon": x, "lat": y} for x, y in [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]))
    pieces = rings.assemble_rings(spark.createDataFrame(rows, "relation long, way_ord int, path array<struct<lon:double,lat:double>>"))
    found = {}
    for r in rings.ring_vertices(pieces).orderBy("relation", "ring_ord", "position", "step").collect():
        found.setdefault((r.relation, r.ring_ord), (r.closed, []))[1].append((r.lon, r.lat))
    first = {(a, b): [(p["lon"], p["lat"]) for p in path] for a, b, path in rows}
    for (relation, ring), (closed, points) in found.items():
        if relation == 99:
            assert (ring, closed, len(points)) == (7, True, 4)
            continue
        assert ring == 0 and closed == want[relation][0] and sorted(set(points)) == want[relation][1]
        assert (points[0] == points[-1]) == closed and len(points) == len(want[relation][1]) + closed
        forward = first[relation, 0]
        assert any(points[i : i + len(forward)] == forward for i in range(len(points)))
    assert len(found) == 41
    (area,) = rings.largest_closed_ring(pieces.where("relation = 99")).collect()
    assert (area.ring_ord, area.n_points, area.area) == (7, 4, 0.5)


def test_sections_carry_over_the_blocks_of_one_page(spark):
    rows = [("d", 1, i, "IDA" if i == 10 else "VOLTA" if i == 4_990 else f"line {i}") for i in range(9_000)]
    lines = spark.createDataFrame(rows, "doc string, page int, line_no int, text string")
    event = F.when(F.col("text").isin("IDA", "VOLTA"), F.lower("text"))
    got = reports._carry(lines, {"direction": event}).groupBy("direction").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.count("*").alias("n")).collect()
    assert {(r.direction, r.a, r.b, r.n) for r in got} == {(None, 0, 9, 10), ("ida", 10, 4_989, 4_980), ("volta", 4_990, 8_999, 4_010)}
