"""Resolution operators without a SQL form, against brute force over all pairs of a small fixture."""

import random
from difflib import SequenceMatcher, get_close_matches

from transitframe import rules
from transitframe.functions import similarity
from transitframe.operators import aggregates, resolve

TYPES = ["RUA", "AVENIDA", "TRAVESSA", "PRACA"]
NAMES = ["SANTA LUCIA", "SANTA LUZIA", "JOSE DA SILVA", "JOAO DA SILVA", "DO COMERCIO", "DO SOL", "MONTE CASTELO", "BARAO DE PENEDO", "OTACILIO DE JESUS", "TARCISIO DE JESUS"]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def street_names(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        name = f"{rng.choice(TYPES)} {rng.choice(NAMES)}"
        if rng.random() < 0.3:
            name += f" {rng.choice(['2', '3', 'II', 'A', 'NORTE'])}"
        if rng.random() < 0.4:
            i = rng.randrange(len(name))
            name = name[:i] + rng.choice("AEIOSRNZ") + name[i + 1 :]
        name = " ".join(name.split())
        if name not in out:
            out.append(name)
    return out


def as_itinerary(spark, names):
    rows = [(n, None if i % 3 == 0 else f"{i:05d}", "exato", i, "ida", 0, "L") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "street string, street_code string, match string, ord int, direction string, seq int, line_name string")


def core(name, prefixes):
    words = name.split()
    while words and words[0] in prefixes:
        words.pop(0)
    return words


def test_similar_pairs(spark):
    names = street_names(1, 90)
    streets = aggregates.distinct_streets(as_itinerary(spark, names))
    got = {(r.key_a, r.key_b) for r in resolve.similar_pairs(streets).collect()}
    cores = {n: core(n, rules.CORE_PREFIXES_REPORT) for n in names}
    usable = [n for n in names if len(" ".join(cores[n])) >= rules.PAIR_MIN_CORE]
    expected = {
        (a, b) for i, a in enumerate(usable) for b in usable[i + 1 :] if set(cores[a]) & set(cores[b]) and 0.82 <= ratio(a, b) < 1
    }
    assert expected and got == expected


def distinctive(name):
    known = rules.SPELLED_NUMBERS + rules.ROMAN_NUMERALS
    return {w for w in name.split() if w.isdigit() or w in known or (len(w) == 1 and w.isalpha())}


def test_duplicate_candidates(spark):
    names = sorted(street_names(2, 90))
    df = spark.createDataFrame([(n,) for n in names], "street string")
    got = {(r.street_a, r.street_b) for r in resolve.duplicate_candidates(df).collect()}
    expected = {
        (a, b) for i, a in enumerate(names) for b in names[i + 1 :] if distinctive(a) == distinctive(b) and ratio(a, b) >= 0.82
    }
    assert expected and got == expected


def test_close_matches(spark):
    left, right = street_names(3, 60), street_names(4, 60)
    names = spark.createDataFrame([(n,) for n in left], "name string")
    candidates = spark.createDataFrame([(n, i) for i, n in enumerate(right)], "candidate string, ord int")
    got = {r.name: r.candidate for r in resolve.close_matches(names, candidates).collect()}
    expected = {n: hit[0] for n in left if (hit := get_close_matches(n, right, n=1, cutoff=0.85))}
    assert expected and got == expected


def test_variant_candidates(spark):
    reference, new = street_names(5, 60), street_names(6, 60)
    df = lambda rows: spark.createDataFrame([(n, i) for i, n in enumerate(rows)], "street string, ord int")
    got = {}
    for r in resolve.variant_candidates(df(new).select("street"), df(reference)).collect():
        if r["rank"] is not None:
            got.setdefault(r.street, []).append((r["rank"], r.reference, round(r.score, 9)))

    def tokens(n):
        return {w for w in n.split() if w not in rules.STOPWORDS and len(w) > 2}

    def score(a, b):
        union = tokens(a) | tokens(b)
        return 0.5 * ratio(a, b) + 0.5 * (len(tokens(a) & tokens(b)) / len(union) if union else 0.0)

    for name in new:
        if name in reference:
            assert name not in got
            continue
        best = sorted(((score(name, r), r, r) for r in reference if score(name, r) >= 0.5), reverse=True)[:3]
        assert [x[1:] for x in sorted(got.get(name, []))] == [(r, round(s, 9)) for s, r, _ in best]


def test_street_cascade_against_loops(spark):
    rng = random.Random(9)
    registry = [(f"{i:05d}", n, i) for i, n in enumerate(street_names(10, 40))]
    coded = [(f"{rng.randint(1, 3):04d}", rng.choice(rules.DIRECTIONS), n, f"9{i:04d}", i) for i, n in enumerate(street_names(11, 40))]
    asked = [(f"{rng.randint(1, 5):04d}" if rng.random() < 0.8 else "", rng.choice(rules.DIRECTIONS), n) for n in street_names(12, 80)]

    everywhere, lines = {}, {}
    for code, name, _ in registry:
        everywhere.setdefault(name, code)
    for line, side, name, code, _ in coded:
        lines.setdefault(line, {"ida": {}, "volta": {}})[side][name] = code

    def best(query, options):
        top, value = 0.0, None
        for name, code in options:
            if ratio(query, name) > top:
                top, value = ratio(query, name), code
        return value if top >= 0.82 else None

    def resolve_one(line, side, name):
        own = lines.get(line, {"ida": {}, "volta": {}}) if line else {"ida": {}, "volta": {}}
        for options in (own[side], own["ida"], own["volta"]):
            if name in options:
                return options[name], "exato"
        if name in everywhere:
            return everywhere[name], "exato_global"
        if len(name) >= 8:
            for other, code in ({**own["ida"], **own["volta"]} or everywhere).items():
                if (name in other or other in name) and min(len(name), len(other)) / max(len(name), len(other)) >= 0.70:
                    return code, "contem"
        hit = best(name, [*own["ida"].items(), *own["volta"].items()])
        if hit:
            return hit, "fuzzy"
        hit = best(name, everywhere.items())
        return (hit, "fuzzy_global") if hit else (None, "nao_encontrado")

    got = resolve.resolve_streets(
        spark.createDataFrame(asked, "line_num string, direction string, street string"),
        spark.createDataFrame(coded, "line_num string, direction string, street string, street_code string, ord int"),
        spark.createDataFrame(registry, "street_code string, street string, ord int"),
    ).collect()
    assert {(r.line_num, r.direction, r.street): (r.street_code, r.match) for r in got} == {q: resolve_one(*q) for q in asked}
    assert len({r.match for r in got}) >= 4


def test_merge_with_system_names_sharing_a_code(spark):
    """Lines of one code list the same streets at the same places: they count once for each line name."""
    system = [("1A", "ida", i, s) for i, s in enumerate(["RUA DO SOL", "R. DAS FLORES NOVAS", "AV. MONTE CASTELO", "RUA B"])]
    system = system * 2 + [("1A", "ida", 1, "RUA DAS FLORES NOVAS"), ("2", "ida", 0, "RUA DO SOL"), ("2", "volta", 0, None), ("9", "ida", 0, "RUA X")]
    manual = [("1A", "1 A - X", "ida", 0, "RUA DO SOL"), ("1A", "1 A - X", "ida", 1, "RUA FLORES NOVAS"), ("1A", "1 A - Y", "ida", 0, "RUA B"), ("2", "2 - Z", "ida", 0, None)]
    merged, pairs, extras = resolve.merge_with_system(
        spark.createDataFrame(manual, "line_code string, line_name string, direction string, seq long, street string"),
        spark.createDataFrame(system, "line_code string, direction string, seq long, street string"),
    )
    assert sorted((tuple(r) for r in merged.collect()), key=repr) == sorted(manual, key=repr)
    assert [tuple(r) for r in pairs.collect()] == [("1A", "1 A - X", "ida", 1, "RUA FLORES NOVAS", "RUA DAS FLORES NOVAS", 0.75)]
    assert sorted((tuple(r) for r in extras.collect()), key=repr) == sorted([
        ("1A", "1 A - X", "ida", 2, "AVENIDA MONTE CASTELO"), ("1A", "1 A - Y", "ida", 1, "RUA DAS FLORES NOVAS"), ("1A", "1 A - Y", "ida", 2, "AVENIDA MONTE CASTELO"),
        ("2", "2 - Z", "ida", 0, "RUA DO SOL"), ("2", "2 - Z", "volta", 0, None),
    ], key=repr)


def test_street_cascade_compares_a_key_once_per_line(spark, monkeypatch):
    """A street of both directions is one candidate of its line, and candidates carry no hits through the comparison."""
    compared, plain = [], resolve.ratio_join

    def counted(left, right, *rest, **more):
        if more.get("on"):
            compared.append((right.count(), sorted(right.columns)))
        return plain(left, right, *rest, **more)

    monkeypatch.setattr(resolve, "ratio_join", counted)
    lined = [("0001", way, "RUA JOSE DA SILVA", code, i) for i, (way, code) in enumerate([("volta", "00002"), ("ida", "00001"), (None, "00003")])]
    lined = spark.createDataFrame(lined, "line_num string, direction string, street string, street_code string, ord long")
    queries = [("0001", "volta", "RUA JOSE DA SILVA"), ("0001", None, "RUA JOSE DA SILVA"), ("0001", "volta", "RUA JOAO DA SILVA"), ("0001", "ida", None)]
    queries = spark.createDataFrame(queries, "line_num string, direction string, street string")
    registry = spark.createDataFrame([("00009", "LADEIRA DO SOL", 1)], "street_code string, street string, ord long")
    rows = {(r.direction, r.street): (r.street_code, r.match) for r in resolve.resolve_streets(queries, lined, registry).collect()}
    assert rows == {
        ("volta", "RUA JOSE DA SILVA"): ("00002", "exato"), (None, "RUA JOSE DA SILVA"): ("00001", "exato"),
        ("volta", "RUA JOAO DA SILVA"): ("00001", "fuzzy"), ("ida", None): (None, "nao_encontrado"),
    }
    assert compared == [(1, ["line_num", "norm", "pos"])]
