"""Decontamination against brute force, and its edge cases."""

import hashlib
import random
import re

from transitframe.llm import decontaminate as dc


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, size=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(size, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [*"abcdefgh", "Éa", "éa", "K", "K", "x1", "İ"]
    say = lambda n: rng.choice([" ", ", ", "\n-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 4, 6, 9]))) for i in range(12)] + [(99, None), (1, "Q q Q q Q"), (None, "z z z z")]
    docs = [(i, say(rng.choice([0, 1, 3, 8, 30, 60]))) for i in range(60)] + [(60, None), (61, "..."), (62, "q Q q q q Q"), (62, "other"), (None, "z Z z z z")]
    got = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), size=4)
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    want = [r for r in brute(docs, [x for x in items if x[0] is not None], 4) if r[0] is not None]
    assert [r for r in rows if r[0] is not None] == want
    assert [r[:3] for r in rows if r[0] is None] == [(None, 5, 5)]


def test_removal_keeps_clean_rows_and_columns(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, f"Before. {passage}, after", 1), (2, "nothing here", 2), (3, None, 3), (2, passage.upper(), 4), (2, "nothing here", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int").selectExpr("*", "spans as items", "spans as id")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.spans for r in kept.collect()) == [2, 2, 3]
    cut = {r.spans: r.text for r in dc.decontaminate(docs, items, remove="spans").collect()}
    assert cut == {1: "Before. after", 2: "nothing here", 3: None, 4: ""}


def test_long_text_and_empty_tables(spark):
    body = " ".join(f"v{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(5000, 5400)))], "item_id long, text string")
    row = dc.contamination(docs, items).first()
    assert (row.n_words, row.n_hit, row.n_items) == (100_000, 400, 1)
    assert dc.contamination(docs.limit(0), items).collect() == []
    assert not dc.contamination(docs, items.limit(0)).first().contaminated


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = dc.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
