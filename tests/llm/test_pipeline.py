"""The pipeline's stages on a small corpus with planted cases, and on odd tables."""

import random

import pytest

import corpus_pipeline
from transitframe.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, items):
    for name, rows, schema in (("documents", docs, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    say = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    docs, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = say(rng.randint(40, 120)).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["scum", "moron", "trash"]))
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        if i < 550:
            labels.append((i, 1, int(toxic)))
    item = say(30)
    docs[7] = (7, docs[7][1] + " mail a.b@c.de now", "en", "s1", 0)
    docs[11] = (11, say(20) + " " + item[:200] + " " + say(20), "en", "s2", 0)
    docs += [(1000, docs[1][1], "en", "s1", 0), (1001, docs[1][1] + " extra", "en", "s1", 0), (1002, None, None, None, None), (1003, "", "en", "s0", 0), (1001, docs[1][1] + " extra", "en", "s1", 0)]
    return write(spark, tmp_path_factory.mktemp("sf"), docs, labels, [(1, item)])


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "decontamination", "personal_data", "mixing"]
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    toxic = {i for i in range(600) if i % 6 == 0}
    assert len(left & toxic) <= 5 and len(set(before) - toxic - left) <= 5
    one = stages["jaccard_join"](spark, docs, folder)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(before) - {1000, 1001}
    off = stages["decontamination"](spark, docs, folder)
    assert off.columns == docs.columns and {r.doc_id for r in off.collect()} == set(before) - {11}
    safe = stages["personal_data"](spark, docs, folder)
    assert safe.columns == docs.columns and safe.schema == docs.schema
    rows = {r.doc_id: r for r in safe.collect()}
    assert rows[7].text == before[7].text.replace("a.b@c.de", "[EMAIL]") and rows[7].n_chars == len(rows[7].text)
    assert all(rows[i].text == before[i].text for i in before if i != 7) and rows[1002].n_chars is None
    mixed = stages["mixing"](spark, docs, folder)
    assert set(docs.columns) < set(mixed.columns) and {r.doc_id for r in mixed.collect()} <= set(before)


def test_whole_run(spark, folder):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert ids and not ids & {11, 1000, 1001}


def test_empty_tables_and_extra_columns(spark, tmp_path):
    folder = write(spark, tmp_path / "a", [], [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], COLUMNS).selectExpr("*", "1 as toxic", "2 as score", "3 as spans", "4 as key", "5 as mix_copy", "6 as items")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[:6] == docs.columns[:6], name
        assert [r.doc_id for r in out.collect()] == [1], name


def test_one_query_each():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
