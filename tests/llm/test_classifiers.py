"""Language, quality and toxicity: held-out accuracy, folds, and edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from transitframe.llm import langid, quality, toxicity
from transitframe.llm.common import bounded_sample, part_of

WORDS = {"en": "the of and to in is that it was for with".split(), "de": "der die und in den von zu das mit sich für".split(),
         "fr": "le de un à être et en avoir que pour été".split()}


def say(rng, lang, n):
    stems = {"en": "ing tion er", "de": "ung keit sch", "fr": "eau ment que"}[lang].split()
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


EDGES = [(1001, None), (1002, ""), (1003, "123 !!! \n"), (1004, "é"), (None, "the of"), (1005, "the and of " * 60_000), (1, "the of and"), (1, "the of and")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, say(rng, lang, rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(300))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_language(spark, docs):
    held = part_of("doc_id", 3) == 1
    model = langid.fit(docs.where(~held))
    assert (model.weights == 0).mean() > 0.5  # sparse
    got = langid.identify(docs.withColumn("lang_pred", F.col("lang")), model, {"doc_id": F.col("doc_id"), "held": held, "lang": F.col("lang")}).where("held").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    edges = spark.createDataFrame(EDGES, "doc_id long, text string")
    rows = langid.identify(edges, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert [(by[i].lang_pred, by[i].score) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert by[1004].lang_pred in WORDS and by[1005].lang_pred == "en" and by[1].lang_pred == "en"


def test_language_without_rows(spark, docs):
    model = langid.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, model, {"doc_id": F.col("doc_id")}).collect()} == {("und", 0.0)}
    one = langid.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in langid.identify(docs, one, {"doc_id": F.col("doc_id")}).collect()} == {"de"}
    assert langid.identify(docs.limit(0), model, {"doc_id": F.col("doc_id")}).collect() == []


def test_frequencies_cover_every_row(docs):
    idf = langid.inverse_frequencies(docs.select("text"))
    rows = [r.text for r in docs.collect()]
    seen = np.zeros(langid.DIM)
    for text in rows:
        seen[langid.ngram_counts(text)[0]] += 1
    assert np.allclose(idf, np.log((1 + len(rows)) / (1 + seen)) + 1)


def test_temperature_is_honest():
    rng = np.random.RandomState(0)
    true = rng.normal(size=(4000, 3))
    p = np.exp(true) / np.exp(true).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert 2.5 < langid.temperature(true * 3, labels) < 3.5


def junk(rng, n):
    words = say(rng, "en", n).split()
    return rng.choice([" ".join(w + rng.choice(["###", "$$$"]) for w in words), " ".join([words[0]] * n), " ".join(w.upper() + "!!" for w in words)])


def test_quality(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        good = rng.random() < 0.8
        rows.append((i, say(rng, "en", rng.randint(20, 80)) if good else junk(rng, rng.randint(20, 80)), int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").selectExpr("*", "quality as score", "text as _s_chars")
    model = quality.fit(docs, docs.where(part_of("doc_id", 5) != 0))
    got = quality.score(docs, model, {"doc_id": F.col("doc_id"), "held": part_of("doc_id", 5) == 0, "y": F.col("quality")}).where("held").collect()
    assert np.mean([(r.score >= 0.3) == (r.y == 1) for r in got]) > 0.95
    assert 0 < len(model.rules) < 200
    # the compiled column equals the rules applied in numpy
    table = quality.with_statistics(docs, "text").select("doc_id", *[f"_s_{s}" for s in quality.STATISTICS]).orderBy("doc_id").collect()
    expected = model.scores(np.array([r[1:] for r in table], float))
    scored = [r.score for r in quality.score(docs, model, {"doc_id": F.col("doc_id")}).orderBy("doc_id").collect()]
    assert np.allclose(expected, scored)
    edges = quality.score(spark.createDataFrame(EDGES, "doc_id long, text string"), model, {"doc_id": F.col("doc_id")}).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    for part, score in ((docs.limit(0), 0.5), (docs.where("quality = 1"), 0.999)):
        one = quality.fit(docs, part)
        assert {round(r.score, 6) for r in quality.score(docs, one, {"doc_id": F.col("doc_id")}).collect()} == {score}


def test_lasso_leaves_noise_out():
    rng = np.random.RandomState(1)
    x = (rng.rand(500, 20) < 0.5).astype(float)
    y = (rng.rand(500) < np.where(x[:, 3] > 0, 0.9, 0.1)).astype(float)
    weights, _ = quality.lasso(x, y, 0.02)
    assert np.argmax(np.abs(weights)) == 3 and (weights == 0).sum() >= 15


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["scum", "moron", "trash"]
    rows = []
    for i in range(900):
        toxic, lang = rng.random() < 0.2, rng.choice(["en", "de"])
        words = say(rng, lang, rng.randint(5, 200)).split() + [f"u{i}x{k}" for k in range(30)]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "***", "."]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    model = toxicity.fit(docs, docs.where(part_of("doc_id", 5) != 0))
    got = toxicity.score(docs.withColumn("score", F.lit(7)), model, {"doc_id": F.col("doc_id"), "held": part_of("doc_id", 5) == 0, "y": F.col("toxic")}).where("held").collect()
    hits = sum(r.y == 1 and r.score >= 0.5 for r in got)
    assert hits >= 0.9 * sum(r.y for r in got)
    assert sum(r.y == 0 and r.score >= 0.5 for r in got) <= 0.02 * len(got)
    tail = spark.createDataFrame([(1, "the of and " * 50_000 + "Moron!"), (2, "the of and " * 50_000), *EDGES], "doc_id long, text string")
    long = toxicity.score(tail, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(long) == len(EDGES) + 2 and all(0 <= r.score <= 1 for r in long)
    assert long[0].score >= 0.5 > long[1].score
    for part in (docs.limit(0), docs.where("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, part), {"doc_id": F.col("doc_id")}).collect()} == {0.0}


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A word that stands in four of 9,000 labelled rows is in the counts, whatever parts the rows are dealt into."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 2500)
    rows = [(i, f"plain words of row {'zyx' if i % 2250 == 7 else 'abc'} {'scum' if i % 3 == 0 else 'fine'}", "en", int(i % 3 == 0)) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    model = toxicity.fit(docs, docs, epochs=1)
    hashes, _ = next(toxicity.hashed_words(pa.array(["zyx row"])))
    counts = np.exp(model.words_by_language[toxicity._rows(hashes)[0], 0])
    assert np.isclose(counts[1] / counts[0], 9000.1 / 4.1, rtol=1e-3)
    got = toxicity.score(docs, model, {"y": F.col("toxic")}).collect()
    assert sum((r.score >= 0.5) == (r.y == 1) for r in got) == len(got)


def test_scores_do_not_depend_on_neighbours():
    """Texts scored together and alone agree: filters never cross a text's end."""
    rng = random.Random(4)
    import pyarrow as pa

    docs = [say(rng, "en", rng.randint(0, 12)) for _ in range(30)] + ["", None, "scum"]
    words = [h[i[r] : i[r + 1]] for h, i in toxicity.hashed_words(pa.array(docs)) for r in range(len(i) - 1)]
    model = toxicity._train([w for w in words if len(w)], np.array([k % 2 for k, w in enumerate(words) if len(w)]), 2)
    together = np.concatenate([model.raw(h, i) for h, i in toxicity.hashed_words(pa.array(docs))])
    alone = np.array([model.raw(w, np.array([0, len(w)]))[0] for w in words])
    assert np.allclose(together, alone, atol=1e-5)


def test_bounded_sample(spark):
    df = spark.range(20_000).selectExpr("id", "case when id % 100 = 0 then 'rare' when id % 100 = 1 then null else 'often' end as label")
    counts = {r.label: r["count"] for r in bounded_sample(df.where("label is not null"), "label", "id", 1000).groupBy("label").count().collect()}
    assert counts["rare"] == 200 and 850 < counts["often"] < 1150
