"""WN11: many long titles that share their beginnings."""

from pyspark.sql import functions as F

from transitframe.operators import numbering


def one_by_one(titles):
    used, out = set(), []
    for title in titles:
        base = title[:31]
        name, n = base, 2
        while name in used:
            suffix = f" ({n})"
            name, n = base[: 31 - len(suffix)] + suffix, n + 1
        used.add(name)
        out.append(name)
    return out


def test_a_title_like_a_numbered_name(spark):
    titles = ["EUROPE - FRANCE"] * 16
    titles[3], titles[12] = "EUROPE - FRANCE (9)", "EUROPE - FRANCE (7)"
    rows = spark.createDataFrame(list(enumerate(titles)), "ord long, title string").withColumn("company", F.lit("c"))
    got = numbering.unique_sheet_names(rows, ["company"]).orderBy("ord").collect()
    assert [r.sheet for r in got] == one_by_one(titles)


def test_long_runs_of_collisions_settle_at_once(spark, monkeypatch):
    long = ["MIDDLE EAST - SAUDI ARABIA" + end for end in ("", " (Via Norte)", " (DESATIVADO)")]
    titles = [long[i * i % 3] for i in range(1500)]
    written = []
    plain = numbering.cut_lineage
    monkeypatch.setattr(numbering, "cut_lineage", lambda df: written.append(1) or plain(df))
    rows = spark.createDataFrame(list(enumerate(titles)), "ord long, title string").withColumn("company", F.lit("c"))
    got = numbering.unique_sheet_names(rows, ["company"]).orderBy("ord").collect()
    assert [r.sheet for r in got] == one_by_one(titles)
    assert len(written) <= 8
