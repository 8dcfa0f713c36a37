"""Several tables published as one version: unchanged lines stay where they are, every version reads back whole."""

from __future__ import annotations

import pytest

from transitframe.sources import writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions_read_back_and_unchanged_lines_are_not_written_again(spark, tmp_path):
    root = str(tmp_path / "published")
    schema = "line_id string, seq int, street string"
    first = [("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("b", 1, "y"), (None, 1, "z"), ("gone", 1, "w")]
    second = [("a", 2, None), ("a", 1, "x"), ("b", 1, "y"), (None, 1, "z"), ("new", 1, "v")]
    other = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "line_id string, km double")
    none = other.limit(0)
    assert writers.current_version(spark, root) is None
    writers.publish_tables({"streets": spark.createDataFrame(first, schema), "lengths": other, "empty": none}, root, "v1")
    writers.publish_tables({"streets": spark.createDataFrame(second, schema), "lengths": other, "empty": none}, root, "v2")
    assert writers.current_version(spark, root) == "v2"
    read = lambda name, version=None: rows(writers.read_published(spark, root, name, version).select(*(["line_id", "seq", "street"] if name == "streets" else ["line_id", "km"])))
    assert read("streets") == sorted(second, key=repr) and read("streets", "v1") == sorted(first, key=repr)
    assert read("lengths") == [("a", 1.5), ("b", 2.5)] and read("empty") == []
    # a repeated row less is a change, another order is none
    assert rows(spark.read.parquet(f"{root}/streets/version=v2")) == [("b", 1, "y"), ("new", 1, "v")]
    assert spark.read.parquet(f"{root}/lengths/version=v2").count() == 0
    with pytest.raises(Exception):  # noqa: B017 - a version is never overwritten
        writers.publish_tables({"streets": spark.createDataFrame(second, schema)}, root, "v2")
    assert read("streets") == sorted(second, key=repr)


def test_a_publish_writes_no_checkpoints_and_reads_unchanged_tables_without_a_join(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path / "published"), "line_id string, seq int, street string"
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", None)
    first = spark.createDataFrame([(f"l{i % 50}", i, "x") for i in range(500)], schema)
    kept = first.drop("street")
    writers.publish_tables({"streets": first, "kept": kept}, root, "2024.10")
    writers.publish_tables({"streets": first.filter("line_id <> 'l7'").replace("x", "y", "street").filter("line_id <> 'l8'").union(first.filter("line_id = 'l8'")), "kept": kept}, root, "2024.11")
    streets = rows(writers.read_published(spark, root, "streets"))
    assert streets == sorted([(f"l{i % 50}", i, "x" if i % 50 == 8 else "y") for i in range(500) if i % 50 != 7], key=repr)
    assert rows(writers.read_published(spark, root, "streets", "2024.10")) == rows(first)
    same = writers.read_published(spark, root, "kept")
    assert rows(same) == rows(kept) and "Join" not in same._jdf.queryExecution().executedPlan().toString()
