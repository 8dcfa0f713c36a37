"""Costly expressions of a column are computed once per distinct value and in all tasks."""

from pyspark.sql import functions as F

from transitframe.operators import addresses, resolve
from transitframe.plans import domain
from transitframe.plans.catalog import texts
from transitframe.session import once_per_value


def test_values_are_spread_and_a_later_filter_does_not_repeat_the_work(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(value):
        calls.add(1)
        return f"<{value}>"

    rows = spark.range(0, 4000, 1, 1).select(F.concat(F.lit("RUA "), (F.col("id") % 40).cast("string")).alias("street"))
    full = once_per_value(rows, "street", {"full": costly("street")})
    assert full.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert {tuple(r) for r in full.filter("full <> ''").collect()} == {(f"RUA {k}", f"<RUA {k}>") for k in range(40)}
    assert calls.value == 40


def test_rules_run_once_per_spelling(spark, monkeypatch):
    seen = []

    def recorded(df, column, derived):
        out = once_per_value(df, column, derived)
        seen.append((column, df.count(), out.count()))
        return out

    for module in (texts, addresses):
        monkeypatch.setattr(module, "once_per_value", recorded)
    sf = "/root/testdata/sf0.001"
    texts.f6(spark, sf).count()
    texts.sm4(spark, sf).count()
    addresses.resolve_addresses(texts.addresses(spark, sf).select("address"), domain.registry(spark, sf))
    assert [column for column, _, _ in seen] == ["street", "street", "part", "street"]
    assert all(values <= rows for _, rows, values in seen) and seen[2][2] < seen[2][1]


def test_variants_of_repeated_reference_names(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(resolve, "once_per_value", lambda df, c, x: seen.append(once_per_value(df, c, x).count()) or once_per_value(df, c, x))
    new = spark.createDataFrame([(" RUA SANTA LUSIA ",), ("RUA SANTA LUSIA",), ("R. DO SOL",)] * 20, "street string")
    reference = spark.createDataFrame([("RUA SANTA LUCIA", 1), ("Rua Santa Lúcia", 3), ("RUA SANTA LUCIA", 2)], "street string, ord int")
    got = {(r.street, r.rank, r.reference) for r in resolve.variant_candidates(new, reference).collect()}
    assert got == {("RUA SANTA LUSIA", 1, "Rua Santa Lúcia"), ("R. DO SOL", None, None)}
    assert seen == [2, 2]
