"""The signatures of word sets spare pairs that cannot overlap, and none that can."""

import random

import pytest
from pyspark.sql import functions as F

from transitframe.functions.similarity import jaccard
from transitframe.operators import candidates


@pytest.mark.parametrize("threshold", [0.25, 0.4, 0.7])
def test_signature_loses_no_pair(spark, threshold):
    draw = random.Random(1)
    sets = [[f"W{x}" for x in draw.sample(range(120), draw.choice([1, 2, 4, 40, 100]))] for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in sets], "w array<string>")
    l = df.selectExpr("w as l_w").withColumns(candidates._signature(F.col("l_w"), "l"))
    r = df.selectExpr("w as r_w").withColumns(candidates._signature(F.col("r_w"), "r"))
    pairs = l.crossJoin(r).select(candidates._can_overlap(threshold).alias("able"), (jaccard(F.col("l_w"), F.col("r_w")) >= threshold).alias("over"))
    assert pairs.filter("over and not able").count() == 0
    assert pairs.filter("not able").count() > 0
