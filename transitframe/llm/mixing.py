"""Mixing sources to target weights by temperature.

Source weights are token shares raised to an exponent and normalised: 1 keeps the shares, 0 makes sources equal. The
exponent is bisected, over aggregates of the per-source table, to meet a target entropy or a limit on repetition. A
source's quota of the token budget becomes whole copies of it and one cut copy. Each copy is dealt by hash into
blocks and ordered by hash within them, a different permutation for each copy; the cut copy ends where its quota
does. Only the per-source table meets the documents, so their texts are never shuffled.

A null source is a source of its own. Null and empty texts have no tokens; a source without tokens gets no weight.
Rows equal in all columns (but maps) share a place and are taken or left together; rows without an id are told apart by the others. No rows, or a budget of 0, give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from transitframe.llm.common import broadcast_if_small, store

BLOCK_DOCS = 4096


def word_tokens(text_col: str = "text") -> Column:
    """White-space words of a text, the default token count."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def source_tokens(rows: DataFrame) -> DataFrame:
    """(source_key, docs, tokens) from rows with ``_key`` and ``_tokens``."""
    return rows.groupBy(F.col("_key").alias("source_key")).agg(F.count("*").alias("docs"), F.sum("_tokens").alias("tokens"))


def find_exponent(sources: DataFrame, budget: float, entropy: float | None = None, repetitions: float | None = None, rounds: int = 6, ways: int = 16) -> float:
    """The exponent in [0, 1] nearest to 0 whose weights have at most ``entropy`` (nats) and repeat no source more than
    ``repetitions`` times. Entropy and repetition fall as the exponent rises, so each round keeps one of ``ways`` sections; 1 if none will do.
    """
    live = sources.where("tokens > 0")
    total = live.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    log_share = F.log(F.col("tokens") / F.lit(float(total)))
    low, high = 0.0, 1.0
    for place in range(rounds):
        points = [low + (high - low) * i / ways for i in range(ways + 1)]
        sums = []
        for a in points:
            power = F.exp(log_share * a)
            sums.append(F.struct(F.sum(power).alias("z"), F.sum(power * log_share).alias("s"), F.max(power / F.col("tokens")).alias("most")))
        found = live.agg(F.array(*sums).alias("x")).first()[0]

        def meets(a: float, x) -> bool:
            if entropy is not None and _entropy(a, x["z"], x["s"]) > entropy + 1e-12:
                return False
            return repetitions is None or budget * x["most"] / x["z"] <= repetitions * (1 + 1e-12)

        ok = next((i for i, (a, x) in enumerate(zip(points, found, strict=True)) if meets(a, x)), None)
        if ok is None:
            return 1.0
        if ok == 0:
            return points[0]
        low, high = points[ok - 1], points[ok]
    return high


def _entropy(a: float, z: float, s: float) -> float:
    return math.log(z) - a * s / z


def quotas(sources: DataFrame, exponent: float, budget: float) -> DataFrame:
    """(source_key, docs, tokens, weight, quota, copies, rest): quota = copies * tokens + rest, in tokens."""
    live = sources.where("tokens > 0")
    log_tokens = F.log(F.col("tokens").cast("double"))
    top = live.agg(F.max(log_tokens)).first()[0] or 0.0
    power = F.exp((log_tokens - top) * exponent)
    z = live.agg(F.sum(power)).first()[0] or 1.0
    rows = live.withColumn("weight", power / F.lit(float(z)))
    rows = rows.withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
    rows = rows.withColumn("copies", F.floor(F.col("quota") / F.col("tokens")).cast("long"))
    return rows.withColumn("rest", F.col("quota") - F.col("copies") * F.col("tokens"))


def _place(copy: Column, blocks: Column, row: Column) -> tuple[Column, Column]:
    """(block, order) of a row's copy: two independent hashes."""
    return F.pmod(F.xxhash64(row, copy, F.lit(1)), blocks), F.xxhash64(row, copy, F.lit(2))


def _hashes(kind: DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def mix(docs: DataFrame, budget_share: float = 1.0, entropy: float | None = None, repetitions: float | None = None,
        id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """``docs`` repeated and cut to the mixture, with ``mix_copy`` (from 0), ``mix_block`` and ``mix_order``.

    The budget is ``budget_share`` of all tokens. No source exceeds its quota; it falls short of it by less than the row
    that would not fit. Reading by (copy, block, order) is a permutation of each copy. Columns of those names are replaced.
    """
    tokens = word_tokens() if tokens is None else tokens
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), source_key(F.col(source_col)).alias("_key"), tokens.alias("_tokens"),
        F.xxhash64(F.col(id_col), F.col(source_col), *[F.col(c) for c in docs.columns if c not in (id_col, source_col) and _hashes(docs.schema[c].dataType)]).alias("_row"))
    slim = store(rows.select("_key", "_tokens", "_row"))
    sources = store(source_tokens(slim))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = budget_share * total
    plan = quotas(sources, find_exponent(sources, budget, entropy, repetitions), budget)
    plan = store(plan.withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS)))
    # the cut copy: whole blocks first, then rows of the block where the quota ends
    near = slim.join(broadcast_if_small(plan, ["source_key"]), F.col("_key") == F.col("source_key"))
    block, order = _place(F.col("copies"), F.col("blocks"), F.col("_row"))
    near = near.select("_key", "_tokens", "rest", "_row", block.alias("block"), order.alias("order"))
    sums = near.groupBy("_key", "block", "rest").agg(F.sum("_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("_key").orderBy("block"))
    ends = sums.withColumn("upto", before).where("upto > rest").groupBy("_key").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")), "block").alias("end"))
    ends = ends.select(F.col("_key").alias("end_key"), "end.block", "end.left")
    last = near.select("_key", "_tokens", "block", "order").join(ends.withColumnRenamed("block", "end_block"), (F.col("_key") == F.col("end_key")) & (F.col("block") == F.col("end_block")))
    running = F.sum("_tokens").over(Window.partitionBy("_key").orderBy("order"))
    cut = last.withColumn("running", running).where("running > left").groupBy("_key", "end_block").agg(F.min("order").alias("cut_order"))
    plan = store(plan.join(cut.withColumnRenamed("_key", "source_key"), "source_key", "left").select(F.col("source_key").alias("_plan_key"), "copies", "blocks", "end_block", "cut_order"))
    # every row meets its source's line of the plan once
    whole = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    b, o = _place(F.col("copies"), F.col("blocks"), F.col("_row"))
    fits = F.col("end_block").isNotNull() & ((b < F.col("end_block")) | ((b == F.col("end_block")) & (o < F.col("cut_order"))))
    copies = F.when(fits, F.concat(whole, F.array("copies"))).otherwise(whole)
    out = rows.join(broadcast_if_small(plan, ["_plan_key"]), F.col("_key") == F.col("_plan_key")).withColumn("_copy", F.explode(copies))
    b, o = _place(F.col("_copy"), F.col("blocks"), F.col("_row"))
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_block", "mix_order")]
    return out.select(*[F.col("doc")[c].alias(c) for c in kept], F.col("_copy").alias("mix_copy"), b.alias("mix_block"), o.alias("mix_order"))
