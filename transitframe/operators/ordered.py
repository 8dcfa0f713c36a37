"""Order-aware operators that keep working when one group holds most of the rows.

A window over a whole group would put that group in one task. These helpers cut each group into
blocks, work inside the blocks, and pass only one small summary row per block between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitframe.session import cut_lineage


def _block_offsets(summary: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*group, "_block", F.coalesce(F.sum(value).over(before), F.lit(0)).alias(out))


def number_rows(
    df: DataFrame, group: list[str], order: list[str | Column], block: Column, out: str = "seq", start: int = 0
) -> DataFrame:
    """Dense numbers per group in ``order``; ``block`` must be monotone in that order."""
    blocked = df.withColumn("_block", block)
    within = Window.partitionBy(*group, "_block").orderBy(*order)
    local = blocked.withColumn("_local", F.row_number().over(within))
    # counted map-side, so only one row per block is shuffled a second time
    summary = blocked.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _block_offsets(summary, group, "_rows", "_offset")
    return (
        local.join(offsets, [*group, "_block"])
        .withColumn(out, (F.col("_offset") + F.col("_local") + (start - 1)).cast("long"))
        .drop("_block", "_local", "_offset")
    )


def running_sum(
    df: DataFrame, group: list[str], order: list[str], block: Column, value: str, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per group."""
    blocked = df.withColumn("_block", block)
    within = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("_cum", F.sum(value).over(within))
    summary = blocked.groupBy(*group, "_block").agg(F.sum(value).alias("_total"))
    offsets = _block_offsets(summary, group, "_total", "_offset")
    return (
        local.join(offsets, [*group, "_block"])
        .withColumn(out, F.col("_offset") + F.col("_cum"))
        .drop("_block", "_cum", "_offset")
    )


def segments(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` cut into runs of equal size of its (group, order) sequence, numbered by ``_part``.

    The bounds come from the rows themselves, so neither a long group nor sparse order values make uneven runs. Written
    once: the bounds are sampled and must not be drawn again.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    return cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_part", F.spark_partition_id())


def carry_forward(df: DataFrame, group: list[str], order: list[str], events: dict[str, Column]) -> DataFrame:
    """WN2: last non-null value of each event column up to and including the row.

    A segmented scan: each run of ``segments`` is carried on its own, and what enters a run is the last value of the
    group's earlier runs. A group has one summary row per run it reaches into, at most one per task of the sort.
    """
    marked = df
    for name, event in events.items():
        marked = marked.withColumn(name, event)
    marked = segments(marked, group, order)
    position = F.struct(*[F.col(c) for c in order])
    summary = marked.groupBy(*group, "_part").agg(
        *[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), position)).alias(f"_last_{n}") for n in events]
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    entering = summary.select(
        *[F.col(c).alias(f"_of_{c}") for c in group], F.col("_part").alias("_of_part"),
        *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in events],
    ).dropna("all", subset=[f"_in_{n}" for n in events])
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.select(
        *[c for c in marked.columns if c not in events],
        *[F.last(n, ignorenulls=True).over(inside).alias(n) for n in events],
    )
    same = F.col("_part") == F.col("_of_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = carried.join(entering, same, "left")
    for name in events:
        out = out.withColumn(name, F.coalesce(name, f"_in_{name}"))
    return out.drop("_part", "_of_part", *[f"_of_{c}" for c in group], *[f"_in_{n}" for n in events])


def neighbour(df: DataFrame, group: list[str], columns: dict[str, str], seq: str = "seq", step: int = 1) -> DataFrame:
    """Values of the row ``step`` positions further in its group, by an equi-join on the dense ``seq``.

    The join key spreads a long group over all partitions; a lead/lag window would not.
    """
    ahead = df.select(
        *group, (F.col(seq) - step).alias(seq), *[F.col(c).alias(alias) for c, alias in columns.items()]
    )
    return df.join(ahead, [*group, seq], "left")


def global_ordinal(df: DataFrame, order: list[str | Column], out: str = "ordinal", start: int = 0) -> DataFrame:
    """Dense number over the whole table in ``order`` without a one-partition window.

    Rows are range-partitioned and sorted, written once (bounds are sampled, so the sort must not be
    evaluated twice), then each partition adds the count of the partitions before it.
    """
    ordered = [c.asc_nulls_first() if isinstance(c, Column) else F.col(c).asc_nulls_first() for c in order]
    placed = cut_lineage(df.repartitionByRange(*ordered).sortWithinPartitions(*ordered))
    numbered = placed.withColumn("_part", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort: bounded by the partition count, so broadcast is safe
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_row") + start)
        .drop("_part", "_row", "_offset")
    )


def first_wins(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """WN8: values of the first row per key; a partial aggregation, so hot keys combine map-side."""
    position = F.struct(*[F.col(c) for c in order])
    picked = F.min_by(F.struct(*[F.col(c) for c in columns]), position)
    return df.groupBy(*keys).agg(picked.alias("_v")).select(*keys, "_v.*")


def last_wins(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """WN8: values of the last row per key."""
    position = F.struct(*[F.col(c) for c in order])
    picked = F.max_by(F.struct(*[F.col(c) for c in columns]), position)
    return df.groupBy(*keys).agg(picked.alias("_v")).select(*keys, "_v.*")


def best_per_key(df: DataFrame, keys: list[str], score: str, order: list[str], columns: list[str]) -> DataFrame:
    """WN7: highest score per key, the earliest row among equals."""
    rank = F.struct((-F.col(score)).alias("s"), *[F.col(c) for c in order])
    picked = F.min_by(F.struct(*[F.col(c) for c in [*columns, score]]), rank)
    return df.groupBy(*keys).agg(picked.alias("_v")).select(*keys, "_v.*")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """SO6/WN9: first ``n`` rows per group. Spark limits each group before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)
