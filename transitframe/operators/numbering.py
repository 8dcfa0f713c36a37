"""Sequential codes and unique names (WN4-WN6, WN11) and report orderings (SO*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitframe.functions import codes
from transitframe.functions import text as tx
from transitframe.operators.ordered import global_ordinal, number_rows
from transitframe.session import cut_lineage


def _code(ordinal: str):
    text = F.col(ordinal).cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def neighbourhood_codes(listed: DataFrame) -> DataFrame:
    """WN4: one running four-digit code over neighbourhoods and their distinct streets, both sorted ignoring
    accents; blanks dropped."""
    rows = listed.select("neighbourhood", tx.strip("street").alias("street")).filter(F.col("street") != "").distinct()
    keyed = rows.withColumns({"nk": tx.norm_ascii("neighbourhood"), "sk": tx.norm_ascii("street")})
    return global_ordinal(keyed, ["nk", "neighbourhood", "sk", "street"], "n", start=1).select(
        "neighbourhood", _code("n").alias("code"), "street"
    )


def code_ranges(coded: DataFrame) -> DataFrame:
    """WN4: first and last code and street count per neighbourhood."""
    number = F.col("code").cast("long")
    return coded.groupBy("neighbourhood").agg(
        F.min_by("code", number).alias("first_code"), F.max_by("code", number).alias("last_code"), F.count(F.lit(1)).alias("streets")
    )


def proposed_codes(suggested: DataFrame) -> DataFrame:
    """WN5: running code over suggested (neighbourhood, street) in plain order."""
    return global_ordinal(suggested.select("neighbourhood", "street"), ["neighbourhood", "street"], "n", start=1).select(
        "neighbourhood", _code("n").alias("code"), "street"
    )


def street_ids(streets: DataFrame) -> DataFrame:
    """WN6: id from 1 over the sorted distinct streets."""
    return global_ordinal(streets.select("street").distinct(), ["street"], "id", start=1).select("id", "street")


def _first_claims(based: DataFrame, group: list[str], limit: int) -> DataFrame:
    """Rows with the number ``n`` that each gets if no base looks like another's numbered name.

    Numbers of equally many digits cut their bases to the same length, so bases with a common beginning share those numbers.
    They fill up in order: the first rows in ``ord`` take them, the others go on to the numbers with one digit more.
    """
    block = F.floor(F.col("ord") / 100_000)
    claims = cut_lineage(number_rows(based, [*group, "base"], ["ord"], block, out="n", start=1))
    settled, waiting, digits = claims.filter("n = 1"), claims.filter("n > 1").drop("n"), 1
    while not waiting.isEmpty():
        first = 2 if digits == 1 else 10 ** (digits - 1)
        begun = waiting.withColumn("_begin", F.substring("base", 1, limit - 3 - digits))
        placed = cut_lineage(number_rows(begun, [*group, "_begin"], ["ord"], block, out="n", start=first).drop("_begin"))
        settled = settled.unionByName(placed.filter(F.col("n") < 10**digits))
        waiting, digits = placed.filter(F.col("n") >= 10**digits).drop("n"), digits + 1
    return settled


def unique_sheet_names(entries: DataFrame, group: list[str], limit: int = 31) -> DataFrame:
    """WN11: unique sheet names per group in ``ord``: a name already taken gets ' (2)', ' (3)', ...

    ``entries(*group, ord, title)`` with a numeric ``ord``. Every row claims the first number its forerunners leave free, in
    one pass per number of digits. Only where a title looks like another's numbered name do claims meet: a sheet goes to its
    earliest claimant and the others move to their next number, until nobody moves. No claim is above the number a row gets
    when rows are named one by one, so this settles on that result.
    """
    based = entries.withColumn("base", tx.safe_sheet_name("title", limit))
    claims = cut_lineage(_first_claims(based, group, limit))
    suffix = F.when(F.col("n") == 1, F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    sheet = F.concat(F.substring("base", F.lit(1), F.lit(limit) - F.length(suffix)), suffix)
    while True:
        named = claims.withColumn("sheet", sheet)
        owners = named.groupBy(*group, "sheet").agg(F.min("ord").alias("_owner"))
        judged = named.join(owners, [*group, "sheet"])
        if not judged.filter("ord <> _owner").take(1):
            return named.select(*entries.columns, "sheet")
        moved = F.when(F.col("ord") == F.col("_owner"), F.col("n")).otherwise(F.col("n") + 1)
        claims = cut_lineage(judged.withColumn("n", moved).drop("_owner", "sheet"))


def by_line_number(lines: DataFrame) -> DataFrame:
    """SO1: leading number, names without one last, then the name."""
    return lines.orderBy(codes.sort_number("line_name"), "line_name")


def by_line_number_night_last(lines: DataFrame) -> DataFrame:
    """SO2: night lines last, suffix letters after the plain number."""
    return lines.orderBy(codes.night_aware_sort("line_name"))


def by_service(active: DataFrame) -> DataFrame:
    """SO3: fixed service order, then code."""
    return active.orderBy(codes.service_rank("service"), "service", "code")


PAIR_PRIORITY = ("SUGERIR_A_PARA_B", "SUGERIR_B_PARA_A", "MESMO_CODIGO", "CODIGOS_DIFERENTES", "SEM_CODIGO")


def pair_priority(pair_class: str):
    return F.array_position(F.array(*[F.lit(p) for p in PAIR_PRIORITY]), F.col(pair_class)) - 1


def by_priority(pairs: DataFrame) -> DataFrame:
    """SO4: actionable pairs first, best score first."""
    return pairs.orderBy(pair_priority("pair_class"), F.desc("score"), "key_a", "key_b")


def ignoring_accents(df: DataFrame, column: str) -> DataFrame:
    """SO5: order by the accent-free form, then the raw text."""
    return df.orderBy(tx.norm_ascii(column), column)


def top_with_rest(df: DataFrame, order: list, n: int) -> DataFrame:
    """SO6: the first ``n`` rows, then one row whose ``more`` counts the rows left out."""
    top = df.orderBy(*order).limit(n).withColumn("more", F.lit(None).cast("long"))
    rest = df.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more")).filter("more > 0")
    return top.unionByName(rest, allowMissingColumns=True)
