"""SC21: positioned words of a stop listing to typed stop rows.

Input is ``words(doc, page, top, x0, text)``. Rows are formed inside a page, which is bounded by paper;
header state is carried from page to page by ``ordered.carry_forward``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitframe.functions import values
from transitframe.operators.ordered import carry_forward
from transitframe.rules import STOP_COLUMNS
from transitframe.session import cut_lineage


def _page_rows(words: DataFrame) -> DataFrame:
    """Profile A: rows by the vertical position rounded to multiples of five."""
    return words.withColumn("row", F.rint(F.col("top") / 5) * 5).groupBy("doc", "page", "row").agg(
        F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("cells")
    )


def _row_starts(heights: DataFrame, tolerance: float) -> DataFrame:
    """(doc, page, top) of the words that open a row, of ``heights(doc, page, top, _run)``.

    A gap above the tolerance always opens a row, so every run of heights without such a gap stands for itself; most runs are
    one row. In longer runs each height points to the first one beyond its reach, and the rows are the chain of pointers from
    the run's first height: it is marked in as many rounds as the longest chain's length has binary digits.
    """
    run = ["doc", "page", "_run"]
    starts = heights.filter(F.col("top") == F.col("_run")).select("doc", "page", "top")
    tall = heights.groupBy(*run).agg((F.max("top") - F.col("_run")).alias("_high")).filter(F.col("_high") > tolerance).select(*run)
    chained = heights.join(tall, run, "left_semi")
    # heights and limits in one descending sequence: a limit sees the heights above it, the nearest last
    ahead = F.struct(F.col("top").alias("first"), F.lead("top").over(Window.partitionBy(*run).orderBy("top")).alias("second"))
    limit = F.struct(F.lit(0).alias("kind"), (F.col("top") + tolerance - 1e-9).alias("value"), F.lit(None).cast("struct<first:double,second:double>").alias("ahead"))
    both = chained.withColumn("_ahead", ahead).select(
        *run, "top", F.explode(F.array(limit, F.struct(F.lit(1).alias("kind"), F.col("top").alias("value"), F.col("_ahead").alias("ahead")))).alias("e")
    )
    above = Window.partitionBy(*run).orderBy(F.col("e.value").desc(), F.col("e.kind")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_seen", F.last("e.ahead", ignorenulls=True).over(above)).filter("e.kind = 0")
    # the limit is a hair low, so that the exact comparison decides
    beyond = F.when(F.col("_seen.first") - F.col("top") > tolerance, F.col("_seen.first")).otherwise(F.col("_seen.second"))
    pointers = cut_lineage(seen.select("doc", "page", "top", beyond.alias("_next")).filter("_next is not null"))
    marked = cut_lineage(starts)
    while not pointers.isEmpty():
        reached = pointers.join(marked, ["doc", "page", "top"], "left_semi").select("doc", "page", F.col("_next").alias("top"))
        marked = cut_lineage(marked.unionByName(reached).distinct())
        after = pointers.select("doc", "page", F.col("top").alias("_next"), F.col("_next").alias("_after"))
        pointers = cut_lineage(pointers.join(after, ["doc", "page", "_next"]).select("doc", "page", "top", F.col("_after").alias("_next")))
    return marked


def _gap_rows(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Profile B: a row takes every following word within ``tolerance`` of the row's first word. Words without a height are
    left out; different heights are at least 1e-9 apart."""
    placed = words.withColumn("top", F.col("top").cast("double")).filter("top is not null")
    page = Window.partitionBy("doc", "page").orderBy("top")
    gap = F.col("top") - F.lag("top").over(page)
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    heights = placed.select("doc", "page", "top").distinct().withColumn("_opens", F.when(gap.isNull() | (gap > tolerance), F.col("top")))
    heights = cut_lineage(heights.withColumn("_run", F.last("_opens", ignorenulls=True).over(upto)).drop("_opens"))
    starts = _row_starts(heights, tolerance).withColumn("_start", F.col("top"))
    rows = heights.join(starts, ["doc", "page", "top"], "left").select("doc", "page", "top", F.last("_start", ignorenulls=True).over(upto).alias("row"))
    return placed.join(rows, ["doc", "page", "top"]).groupBy("doc", "page", "row").agg(
        F.array_sort(F.collect_list(F.struct(F.col("x0").cast("double").alias("x0"), "text"))).alias("cells")
    )


def _between(start: float, stop: float) -> Column:
    inside = F.filter("cells", lambda c: (c["x0"] >= start) & (c["x0"] < stop))
    return F.btrim(F.array_join(F.transform(inside, lambda c: c["text"]), " "))


def _rows(words: DataFrame, profile: str) -> DataFrame:
    rows = _page_rows(words) if profile == "A" else _gap_rows(words)
    columns = [_between(lo, hi).alias(name) for name, lo, hi in STOP_COLUMNS[profile]]
    return rows.select("doc", "page", "row", F.array_join(F.transform("cells", lambda c: c["text"]), " ").alias("text"), *columns)


def _found(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.btrim(F.regexp_extract("text", pattern, group)), F.lit(""))


def stop_listing(words: DataFrame, profile: str = "A") -> DataFrame:
    """Stops of sections that are the main service and active, with line and direction names.

    Profile A recognises a stop by its two trailing coordinates; profile B by four numeric columns and
    appends rows without them to the address of the stop above.
    """
    rows = _rows(words, profile)
    order = ["page", "row"]
    footer = F.col("text").rlike("Operacional|Cadastro")
    if profile == "A":
        opens = F.col("text").contains("Atendimento") & ~footer
        is_stop = F.col("text").rlike(r"-\d+,\d{4,}\s+-\d+,\d{4,}") & ~footer
        table_head = F.col("text").rlike("Nome Abrev") | (F.col("text").contains("Nome") & F.col("text").contains("Ordem"))
    else:
        opens = F.col("text").contains("Atendimento Principal:")
        number = lambda c: F.col(c).rlike(r"^\d+$")
        coordinate = lambda c: F.col(c).rlike(r"^-?\d+,\d+$")
        is_stop = number("position") & number("speed_limit") & coordinate("lat") & coordinate("lon")
        table_head = F.startswith("text", F.lit("Nome Nome Abrev"))
    main = F.coalesce(_found(r"(?i)Principal:\s*(Sim|N[aãA-Z]o)"), _found(r"(?i)Atendimento\s+(Sim|N[aã]o)"))
    active = F.coalesce(_found(r"(?i)Ativo:\s*(Sim|N.o)"), F.when(F.col("text").rlike("(?i)^(Sim|N[aã]o)$"), F.col("text")))
    line = F.coalesce(_found(r"(?i)Linha:\s*(.+?)(?:Nome Ida|Ativo|$)"), _found(r"(?i)(?:Principal:|Atendimento)\s*:?\s*(?:Sim|N[aã]o)\s+(.+)"))

    def event(value: Column) -> Column:
        # a new section forgets the header of the one before
        return F.when(opens, F.struct(value.alias("v"))).when(value.isNotNull(), F.struct(value.alias("v")))

    sections = rows.withColumns({"_opens": opens, "_stop": is_stop, "_head": table_head, "_footer": footer})
    state = carry_forward(
        sections, ["doc"], order,
        {
            "section": F.when(opens, F.struct("page", "row")),
            "main": event(main), "active": event(active), "line": event(line),
            "name_ida": event(_found(r"(?i)Nome Ida:\s*(.+?)(?:Ativo|$)")), "name_volta": event(_found(r"(?i)Nome Volta:\s*(.+?)$")),
            "stop_at": F.when(is_stop, F.struct("page", "row")).when(opens, F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("row"))),
        },
    )
    kept = state.filter(
        F.col("section").isNotNull() & F.lower("main.v").startswith("sim") & F.lower("active.v").startswith("sim")
    )
    stops = kept.filter("_stop").select(
        "doc", F.col("section").alias("section"), "page", "row", F.col("line.v").alias("line"), F.col("name_ida.v").alias("name_ida"),
        F.col("name_volta.v").alias("name_volta"), "name", "abbreviation", "address",
        values.int_or_zero("position").alias("position"), values.int_or_zero("speed_limit").alias("speed_limit"),
        values.decimal_comma("lat").alias("lat"), values.decimal_comma("lon").alias("lon"),
    )
    if profile == "A":
        return stops
    header = F.col("text").rlike("Atendimento Principal:|Nome Ida:|Ativo:|Nome Volta:")
    more = kept.filter(~F.col("_stop") & ~header & ~F.col("_head") & F.col("stop_at.row").isNotNull())
    # continuation rows of one stop: a wrapped address, a handful of rows
    tails = more.groupBy("doc", F.col("stop_at.page").alias("page"), F.col("stop_at.row").alias("row")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            F.col("page").alias("p"), F.col("row").alias("r"), F.concat_ws(" ", "name", "abbreviation", "address").alias("t")))),
            lambda s: F.btrim(s["t"])), " ").alias("tail")
    )
    return stops.join(tails, ["doc", "page", "row"], "left").withColumn(
        "address", F.when(F.coalesce(F.length("tail"), F.lit(0)) > 0, F.concat_ws(" ", "address", "tail")).otherwise(F.col("address"))
    ).drop("tail")
