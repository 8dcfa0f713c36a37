"""Benchmark decontamination with DataFrame functions only.

The test items are cut into windows of consecutive normalised words; the set of their n-grams is broadcast while its
measured size allows (beyond that Spark joins by shuffle). Training texts are split into words once. A word meets the
window set through the window's anchor, its word that is rarest among the items, so only windows around anchors are
built; each is then looked up whole in the n-gram set. Hits are merged to word spans per document.

Words: A-Z lower-cased, runs of digits, letters and non-ASCII characters. A window has ``size`` words; an item of
fewer words, but not none, is one window. Null or empty texts have no words and no hits. An empty item table hits
nothing. Repeated rows, and several rows of one id, are each judged on their own text. Clashing column names are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitframe.llm.common import broadcast_if_small, store

#: Characters between words, with A-Z counted as letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pieces(text: Column) -> Column:
    """The words in their own case; an empty first or last element stands for separators at an end."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def word_count(text: Column) -> Column:
    pieces = _pieces(text)
    ends = (F.element_at(pieces, 1) == "").cast("long") + ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("long")
    return F.size(pieces).cast("long") - ends


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, n, gram, anchor, before): every distinct window of every item, its anchor and the words before it."""
    words = F.filter(_pieces(_ascii_lower(F.col(text_col))), lambda w: w != "")
    rows = items.select(F.col(id_col).alias("item"), words.alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    windows = rows.select("item", length.alias("n"), F.explode(F.transform(starts, lambda s: F.slice("words", s, length))).alias("window")).distinct()
    words = windows.select("item", "n", "window", F.posexplode("window").alias("before", "word"))
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    best = words.join(often, "word").groupBy("item", "n", "window").agg(
        F.min(F.struct("often", (-F.length("word")).alias("short"), "word", "before")).alias("best"))
    return best.select("item", F.array_join("window", " ").alias("gram"), "n", F.lower("best.word").alias("anchor"), "best.before")


def hit_spans(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
              item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text_hash, spans, items) of the rows with hits; spans are sorted (start word, words) from 0, items distinct."""
    windows = store(item_windows(items, item_id, item_text, size))
    anchors = broadcast_if_small(windows.select("anchor", "before", "n").distinct(), ["anchor"])
    grams = broadcast_if_small(windows.select("gram", "item").distinct(), ["gram", "item"])
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), _pieces(F.col(text_col)).alias("pieces"))
    words = texts.select("id", "text_hash", "pieces", F.posexplode("pieces").alias("at", "word"))
    found = words.join(anchors, F.lower("word") == F.col("anchor")).where((F.col("at") >= F.col("before")) & (F.col("at") - F.col("before") + F.col("n") <= F.size("pieces")))
    lead = (F.element_at("pieces", 1) == "").cast("int")
    start = F.col("at") - F.col("before")
    found = found.select("id", "text_hash", "n", (start - lead).alias("start"), _ascii_lower(F.array_join(F.slice("pieces", F.greatest(start + 1, F.lit(1)), F.col("n")), " ")).alias("gram"))
    hits = found.join(grams, "gram")
    return hits.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n")))).alias("spans"), F.collect_set("item").alias("items"))


def _covered(spans: Column) -> Column:
    """The number of words inside at least one of the sorted spans."""
    def step(acc: Column, span: Column) -> Column:
        end = span["start"] + span["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], span["start"]))).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])


def _beside(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``rows`` (columns id, text_hash and others) with their hits, null-safe on the id."""
    hits = hits.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "spans", "items")
    return rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = hit_spans(docs, items, size, id_col, text_col, item_id, item_text)
    rows = _beside(docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("n_words"), F.xxhash64(text_col).alias("text_hash")), hits)
    names = F.coalesce(F.array_sort(F.transform("items", lambda x: x.cast("string"))), F.array().cast("array<string>"))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return rows.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, remove: str = "documents", id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows (``documents``) or with the hit words cut from their texts (``spans``)."""
    hits = hit_spans(docs, items, size, id_col, text_col, item_id, item_text)
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")  # keeps the documents' names apart
    rows = _beside(docs.select(whole, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")), hits)
    if remove == "documents":
        return rows.where("spans is null").select("doc.*")
    # words and the separators between them alternate
    old = F.col("doc")[text_col]
    runs = F.regexp_extract_all(old, F.lit(SEPARATORS + "|" + SEPARATORS.replace("[", "[^", 1)), 0)
    lead = F.when(F.element_at(_pieces(old), 1) == "", 1).otherwise(0)
    at = lambda i: F.floor((i - lead) / 2)
    kept = F.filter(runs, lambda run, i: ~F.exists("spans", lambda s: (i >= lead) & (at(i) >= s["start"]) & (at(i) < s["start"] + s["n"])))
    text = F.when(F.col("spans").isNull(), old).otherwise(F.array_join(kept, ""))
    return rows.select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])
