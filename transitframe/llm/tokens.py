"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Every text is encoded with a public tokenizer (its file's path is a parameter). Lengths are counted per batch, then
added up, so only (length, documents) rows are shuffled. From suffix sums over the histogram come totals, quantiles
and truncated totals for any context limit. Null and empty texts have length 0. Repeated rows each count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitframe.llm.common import store

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts a text before merging (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK = 256
_encoders: dict = {}


def encoder(path: str, pattern: str = PATTERN):
    """The encoder of a rank file, kept per process."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _encoders[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def encoded_lengths(column: pa.Array, path: str) -> np.ndarray:
    encode = encoder(path).encode_ordinary
    return np.fromiter((len(encode(t)) if (t := x.as_py()) else 0 for x in column), np.int64, len(column))


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(n_tokens, n_docs): how many rows have each encoded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for length, n in zip(*np.unique(encoded_lengths(batch.column(0), tokenizer), return_counts=True), strict=True):
                seen[int(length)] = seen.get(int(length), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return rows.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, at each length L: documents and tokens of length >= L, the share of documents of length
    <= L, and the total that is left when every document is cut to L tokens.

    Sums run within blocks of BLOCK lengths, over the blocks' own totals; the block table has longest / BLOCK rows.
    """
    tokens = F.col("n_docs") * F.col("n_tokens")
    rows = store(histogram).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block", F.coalesce(F.sum("docs").over(longer), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(every).alias("docs_all"), F.sum("tokens").over(every).alias("tokens_all"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    rows = rows.join(totals, "block").select(
        "n_tokens", "n_docs", (F.col("docs_after") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("tokens_after") + F.sum(tokens).over(inside)).alias("tokens_from"), "docs_all", "tokens_all")
    return rows.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", ((F.col("docs_all") - F.col("docs_from") + F.col("n_docs")) / F.col("docs_all")).alias("share_up_to"),
        (F.col("tokens_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"), "docs_all", "tokens_all")


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(max_tokens, truncated_total) for each context limit, from one pass over the sums; none is 0 without rows."""
    columns = []
    for limit in limits:
        below = F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_docs") * F.col("n_tokens")).otherwise(F.col("n_docs") * limit))
        columns.append(F.struct(F.lit(limit).cast("long").alias("max_tokens"), F.coalesce(below, F.lit(0)).alias("truncated_total")))
    return sums.agg(F.array(*columns).alias("x")).select(F.inline("x"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least ``share`` of the documents do not exceed; null without rows."""
    columns = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_up_to") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return sums.agg(F.array(*columns).alias("x")).select(F.inline("x"))
