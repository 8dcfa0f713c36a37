"""Target-distribution importance resampling with n-gram features hashed by prefix CRCs.

Texts are normalised to words joined by one space and scanned once; running CRCs give the CRC-32 of every run of words
by cancelling the prefix before it (``crc``). A feature's bucket is that CRC modulo ``buckets``. The gain of a bucket is
the log ratio of its share among the target texts and among all documents, in thousandths. A document's weight is the
floored mean gain of its features; adding Gumbel noise drawn from a digest of its id and taking the highest scores
draws documents without replacement, with odds that follow the weights.

Null and empty texts have no features: weight 0, never drawn (fewer words than ``least_words``). A null id hashes like
the empty string and comes before other ids in ties. Repeated rows are drawn one by one. Without documents there are
no rows; without targets every gain compares with an even spread. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitframe.llm.common import spread_table, store
from transitframe.llm.crc import normalised, running, substring_crc, word_pieces
from transitframe.operators.ordered import global_ordinal

#: Words are runs of lower-case letters, digits and anything beyond ASCII (A-Z are lower-cased before).
WORD_BYTES = spread_table(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))


def features(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, bucket) of every run of 1 to ``longest`` words, and the length of the runs."""
    for _, data, starts, ends, rows, fresh in word_pieces(column, lambda x: WORD_BYTES[x], longest - 1):
        text, first, last = normalised(data, starts, ends, rows)
        registers = running(text)
        for words in range(1, longest + 1):
            head, tail = first[: len(first) - words + 1], last[words - 1 :]
            of = rows[words - 1 :]
            use = np.flatnonzero((rows[: len(head)] == of) & (np.arange(words - 1, len(rows)) >= fresh)) if len(rows) >= words else np.zeros(0, np.int64)
            if len(use):
                yield of[use], substring_crc(registers, head[use], tail[use]) % np.uint32(buckets), words


def _counted(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features(batch.column(0), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts: every task gives one row a bucket, whatever it reads."""
    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(_counted(longest, buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, targets: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """The gain of every bucket; the tables joined and fetched have ``buckets`` rows."""
    spark = docs.sparkSession
    both = [bucket_counts(x, text_col, longest, buckets).withColumnRenamed("n", name) for x, name in ((docs, "s"), (targets, "t"))]
    counts = store(spark.range(buckets).withColumnRenamed("id", "bucket").join(both[0], "bucket", "left").join(both[1], "bucket", "left").na.fill(0))
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(total["s"] + buckets)).cast("double") / ((F.col("s") + 1) * F.lit(total["t"] + buckets)).cast("double")
    gains = np.zeros(buckets, np.int64)
    for row in counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():
        gains[row["bucket"]] = row["gain"]
    return gains


def _weighed(longest: int, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            count, words, gained = (np.zeros(n, np.int64) for _ in range(3))
            for rows, bucket, length in features(batch.column(1), longest, len(gains)):
                low = rows[0]
                own = np.bincount(rows - low)
                count[low : low + len(own)] += own
                if length == 1:
                    words[low : low + len(own)] += own
                order = np.concatenate([[0], np.cumsum(gains[bucket])])  # exact in integers
                ends = np.cumsum(own)
                gained[low : low + len(own)] += order[ends] - order[ends - own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(words), pa.array(gained)], ["id", "n_features", "n_words", "gained"])

    return run


def resample(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = 10_000,
             percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per document: id, ``n_features``, ``weight``, ``score`` and ``rank`` (1 for the first drawn; null if not drawn).

    ``percent`` of the documents of at least ``least_words`` words are drawn.
    """
    gains = bucket_gains(docs, targets, text_col, longest, buckets)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    rows = slim.mapInArrow(_weighed(longest, gains), f"id {id_type}, n_features long, n_words long, gained long")
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gained") / F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    rows = rows.select("id", "n_features", weight.alias("weight"), (weight + noise).alias("score"), (F.col("n_words") < least_words).alias("_short"))
    # highest scores of the long enough documents first; the last key only deals equal rows over partitions
    order = ["_short", -F.col("score"), "id", "n_features", F.monotonically_increasing_id()]
    numbered = global_ordinal(rows, order, out="_place", start=1)
    last = numbered.where(~F.col("_short")).agg(F.count("*")).first()[0] * percent // 100
    rank = F.when(F.col("_place") <= last, F.col("_place"))
    return numbered.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
