"""Helpers the operators of this subpackage share: written intermediates, Arrow text batches, word hashes, bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitframe.session import shared_folder

CHUNK_BYTES = 2 << 20


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables from ``store`` that no later plan reads."""
    for table in stored:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def part_of(column: Column | str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``: the fold rule of the scored queries. Null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % parts, F.lit(0))


def bounded_sample(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label value, chosen by a hash of ``key``; all rows of rarer values.

    The label's distinct values must be few (languages, 0/1). Sampling is for fitting only.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(20)), F.lit(1 << 30)) / float(1 << 30)
    return df.where(draw < rate)


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, per_label: int, columns: dict[str, str], key: str = "doc_id") -> tuple[DataFrame, dict]:
    """(label, *columns) of a bounded sample of the labelled documents, and the rows of each label value 0 and 1.

    The ids are drawn from the label table and broadcast: about 2 * ``per_label`` of them, so no text is shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    total = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    texts = docs.select(F.col(key).alias("_key"), *[F.col(c).alias(a) for a, c in columns.items()])
    drawn = texts.join(F.broadcast(bounded_sample(known, "label", "_key", per_label)), "_key")
    return drawn.select("label", *columns), total


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split an Arrow string column into runs of rows of at most ``limit`` bytes (one longer row alone).

    Yields (first row, end row, bytes, offsets into the bytes). A null is an empty text.
    """
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_RANDOM = np.random.RandomState(7)
_BYTE_CODE = _RANDOM.randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE[65:91] = _BYTE_CODE[97:123]  # A-Z count as a-z
_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for step in (_STEP, _STEP_BACK):
            table = np.full(size, step, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def spread_table(members: bytes | None = None, *, spaces: bool = False) -> np.ndarray:
    """A byte table: true where the byte belongs to a word."""
    table = np.ones(256, bool)
    if spaces:
        table[[32, 9, 10, 11, 12, 13]] = False
    else:
        table[:] = False
        table[list(members or b"")] = True
    return table


#: Words are runs of anything but ASCII white space.
NOT_SPACE = spread_table(spaces=True)


def word_bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = member[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    forward, back = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * forward[: len(data)], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * back[starts])


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


BROADCAST_BYTES = 64 << 20


def broadcast_if_small(table: DataFrame, columns: list[str]) -> DataFrame:
    """``table`` with a broadcast hint if its measured size allows one; beyond that Spark joins by shuffle."""
    size = table.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in columns), F.lit(64)))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table
