"""Document fingerprints by order MinHash.

A text is its k-mers, each numbered by its occurrences so far. Each of ``sketches`` orders picks the ``tuple_size`` least
numbered k-mers, puts them back into text order and hashes the tuple to 16 bits. Unlike a set's MinHash, the share of equal
components falls when passages are moved or repeated, as edit distance rises. Texts are whole; equal texts have equal
fingerprints.

Lengths and k-mers count code points. A text shorter than k is one k-mer; a null or empty text has the fingerprint of
zeros, which is like itself alone. Repeated ids and rows are rows of their own, ordered by id, then by text; null ids come
last. A single document is its own next one. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitframe.llm.common import mix, store

_POSITION_BITS = 22
_CHUNK = 1 << 15
_BLOCK = 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]


def multipliers(sketches: int) -> np.ndarray:
    """An odd 32-bit multiplier for each order."""
    return (mix(np.arange(1, sketches + 1, dtype=np.uint64) * _ODD[0]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k code points from each place on; one hash of a shorter text."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    k = min(k, len(codes))
    out = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        out = out * _ODD[1] + codes[i : len(codes) - k + 1 + i]
    return mix(out + np.uint64(k))


def occurrence_numbers(hashes: np.ndarray) -> np.ndarray:
    """How often each value stood before its place. Long texts are numbered in runs that pass their counts on.

    Values are told apart by their upper 42 bits, so that value and place sort as one number.
    """
    places = 1 << _POSITION_BITS
    numbers = np.empty(len(hashes), np.uint64)
    known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(hashes), places):
        part = hashes[at : at + places]
        both = np.sort((part & ~np.uint64(places - 1)) | np.arange(len(part), dtype=np.uint64))
        value, place = both >> np.uint64(_POSITION_BITS), (both & np.uint64(places - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        size = np.diff(np.append(first, len(value)))
        distinct = value[first]
        before = np.zeros(len(first), np.int64)
        if len(known):
            near = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
            before = np.where(known[near] == distinct, counts[near], 0)
        numbers[at + place] = (np.arange(len(value)) - np.repeat(first - before, size)).view(np.uint64)
        if len(hashes) > at + places:
            known, back = np.unique(np.concatenate([known, distinct]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, size])).astype(np.int64)
    return numbers


def least_places(ranks: np.ndarray, factors: np.ndarray, tuple_size: int) -> np.ndarray:
    """For each order the places of its ``tuple_size`` least k-mers, ties by place; -1 where there are fewer."""
    best = np.full((len(factors), tuple_size), _NONE)
    for at in range(0, len(ranks), _CHUNK):
        part = ranks[at : at + _CHUNK]
        blocks = -(-len(part) // _BLOCK)
        grid = np.empty((len(factors), blocks * _BLOCK), np.uint32)
        np.multiply(factors[:, None], part[None, :], out=grid[:, : len(part)])
        grid[:, len(part) :] = 0xFFFFFFFF
        grid = grid.reshape(len(factors), _BLOCK, blocks)  # a block is every so many-th place
        few = min(tuple_size, blocks)
        least = (grid.min(1).astype(np.uint64) << np.uint64(32)) | np.arange(blocks, dtype=np.uint64)
        if few < blocks:
            least = np.partition(least, few - 1, axis=1)[:, :few]
        chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = np.arange(_BLOCK)[None, :, None] * blocks + chosen[:, None, :]
        values = grid.reshape(-1)[place + (np.arange(len(factors)) * (blocks * _BLOCK))[:, None, None]].astype(np.uint64)
        keys = (values << np.uint64(32)) | (place + at).view(np.uint64)
        keys[place >= len(part)] = _NONE
        best = np.concatenate([best, keys.reshape(len(factors), -1)], axis=1)
        best = np.partition(best, tuple_size - 1, axis=1)[:, :tuple_size]
    places = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.sort(np.where(best == _NONE, -1, places), axis=1)


def components(text: str, k: int = 6, tuple_size: int = 2, sketches: int = 64) -> np.ndarray:
    """The 16-bit components of a text's fingerprint; zeros for the empty text only."""
    if not text:
        return np.zeros(sketches, np.uint16)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes = kmer_hashes(codes, k)
    numbered = occurrence_numbers(hashes)
    numbered *= _ODD[0]
    numbered += hashes
    numbered *= _ODD[1]
    numbered ^= numbered >> np.uint64(29)
    ranks = (numbered >> np.uint64(16)).astype(np.uint32)
    places = least_places(ranks, multipliers(sketches), tuple_size)
    out = np.zeros(sketches, np.uint64)
    for i in range(tuple_size):
        at = places[:, i]
        out = np.where(at >= 0, mix(out * _ODD[1] + hashes[np.maximum(at, 0)]), out)
    return np.maximum(out >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal components."""
    return float(np.mean(a == b))


def as_text(parts: np.ndarray) -> str:
    return parts.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Rows:
    """Result rows gathered into batches; ``spare`` columns of nulls follow."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def add(self, *values) -> None:
        self.rows.append(values + (None,) * (len(self.schema) - len(values)))

    def taken(self) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), self.schema.types, strict=True)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _schema(id_type: pa.DataType, edges: bool) -> pa.Schema:
    fields = [("id", id_type), ("n_chars", pa.int64()), *[(x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")],
              ("near_edited", pa.float64()), ("near_next", pa.float64())]
    return pa.schema(fields + ([("part", pa.int32()), ("edge", pa.string()), ("edge_text", pa.string())] if edges else []))


def _result(text: str, own: np.ndarray, following: str, next_own: np.ndarray, options: dict) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else components(changed, **options)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, next_own)


def _in_order(options: dict):
    """Sorted (id, text) rows -> results of all but the last row of the task, and the task's first and last text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, None
        part = TaskContext.get().partitionId()
        nothing = (None,) * 6
        for batch in batches:
            out = out or _Rows(_schema(batch.schema.field(0).type, True))
            for row in range(batch.num_rows):
                id_, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py() or ""
                own = held[2] if held is not None and held[1] == text else components(text, **options)
                if held is None:
                    out.add(None, *nothing, part, "first", text)
                else:
                    out.add(held[0], *_result(held[1], held[2], text, own, options))
                held = id_, text, own
                if len(out.rows) >= 2000:
                    yield out.taken()
        if held is not None:
            out.add(held[0], *nothing, part, "last", held[1])
            yield out.taken()

    return run


def _across(options: dict):
    """(id, text, following) -> results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(_schema(batch.schema.field(0).type, False))
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out.add(row[0], *_result(row[1], components(row[1], **options), row[2], components(row[2], **options), options))
            if out.rows:
                yield out.taken()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 6, tuple_size: int = 2, sketches: int = 64) -> DataFrame:
    """One row per document: id, ``n_chars``, ``fingerprint``, ``near_next`` (likeness to the next document by descending id;
    the first follows the last), and of the text edited with the next one ``edited_sha256``, ``edited_fingerprint``, ``near_edited``.

    Texts are shuffled once, by range of ids; equal rows are dealt over tasks. Each task compares neighbours as it reads and
    hands on its first and last text, which meet those of other tasks: two rows a task.
    """
    options = {"k": k, "tuple_size": tuple_size, "sketches": sketches}
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    result = _RESULT.format(id=slim.schema["id"].dataType.simpleString())
    order = [F.col("id").desc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit(""))), F.monotonically_increasing_id()]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    done = store(placed.mapInArrow(_in_order(options), f"{result}, part int, edge string, edge_text string"))
    edges = done.where("edge is not null")
    # one row per task of the sort: its last text meets the first text of the next task that had rows
    tasks = edges.where("edge = 'first'").select("part", "edge_text")
    inorder = Window.orderBy("part")
    nexts = tasks.select("part", F.coalesce(F.lead("part").over(inorder), F.min("part").over(Window.partitionBy())).alias("next_part"))
    lasts = edges.where("edge = 'last'").select("id", F.col("edge_text").alias("text"), "part").join(nexts, "part")
    pairs = lasts.join(tasks.select(F.col("part").alias("next_part"), F.col("edge_text").alias("following")), "next_part")
    across = pairs.select("id", "text", "following").mapInArrow(_across(options), result)
    return done.where("edge is null").drop("part", "edge", "edge_text").unionByName(across).withColumnRenamed("id", id_col)
