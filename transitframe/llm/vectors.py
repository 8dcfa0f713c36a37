"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

Normalised vectors are projected on random normals, shifted and cut into steps of ``width``; ``projections`` such
numbers make one bucket of each of ``tables`` tables. Vectors that share a bucket are compared by exact cosine in
double precision. At the threshold 0.95 the defaults find a pair with probability 0.95, at 0.96 with 0.98, at 0.98
with 0.999. Equal vectors form one class and are never compared. Buckets of any size are cut into blocks
of about BLOCK classes; block pairs are compared as matrices, and give link counts and a spanning forest, not pairs. A
pair that shares several buckets counts in the first of its tables alone.

Null, empty and zero vectors and those with null or non-finite components link with nothing. Vectors of different
length are never linked. Repeated rows and ids are classes and rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitframe.llm.common import as_signed, mix, store
from transitframe.llm.components import components

BLOCK = 1024
_FEW = 48


def _rows_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(place, components as doubles) of the usable vectors of an Arrow list column, in batches of equal length."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64())
    holes = ~values.is_valid().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0.0).to_numpy()
    bad = holes | ~np.isfinite(flat)
    lengths = np.diff(offsets)
    for dim in np.unique(lengths[valid & (lengths > 0)]):
        places = np.flatnonzero(valid & (lengths == dim))
        index = offsets[places][:, None] + np.arange(dim)
        x = flat[index] + 0.0
        top = np.abs(x).max(1)
        fine = ~bad[index].any(1) & (top > 0)
        yield places[fine], x[fine]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _class_keys(x: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(x).view(np.uint64)
    odd = np.random.RandomState(23).randint(1, 2**62, x.shape[1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return as_signed(mix((mix(bits) * odd).sum(1, dtype=np.uint64) + np.uint64(x.shape[1])))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        keys, vectors, good = np.zeros(len(column), np.int64), [None] * len(column), np.zeros(len(column), bool)
        for places, x in _rows_of(column):
            keys[places], good[places] = _class_keys(x), True
            for place, row in zip(places, x, strict=True):
                vectors[place] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, mask=~good), pa.array(vectors, pa.binary())], ["id", "vector_class", "vector"])


def bucket_hashes(unit: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """One 32-bit bucket number for each vector and table."""
    dim = unit.shape[1]
    random = np.random.RandomState(101 + dim)
    directions, shifts = random.normal(size=(dim, tables * projections)), random.uniform(0, width, tables * projections)
    steps = np.floor((unit @ directions + shifts) / width).astype(np.int64).astype(np.uint64)
    odd = random.randint(1, 2**62, tables * projections).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (mix(steps + np.uint64(7)) * odd).reshape(len(unit), tables, projections).sum(2, dtype=np.uint64)
    return (mix(mixed + np.uint64(dim)) >> np.uint64(32)).astype(np.uint32)


def _bucketed(tables: int, projections: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            hashes = np.zeros((len(raw), tables), np.uint32)
            sizes = np.array([len(r) // 8 for r in raw])
            for dim in np.unique(sizes):
                places = np.flatnonzero(sizes == dim)
                hashes[places] = bucket_hashes(_unit(np.frombuffer(b"".join(raw[p] for p in places), np.float64).reshape(-1, dim)), tables, projections, width)
            keys = (np.arange(tables, dtype=np.uint64) << np.uint64(32)) | hashes.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(as_signed(keys.ravel()))),
                pa.array([h.tobytes() for h in hashes], pa.binary()), batch.column(1)], ["vector_class", "copies", "keys", "hashes", "vector"])

    return run


def _first_table(one: np.ndarray, two: np.ndarray, table: np.ndarray | int) -> np.ndarray:
    """Is ``table`` the first whose bucket both rows share?"""
    return (one == two).argmax(-1) == table


def _compare(least: float):
    """Sorted tile rows -> (kind, a, b): kind 0 adds b copies to the links of class a, kind 1 is a forest edge."""

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def few(rows: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Tiles of few rows, all their pairs at once."""
        sizes = np.diff(cuts)
        for size in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(size, 1)
            starts = cuts[:-1][sizes == size]
            for lo in range(0, len(starts), max(1, 100_000 // len(i))):
                some = starts[lo : lo + max(1, 100_000 // len(i))]
                one, two = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = (rows["i"][one] == rows["j"][one]) | (rows["side"][one] != rows["side"][two])
                ok &= np.einsum("ij,ij->i", rows["unit"][one], rows["unit"][two]) >= least
                ok &= _first_table(rows["hashes"][one], rows["hashes"][two], rows["table"][one])
                if ok.any():
                    a, b = rows["vector_class"][one[ok]], rows["vector_class"][two[ok]]
                    yield batch_of(0, np.concatenate([a, b]), np.concatenate([rows["copies"][two[ok]], rows["copies"][one[ok]]]))
                    yield batch_of(1, a, b)

    def many(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """One tile as a matrix."""
        inside = rows["i"][0] == rows["j"][0]
        left = np.arange(len(rows["i"])) if inside else np.flatnonzero(rows["side"] == 0)
        right = left if inside else np.flatnonzero(rows["side"] == 1)
        near = rows["unit"][left] @ rows["unit"][right].T >= least
        if inside:
            np.fill_diagonal(near, False)
        sums, mine = np.zeros(len(rows["i"]), np.int64), np.zeros_like(near)
        for k in range(len(left)):
            at = np.flatnonzero(near[k])
            mine[k, at] = _first_table(rows["hashes"][left[k]], rows["hashes"][right[at]], rows["table"][0])
        sums[left] += mine @ rows["copies"][right]
        if not inside:
            sums[right] += mine.T @ rows["copies"][left]
        linked = np.flatnonzero(sums)
        if len(linked):
            yield batch_of(0, rows["vector_class"][linked], sums[linked])
        # each row takes the least label it can see until none changes
        label = np.arange(len(rows["i"]))
        touched = np.flatnonzero(near.any(1))
        while len(touched):
            before = label.copy()
            for k in touched:
                at = np.append(right[near[k]], left[k])
                label[at] = label[at].min()
            if (label == before).all():
                break
        child = np.flatnonzero(label != np.arange(len(label)))
        if len(child):
            yield batch_of(1, rows["vector_class"][child], rows["vector_class"][label[child]])

    def tiles(rows: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(cuts)
        for k in np.flatnonzero(sizes > _FEW):
            yield from many({x: v[cuts[k] : cuts[k + 1]] for x, v in rows.items()})
        small = np.flatnonzero((sizes > 1) & (sizes <= _FEW))
        if len(small):
            at = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in small])
            yield from few({x: v[at] for x, v in rows.items()}, np.concatenate([[0], np.cumsum(sizes[small])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("vector").to_pylist()
            longest = max(map(len, raw)) // 8
            rows = {x: batch.column(x).to_numpy() for x in ("key", "i", "j", "side", "vector_class", "copies")}
            rows["table"] = rows["key"].view(np.uint64) >> np.uint64(32)
            rows["hashes"] = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint32).reshape(len(raw), -1)
            if held is not None:
                longest = max(longest, held["unit"].shape[1])
            rows["unit"] = np.zeros((len(raw), longest))
            for k, vector in enumerate(raw):  # a shorter vector shares a bucket by accident only; see ``dim``
                rows["unit"][k, : len(vector) // 8] = np.frombuffer(vector, np.float64)
            rows["unit"] = _unit(rows["unit"])
            rows["dim"] = np.array([len(v) // 8 for v in raw])
            if held is not None:
                held["unit"] = np.pad(held["unit"], ((0, 0), (0, longest - held["unit"].shape[1])))
                rows = {x: np.concatenate([held[x], rows[x]]) for x in rows}
            new = np.zeros(len(rows["key"]), bool)
            new[1:] = np.logical_or.reduce([rows[x][1:] != rows[x][:-1] for x in ("key", "i", "j", "dim")])
            cuts = np.concatenate([[0], np.flatnonzero(new)])
            yield from tiles(rows, cuts)
            held = {x: v[cuts[-1] :] for x, v in rows.items()}
        if held is not None:
            yield from tiles(held, np.array([0, len(held["key"])]))

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, tables: int = 24,
                 projections: int = 16, width: float = 2.0) -> DataFrame:
    """One row per row of ``df``: id, n_links (other rows linked directly), component_id (least id reachable) and kept."""
    slim = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    id_type = slim.schema["id"].dataType.simpleString()
    rows = store(slim.mapInArrow(_classes, f"id {id_type}, vector_class long, vector binary"))
    classes = rows.where("vector_class is not null").groupBy("vector_class").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"))
    hashed = store(classes.select("vector_class", "vector", "copies").mapInArrow(
        _bucketed(tables, projections, width), "vector_class long, copies long, keys array<long>, hashes binary, vector binary"))
    keys = hashed.select("vector_class", F.explode("keys").alias("key"), F.octet_length("vector").alias("bytes"))
    shared = keys.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = keys.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("vector_class"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"), (x < F.col("block")).cast("int").alias("side")))
    tiles = members.withColumn("tile", F.explode(others)).select("key", "bytes", "tile.i", "tile.j", "tile.side", "vector_class")
    full = tiles.join(hashed.select("vector_class", "copies", "hashes", "vector"), "vector_class")
    full = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "bytes", "side")
    found = store(full.select("key", "i", "j", "side", "vector_class", "copies", "hashes", "vector").mapInArrow(_compare(cosine), "kind int, a long, b long"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("vector_class")).agg(F.sum("b").alias("others"))
    roots = components(found.where("kind = 1").select("a", "b"))
    own = rows.select("id", "vector_class").join(classes.select("vector_class", "copies"), "vector_class", "left").join(links, "vector_class", "left")
    own = own.join(roots.select(F.col("node").alias("vector_class"), "root"), "vector_class", "left").withColumn("root", F.coalesce("root", "vector_class"))
    least = own.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long")
    out = own.join(least, "root", "left").select(F.col("id").alias(id_col), n_links.alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
