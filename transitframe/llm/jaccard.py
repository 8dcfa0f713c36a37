"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

Texts become sets of word shingles (64-bit hashes). Two sets link when ``100 * intersection >= percent * union``.

1. Equal sets form one class; only classes are compared.
2. Classes are banded by set size. A linked pair lies in one band or across one border, where at most H elements
   differ. A set is cut by hash range into P > H parts; at least P - H parts of a linked pair are equal, so both
   sets hold a common (band, part, content) tile key. Keys are ordered by part size. If a set differs from any partner
   in at most d elements, at most d of its parts come before the first one that both hold, so its d + 1 first keys are
   enough; nearly empty parts are left out. No pair is lost, and texts that share only a passage rarely meet.
3. Each class is checked with one class of its tiles, the one that shares most tiles with others; links found so are
   contracted to components. A large group of copies mostly ends here.
4. Tiles whose members still lie in several components are compared in blocks: XOR bitmaps bound the intersection
   from above. While that finds many links, each class is checked with its nearest one of another component in every
   tile; then every pair left between components that passes the bound is intersected exactly. A tile without further
   pairs that pass is dropped after a round.

Nulls and texts without words have the empty set and link with nothing. Repeated rows are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitframe.llm.common import NOT_SPACE, as_signed, discard, mix, store, text_chunks, word_bounds, word_hashes
from transitframe.llm.components import components

BITS = 1024
BLOCK = 256
_SEEN = 1 << 20
_MULTIPLIERS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA24BAED4963EE407, 0x8CB92BA72F3D8DD7)]


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``words``-word shingles."""
    for first, end, data, offsets in text_chunks(column):
        starts, ends, index = word_bounds(data, offsets, NOT_SPACE)
        hashes = word_hashes(data, starts, ends)
        m = len(hashes)
        rolled = np.zeros(max(0, m - words + 1), np.uint64)
        for i in range(words):
            if len(rolled):
                rolled += hashes[i : m - words + 1 + i] * _MULTIPLIERS[i % 5] * np.uint64(2 * (i // 5) + 1)
        rolled = mix(rolled)
        for row in range(end - first):
            lo, hi = index[row], index[row + 1]
            if hi - lo >= words:
                own = np.sort(rolled[lo : hi - words + 1])
                keep = np.ones(len(own), bool)
                keep[1:] = own[1:] != own[:-1]
                yield own[keep]
            elif hi > lo:
                short = np.array([hi - lo], np.uint64)
                for i in range(lo, hi):
                    short = mix(short * _MULTIPLIERS[4] + hashes[i])
                yield short
            else:
                yield np.zeros(0, np.uint64)


def _class_of(own: np.ndarray) -> int:
    """One number for a set: a mixed sum, a mixed XOR and the size."""
    if not len(own):
        return 0
    total = np.array([[own.sum(dtype=np.uint64)], [np.bitwise_xor.reduce(mix(own + np.uint64(1)))], [len(own)]], np.uint64)
    return int(as_signed(mix(mix(total[0]) + total[1] * _MULTIPLIERS[0] + total[2] * _MULTIPLIERS[1]))[0])


def _bands(percent: int, largest: int) -> list[int]:
    """Band borders, each three times the one before or more: a link crosses one border at most.

    Wide bands have few borders, and a set's keys in its own band depend on its own size, not on the band's width.
    """
    borders = [1]
    while borders[-1] <= largest:
        at = borders[-1]
        borders.append(at + max(2 * at, -(-at * (100 - percent) // percent)))
    return borders


def _places(n: int, borders: list[int], percent: int) -> list[tuple[int, int, int]]:
    """(band id, H, own) of the places where a set of ``n`` elements meets its partners: its band, and borders in reach.

    A linked pair differs in at most (100 - percent) * (n1 + n2) / (100 + percent) elements: H bounds that for all pairs
    of the place, ``own`` for this set and the largest partner it can have there.
    """
    band = int(np.searchsorted(borders, n, "right")) - 1
    off, whole = 100 - percent, 100 + percent
    largest = n * 100 // percent
    last = borders[band + 1] - 1
    places = [(2 * band, off * 2 * last // whole, off * (n + min(last, largest)) // whole)]
    for at in (band, band + 1):  # the border below and the one above
        border = borders[at]
        below = border - 1
        if border > 1 and n * 100 >= percent * border and n * percent <= below * 100:
            places.append((2 * at + 1, off * (below * (100 + percent) // percent) // whole, off * (n + (below if n > below else largest)) // whole))
    return places


def tile_keys(own: np.ndarray, borders: list[int], percent: int) -> np.ndarray:
    """The tile keys of one sorted set."""
    mixed = mix(own ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:], dtype=np.uint64)
    top = own >> np.uint64(32)
    keys = []
    for place, most, differ in _places(len(own), borders, percent):
        spare = most // 4
        parts = most + 1 + spare
        part = (top * np.uint64(parts)) >> np.uint64(32)  # the set is sorted, so parts are runs
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(own)]])
        band = np.array([place], np.uint64) * _MULTIPLIERS[3]
        label = part[cut[:-1]] * _MULTIPLIERS[2] + band
        key = mix(sums[cut[1:]] - sums[cut[:-1]] + mix(label))
        if len(key) > differ + 1:  # the largest parts, ties by content
            count = np.diff(cut).astype(np.uint64)
            order = np.argsort((np.minimum(count, np.uint64(255)) << np.uint64(56)) | (key >> np.uint64(8)), kind="stable")
            key = key[order[len(key) - differ - 1 :]]
        elif len(key) < differ + 1:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[cut[:-1]])
            key = np.concatenate([key, mix(mix(empty * _MULTIPLIERS[2] + band) + np.uint64(3))])
        keys.append(key)
    return np.concatenate(keys)


def _bitmap(own: np.ndarray) -> bytes:
    """Every element flips one of BITS bits, so differing bits never outnumber differing elements."""
    odd = np.bincount((own >> np.uint64(17)) % np.uint64(BITS), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _classes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes = [], []
            for own in shingle_sets(batch.column(batch.num_columns - 1), words):
                sizes.append(len(own))
                classes.append(_class_of(own))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())], [*names, "n_shingles", "set_class"])

    return run


def _keys(words: int, percent: int, borders: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies met by the same task give their keys once
        for batch in batches:
            keys, classes, held = [], [], 0
            for own in shingle_sets(batch.column(0), words):
                if not len(own) or (of := _class_of(own)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(of)
                keys.append(key := tile_keys(own, borders, percent))
                classes.append(np.full(len(key), of, np.int64))
                held += len(key)
                if held > 500_000:
                    yield _pairs_batch(["key", "set_class"], np.concatenate(keys), np.concatenate(classes))
                    keys, classes, held = [], [], 0
            if held:
                yield _pairs_batch(["key", "set_class"], np.concatenate(keys), np.concatenate(classes))

    return run


def _pairs_batch(names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(as_signed(x) if x.dtype == np.uint64 else x) for x in arrays], names)


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, class): every further class of a key beside the key's first one."""
    key = leader = last = None
    for batch in batches:
        k, c = (batch.column(i).to_numpy() for i in range(2))
        if not len(k):
            continue
        if key is not None:
            k, c = np.concatenate([[key, key], k]), np.concatenate([[leader, last], c])
        new_key = np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        new_class = new_key.copy()
        new_class[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new_key)
        of = c[first[np.cumsum(new_key) - 1]]
        emit = new_class & ~new_key & (c != of)
        if key is not None:
            emit[:2] = False
        if emit.any():
            yield _pairs_batch(["key", "leader", "member"], k[emit], of[emit], c[emit])
        key, leader, last = k[-1], of[-1], c[-1]


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal rows met by the same task give their set once
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            out: list[tuple] = []
            held = 0
            for want, own in zip(wanted, shingle_sets(batch.column(1), words), strict=True):
                if len(own) and want not in seen and _class_of(own) == want:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(want)
                    out.append((want, len(own), _bitmap(own), own.tobytes()))
                    held += own.nbytes
                if held > 8 << 20:
                    yield _set_batch(out)
                    out, held = [], 0
            if out:
                yield _set_batch(out)

    return run


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["set_class", "n", "bits", "items"])


def bound_passes(n1: np.ndarray, n2: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Can a pair link whose bitmaps differ in ``differing`` bits? 2 * intersection <= n1 + n2 - differing."""
    both = n1 + n2
    return (100 + percent) * (both - differing) >= 2 * percent * both


def _verified(percent: int):
    """Rows (a, b, n_a, bits_a, items_a, n_b, bits_b, items_b) -> linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n1, n2 = (batch.column(i).to_numpy() for i in (0, 1, 2, 5))
            bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (3, 6)]
            passed = np.flatnonzero(bound_passes(n1, n2, np.bitwise_count(bits[0] ^ bits[1]).sum(1).astype(np.int64), percent))
            linked = []
            left, right = batch.column(4), batch.column(7)
            for i in passed:
                x, y = (np.frombuffer(col[int(i)].as_py(), np.uint64) for col in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    linked.append(i)
            if linked:
                yield _pairs_batch(["a", "b"], a[linked], b[linked])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    named = lambda x: sets.select(F.col("set_class").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"), F.col("items").alias(f"items_{x}"))
    rows = pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b")
    return rows.select("a", "b", "n_a", "bits_a", "items_a", "n_b", "bits_b", "items_b").mapInArrow(_verified(percent), "a long, b long")


def _tiles(percent: int, nearest: bool):
    """Rows sorted by tile (key, i, j): pairs of different components that the size and bitmap bounds let pass.

    Columns (key, a, b, more). ``nearest``: for each class of the tile its best pair only, the one of least share of
    differing bits; ``more`` says that the class has others.
    """

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        right = np.flatnonzero(rows["side"] == 1)
        n, bits, comp, of, odd = rows["n"], rows["bits"], rows["root"], rows["member"], rows["odd"]
        found = []
        for i in np.flatnonzero(rows["side"] == 0):
            near = right[(comp[right] != comp[i]) & (nearest | ~odd[right] | (of[right] > of[i]))]
            differing = np.bitwise_count(bits[near] ^ bits[i]).sum(1).astype(np.int64)
            passed = bound_passes(n[near], n[i], differing, percent)
            if passed.any():
                b, more = of[near[passed]], nearest and len(passed.nonzero()[0]) > 1
                if nearest:
                    b = b[np.lexsort([b, differing[passed] / (n[near[passed]] + n[i])])[:1]]
                found.append((np.full(len(b), of[i]), b, np.full(len(b), more)))
        if found:
            a, b, more = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _pairs_batch(["key", "a", "b", "more"], np.full(len(a), rows["key"][0]), a, b, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {x: batch.column(x).to_numpy() for x in ("key", "i", "j", "side", "member", "root", "n")}
            rows["odd"] = batch.column("odd").to_numpy(zero_copy_only=False)
            rows["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            if held is not None:
                rows = {x: np.concatenate([held[x], rows[x]]) for x in rows}
            new = np.zeros(len(rows["key"]), bool)
            new[1:] = np.logical_or.reduce([rows[x][1:] != rows[x][:-1] for x in ("key", "i", "j")])
            cuts = [0, *np.flatnonzero(new)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield from pairs({x: v[lo:hi] for x, v in rows.items()})
            held = {x: v[cuts[-1] :] for x, v in rows.items()}
        if held is not None:
            yield from pairs(held)

    return run


def _open_tiles(shared: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Sorted rows of the tiles whose members are not yet one component.

    Members of the leader's component need not meet one another: only the others (``odd``) meet every member.
    Both are dealt into blocks, so a tile is at most about BLOCK x BLOCK whatever the key's rows.
    """
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    rows = shared.join(root("member"), "member", "left").join(root("leader"), "leader", "left")
    rows = rows.withColumns({f"{x}_root": F.coalesce(f"{x}_root", x) for x in ("member", "leader")})
    rows = rows.withColumn("odd", F.col("member_root") != F.col("leader_root"))
    still = store(rows.where("odd").groupBy("key").agg(F.count("*").alias("n_odd")))
    rows = rows.join(still.select("key"), "key", "left_semi")
    members = store(
        rows.select("key", "member", F.col("member_root").alias("root"), "odd")
        .unionByName(rows.groupBy("key").agg(F.first("leader").alias("member"), F.first("leader_root").alias("root"), F.lit(False).alias("odd")))
    )
    counts = members.groupBy("key").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("odd") / BLOCK).cast("int").alias("odd_blocks"))
    members = members.join(counts, "key").join(sets.select(F.col("set_class").alias("member"), "n", "bits"), "member")
    dealt = lambda parts: F.pmod(F.xxhash64("member"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    columns = ("key", "i", "j", "side", "member", "root", "odd", "n", "bits")
    left = members.where("odd").select("*", dealt("odd_blocks").alias("i"), every("blocks").alias("j"), F.lit(0).alias("side"))
    right = members.select("*", every("odd_blocks").alias("i"), dealt("blocks").alias("j"), F.lit(1).alias("side"))
    tiles = left.select(*columns).unionByName(right.select(*columns))
    return tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _central(shared: DataFrame) -> DataFrame:
    """(a, b): every class of a tile beside the class of its tiles that stands in most tiles."""
    rows = shared.select("key", "member").unionByName(shared.groupBy("key").agg(F.first("leader").alias("member")))
    often = rows.groupBy("member").agg(F.count("*").alias("often"))
    top = rows.join(often, "member").groupBy("key").agg(F.max(F.struct("often", "member")).alias("top"))
    best = rows.join(top, "key").groupBy("member").agg(F.max("top").alias("top"))
    return best.select(F.col("member").alias("a"), F.col("top.member").alias("b")).where("a <> b")


def _links(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Enough exact links (a, b) that their components are those of all links.

    Components only grow, and every pair found is intersected exactly. So only tiles in which a class passed the bounds
    with more classes than its nearest one can still hold a link: each round passes these alone to the next.
    """
    found_columns = "key long, a long, b long, more boolean"
    distinct_pairs = lambda rows: rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = store(_verify(_central(shared), sets, percent))
    live = shared
    while True:
        tiles = _open_tiles(live, components(links), sets)
        found = store(tiles.mapInArrow(_tiles(percent, nearest=True), found_columns))
        new = store(_verify(distinct_pairs(found), sets, percent))
        fewer = store(live.join(found.where("more").select("key").distinct(), "key", "left_semi"))
        discard(found, *([live] if live is not shared else []))
        live = fewer
        n_new, n_links = new.count(), links.count()
        if n_new:
            before, links = links, store(links.unionByName(new))
            discard(before)
        discard(new)
        if n_new * 20 <= n_links:  # what is left is little work for all pairs
            break
    tiles = _open_tiles(live, components(links), sets)
    pairs = distinct_pairs(tiles.mapInArrow(_tiles(percent, nearest=False), found_columns))
    all_links = store(links.unionByName(_verify(pairs, sets, percent)))
    discard(links, live)
    return all_links


def _grouped(slim: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of (row_key, id, text) rows: the stored (row_key, id, n_shingles, set_class, root) and the links between classes."""
    id_type = slim.schema["id"].dataType.simpleString()
    kept = store(slim.select("row_key", "id", "text").mapInArrow(_classes(words), f"row_key long, id {id_type}, n_shingles long, set_class long"))
    largest = kept.agg(F.max("n_shingles")).first()[0] or 0
    borders = _bands(percent, largest)
    keys = slim.select("text").mapInArrow(_keys(words, percent, borders), "key long, set_class long")
    shared = store(
        keys.repartition("key").sortWithinPartitions("key", "set_class").mapInArrow(_leaders, "key long, leader long, member long")
    )
    involved = shared.select(F.col("leader").alias("set_class")).union(shared.select("member")).distinct()
    # a class is read from one of its rows, told by id and text: a null or repeated id is no other than a single one
    holders = kept.where("n_shingles > 0").groupBy("set_class").agg(F.min("row_key").alias("row_key")).join(involved, "set_class", "left_semi")
    sets = store(
        slim.select("row_key", "text").join(holders, "row_key").select("set_class", "text")
        .mapInArrow(_sets(words), "set_class long, n long, bits binary, items binary").dropDuplicates(["set_class"])
    )
    links = _links(shared, sets, percent)
    discard(shared, sets)
    roots = components(links).select(F.col("node").alias("set_class"), "root")
    own = kept.join(roots, "set_class", "left").withColumn("root", F.coalesce("root", "set_class"))
    return own, links


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id`` (least id reachable by links, itself included).

    Null, empty and blank texts have no shingles and are their own component; each text of a repeated id is compared, and
    equal texts share a component; other columns of ``docs`` are ignored. A null id takes the least id of its group, or
    null if the group has none; links through texts without an id count.
    """
    own, _ = _grouped(_slim(docs, id_col, text_col), words, percent)
    least = own.where("n_shingles > 0").groupBy("root").agg(F.min("id").alias("least"))
    return own.join(least, "root", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component left: the row of the least id (nulls last), then of the least hash of its text.

    A row goes only for its own text: another text under the same id stays. Of equal ids and texts one row stays. Texts
    without words link with nothing and stay. Only the keys of rows that go or repeat meet the documents.
    """
    own, _ = _grouped(_slim(docs, id_col, text_col), words, percent)
    rows = own.where("n_shingles > 0").groupBy("root", "row_key").agg(F.first("id").alias("id"), F.count("*").alias("rows"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first"))
    fates = store(
        rows.join(first, "root").select("row_key", F.when(F.col("row_key") != F.col("first.row_key"), "goes").when(F.col("rows") > 1, "repeats").alias("fate"))
        .where("fate is not null"))
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")  # keeps the documents' names apart
    keyed = docs.select(whole, F.xxhash64(id_col, text_col).alias("row_key"))
    single = keyed.join(fates.select("row_key"), "row_key", "left_anti")
    repeated = keyed.join(fates.where("fate = 'repeats'").select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"])
    return single.select("doc.*").unionByName(repeated.select("doc.*"))
