"""Grouping spelling variants by reduced-alphabet generation.

Words are counted over all texts. Letters are hashed to a few symbols; every word of the vocabulary gives the full one-edit
neighbourhood of its reduced form (itself, all deletions, replacements and insertions over the small alphabet), which is
joined to the reduced vocabulary. One edit of a word is at most one edit of its reduced form, so no near pair is lost; each
ordered pair comes once, because every neighbour is generated in one way only. Pairs are then checked on the words. The
small alphabet keeps the neighbourhood short and far wider than the vocabulary: 8 symbols give 20 keys a letter.

Null and empty texts have no words; a null id counts as the empty string before the colon; repeated rows count each
time; no texts give no rows. Other columns are ignored. Words and reduced words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitframe.llm.common import as_signed, discard, mix, store, word_hashes
from transitframe.llm.crc import joined_crc, running, substring_crc, word_pieces

_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_LEAD = 0xC3  # the first UTF-8 byte of U+00C0 to U+00FF


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Marks a-z and the letters from U+00C0 to U+00FF in lower-cased UTF-8."""
    inside = _ASCII[data]
    lead = data == _LEAD
    inside |= lead
    inside[1:] |= lead[:-1]
    return inside


def _drop(word: str, at: int) -> str:
    return word[:at] + word[at + 1 :]


def _word_counts(least_length: int, typo: int):
    """(id, text) -> (word, n), summed over a run of rows. A run of letters whose CRC with its id ``typo`` divides loses a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in batch.column(0).to_pylist()], np.uint32)
            for _, data, starts, ends, rows, _ in word_pieces(batch.column(1), letter_bytes):
                size = ends - starts
                crcs = joined_crc(heads[rows], substring_crc(running(data), starts, ends), size)
                leads = np.concatenate([[0], np.cumsum(data == _LEAD)])
                length = size - (leads[ends] - leads[starts])
                changed = crcs % np.uint32(typo) == 0 if typo else np.zeros(len(size), bool)
                kept = np.flatnonzero(~changed & (length >= least_length))
                _, first, count = np.unique(word_hashes(data, starts[kept], ends[kept]), return_index=True, return_counts=True)
                words = [data[starts[i] : ends[i]].tobytes().decode() for i in kept[first]]
                counts = count.tolist()
                for i in np.flatnonzero(changed & (length > least_length)):
                    words.append(_drop(data[starts[i] : ends[i]].tobytes().decode(), int(crcs[i]) % int(length[i])))
                    counts.append(1)
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts, pa.int64())], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, typo: int = 199) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points that occur ``least_count`` times or more."""
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = slim.mapInArrow(_word_counts(least_length, typo), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 18


def _symbol_codes(symbols: int) -> np.ndarray:
    return mix(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def reduce_letters(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol of each code point, by a multiplicative hash."""
    return ((codes.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(40)) % np.uint64(symbols)


def _powers(n: int) -> np.ndarray:
    table = np.full(n, _STEP, np.uint64)
    table[:1] = 1
    return np.cumprod(table, dtype=np.uint64)


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length * 0xC2B2AE3D27D4EB4F % (1 << 64)))


def neighbour_keys(reduced: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key): the keys of each row of ``reduced`` (words of one length) and of all strings one edit away, each once.

    A deletion takes the last of a run of equal symbols, an insertion never stands before an equal symbol.
    """
    words, length = reduced.shape
    code = _symbol_codes(symbols)
    power = _powers(length + 1)
    terms = code[reduced] * power[:length]
    prefix = np.zeros((words, length + 1), np.uint64)
    np.cumsum(terms, axis=1, out=prefix[:, 1:], dtype=np.uint64)
    total = prefix[:, -1:]
    yield np.arange(words), _finished(total[:, 0], length)
    step = max(1, _BLOCK // (words * symbols))
    every = np.arange(symbols)
    for a in range(0, length + 1, step):
        b = min(a + step, length)
        if a < b:
            here, row_terms = reduced[:, a:b], terms[:, a:b]
            after = np.full(here.shape, symbols, reduced.dtype)
            upto = min(b + 1, length)
            after[:, : upto - a - 1] = reduced[:, a + 1 : upto]
            shorter = prefix[:, a:b] + (total - prefix[:, a + 1 : b + 1]) * _STEP_BACK
            last = here != after
            yield np.nonzero(last)[0], _finished(shorter[last], length - 1)
            swapped = (total - row_terms)[:, :, None] + code[None, None, :] * power[None, a:b, None]
            other = here[:, :, None] != every
            yield np.nonzero(other)[0], _finished(swapped[other], length)
        end = min(a + step, length + 1)
        before = np.full((words, end - a), symbols, reduced.dtype)
        before[:, : b - a] = reduced[:, a:b]
        longer = (prefix[:, a:end] + (total - prefix[:, a:end]) * _STEP)[:, :, None] + code[None, None, :] * power[None, a:end, None]
        free = before[:, :, None] != every
        yield np.nonzero(free)[0], _finished(longer[free], length + 1)


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, reduced words) for runs of words of one length."""
    length = np.array([len(w) for w in words])
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        step = max(1, _BLOCK // (int(size) * symbols))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            codes = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), int(size))
            yield some, reduce_letters(codes, symbols)


def _keys(symbols: int, neighbours: bool):
    """(id, word) -> (key, id): the keys of the neighbourhood, or the word's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, reduced in _by_length(batch.column(1).to_pylist(), symbols):
                for row, key in neighbour_keys(reduced, symbols):
                    yield pa.RecordBatch.from_arrays([pa.array(as_signed(key)), pa.array(ids[rows[row]])], ["key", "id"])
                    if not neighbours:
                        break

    return run


def near_pairs(words: DataFrame, symbols: int = 8) -> DataFrame:
    """(id, near, near_n): every ordered pair of words exactly one edit apart. ``words``: id, word, n.

    Spark takes the keys to be as many as the words, though they are 20 a letter; the hint keeps it from broadcasting them.
    """
    keys = lambda every: words.select("id", "word").mapInArrow(_keys(symbols, every), "key long, id long")
    own = keys(False).join(words.select("id", F.col("word").alias("near"), F.col("n").alias("near_n")), "id").withColumnRenamed("id", "near_id")
    met = keys(True).hint("merge").join(own, "key").where("id <> near_id").select("id", "near", "near_n")
    return met.join(words.select("id", "word"), "id").where(F.levenshtein("word", "near", 1) == 1).select("id", "near", "near_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, typo: int = 199,
             times: int = 5, symbols: int = 8) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form`` (null if none), ``form_n`` and ``root``.

    A form is at least ``times`` as frequent, so a chain of forms is no longer than the logarithm of the largest count;
    roots are found by pointer doubling in a number of rounds fixed by that count.
    """
    words = store(vocabulary(docs, id_col, text_col, least_length, least_count, typo).withColumn("id", F.xxhash64("word")))
    best = near_pairs(words, symbols).groupBy("id").agg(
        F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    rows = words.join(best, "id", "left")
    is_form = F.col("best.near_n") >= F.lit(times) * F.col("n")
    rows = store(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, F.col("best.near_n")).alias("form_n")))
    discard(words)
    most = rows.agg(F.max("n")).first()[0] or 0
    steps = 0
    while times > 1 and most >= least_count * times ** (steps + 1):
        steps += 1
    roots = store(rows.where("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(max(0, steps - 1).bit_length()):
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = store(roots.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        discard(roots)
        roots = further
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
