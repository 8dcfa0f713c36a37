"""CRC-32 of any substring from two running values: one scan of a text serves all of its n-grams.

The CRC register is linear over GF(2). If R is the register after each prefix (started at 0), the CRC of bytes i to j is
``~(R[j] ^ shift(R[i] ^ ~0, j - i))``, where ``shift`` lets a number of zero bytes pass. Shifts by powers of two are
tables, so a shift by n bytes takes as many lookups as n has one bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from transitframe.llm.common import CHUNK_BYTES, text_chunks, word_bounds

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32 as zlib, gzip and Parquet use it
ONES = np.uint32(0xFFFFFFFF)
_LANES = 8192


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table


_TABLE = _byte_table()


def _apply(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by its values on each of the four bytes."""
    out = tables[0][register & np.uint32(255)]
    for place in (1, 2, 3):
        out = out ^ tables[place][(register >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def _shift_tables() -> list[np.ndarray]:
    """Entry k holds the map "2^k zero bytes pass"; each is the square of the one before."""
    values = [np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)]
    tables = [np.stack([(v >> np.uint32(8)) ^ _TABLE[v & np.uint32(255)] for v in values])]
    while len(tables) < 40:
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


_SHIFTS = _shift_tables()


def shift(register: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``register`` after ``count`` zero bytes, element by element."""
    register, count = np.broadcast_arrays(np.asarray(register, np.uint32), np.asarray(count, np.int64))
    register = register.copy()
    for k in range(int(count.max(initial=0)).bit_length()):
        moved = np.flatnonzero((count >> k) & 1)
        register[moved] = _apply(_SHIFTS[k], register[moved])
    return register


def running(data: np.ndarray) -> np.ndarray:
    """The register, started at 0, before the first and after each of the bytes.

    The bytes are cut into lanes which are scanned side by side; what enters a lane is then added, shifted along it.
    """
    lanes = max(1, min(_LANES, len(data) // 64))
    length = -(-len(data) // lanes) if len(data) else 1
    grid = np.zeros((lanes, length), np.uint8)
    grid.reshape(-1)[: len(data)] = data
    grid = np.ascontiguousarray(grid.T)
    states = np.empty((length, lanes), np.uint32)
    state = np.zeros(lanes, np.uint32)
    for step in range(length):
        state = (state >> np.uint32(8)) ^ _TABLE[(state ^ grid[step]) & np.uint32(255)]
        states[step] = state
    entering, reach = state, 1
    while reach < lanes:  # inclusive scan over lanes
        further = entering.copy()
        further[reach:] ^= shift(entering[:-reach], np.int64(reach * length))
        entering, reach = further, reach * 2
    state = np.concatenate([np.zeros(1, np.uint32), entering[:-1]])
    for step in range(length):
        state = (state >> np.uint32(8)) ^ _TABLE[state & np.uint32(255)]
        states[step] ^= state
    return np.concatenate([np.zeros(1, np.uint32), states.T.reshape(-1)[: len(data)]])


def substring_crc(registers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes ``starts`` to ``ends`` of the text that ``running`` scanned."""
    return ~(registers[ends] ^ shift(registers[starts] ^ ONES, ends - starts))


def joined_crc(head: np.ndarray, tail: np.ndarray, tail_length: np.ndarray) -> np.ndarray:
    """CRC-32 of a head followed by a tail, from the CRC-32 of both."""
    return shift(head, tail_length) ^ tail


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_MARK = np.array([False, True])


def word_pieces(column: pa.Array, inside: Callable[[np.ndarray], np.ndarray], context: int = 0, limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Runs of rows, and runs of words of one long row: (first row, lower-cased bytes, starts, ends, row of each word, fresh).

    Only A-Z are lower-cased; ``inside`` marks the bytes of words in lower-cased UTF-8. A row longer than ``limit`` comes in several pieces cut between words (a single word is never cut);
    its later pieces begin with the ``context`` words before them, and ``fresh`` counts those.
    """
    for first, end, data, offsets in text_chunks(column, limit):
        if end - first > 1 or len(data) <= limit:
            data = _LOWER[data]
            starts, ends, index = word_bounds(inside(data).view(np.uint8), offsets, _MARK)
            yield first, data, starts, ends, np.repeat(np.arange(first, end), np.diff(index)), 0
            continue
        at, fresh = 0, 0
        while at < len(data):
            cut = at + limit
            while cut < len(data):  # up to the next byte outside words
                gap = np.flatnonzero(~inside(_LOWER[data[cut - 1 : cut + 4096]])[1:])
                if len(gap):
                    cut += int(gap[0])
                    break
                cut += 4096
            cut = min(cut, len(data))
            piece = _LOWER[data[at:cut]]
            starts, ends, _ = word_bounds(inside(piece).view(np.uint8), np.array([0, len(piece)]), _MARK)
            if len(starts) > fresh:
                yield first, piece, starts, ends, np.full(len(starts), first), fresh
            if cut >= len(data):
                break
            kept = min(context, len(starts))
            at, fresh = (at + int(starts[len(starts) - kept]), kept) if kept else (cut, 0)
            limit = max(limit, 2 * (cut - at))  # context words may be long themselves


def normalised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row joined by one space: bytes, and where each word starts and ends in them."""
    length = ends - starts
    gap = np.ones(len(starts), np.int64)
    gap[:1] = 0
    gap[1:] = rows[1:] == rows[:-1]
    after = np.cumsum(length + gap)
    before = after - length
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    np.subtract.at(keep, ends, 1)
    inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    out = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    spaces = before[gap == 1] - 1
    word_bytes = np.ones(len(out), bool)
    word_bytes[spaces] = False
    out[word_bytes] = data[inside]
    return out, before, after
