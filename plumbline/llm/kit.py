"""Vectorised text helpers that run inside tasks, on Arrow buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D.  A word's hash
is a polynomial over randomly mapped bytes, taken from prefix products, so that
no Python object is made for a word.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240117))
_EXACT = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}
_HELD: dict[str, Callable[[], None]] = {}


def holds(name: str, free: Callable[[], None]) -> None:
    """``free`` gives back what the operator of that name keeps in this worker process."""
    _HELD[name] = free


def begins(name: str) -> None:
    """A task of the operator of that name begins: what others keep goes, as workers serve one stage after another."""
    others = [n for n in _HELD if n != name]
    for other in others:
        _HELD.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = (max(int(n), 1) + 0xFFFF) & ~0xFFFF
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def row_slices(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _hash_block(data: np.ndarray, breaks: np.ndarray, table: np.ndarray, outside: np.ndarray):
    """Starts, ends and hashes of the words of one block; a word ends at each break."""
    inside = ~outside[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    start[inner] = inside[inner]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    gap = ~inside
    gap[inner] = True  # a word ends before a break even where no white space stands
    cut = np.flatnonzero(gap)
    after = np.searchsorted(cut, starts, side="right")
    ends = np.append(cut, len(data))[after]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return starts, ends, mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, outside: np.ndarray = _SPACE):
    """Words of the rows that ``offsets`` delimit: maximal runs of bytes that ``outside`` (256 flags) does not hold.

    Returns (starts, ends, hashes, first): byte positions within ``data``, a
    64-bit hash of each word (``fold``: of the word with A-Z in lower case), and
    per row the index of its first word, with one more entry for the total.
    Long rows are hashed block by block, cut at bytes outside of words.
    """
    table = _FOLDED if fold else _EXACT
    low, high = int(offsets[0]), int(offsets[-1])
    parts, at = [], low
    while at < high:
        to = min(high, at + BLOCK_BYTES)
        while to < high and not outside[data[to]]:  # to the next byte outside of words
            step = data[to : to + 4096]
            found = np.flatnonzero(outside[step])
            to = min(high, to + (int(found[0]) if len(found) else len(step)))
        i, j = np.searchsorted(offsets, [at, to], side="left")
        starts, ends, hashes = _hash_block(data[at:to], np.asarray(offsets[i : j + 1], np.int64) - at, table, outside)
        parts.append((starts + at, ends + at, hashes))
        at = to
    if parts:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts = ends = np.zeros(0, np.int64)
        hashes = np.zeros(0, np.uint64)
    return starts, ends, hashes, np.searchsorted(starts, offsets, side="left")


def windows(hashes: np.ndarray, first: np.ndarray, width: int, short: bool = False):
    """Hashes of ``width``-word windows within rows.

    Returns (hashes, starting word, first window of each row and the total).
    ``short``: a row of fewer words, but at least one, gives one window of all.
    """
    n = np.diff(first)
    count = np.maximum(n - width + 1, 0)
    if short:
        count = np.where((n > 0) & (count == 0), 1, count)
    begin = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = first[:-1][row] + (np.arange(begin[-1]) - begin[:-1][row])
    last = first[1:][row] - 1
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k <= last
        word = hashes[np.minimum(at + k, last)] if len(at) else np.zeros(0, np.uint64)
        out = np.where(inside, mix64(out * _BASE + word + np.uint64(k + 1)), out)
    return out, at, begin


def unique_in_rows(values: np.ndarray, begin: np.ndarray):
    """Sorted distinct values of each row, with the rows' new beginnings."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[fresh], row[fresh]
    return values, np.searchsorted(row, np.arange(len(begin)), side="left")


def constant_array(values: list[float]) -> Column:
    """An array of numbers as one constant of the plan, however many they are."""
    return F.split(F.lit(",".join(f"{float(v):.9g}" for v in values)), ",").cast("array<double>")


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the given rows."""
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values, kind))
