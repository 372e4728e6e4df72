"""Words of whole Arrow batches as numpy arrays, without a Python object a word.

Words are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage
return.  A batch is read in segments of about ``SEGMENT`` bytes, cut between words, so that
work arrays stay small however long a text is; a text may go on in the next segment.

Defined results: a null text is empty, an empty or blank text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(71).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, one after another, and where each begins (one more than texts)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def segments(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, where texts begin and end): whole texts, or one text's parts.

    Every text is in some segment; the parts of a long one follow each other.
    """
    size = size or SEGMENT
    data, at = bytes_of(column)
    text, n = 0, len(at) - 1
    while text < n:
        stop = max(text + 1, int(np.searchsorted(at, at[text] + size, side="right")) - 1)
        if at[stop] - at[text] <= 2 * size:
            yield text, data[at[text] : at[stop]], at[text : stop + 1] - at[text]
            text = stop
            continue
        low, end = int(at[text]), int(at[text + 1])
        while low < end:
            high = min(low + size, end)
            while high < end:  # to the next space
                blank = np.flatnonzero(_SPACE[data[high : min(high + size, end)]])
                if len(blank):
                    high += int(blank[0])
                    break
                high = min(high + size, end)
            yield text, data[low:high], np.array([0, high - low])
            low = high
        text += 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in a segment, and the first word of each text (one more than texts)."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, modulo 2**64, of an odd number and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            factors = np.full(max(n, 2 * SEGMENT), base, np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        if n > 4 * SEGMENT:  # one huge word: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span, the same for the same bytes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * up[: len(data)], out=run[1:])
    h = (run[ends] - run[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def numbered(values: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values (ascending if ``ordered``), the number of its distinct value for each, and a place where each is seen."""
    coded = pa.array(values).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    if ordered:
        order = np.argsort(distinct)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        distinct, codes = distinct[order], place[codes]
    seen = np.empty(len(distinct), np.int64)
    seen[codes] = np.arange(len(codes))
    return distinct, codes, seen


def texts_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings; a span never cuts a character."""
    n = ends - starts
    edge = np.concatenate([[0], np.cumsum(n)])
    if edge[-1] >= 1 << 31:
        raise ValueError("spans of 2 GB and more at once")
    flat = data[np.repeat(starts - edge[:-1], n) + np.arange(edge[-1])]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(flat))


def last_characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int) -> np.ndarray:
    """Where the last ``count`` characters of each span begin, or its start if it has fewer."""
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    place = np.searchsorted(leads, ends) - count
    return np.maximum(leads[np.maximum(place, 0)], starts) if len(leads) else starts


def found_in(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key in the ascending ``known``, or -1."""
    if not len(known):
        return np.full(len(key), -1, np.int64)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, at, -1)
