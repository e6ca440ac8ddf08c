"""Sets of word shingles of Arrow text columns, hashed over whole buffers at once.

A word's hash is a sum over its bytes of a fixed random value of the byte times a
power of an odd number, modulo 2**64, mixed; so all words of a buffer come from
one running sum. Work goes in blocks of at most `BLOCK` bytes, cut at white space,
which bounds memory whatever the length of a text. Words of `LONG` bytes or more
(of which a block may hold a part only) are hashed by xxhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 19
LONG = 1 << 12

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15
#: The bytes that separate words, and A-Z as a-z.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_VALUE = np.random.default_rng(20_250_101).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]


def _powers(radix: int, n: int) -> np.ndarray:
    out = np.full(n, radix, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_UP = _powers(_RADIX, BLOCK + LONG)
_DOWN = _powers(pow(_RADIX, -1, 1 << 64), BLOCK + LONG)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, whose texts end at `ends`, and how many there
    are up to each end. data holds whole words and at most BLOCK + LONG bytes."""
    inside = ~_SPACE[data]
    first = np.empty(len(data) + 1, bool)
    first[:-1], first[-1] = inside, False
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    cut[0] = True
    after = np.empty(len(data) + 1, bool)
    after[0], after[1:] = False, inside
    starts = np.flatnonzero(first & (~after | cut))
    stops = np.flatnonzero(after & (~first | cut))
    total = np.empty(len(data) + 1, _U)
    total[0] = 0
    np.cumsum(_VALUE[data] * _UP[: len(data)], out=total[1:])
    h = mixed((total[stops] - total[starts]) * _DOWN[starts])
    for k in np.flatnonzero(stops - starts >= LONG):
        h[k] = xxhash.xxh3_64_intdigest(_LOWER[data[starts[k] : stops[k]]].tobytes())
    return h, np.searchsorted(starts, ends, "left")


def _long_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, block by block."""
    found, at = [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # inside one long word: to its end
                start = at
                while stop < len(data) and not (gaps := np.flatnonzero(_SPACE[data[stop : stop + BLOCK]])).size:
                    stop = min(stop + BLOCK, len(data))
                stop += int(gaps[0]) if gaps.size and stop < len(data) else 0
                found.append(np.array([xxhash.xxh3_64_intdigest(_LOWER[data[start:stop]].tobytes())], _U))
                at = stop
                continue
        part = data[at:stop]
        found.append(_words(part, np.array([len(part)]))[0])
        at = stop
    return np.concatenate([*found, np.empty(0, _U)])


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each text in order (null: none), the hashes of its words in order."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, at, buffer = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    null = np.asarray(column.is_null())
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        if offsets[stop] - offsets[row] > BLOCK:
            yield _long_words(data[offsets[row] : offsets[stop]]) if not null[row] else np.empty(0, _U)
        else:
            h, counts = _words(data[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row])
            begin = 0
            for k, end in enumerate(counts.tolist()):
                yield h[begin:end] if not null[row + k] else np.empty(0, _U)
                begin = end
        row = stop


def shingled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` of words' hashes in order, repeats kept; of
    the whole sequence if it is shorter; none without words."""
    if not len(h):
        return h
    wide = min(width, len(h))
    out = np.full(len(h) - wide + 1, wide, _U)
    for k in range(wide):
        out = out * _U(_RADIX) + h[k : k + len(out)]
    return mixed(out)


def sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Of each text in order, its distinct shingles' hashes, sorted."""
    for h in word_hashes(column):
        out = np.sort(shingled(h, width))
        yield out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def set_of(text: str | None, width: int = 5) -> np.ndarray:
    return next(sets(pa.array([text], pa.large_string()), width))
