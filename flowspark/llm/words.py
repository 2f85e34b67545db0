"""Word and shingle hashes of whole texts, computed over Arrow buffers without a Python object per word."""

import numpy as np
import pyarrow as pa

_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Rows of a batch that are worked on at once.
ROWS = 512

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _separators(ranges):
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first:last + 1] = True
    return table


#: Words are runs of anything but white space, or runs of letters, digits and non-ASCII characters.
WHITE_SPACE = _separators([(0x20, 0x20), (0x09, 0x0D)])
NOT_ALNUM = _separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_folded_values = _values[_lower]
_powers = {}


def _power_tables(n):
    if _powers.get("n", 0) < n:
        n = max(n, _PIECE + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(x):
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column):
    """Offsets (from 0) and bytes of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], data


def word_bounds(offsets, data, separators):
    """Start and end of every word, and the index of each text's first word (one more at the end)."""
    inside = ~(separators[_lower])[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data, starts, ends, fold=True):
    """A 64-bit hash of every word, A-Z taken as lower case unless fold is false.

    Words must be in the order of their starts; long buffers go piece by piece.
    """
    values = _folded_values if fold else _values
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        base = starts[i]
        piece = data[base:ends[j - 1]]
        up, down = _power_tables(len(piece) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(values[piece] * up[:len(piece)], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _BASE)
        i = j
    return out


def words_of(column, separators):
    """(hash of every word, index of each text's first word) for a string array."""
    offsets, data = text_buffers(column)
    starts, ends, first = word_bounds(offsets, data, separators)
    return hash_words(data, starts, ends), first


def windows(hashes, width):
    """A hash of every `width` words in a row; position i covers words i to i + width - 1."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        out = mix(hashes[:n] + np.uint64(width))
        for k in range(1, width):
            out = mix(out * _BASE + hashes[k:k + n])
    return out


def slices(batches, rows=ROWS):
    """The batches in pieces of a few rows, so that what is worked on at once stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
