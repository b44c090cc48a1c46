"""Vectorised hashing of words and shingles, and fast similarity sketches.

Everything here works on one Arrow batch at a time and on numpy arrays only, so the memory it needs is bounded by the batch.
Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D``; A-Z are lower-cased. In UTF-8 those bytes never occur inside
another character, so splitting the encoded text is the same as splitting the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
#: Odd multipliers of the hash functions (fixed values).
BASE = U(0x9E3779B97F4A7C15)
MIX_A = U(0xBF58476D1CE4E5B9)
MIX_B = U(0x94D049BB133111EB)
SHORT = U(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n + 1, U)
    out[0] = 1
    if n:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return (data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]), offsets - (offsets[0] if len(offsets) else 0)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each row the index of its first word (one entry more than rows).

    The hash of a word is a polynomial over its lower-cased bytes, from prefix sums modulo 2**64, finalised with its length.
    """
    rows = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    white = _WHITE[data]
    starts_here = ~white
    starts_here[1:] &= white[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    starts_here[cut] = ~white[cut]
    ends_here = ~white
    ends_here[:-1] &= white[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends_here[last] = ~white[last]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    # polynomial prefix sums in pieces, so that the temporary arrays stay small
    total = np.zeros(len(data) + 1, U)
    step = 1 << 20
    power = _powers(step, BASE)
    carry, scale = U(0), U(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), step):
            piece = _LOWER[data[at : at + step]].astype(U)
            piece += U(1)
            piece *= power[: len(piece)]
            np.add.accumulate(piece, out=piece)
            total[at + 1 : at + 1 + len(piece)] = piece * scale + carry
            carry = total[at + len(piece)]
            scale = scale * power[step]
        down = _powers(step, U(_inverse(int(BASE))))
        block, inner = starts // step, starts % step
        far = _powers(int(block[-1]) if len(block) else 0, down[step])
        value = (total[ends] - total[starts]) * down[inner] * far[block]
        value = mix(value + (ends - starts).astype(U) * MIX_B)
    return value, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word shingle, and the row of each; a row of fewer words gives its whole sequence as one shingle."""
    counts = np.diff(first)
    rows = len(counts)
    with np.errstate(over="ignore"):
        power = _powers(k, BASE)
        usual = np.zeros(max(0, len(words) - k + 1), U)
        for j in range(k):
            usual += words[j : j + len(usual)] * power[j]
        usual = mix(usual)
        row = np.repeat(np.arange(rows), counts)
        inside = row[: len(usual)] == row[k - 1 :] if len(usual) else np.zeros(0, bool)
        short = np.flatnonzero((counts > 0) & (counts < k))
        alone = np.zeros(len(short), U)
        for j in range(k - 1):
            there = counts[short] > j
            alone[there] += words[first[short[there]] + j] * power[j]
        alone = mix(alone + SHORT * (counts[short] + 1).astype(U))
    return np.concatenate([usual[inside], alone]), np.concatenate([row[: len(usual)][inside], short])


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) in order of row, then value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def fast_similarity_sketch(row: np.ndarray, value: np.ndarray, rows: int, t: int) -> np.ndarray:
    """Sketches of t coordinates for each of `rows` sets, given as (row, value) pairs.

    Rounds of hashed bin placement: in round i below t every element falls into a bin drawn for that round, with a fraction drawn
    for that round; a bin keeps the smallest (round, fraction). In round t + j all elements compete for bin j, so that after
    at most 2t rounds every bin of a set that isn't empty is full. A set leaves as soon as its bins are full; as later rounds never displace
    earlier ones, the result is the same. Empty sets get zeros.
    """
    out = np.full((rows, t), np.iinfo(np.uint64).max, U)
    filled = np.zeros((rows, t), bool)
    present = np.zeros(rows, bool)
    present[row] = True
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if len(row) == 0:
                break
            h = mix(value + BASE * U(i + 1))
            if i < t:
                bins = ((h >> U(32)) * U(t) >> U(32)).astype(np.int64)
            else:
                bins = np.full(len(h), i - t, np.int64)
            fraction = mix(h + MIX_A)
            flat = row * t + bins
            free = ~filled.ravel()[flat]
            np.minimum.at(out.ravel(), flat[free], fraction[free])
            filled.ravel()[flat[free]] = True
            open_rows = ~filled.all(axis=1)
            keep = open_rows[row]
            row, value = row[keep], value[keep]
    out[~present] = 0
    return out


def slices(table: pa.RecordBatch, column: str, most: int = 1 << 20):
    """The batch in runs of rows whose texts have at most `most` bytes together; a longer text is alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield table.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield table.slice(start)
