"""Words, word hashes and shingle hashes of Arrow batches of texts, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multipliers modulo 2**64. Fixed values.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in a row, and the offset at which each begins, with the end."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) << 5).astype(np.uint8)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    plain = (sums[ends] - sums[starts]) * down[starts]
    return mixed(plain + (ends - starts).astype(np.uint64) * np.uint64(MIX[1]))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (runs of bytes other than space and \\t to \\r), and the words before each text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[1:] != space[:-1]
    # A text's start and end cut words too.
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    inside = ~space[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[inside], ends[inside]
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words (the whole of a shorter text that has words), and their texts."""
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    long_enough = np.zeros(len(words), bool)
    if len(words) >= size:
        long_enough[: len(words) - size + 1] = of[: len(words) - size + 1] == of[size - 1 :]
    at = np.flatnonzero(long_enough)
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(BASE) + words[at + k])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        rest = n[short].astype(np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            rest[has] = mixed(rest[has] * np.uint64(BASE) + words[first[short[has]] + k])
        out, at_text = np.concatenate([out, rest]), np.concatenate([of[at], short])
        return out, at_text
    return out, of[at]


def distinct_by_text(hashes: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one text after another, and the offset at which each text's begin."""
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    hashes, texts = hashes[new], texts[new]
    return hashes, np.searchsorted(texts, np.arange(n + 1))


def slices(texts: pa.Array, most_bytes: int = 4 << 20):
    """The texts in runs of about ``most_bytes`` bytes, so that work arrays stay small; a longer text is a run of its own."""
    _, offsets = bytes_of(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most_bytes, side="right")) - 1)
        yield texts.slice(begin, end - begin)
        begin = end


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets of word shingles (A-Z in lower case) as sorted hashes, with offsets."""
    parts, ends = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for run in slices(texts):
        data, offsets = bytes_of(run)
        data = lower_ascii(data)
        starts, stops, first = words_of(data, offsets)
        hashes, of = shingle_hashes(range_hashes(data, starts, stops), first, size)
        hashes, own = distinct_by_text(hashes, of, len(run))
        parts.append(hashes)
        ends.append(own[1:] + ends[-1][-1])
    return np.concatenate(parts), np.concatenate(ends)
