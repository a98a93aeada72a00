"""Words and rolling hashes of many texts at once (numpy helpers used inside tasks).

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8
text.  All hashes are unsigned 64-bit with wrap-around arithmetic:

* a word's hash is a polynomial over its bytes in an odd base, mixed with its
  length by a bijective finaliser.  Such polynomials collide for certain long
  words (Thue-Morse words of 1,024 letters for every base), so words of more
  than ``LONG_WORD`` bytes get a BLAKE2 hash;
* a window of ``k`` words has the Rabin-Karp hash ``sum(word[i] * R**i)``,
  taken from prefix sums (one subtraction and one product per window,
  whatever ``k``), and finalised again.

Work goes in slices of bounded size, so memory follows the batch and not the
longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .memory import release

BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1
SLICE_BYTES = 1 << 18
LONG_WORD = 256

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII A-Z to a-z, every other byte unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: dict = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) for i < n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        have = _powers[base] = (out[0], out[1])
    return have


def finalise(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (spreads every bit over all bits)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and the offsets of each text
    (one more than texts).  Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.empty(0, np.uint8)
    return buf, offsets - first


def text_slices(offsets: np.ndarray, max_bytes: int = 1 << 20):
    """(first, last + 1) of runs of texts of about ``max_bytes`` together; a
    longer text is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
    release()


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of every word, and for each text the index of
    its first word (one more than texts).  Words never cross texts."""
    inside = ~_SEPARATOR[buf]
    opens = inside.copy()
    closes = inside.copy()
    if len(buf) > 1:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    if len(heads):
        opens[heads] |= inside[heads]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes[tails] |= inside[tails]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple = ()):
    """64-bit hash of every word; with ``prefixes`` a list of that and, for
    each given length, the hashes of the first so many bytes (of whole words
    where they are no longer)."""
    n = len(starts)
    out = np.empty(n, dtype=np.uint64)
    more = [np.empty(n, dtype=np.uint64) for _ in prefixes]
    i = 0
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right"))
        if j <= i:  # one word longer than a slice; hashed below
            j = i + 1
        lo, hi = int(starts[i]), min(int(ends[j - 1]), int(starts[i]) + SLICE_BYTES)
        power, inverse = _power_table(BYTE_BASE, hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, np.minimum(ends[i:j], hi) - lo
        for a, stop in zip([out, *more], [e, *(np.minimum(e, s + cut) for cut in prefixes)]):
            a[i:j] = (sums[stop] - sums[s]) * inverse[s] + (stop - s).astype(np.uint64) * np.uint64(WORD_BASE)
        i = j
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = buf[starts[i]:ends[i]].tobytes()
        for a, cut in zip([out, *more], [len(word), *prefixes]):
            if cut > LONG_WORD:
                a[i] = int.from_bytes(hashlib.blake2b(word[:cut], digest_size=8).digest(), "little")
    return [finalise(a) for a in (out, *more)] if prefixes else finalise(out)


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``k`` words that lie in one text:
    (hash, index of the window's first word), in order."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.empty(n - k + 1, dtype=np.uint64)
    step = SLICE_BYTES
    for lo in range(0, n - k + 1, step):
        hi = min(n - k + 1, lo + step)
        part = words[lo:hi + k - 1]
        power, inverse = _power_table(WORD_BASE, len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[:len(part)], out=sums[1:])
        out[lo:hi] = (sums[k:] - sums[:-k]) * inverse[:hi - lo]
    # a window is whole when it ends before the next text begins
    length = np.diff(first)
    left = np.repeat(first[1:], length) - np.arange(n)
    at = np.flatnonzero(left[:n - k + 1] >= k)
    return finalise(out[at]), at
