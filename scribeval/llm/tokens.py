"""Token ids of whole texts with the tokenizers library, word by word.

A byte-level BPE splits a text into pieces before merging; a blank that is
followed by a non-blank always opens a piece, and a single line break between
non-blanks is a piece of its own.  So a text whose white space is single
blanks and line breaks inside it can be cut into words (each with the blank
or line break before it), and equal words have equal ids: each distinct word
is encoded once, by the library, and its ids are copied to every place.
Texts with any other white space (runs, tabs, blanks at either end, blanks
outside ASCII) go to the library whole, and so do texts that hold the content
of an added token (``<|endoftext|>``).  ``tests/llm`` compares both ways.

The ids are those that the library gives for the file as it is, where an added
token's content is that token; ``added_as_text`` takes it as text.

Words are known by their 64-bit hash; the table of known words is bounded and
emptied when full.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .words import finalise, text_buffer, text_slices, word_hashes, word_spans

LONGEST_KEPT = 48
#: Marks that are pieces of their own behind an ASCII letter at a word's end.
MARKS = ".,;:!?"
_MARK = np.full(256, -1, np.int64)
_MARK[[ord(m) for m in MARKS]] = np.arange(len(MARKS))
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: What stands before a word.
FIRST, BLANK, LINE = 0, 1, 2

_encoders: dict = {}


def encoder(path: str) -> "Encoder":
    """The process-wide encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _wide_blanks(buf: np.ndarray) -> np.ndarray:
    """Places of white space outside ASCII (UTF-8): U+0085, U+00A0, U+1680,
    U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    at = np.flatnonzero(_LEAD[buf])
    if not len(at):
        return at
    end = np.append(buf, np.zeros(2, np.uint8))
    a, b, c = buf[at], end[at + 1], end[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    ogham = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    mathematical = (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    ideographic = (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[two | ogham | general | mathematical | ideographic]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return np.repeat(begin - (stop - size), size) + np.arange(total)


class _Known:
    """Ids of known words as sorted runs: (keys, begin, size, ids, used).  When
    full, words that were never looked up again are forgotten."""

    def __init__(self, most: int, kind: str):
        self.most, self.kind = most, kind
        self.runs: list[tuple] = []

    def find(self, keys: np.ndarray):
        """(ids of all runs end to end, begin, size of each key; size -1: new)"""
        begin, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        base = 0
        for k, b, n, ids, used in self.runs:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[at] == keys
            at = at[hit]
            begin[hit] = b[at] + base
            size[hit] = n[at]
            used[at] = True
            base += len(ids)
        return np.concatenate([r[3] for r in self.runs] or [np.empty(0, self.kind)]), begin, size

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """``keys`` ascending, their ids end to end."""
        if not len(keys):
            return
        full = sum(len(r[0]) for r in self.runs) + len(keys) > self.most
        if full or len(self.runs) > 5:
            self._merge(only_used=full)
            if sum(len(r[0]) for r in self.runs) + len(keys) > self.most:
                self.runs.clear()
        self.runs.append((keys, (np.cumsum(size) - size).astype(np.int32), size.astype(np.int32), ids, np.zeros(len(keys), bool)))

    def _merge(self, only_used: bool) -> None:
        if not self.runs:
            return
        kept = [r[4] if only_used else np.ones(len(r[0]), bool) for r in self.runs]
        ids = [r[3][_ranges(r[1][k].astype(np.int64), r[2][k].astype(np.int64))] for r, k in zip(self.runs, kept)]
        keys, size, used = (np.concatenate([r[i][k] for r, k in zip(self.runs, kept)]) for i in (0, 2, 4))
        self.runs.clear()
        if not len(keys):
            return
        flat = np.concatenate(ids)
        begin = (np.cumsum(size) - size).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        self.runs = [(keys[order], begin[order], size[order], flat, np.zeros(len(keys), bool) if only_used else used[order])]


class Encoder:
    def __init__(self, path: str, max_words: int = 1_000_000, added_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        if added_as_text:
            self.tokenizer.encode_special_tokens = True
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known = _Known(max_words, self.kind)
        one = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_break = one[0] if len(one) == 1 and not any(b"\n" in t for t in self.added) else None
        self.marks = self.whole(list(MARKS))

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, straight from the library."""
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _added(self, buf: np.ndarray) -> np.ndarray:
        """Places where an added token's content begins."""
        raw, found = buf.tobytes(), []
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                found.append(at)
                at = raw.find(content, at + 1)
        return np.array(found, np.int64)

    def _new(self, buf: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(sizes, ids end to end) of words.  They are encoded as the lines of
        texts: the break between lines is one piece and one id, by which the
        ids are cut again."""
        blank = (kind == BLANK).astype(np.int64)
        length = ends - starts + blank + 1
        stop = np.cumsum(length)
        lines = np.empty(int(stop[-1]), np.uint8)
        lines[(stop - length)[blank > 0]] = 0x20
        lines[stop - 1] = 0x0A
        size = ends - starts
        lines[_ranges(stop - length + blank, size)] = buf[_ranges(starts, size)]
        sizes, flat = [], []
        for lo in range(0, len(kind), 2000):
            hi = min(len(kind), lo + 2000)
            text = lines[stop[lo] - length[lo]:stop[hi - 1] - 1].tobytes().decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            breaks = np.flatnonzero(ids == self.line_break)
            if len(breaks) != hi - lo - 1:
                raise ValueError("the tokenizer does not keep line breaks apart")
            sizes.append(np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1)
            flat.append(np.delete(ids, breaks))
        sizes, flat = np.concatenate(sizes), np.concatenate(flat).astype(self.kind)
        after = kind == LINE
        if after.any():
            flat = np.insert(flat, (np.cumsum(sizes) - sizes)[after], self.line_break)
            sizes = sizes + after
        return sizes, flat

    def _words(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids, which texts must go whole)."""
        n_texts = len(offsets) - 1
        starts, ends, first = word_spans(buf, offsets)
        kind = np.full(len(starts), BLANK, np.int64)
        before = buf[np.maximum(starts - 1, 0)]
        kind[before == 0x0A] = LINE
        heads = first[:-1][first[:-1] < first[1:]]
        kind[heads] = FIRST
        doc = np.repeat(np.arange(n_texts), np.diff(first))
        gap = np.empty(len(starts), np.int64)
        gap[1:] = starts[1:] - ends[:-1]
        gap[heads] = 1
        odd = np.zeros(n_texts, bool)
        odd[doc[(gap != 1) | ((kind == BLANK) & (before != 0x20))]] = True
        some = np.flatnonzero(first[:-1] < first[1:])
        odd[some] |= (starts[first[some]] != offsets[some]) | (ends[first[some + 1] - 1] != offsets[some + 1])
        odd |= (first[:-1] == first[1:]) & (offsets[:-1] < offsets[1:])
        wide = _wide_blanks(buf)
        if len(wide):
            odd[np.searchsorted(offsets, wide, side="right") - 1] = True
        odd[np.searchsorted(offsets, self._added(buf), side="right") - 1] = True
        use = ~odd[doc] if odd.any() else slice(None)
        starts, ends, kind, doc = starts[use], ends[use], kind[use], doc[use]
        mark = np.where((ends - starts >= 2) & _LETTER[buf[ends - 2]], _MARK[buf[ends - 1]], -1) if len(ends) else np.empty(0, np.int64)
        ends = ends - (mark >= 0)
        key = finalise(word_hashes(buf, starts, ends) + kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        flat, begin, size = self.known.find(distinct)
        new = np.flatnonzero(size < 0)
        if len(new):
            where = at[new]
            sizes, ids = self._new(buf, kind[where], starts[where], ends[where])
            size[new] = sizes
            begin[new] = len(flat) + np.cumsum(sizes) - sizes
            short = (ends - starts)[where] <= LONGEST_KEPT
            self.known.add(distinct[new][short], sizes[short], ids[np.repeat(short, sizes)])
            flat = np.concatenate([flat, ids])
        raw = flat[_ranges(begin, size)].astype("<u4").tobytes()
        stop = 4 * np.cumsum(size)
        pieces = [raw[a:b] for a, b in zip((stop - 4 * size).tolist(), stop.tolist())]
        marked = np.flatnonzero(mark >= 0)
        back = np.insert(back, marked + 1, len(pieces) + mark[marked])
        doc = np.insert(doc, marked + 1, doc[marked])
        pieces += self.marks
        size = np.append(size, [len(m) // 4 for m in self.marks])
        ids = b"".join(map(pieces.__getitem__, back.tolist()))
        tokens = np.concatenate([[0], np.cumsum(size[back])])
        return ids, tokens[np.searchsorted(doc, np.arange(n_texts + 1))], odd

    def encode(self, column: pa.Array, max_bytes: int = 2 << 20):
        """(first row, little-endian 32-bit ids of each text) for runs of
        texts of bounded size; a null text has none."""
        buf, offsets = text_buffer(column)
        for lo, hi in text_slices(offsets, max_bytes):
            part = buf[offsets[lo]:offsets[hi]]
            if self.line_break is None:  # words can't be told apart
                yield lo, self.whole([t.as_py() or "" for t in column[lo:hi]])
                continue
            raw, cuts, odd = self._words(part, offsets[lo:hi + 1] - offsets[lo])
            out = [raw[4 * a:4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            whole = np.flatnonzero(odd).tolist()
            if whole:
                for i, x in zip(whole, self.whole([column[lo + i].as_py() for i in whole])):
                    out[i] = x
            yield lo, out
