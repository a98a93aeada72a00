"""The judge's rubric as rules: the cheapest weighted alignment of two texts.

Every edit is worth 0, 0.5 or 1 point and the score is ``1 - points /
reference words`` clamped to [0, 1].  It is a deterministic stand-in for the
language-model judge and is labelled ``rubric_score``, never ``laser_score``.

The points are those of the cheapest alignment under these moves:

* one word for one: equal; singular and plural (0); tense and comparison
  forms of one stem, prepositions, one character in a longer word (0.5);
  anything else (1);
* one word left out or put in: fillers, discourse markers and repetitions (0),
  articles (0.5), other words (1);
* two words left out or put in that are a marker together, "you know" (0);
* two or three words for one and one for two or three, where they are the same
  letters: compounds ("health care", "healthcare") and spelled abbreviations
  ("a t m", "atm") (0).

Among alignments of the same points the one with fewer whole points counts,
then the one with fewer free edits: the three sums are one whole number, so
the result is unique and any other way of computing it gives the same counts.

``rubric_scores`` is the one Python step, in ``mapInArrow``.  Pairs are taken
together up to ``WORDS`` words: what depends on words alone (related words,
compounds) is found once for the words that occur there, and numpy finds where
they stand.  The tables of many pairs of like length are worked a row at a time; a
few rows are held, whatever the length.  Words cost one of two values in nearly
all places (equal or wholly different); the few related words, merges and splits
are single places of a row.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: rubric word classes ----------------------------------------------
FILLERS = ("uh", "um", "ah", "er", "hmm", "mm", "mhm")
DISCOURSE = ("well", "so", "and", "but", "like", "okay", "ok", "yeah", "right")
MARKERS = ("you know", "i mean", "you see", "sort of", "kind of")
ARTICLES = ("a", "an", "the")
PREPOSITIONS = ("in", "on", "at", "of", "for", "to", "with", "about", "by", "from", "into", "onto")
CONFUSED = ("affect effect", "effect affect")  # one letter apart, yet different words
IRREGULAR = ("is was", "are were", "has had", "have had", "do did", "does did", "go went", "goes went", "run ran", "say said", "see saw",
             "good better", "good best", "bad worse", "bad worst")
ENDINGS = ("ing", "est", "ed", "er", "es", "s", "e")  # the first that fits is taken off
DOUBLED = "bdgmnprt"
# -------------------------------------------------------------------------------------
SPELLING_MIN_LEN = 5
LEAST_STEM = 3

#: Half points, whole-point edits and free edits in one number.
FREE, MINOR, MAJOR = 1, 1 << 40, (2 << 40) + (1 << 20)
#: Above all costs.
FAR = 1 << 60
LOW = (1 << 20) - 1
#: In tables of pairs of up to so many words these have bits of their own in 32 bits.
SMALL_BITS = 9
#: Words of all pairs that are taken together, and places of a row of their tables.
WORDS = 1 << 17
PLACES = 1 << 14
WORDS_KEPT = 1 << 15
#: Words of more characters are compared by their ends.
LONG = 32
#: So many characters at most are more in one of two related words: an ending and a doubled letter.
AFFIX = 4
#: Of the words' hashes; parts the marks of different texts.
BASE = np.int64(0x2545F4914F6CDD1D)
SPREAD = np.int64(0x1E3779B97F4A7C15)
_IRREGULAR = {tuple(p.split()) for p in IRREGULAR} | {tuple(p.split()[::-1]) for p in IRREGULAR}


@lru_cache(WORDS_KEPT)
def stem(word: str) -> str:
    """A word without its ending; a doubled last consonant counts once."""
    for e in ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= LEAST_STEM:
            word = word[:-len(e)]
            break
    if len(word) > LEAST_STEM and word[-1] == word[-2] and word[-1] in DOUBLED:
        word = word[:-1]
    return word


def one_apart(a: str, b: str) -> bool:
    """One character substituted, inserted or deleted."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else (a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:])


def _plural(a: str, b: str) -> bool:
    return a + "s" == b or b + "s" == a or a + "es" == b or b + "es" == a


def substitution(r: str, h: str) -> int:
    """Cost of one word for another."""
    if r == h:
        return 0
    if _plural(r, h):
        return FREE
    if f"{r} {h}" in CONFUSED:
        return MAJOR
    related = (r in PREPOSITIONS and h in PREPOSITIONS or stem(r) == stem(h) or (r, h) in _IRREGULAR
               or len(r) >= SPELLING_MIN_LEN and one_apart(r, h))
    return MINOR if related else MAJOR


def _single(words: list[str]) -> list[int]:
    """Cost of each word that has no counterpart."""
    out, before = [], None
    for w in words:
        out.append(FREE if w in _FREE_ALONE or w == before else MINOR if w in ARTICLES else MAJOR)
        before = w
    return out


_FREE_ALONE = frozenset(FILLERS + DISCOURSE)


_OTHER_FORMS: dict[str, list[str]] = {}
for _pair in _IRREGULAR:
    _OTHER_FORMS.setdefault(_pair[0], []).append(f" {min(_pair)} {max(_pair)}")


class _Words:
    """The words that occur, with hashes of what each has in common with the words
    it is related to: two related words share a mark, others seldom."""

    def __init__(self, words):
        self.words, n = list(words), len(words)
        self.codes = dict(zip(self.words, range(n)))
        self.alone = np.array([c for w in self.words for c in _single([w])], np.int64)
        self.lengths = lengths = np.fromiter(map(len, self.words), np.int64, n)
        self.powers = np.concatenate([[1], np.full(lengths.max(initial=LONG), BASE)]).cumprod()
        chars = np.array(self.words, f"U{LONG}").view(np.int32).reshape(n, LONG).T.astype(np.int64) + 1
        begins = np.zeros((LONG + 1, n), np.int64)  # of a word's first characters
        for k in range(LONG):
            begins[k + 1] = begins[k] * BASE + chars[k]
        every = np.arange(n)
        begun = lambda k: begins[np.minimum(k, LONG), every]
        self.hashes = begun(lengths)
        long = np.flatnonzero(lengths > LONG).tolist()
        for i in long:
            c = np.frombuffer(self.words[i].encode("utf-32-le"), np.int32).astype(np.int64) + 1
            self.hashes[i] = (c * self.powers[len(c) - 1::-1]).sum()
        last = [chars[np.clip(lengths - k, 0, LONG - 1), every] - 1 for k in (1, 2)]
        short, s = lengths <= LONG, last[0] == ord("s")
        self.stems = [stem(w) for w in self.words]
        marks = [self.hashes, begun(np.fromiter(map(len, self.stems), np.int64, n)) * BASE, begun(lengths - 1), begun(np.maximum(lengths - 2, 0))]
        known = [np.ones(n, bool), short, short & s, short & s & (last[1] == ord("e")) & (lengths > 2)]
        # words one character apart are the same but for one character, and long ones at one end at least
        spelled = short & (lengths >= SPELLING_MIN_LEN - 1)
        for k in range(int(lengths[short].max(initial=0))):
            marks.append(self.hashes + (begins[k] - begins[k + 1]) * self.powers[np.maximum(lengths - 1 - k, 0)])
            known.append(spelled & (lengths > k))
        more = [(self.codes[w], m) for w, ms in _OTHER_FORMS.items() if w in self.codes for m in ms] + [
            (self.codes[w], "in on") for w in PREPOSITIONS if w in self.codes]
        for i in np.flatnonzero(lengths >= LONG - AFFIX).tolist():
            w = self.words[i]
            shorter = (w[:-1], w[:-2]) if w.endswith("es") else (w[:-1],) if w.endswith("s") else ()
            more += [(i, f" {x}") for x in (w, *shorter)] + [(i, f"  {self.stems[i]}"), (i, f"{w[:LONG // 2 - 1]} "), (i, f" {w[1 - LONG // 2:]} ")]
        flags = np.stack(known, axis=1)
        whose = np.concatenate([np.nonzero(flags)[0], np.array([i for i, _ in more], np.int64)])
        marks = np.concatenate([np.stack(marks, axis=1)[flags], np.array([hash(m) for _, m in more], np.int64)])
        order = np.argsort(whose, kind="stable")
        self.marks, self.begin = marks[order], np.searchsorted(whose[order], np.arange(n + 1))


def _candidates(text: np.ndarray, marks: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``ids`` of one text that share a mark, both ways round.
    ``marks``: of all words, from ``begin`` on."""
    whose, number = _repeated((begin[1:] - begin[:-1])[ids])
    keys = marks[begin[ids[whose]] + number] ^ text[whose] * SPREAD
    order = np.argsort(keys)
    keys, whose = keys[order], whose[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    first, sizes = first[sizes > 1], sizes[sizes > 1]
    run, number = _repeated(sizes * sizes)
    a, b = whose[first[run] + number // sizes[run]], whose[first[run] + number % sizes[run]]
    pairs = np.unique(a[other := (a != b) & (text[a] == text[b])] * len(ids) + b[other])
    return pairs // max(len(ids), 1), pairs % max(len(ids), 1)


def _related_words(text: np.ndarray, ids: np.ndarray, first: np.ndarray, second: np.ndarray, words: _Words) -> np.ndarray:
    """The words of first and second texts that are neither equal nor wholly
    different, as lines of text, word, word, cost.  ``first``, ``second``: which of
    the ``ids`` of the ``text`` stand in its first and second text."""
    a, b = _candidates(text, words.marks, words.begin, ids)
    both = first[a] & second[b]
    a, b = a[both], b[both]
    n, w = len(words.words), words.words
    pairs, line = np.unique(ids[a] * n + ids[b], return_inverse=True)
    costs = np.array([substitution(w[p // n], w[p % n]) for p in pairs.tolist()], np.int64)[line]
    return np.stack([text[a], ids[a], ids[b], costs])[:, costs < MAJOR]


def _related(rs, hs) -> list[tuple[str, str, int]]:
    """The pairs of words of two texts that are neither equal nor wholly different."""
    words = _Words({**dict.fromkeys(rs), **dict.fromkeys(hs)})
    w = words.words
    found = _related_words(np.zeros(len(w), np.int64), np.arange(len(w)), np.array([x in rs for x in w], bool), np.array([x in hs for x in w], bool), words)
    return [(w[r], w[h], cost) for _, r, h, cost in found.T.tolist()]


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 .. n - 1 for each count n: whose it is, and the number."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(counts.cumsum() - counts, counts)


class _Side:
    """The words of all first or of all second texts, end to end: number, text and
    place (from 1) of each, and what it costs alone."""

    def __init__(self, texts: list[list[str]], known: _Words):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], self.lengths.cumsum()])
        self.known = known
        self.ids = np.fromiter(map(known.codes.__getitem__, chain.from_iterable(texts)), np.int64, self.begin[-1])
        self.text, self.place = _repeated(self.lengths)
        self.place += 1
        self.words = len(known.words)
        self.pairs = self.ids[:-1] * self.words + self.ids[1:]
        self.alone = known.alone[self.ids]
        again = (self.ids[1:] == self.ids[:-1]) & (self.text[1:] == self.text[:-1])
        self.alone[1:][again] = FREE
        keys = self.text * self.words + self.ids
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], self.place[order]

    def meet(self, text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ``text`` where ``word`` stands: which one it is, and the place."""
        sought = text * self.words + word
        first, end = np.searchsorted(self.keys, sought), np.searchsorted(self.keys, sought, "right")
        whose, number = _repeated(end - first)
        return whose, self.places[first[whose] + number]

    def several(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, last place and word of every ``k`` words that are one word together."""
        w = self.known
        if len(self.ids) < k:
            return (np.zeros(0, np.int64),) * 3
        together = w.hashes[self.ids]
        for i in range(1, k):
            more = self.ids[i:]
            together = together[:-1] * w.powers[w.lengths[more]] + w.hashes[more]
        order = np.argsort(w.hashes)
        sorted_hashes = w.hashes[order]
        first = np.searchsorted(sorted_hashes, together)
        at = np.flatnonzero(first < self.words)
        at = at[sorted_hashes[first[at]] == together[at]]
        at = at[self.text[at] == self.text[at + k - 1]]
        whose, number = _repeated(np.searchsorted(sorted_hashes, together[at], "right") - first[at])
        at = at[whose]
        word = order[first[at] + number]
        same = [w.words[x] == "".join(w.words[i] for i in self.ids[a:a + k].tolist()) for a, x in zip(at.tolist(), word.tolist())]
        at, word = at[np.array(same, bool)], word[np.array(same, bool)]
        return self.text[at], self.place[at + k - 1], word

    def markers(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and last place of the two words that are a marker together."""
        codes = self.known.codes
        known = [codes[a] * self.words + codes[b] for a, b in (m.split() for m in MARKERS) if a in codes and b in codes]
        at = np.flatnonzero(np.isin(self.pairs, known) & (self.text[1:] == self.text[:-1])) + 1
        return self.text[at], self.place[at]


def _moves(ref: _Side, hyp: _Side) -> np.ndarray:
    """The moves that are neither equal nor wholly different words, in the order of
    their texts, as lines of text, row, place, rows back, place there, and whether
    it is half a point or free."""
    out = []

    def put(text, row, place, back, there, half):
        out.append(np.stack(np.broadcast_arrays(text, row, place, back, there, half), dtype=np.int32, casting="same_kind"))

    here = np.unique(np.concatenate([ref.keys, hyp.keys]))
    first, second = np.zeros(len(here), bool), np.zeros(len(here), bool)
    first[np.searchsorted(here, ref.keys)] = second[np.searchsorted(here, hyp.keys)] = True
    text, r, h, cost = _related_words(here // ref.words, here % ref.words, first, second, ref.known)
    whose, row = ref.meet(text, r)
    text, h, cost = text[whose], h[whose], cost[whose]
    whose, place = hyp.meet(text, h)
    put(text[whose], row[whose], place, 1, place - 1, cost[whose] == MINOR)
    for one, other, merge in ((ref, hyp, True), (hyp, ref, False)):
        for k in (2, 3):
            text, last, word = other.several(k)
            whose, at = one.meet(text, word)
            text, last = text[whose], last[whose]
            put(text, at, last, 1, last - k, False) if merge else put(text, last, at, k, at - 1, False)
    moves = np.concatenate(out, axis=1)
    return moves[:, np.argsort(moves[0], kind="stable")]


def _packed(costs: np.ndarray, bits: int, kind) -> np.ndarray:
    """Costs with ``bits`` for each of the three sums."""
    return ((costs >> 40 << 2 * bits) + ((costs >> 20 & LOW) << bits) + (costs & LOW)).astype(kind)


def _unpacked(costs: np.ndarray, bits: int) -> np.ndarray:
    costs, low = costs.astype(np.int64), (1 << bits) - 1
    return (costs >> 2 * bits << 40) + ((costs >> bits & low) << 20) + (costs & low)


def _table(a: int, z: int, ref: _Side, hyp: _Side, moves: np.ndarray, ref_marks, hyp_marks) -> np.ndarray:
    """The costs of the pairs from ``a`` to ``z``, by falling length of the first
    text.  A place of a row holds the cost less that of putting in all words before
    it, so that putting words in is a running minimum."""
    lengths = ref.lengths[a:z].tolist()
    n, width, count = lengths[0], int(hyp.lengths[a:z].max()) + 1, z - a
    bits, kind = (SMALL_BITS, np.int32) if n + width <= 1 << SMALL_BITS else (20, np.int64)
    free, major = (kind(_packed(np.int64(c), bits, kind)) for c in (FREE, MAJOR))
    r, h = slice(ref.begin[a], ref.begin[z]), slice(hyp.begin[a], hyp.begin[z])
    refs, hyps = np.zeros((n, count), np.int32), np.full((count, width - 1), -1, np.int32)
    left_out, put_in = np.zeros((n, count), kind), np.zeros((count, width), kind)
    refs[ref.place[r] - 1, ref.text[r] - a] = ref.ids[r]
    hyps[hyp.text[h] - a, hyp.place[h] - 1] = hyp.ids[h]
    left_out[ref.place[r] - 1, ref.text[r] - a] = _packed(ref.alone[r], bits, kind)
    put_in[hyp.text[h] - a, hyp.place[h]] = _packed(hyp.alone[h], bits, kind)
    before = put_in.cumsum(axis=1, dtype=kind)
    different = major - put_in[:, 1:]
    text, row, place, back, there, half = moves[:, slice(*np.searchsorted(moves[0], (a, z)))]
    keys = row * 4 + back
    order = np.argsort(keys, kind="stable")
    bounds = np.searchsorted(keys[order], np.arange(4 * n + 6)).tolist()
    to, begin = ((text - a) * width + place)[order], ((text - a) * width + there)[order]
    worth = _packed(np.where(half[order], MINOR, FREE), bits, kind) + before.reshape(-1)[begin] - before.reshape(-1)[to]
    ref_markers: dict[int, list[int]] = {}
    for t, i in zip(*(x[slice(*np.searchsorted(ref_marks[0], (a, z)))].tolist() for x in ref_marks)):
        ref_markers.setdefault(i, []).append(t - a)
    hyp_markers = [(t - a, j, free + before[t - a, j - 2] - before[t - a, j])
                   for t, j in zip(*(x[slice(*np.searchsorted(hyp_marks[0], (a, z)))].tolist() for x in hyp_marks))]

    def put(base: np.ndarray) -> np.ndarray:
        """The row with words put in behind each place."""
        np.minimum.accumulate(base, axis=1, out=base)
        for b, j, more in hyp_markers:
            if b < len(base) and base[b, j - 2] + more < base[b, j]:
                np.minimum(base[b, j:], base[b, j - 2] + more, out=base[b, j:])
        return base

    rows = [put(np.zeros((count, width), kind))]  # the last three
    out = np.zeros(count, kind)
    active = count
    for i in range(n + 1):
        if i:
            last = rows[-1][:active]
            base = last + left_out[i - 1, :active, None]
            other = last[:, :-1] + different[:active]
            same = np.flatnonzero(hyps[:active] == refs[i - 1, :active, None])
            other.reshape(-1)[same] -= major
            np.minimum(base[:, 1:], other, out=base[:, 1:])
            for k in (1, 2, 3):
                x, y = bounds[4 * i + k], bounds[4 * i + k + 1]
                if x < y:
                    np.minimum.at(base.reshape(-1), to[x:y], rows[-k].reshape(-1)[begin[x:y]] + worth[x:y])
            for b in ref_markers.get(i, ()):
                np.minimum(base[b], rows[-2][b] + free, out=base[b])
            rows = [*rows[-2:], put(base)]
        while active and lengths[active - 1] == i:
            active -= 1
            end = hyp.lengths[a + active]
            out[active] = rows[-1][active, end] + before[active, end]
    return _unpacked(out, bits)


def _together(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """The costs of pairs that are ordered by falling length of the first text."""
    refs, hyps = [r for r, _ in pairs], [h for _, h in pairs]
    words = _Words(dict.fromkeys(chain.from_iterable(refs + hyps)))
    ref, hyp = _Side(refs, words), _Side(hyps, words)
    moves, ref_marks, hyp_marks = _moves(ref, hyp), ref.markers(), hyp.markers()
    out, a, width = [], 0, 0
    wide = (hyp.lengths + 1).tolist()
    lengths = ref.lengths.tolist()
    for z in range(len(pairs) + 1):
        if z < len(pairs):
            width, places = max(width, wide[z]), width * (z - a)
            if z == a or max(width, wide[z]) * (z - a + 1) <= PLACES and (4 * lengths[z] >= 3 * lengths[a] or 8 * places < PLACES):
                continue
        out.append(_table(a, z, ref, hyp, moves, ref_marks, hyp_marks))
        a, width = z, wide[z] if z < len(pairs) else 0
    return np.concatenate(out)


def alignment_costs(pairs: list[tuple[list[str], list[str]]]) -> list[int]:
    """The least costs of turning each first text into its second."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted((k for k, (r, h) in enumerate(pairs) if r != h), key=lambda k: -len(pairs[k][0]))
    if order:
        out[order] = _together([pairs[k] for k in order])
    return out.tolist()


def alignment_cost(ref: list[str], hyp: list[str]) -> int:
    """The least cost of turning ``ref`` into ``hyp``."""
    return alignment_costs([(ref, hyp)])[0]


def _costs(batches):
    ids, pairs, words = [], [], 0

    def taken():
        nonlocal words
        out = pa.RecordBatch.from_pydict({"sample_id": pa.array(ids, pa.int64()), "ref_words": pa.array([len(r) for r, _ in pairs], pa.int64()),
                                          "cost": pa.array(alignment_costs(pairs), pa.int64())})
        ids.clear(), pairs.clear()
        words = 0
        return out

    for batch in batches:
        for i, a, b in zip(batch["sample_id"].to_pylist(), batch["norm_ref"].to_pylist(), batch["norm_hyp"].to_pylist()):
            ids.append(i)
            pairs.append(((a or "").split(), (b or "").split()))
            words += len(pairs[-1][0]) + len(pairs[-1][1]) + 1
            if words >= WORDS:
                yield taken()
    yield taken()


def rubric_scores(pairs: DataFrame) -> DataFrame:
    """(sample_id, norm_ref, norm_hyp) -> points, reference words, counts of
    whole, half and free edits, rubric_score."""
    rows = pairs.select(F.col("sample_id").cast("long").alias("sample_id"), "norm_ref", "norm_hyp")
    c = rows.mapInArrow(_costs, "sample_id long, ref_words long, cost long")
    half, major = F.shiftright("cost", 40), F.shiftright("cost", 20).bitwiseAND(F.lit((1 << 20) - 1))
    c = c.select("sample_id", "ref_words", (half / 2).alias("points"), major.alias("n_major"), (half - 2 * major).alias("n_minor"),
                 F.col("cost").bitwiseAND(F.lit((1 << 20) - 1)).alias("n_no_penalty"))
    score = F.when(F.col("ref_words") == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("points") / F.col("ref_words"))))
    return c.withColumn("rubric_score", F.round(score, 9))
