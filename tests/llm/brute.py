"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, k, percent):
    """{id: (set size, component)} of [(id, text)]; ids unique."""
    sets = {i: shingles(t, k) for i, t in docs}
    links = []
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    top = roots(ids, links)
    return {i: (len(sets[i]), top[i]) for i in ids}


def cut_repeats(docs, window):
    """{id: (words, removed, kept words)} of [(id, text)]; ids unique."""
    split = {i: words(t) for i, t in docs}
    seen, out = set(), {}
    for i in sorted(split):
        w, gone = split[i], set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), kept)
    return out


def sha256(kept):
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target} of {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, left, out = set(order), share * sum(sizes.values()), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= cap * sizes[s]]
        if not over:
            out.update({s: left * w[s] / total for s in free})
            break
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def check_pieces(rows, ids_of, length=1024):
    """Pieces of a packing cover every document once, sequences are gapless;
    returns the share of padding."""
    seq, doc = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    pad = total = 0
    for parts in seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
        total += at
        pad += 0 if at & (at - 1) == 0 else length - at
    assert set(doc) == set(ids_of)
    for i, parts in doc.items():
        at, ids = 0, ids_of[i]
        for start, n, crc, size in sorted(parts):
            assert start == at and size == len(ids)
            assert zlib.crc32(ids[start:start + n].tobytes()) == crc
            at += n
        assert at == len(ids)
    return pad / max(1, total)


def top_k(vectors, k, scale=256.0, every=50):
    ok = [(i, np.floor(np.array(v, float) * scale)) for i, v in vectors
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted(((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x)))[:k]
    return {q: [(i, -s) for s, i in v] for q, v in out.items()}


def cosine_links(vectors, threshold):
    """{id: (links, component)}; ids unique."""
    ok = {i: np.array(v, float) for i, v in vectors
          if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    links = []
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold:
                    links.append((a, b))
    ids = [i for i, _ in vectors]
    top, n = roots(ids, links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], top[i]) for i in ids}
