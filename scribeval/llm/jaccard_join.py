"""N-gram Jaccard join with a token-group matrix.

Two texts link when their sets of word shingles have Jaccard similarity of at
least ``percent / 100``.  The join is exact up to collisions of 64-bit
shingle hashes:

1. **Sets.** Each text gives its distinct shingle hashes.  Texts with equal
   sets form a class (128-bit signature); only class representatives go on.
2. **Prefixes.** Shingles are put in one order for the whole corpus: by a
   frequency sketch over all documents (fixed size), then by hash.  A set's
   prefix is its first ``n - ceil(p n) + 1`` shingles, the rare ones.  Sets
   ``q`` and ``s`` (``|q| >= |s|``) that reach the threshold share ``a =
   ceil(p (|q| + |s|) / (1 + p))`` shingles, and of these at least
   ``a - ceil(p |q|) + 1`` within their prefixes.  Prefix shingles are matched
   in blocks: per block each distinct one is sent once, and one bit comes back
   that says whether a different set has it too.  What meets nothing drops out.
3. **Stars.** Each text is compared with one leader, the text that is the
   smallest id on most of its prefix shingles.  That joins most copies of a
   text at linear cost; it only saves work, what it misses is found next.
4. **Token-group matrix.** Representatives are partitioned into groups of
   similar texts: parts, of bounded size, of one component found so far.  The
   matrix says which prefix shingles occur in a group's union; a query's count
   in it bounds the prefix overlap with every member, so groups below the
   needed count are never fetched.  For the others the query's overlap with
   the union of the members' whole sets bounds the similarity, and only groups
   that still qualify are opened, that is compared member by member.  Groups of
   the query's own component are skipped: their links change nothing.
5. Links of both steps give the components.

Hot keys: a prefix shingle of a third of all texts is aggregated map-side
(smallest and largest component); once the stars have joined these texts it
lies in one component and makes no candidate.  Groups are cut to a bounded
number of shingles, and the queries of a group are dealt to several tasks.

Edge cases: null or wordless texts have empty sets and link with nothing;
with fewer words than the shingle length the whole sequence is one shingle.
A null id takes part as a text of its own but gets a null component; rows
that repeat an id count as one text each and share the id's component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import bloom
from .graph import components
from .words import ASCII_LOWER, finalise, text_buffer, text_slices, window_hashes, word_hashes, word_spans

SKETCH_BITS = 20
SKETCH_SLICES = 16


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within the text, and the
    offsets of each text's set."""
    low = ASCII_LOWER[buf]
    starts, ends, first = word_spans(low, offsets)
    words = word_hashes(low, starts, ends)
    h, at = window_hashes(words, first, k)
    doc = np.searchsorted(first, at, side="right") - 1
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for i in range(k - 1):  # a sequence shorter than a shingle, position by position
            has = n[few] > i
            whole[has] = finalise(whole[has] + words[first[few[has]] + i] + np.uint64(i + 1))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def _sketch(k: int):
    width = (1 << SKETCH_BITS) // SKETCH_SLICES

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            buf, offsets = text_buffer(batch["text"])
            for lo, hi in text_slices(offsets):
                h, _ = shingle_sets(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], k)
                np.add.at(counts, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        for s in range(SKETCH_SLICES):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()),
                                              "counts": [counts[s * width:(s + 1) * width].tobytes()]})
    return run


def _sum_slices(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in table["counts"].to_pylist())
    return pa.table({"slice": table["slice"][:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def _ceil_share(n, a: int, b: int):
    """ceil(a * n / b) for whole numbers."""
    return -((-a * n) // b)


def _features(k: int, percent: int, sketch):
    """Per text: set size, signature and the ordered prefix."""
    def run(batches):
        counts = sketch.value
        for batch in batches:
            buf, offsets = text_buffer(batch["text"])
            for lo, hi in text_slices(offsets):
                h, at = shingle_sets(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], k)
                n = np.diff(at)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
                        for x in (finalise(h ^ np.uint64(0x5851F42D4C957F2D)), finalise(h * np.uint64(0x2545F4914F6CDD1D)))]
                sign = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                doc = np.repeat(np.arange(hi - lo), n)
                order = np.lexsort((h, counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], doc))
                length = np.where(n > 0, n - _ceil_share(n, percent, 100) + 1, 0)
                rank = np.arange(len(h)) - np.repeat(at[:-1], n)
                raw = h[order][rank < np.repeat(length, n)].tobytes()
                cuts = (8 * np.concatenate([[0], np.cumsum(length)])).tolist()
                yield pa.RecordBatch.from_pydict({
                    "id": batch["id"][lo:hi], "n": pa.array(n, pa.int64()),
                    "s1": pa.array(sign[0]), "s2": pa.array(sign[1]),
                    "prefix": pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})
    return run


class _Prefixes:
    """The prefix shingles of one block: each distinct one in a fixed order,
    with the set it was first seen in."""

    def __init__(self, table: pa.Table, ranges: int):
        self.table = table.sort_by([("id", "ascending"), ("s1", "ascending"), ("s2", "ascending")])
        raw = self.table["prefix"].to_pylist()
        self.sizes = np.array([len(x) // 8 for x in raw], np.int64)
        tokens = np.frombuffer(b"".join(raw), np.uint64)
        doc = np.repeat(np.arange(len(raw)), self.sizes)
        sign = self.table["s1"].to_numpy()
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        entry = np.cumsum(new) - 1
        first = order[new]
        several = np.zeros(len(first), bool)  # in two different sets of this block
        several[entry[sign[doc[order]] != sign[doc[first]][entry]]] = True
        bucket = ((tokens[first] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        deal = np.lexsort((first, bucket))
        place = np.empty(len(deal), np.int64)
        place[deal] = np.arange(len(deal))
        self.value, self.bucket, self.several = tokens[first][deal], bucket[deal].astype(np.int64), several[deal]
        self.owner = sign[doc[first]][deal]
        self.entry = np.empty(len(tokens), np.int64)
        self.entry[order] = place[entry]
        self.tokens = tokens


def _send(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        p = _Prefixes(table, ranges)
        block = table["block"][0].as_py()
        rows = []
        for part in np.split(np.arange(len(p.value)), np.flatnonzero(np.diff(p.bucket)) + 1):
            if len(part):
                o = p.owner[part]
                edge = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                rows.append((int(p.bucket[part[0]]), block, p.value[part].tobytes(), o[edge].tobytes(),
                             np.diff(np.append(edge, len(o))).astype(np.uint32).tobytes(), np.packbits(p.several[part]).tobytes()))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["range", "block", "tokens", "owners", "runs", "several"])
    return run


def _meet(table: pa.Table) -> pa.Table:
    """One hash range: which entries occur in two different sets."""
    tokens = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
    owner = np.concatenate([np.repeat(np.frombuffer(o, np.int64), np.frombuffer(r, np.uint32))
                            for o, r in zip(table["owners"].to_pylist(), table["runs"].to_pylist())])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(t)).astype(bool)
                              for x, t in zip(table["several"].to_pylist(), tokens)])
    t = np.concatenate(tokens)
    order = np.argsort(t, kind="stable")
    new = np.ones(len(t), bool)
    new[1:] = t[order][1:] != t[order][:-1]
    entry = np.cumsum(new) - 1
    met = np.zeros(int(new.sum()), bool)
    met[entry[several[order]]] = True
    met[entry[owner[order] != owner[order][new][entry]]] = True
    answer = np.empty(len(t), bool)
    answer[order] = met[entry]
    cuts = np.cumsum([0] + [len(x) for x in tokens])
    return pa.table({"block": table["block"], "range": table["range"],
                     "bits": pa.array([np.packbits(answer[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                     "count": pa.array(np.diff(cuts), pa.int64())})


def _keep_met(ranges: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Prefixes(left, ranges)
        met = np.zeros(len(p.value), bool)
        start = np.searchsorted(p.bucket, np.arange(ranges + 1))
        for r, bits, n in zip(right["range"].to_pylist(), right["bits"].to_pylist(), right["count"].to_pylist()):
            if n != start[r + 1] - start[r]:
                raise RuntimeError("a block's prefixes changed between two reads of the input")
            met[start[r]:start[r + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        kept = met[p.entry]
        ends = np.cumsum(p.sizes)
        total = np.concatenate([[0], np.cumsum(kept)])
        cuts = pa.array(np.concatenate([[0], total[ends]]), pa.int32())
        place = (np.arange(len(p.tokens)) - np.repeat(ends - p.sizes, p.sizes))[kept]
        shared = pa.StructArray.from_arrays([pa.array(p.tokens[kept].view(np.int64)), pa.array(place)], ["token", "pos"])
        t = p.table
        return pa.table({"id": t["id"], "n": t["n"], "s1": t["s1"], "s2": t["s2"], "shared": pa.ListArray.from_arrays(cuts, shared)})
    return run


def _open_groups(k: int, percent: int):
    """One (group, part of its queries): bound every query against the union,
    open the group for those that qualify."""
    def run(table: pa.Table) -> pa.Table:
        us, vs, sets = [], [], []
        buf, offsets = text_buffer(table["text"])
        for lo, hi in text_slices(offsets):
            h, at = shingle_sets(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], k)
            sets += [h[a:b] for a, b in zip(at[:-1], at[1:])]
        rows = list(zip(table["asks"].to_pylist(), table["id"].to_pylist(), sets))
        members = [(i, t) for a, i, t in rows if not a]
        queries = [(i, t) for a, i, t in rows if a]
        if members and queries:
            union = np.unique(np.concatenate([t for _, t in members]))
            for q, tokens in queries:
                place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                if 100 * int((union[place] == tokens).sum()) < percent * len(tokens):
                    continue
                for i, other in members:
                    small, large = sorted((len(tokens), len(other)))
                    if i == q or 100 * small < percent * large:
                        continue
                    at = np.minimum(np.searchsorted(other, tokens), len(other) - 1)
                    both = int((other[at] == tokens).sum())
                    if 100 * both >= percent * (len(tokens) + len(other) - both):
                        us.append(q)
                        vs.append(i)
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
    return run


QUERIES_A_TASK = 256


def _compare(texts: DataFrame, candidates: DataFrame, groups: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links among ``candidates (id, gid)`` and the members ``groups (gid,
    id)``.  A group's queries go to as many tasks as they need; its members
    go to each of these.  Sets are made anew there from the texts of just
    these documents: a Bloom filter of their ids (fixed size) thins the scan
    before the exact join."""
    candidates = materialize(candidates, "candidates")
    parts = candidates.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("long").alias("parts"))
    asked = candidates.join(parts, "gid").select(
        "id", "gid", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(True).alias("asks"))
    held = groups.join(parts, "gid").select(
        "id", "gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    roles = materialize(asked.unionByName(held), "roles")
    ids = roles.select("id").distinct()
    words = bloom.build(ids, ids.count())
    some = bloom.passing(texts, F.col("id"), words)
    return some.join(roles, "id").groupBy("gid", "part").applyInArrow(_open_groups(shingle, percent), "u long, v long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85,
         group_tokens: int = 1 << 16, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, n_shingles, component_id): the component is the smallest id
    reachable by links, the own id where there is none."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = max(1, -(-size // block_bytes))
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    width = len(counts) // SKETCH_SLICES
    sliced = texts.select("text").mapInArrow(_sketch(shingle), "slice int, counts binary").groupBy("slice").applyInArrow(
        _sum_slices, "slice int, counts binary")
    for r in sliced.collect():  # SKETCH_SLICES rows of fixed size: 4 MB whatever the input
        counts[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.uint32)
    sketch = spark.sparkContext.broadcast(counts)

    # sets, signatures, and the prefix shingles that meet a different set
    feats = texts.mapInArrow(_features(shingle, percent, sketch), "id long, n long, s1 long, s2 long, prefix binary")
    feats = feats.withColumn("block", F.pmod(F.xxhash64("id", "s1"), F.lit(blocks)).cast("long"))
    bits = feats.groupBy("block").applyInArrow(
        _send(blocks), "range long, block long, tokens binary, owners binary, runs binary, several binary"
    ).groupBy("range").applyInArrow(_meet, "block long, range long, bits binary, count long")
    table = materialize(feats.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(
        _keep_met(blocks), "id long, n long, s1 long, s2 long, shared array<struct<token: long, pos: long>>"), "shingles")

    # classes of equal sets; the representative is the smallest id
    some = table.where("n > 0 AND id IS NOT NULL")
    classes = some.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    reps = some.join(classes.select(F.col("rep").alias("id"), "n", "s1", "s2"), ["id", "n", "s1", "s2"], "left_semi")
    posts = materialize(reps.select("id", "n", F.explode("shared").alias("s")).select(
        "id", "n", "s.token", "s.pos").distinct(), "postings")

    def needed(n, m):
        """Fewest shingles that sets of these sizes share within their prefixes."""
        both = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
        return both - F.ceil(F.lit(percent) * F.greatest(n, m) / F.lit(100)) + 1

    near = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    # stars: the leader of most prefix shingles
    heads = posts.groupBy("token").agg(F.min(F.struct("id", "n")).alias("h")).select(
        "token", F.col("h.id").alias("gid"), F.col("h.n").alias("m"))
    votes = posts.join(heads, "token").where("id <> gid").where(near).groupBy("id", "n", "gid", "m").agg(F.count("*").alias("c"))
    stars = votes.where(F.col("c") * 2 >= needed(F.col("n"), F.col("m"))).groupBy("id").agg(
        F.max_by("gid", F.struct("c", -F.col("gid"))).alias("gid"))
    stars = materialize(stars, "stars")
    found = materialize(_compare(texts, stars, stars.select("gid", F.col("gid").alias("id")).distinct(), shingle, percent), "links")
    active = posts.select("id", "n").distinct()
    joined = components(found).toDF("node", "component_id")
    comps = materialize(active.join(joined, active["id"] == joined["node"], "left").select(
        "id", "n", F.coalesce("component_id", "id").alias("comp")), "components")

    # groups of similar texts against the texts of other components
    own = posts.join(comps.select("id", "comp"), "id")
    open_tokens = own.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token")
    own = own.join(open_tokens, "token", "left_semi")
    sizes = comps.groupBy("comp").agg(F.ceil(F.sum("n") / group_tokens).cast("long").alias("parts"))
    grouped = materialize(comps.join(sizes, "comp").select(
        "id", "n", "comp", F.xxhash64("comp", F.pmod(F.xxhash64("id"), "parts")).alias("gid")), "groups")
    own = own.join(grouped.select("id", "gid"), "id")
    # Where a pair first shares a shingle, no more can be shared than what stands
    # behind it in either set: the smaller set has it in a short prefix.
    short = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)) + 1
    heads = own.where(F.col("pos") < short).groupBy("token", F.col("gid").alias("group"), F.col("comp").alias("other")).agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("pos").alias("least_pos"))
    smallest = F.greatest("least_n", F.ceil(F.lit(percent) * F.col("n") / F.lit(100)))
    first = own.join(heads, "token").where("comp <> other").where(f"n >= least_n AND 100 * most_n >= {percent} * n").where(
        f"100 * most_n - {100 + percent} * least_pos >= {percent} * n").where(
        F.lit(100 + percent) * (F.col("n") - F.col("pos")) >= F.lit(percent) * (F.col("n") + F.least("n", smallest)))
    first = first.select("id", "n", F.col("group").alias("gid")).distinct()
    # the matrix: a query's count of shingles in the union of a group's prefixes
    matrix = own.select("token", "gid").distinct()
    spans = grouped.groupBy("gid").agg(F.min("n").alias("least_n"))
    met = first.join(own.select("id", "token"), "id").join(matrix, ["gid", "token"]).groupBy("id", "n", "gid").agg(
        F.count("*").alias("c")).join(spans, "gid")
    candidates = met.where(F.col("c") >= needed(F.col("n"), F.least("n", smallest))).select("id", "gid")
    rest = _compare(texts, candidates, grouped.select("gid", "id"), shingle, percent)
    comps = components(found.unionByName(rest))

    # classes and components together
    label = comps.select(F.col("node").alias("rep"), "component_id")
    members = some.select("id", "n", "s1", "s2").distinct().join(classes, ["n", "s1", "s2"]).join(label, "rep", "left").select(
        "id", F.coalesce("component_id", "rep").alias("component_id"))
    members = members.groupBy("id").agg(F.min("component_id").alias("component_id"))
    return table.select("id", "n").join(members, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))
