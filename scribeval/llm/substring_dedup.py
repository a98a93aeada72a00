"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes.

Every window of ``window`` consecutive words of one text is hashed.  A window
whose word sequence also starts earlier (smaller id, or earlier in the same
text) is removed: each word it covers goes.  The covered words of a text form
maximal intervals, which are what is cut.

How Spark does it:

1. texts are dealt into blocks by a hash of the id (about ``block_bytes`` of
   text each; the block count follows the input);
2. per block (one group, one task) windows are hashed and *combined*: each
   distinct hash leaves the block once with the smallest id that has it, so a
   passage that a third of all texts share costs one entry per block.  The
   entries travel in binary columns, one row per (block, hash range);
3. per hash range the smallest id of each hash is found, and every block gets
   one bit per entry it sent: does a smaller id elsewhere have it?
4. the blocks meet their bits again (co-group on the block; the text shuffle
   of step 2 is reused), hash anew and cut.

Hashes are compared within a hash range, whose number grows with the input,
so two different windows collide with probability 2**-64 / ranges per pair:
about 1e-5 collisions are expected over 10**8 windows.

Edge cases: a null text has no words; a null id counts as smaller than every
other; rows that repeat an id *and* text are the same text and are cut alike;
rows that share an id but not the text are ordered by text.  Texts with fewer
words than the window lose nothing.  Other columns are carried along, and
columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import release
from .words import text_buffer, window_hashes, word_hashes, word_spans

RESULT = ("n_words", "n_removed", "kept_text", "removed_spans")
NO_ID = np.iinfo(np.int64).min


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (id, text) rows in id order: row numbers of the distinct rows,
    their ids (null: smallest), and for every row the distinct one it repeats."""
    n = table.num_rows
    ids = table["_id"].fill_null(NO_ID).to_numpy()
    nulls = table["_id"].is_null().to_numpy() if table["_id"].null_count else np.zeros(n, bool)
    order = np.lexsort((ids, ~nulls))
    same = np.arange(n)
    run = np.flatnonzero(np.diff(ids[order]) == 0)
    if len(run):  # repeated ids are rare: sort these by text
        texts = table["_text"]
        key = {int(i): texts[int(i)].as_py() or "" for i in np.unique(np.concatenate([order[run], order[run + 1]]))}
        order = np.array(sorted(range(n), key=lambda i: (not nulls[i], ids[i], key.get(i, ""))), dtype=np.int64)
        for a, b in zip(order[:-1], order[1:]):
            if ids[a] == ids[b] and nulls[a] == nulls[b] and key[int(a)] == key[int(b)]:
                same[b] = same[a]
    distinct = order[same[order] == order]
    return distinct, ids[distinct], same, order


class _Windows:
    """The windows of one block: hashed, combined and dealt to hash ranges."""

    def __init__(self, table: pa.Table, window: int, ranges: int):
        self.rows, self.ids, self.same, _ = _ordered(table)
        self.buf, self.offsets = text_buffer(table["_text"].take(pa.array(self.rows)))
        starts, ends, self.first = word_spans(self.buf, self.offsets)
        self.starts, self.ends = starts, ends
        h, at = window_hashes(word_hashes(self.buf, starts, ends), self.first, window)
        self.at = at
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        entry = np.cumsum(new) - 1
        first = order[new]  # stable: the earliest window of each hash
        value = h[first]
        bucket = ((value >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        deal = np.lexsort((first, bucket))
        place = np.empty(len(deal), np.int64)
        place[deal] = np.arange(len(deal))
        self.value, self.bucket = value[deal], bucket[deal].astype(np.int64)
        self.first_window = first[deal]
        self.entry = np.empty(len(h), np.int64)
        self.entry[order] = place[entry]

    def sent(self):
        """(range, hashes, ids as runs, run lengths) for each range."""
        doc = np.searchsorted(self.first, self.at[self.first_window], side="right") - 1
        owner = self.ids[doc]
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        for part in np.split(np.arange(len(self.value)), cuts):
            if len(part):
                o = owner[part]
                edge = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                runs = np.diff(np.append(edge, len(o))).astype(np.uint32)
                yield int(self.bucket[part[0]]), self.value[part].tobytes(), o[edge].tobytes(), runs.tobytes()


def _send(window: int, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        block = table["_block"][0].as_py()
        rows = [(b, block, h, i, r) for b, h, i, r in _Windows(table, window, ranges).sent()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        release()
        return pa.table({"_range": pa.array(cols[0], pa.int64()), "_block": pa.array(cols[1], pa.int64()),
                         "_hashes": pa.array(cols[2], pa.binary()), "_ids": pa.array(cols[3], pa.binary()),
                         "_runs": pa.array(cols[4], pa.binary())})
    return run


def _judge(table: pa.Table) -> pa.Table:
    """One hash range: which entries have a smaller id in another block."""
    hs = [np.frombuffer(x, np.uint64) for x in table["_hashes"].to_pylist()]
    ids = [np.repeat(np.frombuffer(i, np.int64), np.frombuffer(r, np.uint32))
           for i, r in zip(table["_ids"].to_pylist(), table["_runs"].to_pylist())]
    h = np.concatenate(hs)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    member = np.zeros(len(h), bool)
    member[1:] |= same
    member[:-1] |= same
    who = order[member]
    lost = np.zeros(len(h), bool)
    if len(who):
        owner = np.concatenate(ids)[who]
        who = who[np.lexsort((owner, h[who]))]
        lost[who[1:]] = h[who][1:] == h[who][:-1]
    bits, at = [], 0
    for x in hs:
        bits.append(np.packbits(lost[at:at + len(x)]).tobytes())
        at += len(x)
    release()
    return pa.table({"_block": table["_block"], "_range": table["_range"], "_bits": pa.array(bits, pa.binary()),
                     "_count": pa.array([len(x) for x in hs], pa.int64())})


def _covered(w: _Windows, removed: np.ndarray, window: int) -> np.ndarray:
    """Mask over words: covered by a removed window (a text's windows end
    inside it, so intervals never cross texts)."""
    edge = np.zeros(len(w.starts) + 1, np.int32)
    np.add.at(edge, w.at[removed], 1)
    np.add.at(edge, w.at[removed] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(window: int, ranges: int, columns: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _empty(left, columns)
        w = _Windows(left, window, ranges)
        lost = np.zeros(len(w.value), bool)
        start = np.searchsorted(w.bucket, np.arange(ranges + 1))
        for r, bits, n in zip(right["_range"].to_pylist(), right["_bits"].to_pylist(), right["_count"].to_pylist()):
            if n != start[r + 1] - start[r]:
                raise RuntimeError("a block's windows changed between two reads of the input")
            lost[start[r]:start[r + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        keep = np.zeros(len(w.at), bool)
        keep[w.first_window[~lost]] = True
        gone = _covered(w, np.flatnonzero(~keep), window)
        n_words = np.diff(w.first)
        total = np.concatenate([[0], np.cumsum(gone)])
        n_gone = total[w.first[1:]] - total[w.first[:-1]]
        kept, spans = [], []
        raw = w.buf
        for d in range(len(w.rows)):
            a, b = int(w.first[d]), int(w.first[d + 1])
            parts = raw[w.offsets[d]:w.offsets[d + 1]].tobytes().split()
            if n_gone[d]:
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                spans.append([{"first_word": int(x), "n_words": int(y - x)} for x, y in zip(edge[::2], edge[1::2])])
                parts = [p for p, x in zip(parts, g.tolist()) if not x]
            else:
                spans.append([])
            kept.append(b" ".join(parts))
        release()
        place = {int(r): i for i, r in enumerate(w.rows)}
        back = np.array([place[int(x)] for x in w.same], dtype=np.int64)
        out = {c: left[c] for c in columns}
        take = pa.array(back)
        out["n_words"] = pa.array(n_words[back], pa.int64())
        out["n_removed"] = pa.array(n_gone[back], pa.int64())
        out["kept_text"] = pa.array(kept, pa.binary()).take(take).cast(pa.string())
        out["removed_spans"] = pa.array(spans, pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))).take(take)
        return pa.table(out)
    return run


def _empty(left: pa.Table, columns: list[str]) -> pa.Table:
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))
    fields = [(c, left.schema.field(c).type) for c in columns]
    fields += [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed_spans", span)]
    return pa.schema(fields).empty_table()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   carry: list[str] | None = None, keep_text: bool = True,
                   block_bytes: int = 2 << 20, range_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` (the id, the text if ``keep_text``, and the columns in
    ``carry``; default: all) with n_words, n_removed, kept_text (kept words joined by one space) and
    removed_spans (maximal runs of removed words)."""
    if window < 1:
        raise ValueError("window must be at least 1")
    size = int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    blocks = max(1, -(-size // block_bytes))
    ranges = max(1, -(-size // range_bytes))  # some 6 bytes of text make one window of 8 bytes
    rest = [c for c in (docs.columns if carry is None else carry) if c not in (id_col, text_col, *RESULT)]
    base = docs.select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("long").alias("_block"),
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
        *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")] if rest else []))
    sent = base.groupBy("_block").applyInArrow(
        _send(window, ranges), "_range long, _block long, _hashes binary, _ids binary, _runs binary")
    judged = sent.groupBy("_range").applyInArrow(_judge, "_block long, _range long, _bits binary, _count long")
    carried = ["_id", *(["_text"] if keep_text else []), *(["_rest"] if rest else [])]
    schema = T.StructType([base.schema[c] for c in carried] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
        T.StructField("removed_spans", T.ArrayType(T.StructType([
            T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])))])
    done = base.groupBy("_block").cogroup(judged.groupBy("_block")).applyInArrow(_cut(window, ranges, carried), schema)
    return done.select(F.col("_id").alias(id_col), *([F.col("_text").alias(text_col)] if keep_text else []),
                       *[F.col("_rest")[c].alias(c) for c in rest], *RESULT)
