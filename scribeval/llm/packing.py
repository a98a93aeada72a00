"""Packing: window cuts by order-preserving dynamic programming.

The token stream of the documents, in the order of the input, is cut into
sequences of at most ``length`` tokens.  Cuts stand at document ends (free),
at sentence ends (a small penalty) or, in stretches longer than a sequence
without either, inside a sentence (a large penalty).  With ``cost[j]`` the
least padding plus penalties of a packing that ends at boundary ``j``::

    cost[j] = penalty[j] + min over i of cost[i] + pad(at[j] - at[i])

``pad(n)`` is ``length - n``, so the minimum runs over ``cost[i] + at[i]`` in
a sliding window of ``length`` tokens: a monotone queue gives each ``cost[j]``
in amortised constant time.  A sequence whose size is a power of two is not
padded; these few predecessors are looked up one by one.

Each task packs its own run of documents in blocks of ``block_tokens``
(ended at a document end), so memory is bounded by a block or one document,
nothing is shuffled, and a lost task is redone alone.  A block's last sequence
may be short; that is one in several hundred.

Order: Spark deals files to tasks in any order, so without more the order is
that of the partitions.  With ``places`` (``written_places``: the file's number
and the row's place in it) a block ends where the run of places breaks, and a
sequence's number holds the place of its block's first document: sequences are
in the written order by their numbers, without a shuffle or a sort.

Edge cases: a null or empty text is its end token alone; repeated rows are
packed as often as they occur; documents longer than a sequence are cut.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import release
from .tokens import encoder

#: A sequence's number: file, row of its block's first document, place in the block.
FILE_BITS, ROW_BITS, SEQUENCE_BITS = 20, 26, 17
PART_FILE = r"part-(\d+)"
SENTENCE_PENALTY = 2.0
INSIDE_PENALTY = 64.0
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def cut_points(at: np.ndarray, penalty: np.ndarray, length: int, free_powers: bool = True) -> np.ndarray:
    """Indices into ``at`` (ascending boundaries, first 0) where the cheapest
    packing cuts, the last boundary included.  Neighbours must lie no further
    apart than ``length``."""
    n = len(at)
    special: dict[int, list[int]] = {}
    if free_powers:
        size = 1
        while size < length:
            j = np.searchsorted(at, at + size)
            ok = np.flatnonzero((j < n) & (at[np.minimum(j, n - 1)] == at + size))
            for i, k in zip(ok.tolist(), j[ok].tolist()):
                special.setdefault(k, []).append(i)
            size *= 2
    where, extra = at.tolist(), penalty.tolist()
    cost, came = [0.0] * n, [0] * n
    queue, values, head = [0], [0.0], 0  # boundaries with rising cost + place
    for j in range(1, n):
        here = where[j]
        least = here - length
        while where[queue[head]] < least:
            head += 1
        i = queue[head]
        best = values[head] + length - here
        if j in special:
            for k in special[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        best += extra[j]
        cost[j], came[j] = best, i
        value = best + here
        while len(queue) > head and values[-1] >= value:
            queue.pop()
            values.pop()
        queue.append(j)
        values.append(value)
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = came[j]
    return np.array(cuts[::-1], dtype=np.int64)


def _boundaries(ids: np.ndarray, ends: np.ndarray, closing: np.ndarray, length: int):
    """Places where a cut may stand (from 0 to the block's end) and penalties."""
    last = int(ends[-1])
    penalty = np.full(last + 1, np.inf)
    penalty[np.flatnonzero(closing[ids]) + 1] = SENTENCE_PENALTY
    penalty[ends] = 0.0
    penalty[0] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    wide = np.flatnonzero(np.diff(at) > length)
    step = max(1, length // 16)
    for i in wide.tolist():
        penalty[np.arange(at[i] + step, at[i + 1], step)] = INSIDE_PENALTY
    if len(wide):
        at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def _closing(tokenizer) -> np.ndarray:
    """Which ids end a sentence: tokens that end in . ! ? or a line break."""
    n = tokenizer.get_vocab_size()
    out = np.zeros(n, bool)
    for i in range(n):
        t = tokenizer.id_to_token(i) or ""
        out[i] = t[-1:] in (".", "!", "?", "Ċ")  # U+010A: the line break in byte-level tokens
    return out


def _pack(path: str, length: int, end_id: int, block_tokens: int, placed: bool):
    def run(batches):
        enc = encoder(path)
        closing = _closing(enc.tokenizer)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        run_of, after = None, None  # file and next row of the open block
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        docs: list = []
        size = 0

        def flush():
            nonlocal number
            raw = b"".join(ids)
            stream = np.frombuffer(raw, "<u4")
            ends = np.cumsum([len(x) // 4 for x in ids])
            at, penalty = _boundaries(stream, ends, closing, length)
            cuts = at[cut_points(at, penalty, length)]
            if run_of is not None and len(cuts) > 1 << SEQUENCE_BITS:
                raise ValueError("a block has more sequences than numbers allow")
            stops = np.union1d(ends, cuts)
            begins = np.concatenate([[0], stops[:-1]])
            doc = np.searchsorted(ends, begins, side="right")
            seq = np.searchsorted(cuts, begins, side="right")
            heads = np.concatenate([[0], ends[:-1]])
            opens = np.concatenate([[0], cuts[:-1]])
            view = memoryview(raw)
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(begins.tolist(), stops.tolist())]
            batch = pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()).take(pa.array(doc)), pa.array(begins - heads[doc]), pa.array(stops - begins),
                pa.array(crc, pa.int64()), pa.array((ends - heads)[doc]), pa.array(number + seq),
                pa.array(begins - opens[seq])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            number += len(cuts)
            ids.clear()
            docs.clear()
            return batch

        for batch in batches:
            names = batch["id"].to_pylist()
            files, rows = (batch[c].to_pylist() if placed else None for c in ("file", "row"))
            for first, found in enc.encode(batch["text"]):
                for i, x in enumerate(found):
                    if placed:
                        place = files[first + i], rows[first + i]
                        if ids and place != (run_of, after):
                            yield flush()
                            size = 0
                        if not ids:
                            number = sequence_base(*place)
                        run_of, after = place[0], place[1] + 1
                    ids.append(x + end)
                    docs.append(names[first + i])
                    size += len(x) // 4 + 1
                    if size >= block_tokens:
                        yield flush()
                        size = 0
        if ids:
            yield flush()
        release(now=True)
    return run


def sequence_base(file: int, row: int) -> int:
    """The number of the first sequence of a block that begins at this place."""
    if not (0 <= file < 1 << FILE_BITS and 0 <= row < 1 << ROW_BITS):
        raise ValueError(f"file {file}, row {row}: no sequence number")
    return (file << ROW_BITS | row) << SEQUENCE_BITS


def written_places(docs: DataFrame) -> dict[str, Column]:
    """``file`` and ``row`` of the rows of Parquet files that one job wrote:
    the part file's number and the row's place in the file.  Empty for rows
    that come from no files; an error where the files' names give no order."""
    names = [n.rsplit("/", 1)[-1] for n in docs.inputFiles()]
    if not names:
        return {}
    if len({_part_number(n) for n in names}) < len(names):
        raise ValueError("the part files' names give no order")
    number = F.regexp_extract(F.col("_metadata.file_name"), PART_FILE, 1)
    return {"file": F.when(number == "", F.lit(0)).otherwise(number.cast("long")), "row": F.col("_metadata.row_index")}


def _part_number(name: str) -> int:
    m = re.match(PART_FILE, name)
    return int(m[1]) if m else 0


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", block_tokens: int = 1 << 18, places: dict[str, Column] | None = None) -> DataFrame:
    """One row per piece: where it starts in its document and in its sequence.
    The order of documents is that of ``places``, else that of the input's
    partitions."""
    if length < 1:
        raise ValueError("length must be at least 1")
    more = [c.cast("long").alias(n) for n, c in (places or {}).items()]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more).mapInArrow(
        _pack(tokenizer_path, length, end_id, block_tokens, bool(places)), SCHEMA)
