"""Word alignment (edit operations).

``align_ops`` is the one Python step: per (reference, hypothesis) pair it
aligns the words bit-parallel (``functions/editbits.py``: a row of the table is
one whole number with a bit per hypothesis word) and backtraces one optimal
alignment (ties: match/substitution, then deletion, then insertion).  It runs
in ``mapInArrow``; Spark partitions the pairs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.editbits import first_state, next_states, places

OPS_SCHEMA = "sample_id long, op_no int, op string, ref_word string, hyp_word string, prev_hyp string"
#: Bits of the table that the backtrace holds at once.
TABLE_BITS = 1 << 28


def edit_ops(ref: list[str], hyp: list[str]) -> list[tuple[str, str | None, str | None]]:
    n, m = len(ref), len(hyp)
    if n == 0:
        return [("ins", None, h) for h in hyp]
    if m == 0:
        return [("del", r, None) for r in ref]
    peq = places(hyp)
    # Only the state before every step-th row is kept; the backtrace makes the
    # rows of one block at a time, so memory is bounded for any length.
    step = max(int(n ** 0.5) + 1, TABLE_BITS // m)
    states = [first_state(m)]
    for at in range(step, n, step):
        for state, _, _ in next_states(states[-1], ref[at - step:at], peq, m):
            pass
        states.append(state)
    ops = []
    i, k = n, m
    while i > 0 and k > 0:
        at = (i - 1) // step
        rows = [(kept, grown) for _, kept, grown in next_states(states[at], ref[at * step:i], peq, m)]
        while i > at * step and k > 0:
            kept, grown = rows[i - 1 - at * step]
            if ref[i - 1] == hyp[k - 1]:
                ops.append(("ok", ref[i - 1], hyp[k - 1]))
                i, k = i - 1, k - 1
            elif not kept >> (k - 1) & 1:
                ops.append(("sub", ref[i - 1], hyp[k - 1]))
                i, k = i - 1, k - 1
            elif grown >> (k - 1) & 1:
                ops.append(("del", ref[i - 1], None))
                i -= 1
            else:
                ops.append(("ins", None, hyp[k - 1]))
                k -= 1
    ops.extend(("del", ref[x - 1], None) for x in range(i, 0, -1))
    ops.extend(("ins", None, hyp[x - 1]) for x in range(k, 0, -1))
    ops.reverse()
    return ops


ROWS_A_BATCH = 50_000
_ARROW = pa.schema([("sample_id", pa.int64()), ("op_no", pa.int32()), *[(c, pa.string()) for c in ("op", "ref_word", "hyp_word", "prev_hyp")]])


def _align_batches(batches):
    columns = [[] for _ in _ARROW]
    ids, numbers, names, refs, hyps, before = columns

    def taken():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)
        for c in columns:
            c.clear()
        return out

    for batch in batches:
        for sid, r, h in zip(batch["sample_id"].to_pylist(), batch["norm_ref"].to_pylist(), batch["norm_hyp"].to_pylist()):
            ops = edit_ops((r or "").split(), (h or "").split())
            ids.extend([sid] * len(ops))
            numbers.extend(range(len(ops)))
            prev = None
            for op, rw, hw in ops:
                names.append(op)
                refs.append(rw)
                hyps.append(hw)
                before.append(prev)
                if hw is not None:
                    prev = hw
            if len(ids) >= ROWS_A_BATCH:
                yield taken()
    yield taken()


def align_ops(pairs: DataFrame) -> DataFrame:
    """(sample_id, norm_ref, norm_hyp) -> one row per edit operation."""
    return pairs.select("sample_id", "norm_ref", "norm_hyp").mapInArrow(_align_batches, OPS_SCHEMA)
