"""Edit distance with a bit per item (Myers 1999, Hyyrö 2003).

A row of the edit table differs from place to place by -1, 0 or 1, so two whole
numbers with a bit per item of the hypothesis hold it, and a dozen operations on
whole numbers make the next row.  The table of two texts of n and m words costs
n * m / 64 steps instead of n * m.  Items are words or their codes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def places(hyp: Sequence) -> dict:
    """item -> the bits of its places in ``hyp``."""
    out: dict = {}
    for k, w in enumerate(hyp):
        out[w] = out.get(w, 0) | 1 << k
    return out


def first_state(m: int) -> tuple[int, int]:
    """The row before any reference item: every step to the right adds one."""
    return (1 << m) - 1, 0


def next_states(state: tuple[int, int], ref: Sequence, peq: dict, m: int) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Per item of ``ref``: the row's state, the places that equal their upper
    left neighbour and the places that are one more than the place above."""
    every = (1 << m) - 1
    up, down = state
    for w in ref:
        eq = peq.get(w, 0)
        kept = ((((eq & up) + up) ^ up) | eq | down) & every
        grown = down | (every ^ (kept | up))
        shrunk = kept & up
        left = grown << 1 | 1
        up, down = ((shrunk << 1) | (every ^ (every & (kept | left)))) & every, left & kept
        yield (up, down), kept, grown
