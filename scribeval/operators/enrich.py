"""A caller's outside scorer or transcriber applied to a column: many calls in
flight, one budget for the cluster, order kept, an error column.

``budget`` bounds the calls in flight everywhere: there are ``budget /
in_flight`` tasks, and each keeps ``in_flight`` calls going in threads (a call
waits for an outside service, so threads do).  A call gets a list of values
and returns as many results.  Results leave in the order of their rows, and a
task reads no further ahead than the calls it may have in flight, so its
memory is bounded by that many lists.

A list whose call fails goes to the next round, after a pause that doubles; in
the last round its values are called one by one, so that one bad value does
not take its neighbours along.  What still fails has a null result and the
text of its last error; no row fails the task, and Spark's own retry is left
for lost executors.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 3
FIRST_PAUSE = 2.0
BUDGET = 12
IN_FLIGHT = 4
VALUES_A_CALL = 16


def _tried(values: list, fn: Callable[[list], list]) -> tuple[list | None, str | None]:
    try:
        out = list(fn(values))
        if len(out) != len(values):
            raise ValueError(f"{len(out)} results for {len(values)} values")
        return out, None
    except Exception as problem:  # noqa: BLE001 - it is the rows' outcome
        return None, f"{type(problem).__name__}: {problem}"


def in_rounds(values: list, fn: Callable[[list], list], rounds: int = ROUNDS, sleep=time.sleep) -> list[tuple]:
    """(result, error) of each value."""
    pause = FIRST_PAUSE
    for turn in range(rounds):
        if turn:
            sleep(pause)
            pause *= 2
        if turn == rounds - 1 and turn and len(values) > 1:
            each = [_tried([v], fn) for v in values]
            return [(None, e) if out is None else (out[0], None) for out, e in each]
        out, error = _tried(values, fn)
        if out is not None:
            return [(r, None) for r in out]
    return [(None, error) for _ in values]


def ordered(items: Iterable, work: Callable, in_flight: int) -> Iterator:
    """``work(item)`` of every item in order, up to ``in_flight`` at once."""
    with ThreadPoolExecutor(max_workers=in_flight) as pool:
        waiting: deque = deque()
        for item in items:
            waiting.append(pool.submit(work, item))
            if len(waiting) >= in_flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def enrich(df: DataFrame, in_col: str, fn: Callable[[list], list], out_col: str, out_type: str = "string", budget: int = BUDGET,
           in_flight: int = IN_FLIGHT, values_a_call: int = VALUES_A_CALL, rounds: int = ROUNDS, sleep=time.sleep) -> DataFrame:
    """Adds ``out_col`` (``fn`` of the values of ``in_col``) and ``{out_col}_error``."""
    if in_flight > budget or min(budget, in_flight, values_a_call, rounds) < 1:
        raise ValueError("wanted: 1 <= in_flight <= budget, values_a_call and rounds of at least 1")
    added = T.StructType.fromDDL(f"`{out_col}` {out_type}, `{out_col}_error` string")
    schema = T.StructType([*df.schema.fields, *added.fields])
    kind = added[0].dataType

    def parts(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, values_a_call):
                yield batch.slice(lo, values_a_call)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        found = in_rounds(part[in_col].to_pylist(), fn, rounds, sleep)
        from pyspark.sql.pandas.types import to_arrow_type
        columns = [*part.columns, pa.array([r for r, _ in found], to_arrow_type(kind)), pa.array([e for _, e in found], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, out_col, f"{out_col}_error"])

    return df.repartition(budget // in_flight).mapInArrow(lambda batches: ordered(parts(batches), one, in_flight), schema)
