"""Registered queries: key -> Spark builder, key -> DuckDB oracle SQL."""

from __future__ import annotations

from . import audio, corpus, extras, judging, optimize, tools, turns
from . import evaluation as ev

QUERIES = {
    "q_eval_run": ev.q_eval_run,
    "q_eval_run_quota": ev.q_eval_run_quota,
    **corpus.QUERIES,
    **judging.QUERIES,
    **audio.QUERIES,
    **turns.QUERIES,
    **tools.QUERIES,
    **optimize.QUERIES,
    **extras.QUERIES,
}

ORACLE = {
    "q_eval_run": ev.sql_q_eval_run,
    "q_eval_run_quota": ev.sql_q_eval_run_quota,
    **corpus.ORACLE,
    **judging.ORACLE,
    **audio.ORACLE,
    **turns.ORACLE,
    **tools.ORACLE,
    **optimize.ORACLE,
    **extras.ORACLE,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: f() for k, f in ORACLE.items()}
