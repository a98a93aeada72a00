"""String helpers built from Spark built-ins (plus their DuckDB twins).

Fixed-point formatting: ``fmt_fixed`` rounds half away from zero on
``abs(x) * 10^d`` computed in double precision, then prints the integer with
a decimal point.  IEEE arithmetic makes the digits identical in every engine;
they can differ from Python's correctly rounded ``f"{x:.2f}"`` only when
``x * 10^d`` lies within one rounding error of ``k + 0.5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import WS

ELLIPSIS = "…"


def fmt_fixed(x: Column, d: int) -> Column:
    scale = 10 ** d
    k = F.floor(F.abs(x) * F.lit(float(scale)) + F.lit(0.5)).cast("long")
    sign = F.when((x < 0) & (k > 0), F.lit("-")).otherwise(F.lit(""))
    if d == 0:
        return F.when(x.isNotNull(), F.concat(sign, k.cast("string")))
    whole = F.floor(k / F.lit(scale)).cast("long")
    frac = F.lpad((k % F.lit(scale)).cast("string"), d, "0")
    return F.when(x.isNotNull(), F.concat(sign, whole.cast("string"), F.lit("."), frac))


def sql_fmt_fixed(x: str, d: int) -> str:
    scale = 10 ** d
    k = f"CAST(floor(abs({x}) * {float(scale)} + 0.5) AS BIGINT)"
    sign = f"CASE WHEN {x} < 0 AND {k} > 0 THEN '-' ELSE '' END"
    if d == 0:
        return f"CASE WHEN {x} IS NOT NULL THEN {sign} || CAST({k} AS VARCHAR) END"
    return (f"CASE WHEN {x} IS NOT NULL THEN {sign} || CAST({k} // {scale} AS VARCHAR) || '.' || "
            f"lpad(CAST({k} % {scale} AS VARCHAR), {d}, '0') END")


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` for the usual blanks (``btrim`` only strips spaces)."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def ellipsis(c: Column, width: int = 120) -> Column:
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit(ELLIPSIS))).otherwise(c)


def first_nonblank(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def count_occurrences(content: Column, old: Column) -> Column:
    """Non-overlapping occurrences of a literal (``str.count``)."""
    return F.when(F.length(old) == 0, F.length(content) + 1).otherwise(
        ((F.length(content) - F.length(F.replace(content, old, F.lit("")))) / F.length(old)).cast("long"))


def replace_first(content: Column, old: Column, new: Column) -> Column:
    """``str.replace(old, new, 1)``."""
    p = F.position(old, content)
    return F.when((p == 0) | (F.length(old) == 0), content).otherwise(
        F.concat(F.substr(content, F.lit(1), p - 1), new, F.substr(content, p + F.length(old))))


def keyword_score(line: Column, words: list[str]) -> Column:
    """How many query words occur as substrings of the lower-cased line."""
    low = F.lower(line)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def number_line(pos: Column, line: Column) -> Column:
    return F.format_string("%4d | %s", pos + 1, line)


def template_fill(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders (str.format with named fields only)."""
    out = F.lit(template)
    for name, col in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), col.cast("string"))
    return out
