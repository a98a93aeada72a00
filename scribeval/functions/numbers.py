"""Spelled-out numbers to digits: a finite-state fold over a token array.

One pass over the tokens (``aggregate``) keeps the number that is being read
and the tokens written so far.  A number has digits already fixed (``pre``), a
total of finished thousands, millions ... (``tot``), the group below the next
scale word (``grp``), decimals (``de``), a sign and a currency.  A token either
extends the number or closes it:

* units, teens and tens add up behind tens, hundreds and scale words
  ("two hundred sixty", "three thousand twenty nine") and stand side by side
  elsewhere ("nineteen ninety nine" 1999, "nine one one" 911, "double oh
  seven" 007);
* "hundred" and scale words multiply, also decimals ("two point five million");
* ordinals and plurals close with their ending ("thirty first" 31st,
  "nineteen fifties" 1950s);
* "and" is dropped inside a number, "and a half" is .5, "point" opens decimals;
* percent, currencies and signs go to the number ("ninety percent" 90%, "two
  dollars and seventy cents" $2.70, "minus 500" -500).

The rules are written once, as conditions and new field values in the SQL that
both engines share; ``spark_fold`` and ``duckdb_fold`` put them into the
engine's own fold.  Numbers beyond 18 digits are closed before they overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: number words ----------------------------------------------
UNITS = (("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9))
TEENS = (("ten", 10), ("eleven", 11), ("twelve", 12), ("thirteen", 13), ("fourteen", 14), ("fifteen", 15), ("sixteen", 16),
         ("seventeen", 17), ("eighteen", 18), ("nineteen", 19))
TENS = (("twenty", 20), ("thirty", 30), ("forty", 40), ("fifty", 50), ("sixty", 60), ("seventy", 70), ("eighty", 80), ("ninety", 90))
SCALES = (("thousand", 10**3), ("million", 10**6), ("billion", 10**9), ("trillion", 10**12), ("quadrillion", 10**15))
IRREGULAR_ORDINALS = (("first", 1, "st"), ("second", 2, "nd"), ("third", 3, "rd"), ("fifth", 5, "th"), ("eighth", 8, "th"),
                      ("ninth", 9, "th"), ("twelfth", 12, "th"))
CURRENCIES = (("dollar", "$"), ("dollars", "$"), ("euro", "€"), ("euros", "€"), ("pound", "£"), ("pounds", "£"), ("cent", "¢"), ("cents", "¢"))
SIGNS = (("minus", "-"), ("negative", "-"), ("plus", "+"), ("positive", "+"))
MULTIPLES = (("double", 2), ("triple", 3))
# ------------------------------------------------------------------------------

NUMERAL = r"^[$¢€£]?[0-9]+([.][0-9]+)?$"


def _table() -> dict[str, tuple[str, int, str]]:
    """word -> (class, value, ending or sign)."""
    out: dict[str, tuple[str, int, str]] = {}
    irregular = {n for _, n, _ in IRREGULAR_ORDINALS}
    for kind, words in (("u", UNITS), ("t", TEENS), ("y", TENS)):
        for w, n in words:
            out[w] = (kind, n, "")
            if n not in irregular:
                out[(w[:-1] + "ie" if kind == "y" else w) + "th"] = (kind, n, "th")
            if kind == "y":
                out[w[:-1] + "ies"] = (kind, n, "s")
    for w, n, ending in IRREGULAR_ORDINALS:
        out[w] = ("u" if n < 10 else "t", n, ending)
    for w, n in (("hundred", 100), *SCALES):
        kind = "h" if n == 100 else "s"
        out |= {w: (kind, n, ""), w + "s": (kind, n, "s"), w + "th": (kind, n, "th")}
    out |= {"zero": ("z", 0, ""), "oh": ("q", 0, ""), "o": ("q", 0, ""), "point": ("p", 0, ""), "and": ("a", 0, ""),
            "percent": ("e", 0, ""), "per": ("r", 0, ""), "nd": ("x", 0, "nd"), "rd": ("x", 0, "rd"), "th": ("x", 0, "th")}
    out |= {w: ("c", 0, sign) for w, sign in CURRENCIES}
    out |= {w: ("n", 0, sign) for w, sign in SIGNS}
    out |= {w: ("m", n, "") for w, n in MULTIPLES}
    return out


TABLE = _table()
#: Token arrays without any of these words pass unchanged.
TRIGGERS = sorted(w for w, (c, _, _) in TABLE.items() if c not in "aqrx") + ["half"]

#: Fields of the state, with their first values.
STATE = (("o", "{strings}"), ("has", "false"), ("sg", "''"), ("pre", "''"), ("tot", "CAST(0 AS BIGINT)"), ("grp", "CAST(NULL AS BIGINT)"),
         ("sc", "CAST(0 AS BIGINT)"), ("la", "''"), ("de", "CAST(NULL AS STRING)"), ("cu", "''"), ("mu", "CAST(0 AS BIGINT)"), ("hd", "false"),
         ("sk", "CAST(0 AS BIGINT)"), ("pd", "false"))


def _is(field: str, classes: str) -> str:
    return f"{field} IN ({', '.join(repr(k) for k in classes)})"


def _case(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


#: The digits read so far.
NUMBER = "s.pre || CASE WHEN s.tot > 0 OR s.grp IS NOT NULL THEN CAST(s.tot + coalesce(s.grp, 0) AS STRING) ELSE '' END"

#: The step that a token ``t`` (class c, value v, ending x, word w; class n and
#: word nx behind it, word nnx behind that) is in the state ``s``: the first
#: condition that holds.
ACTIONS = (
    ("skip", "s.sk > 0"),
    # "and": before a half, inside a number, between dollars and cents
    ("half", "t.c = 'a' AND s.has AND s.de IS NULL AND t.nx = 'a' AND t.nnx = 'half'"),
    ("drop", f"t.c = 'a' AND s.has AND {_is('s.la', 'hs')} AND {_is('t.n', 'uty')}"),
    ("hold", f"t.c = 'a' AND NOT s.has AND s.pd AND {_is('t.n', 'utyd')}"),
    ("point", f"t.c = 'p' AND s.has AND s.de IS NULL AND s.mu = 0 AND ({_is('t.n', 'uzty')} OR t.n = 'd' AND substr(t.nx, 1, 1) BETWEEN '0' AND '9')"),
    ("sign", f"t.c = 'n' AND {_is('t.n', 'uztydhs')}"),
    ("multiple", f"t.c = 'm' AND {_is('t.n', 'uzq')} AND s.mu = 0"),
    ("decimal", f"s.has AND s.de IS NOT NULL AND s.cu = '' AND ({_is('t.c', 'uztyq')} AND t.x = '' AND {_is('s.la', 'puztyq')} OR s.de = '' AND t.c = 'd')"),
    # zeros and repeated digits stand beside what was read
    ("digits", f"(t.c = 'z' OR t.c = 'q' AND s.has AND {_is('s.la', 'uztym')} OR t.c = 'u' AND s.mu > 0) AND s.de IS NULL AND NOT {_is('s.la', 'hsd')} AND length({NUMBER}) < 14"),
    ("new digits", "t.c = 'z' OR t.c = 'q' AND s.mu > 0 OR t.c = 'u' AND s.mu > 0"),
    ("add", f"{_is('t.c', 'uty')} AND s.has AND s.de IS NULL AND ({_is('s.la', 'hs')} OR s.la = 'y' AND t.c = 'u')"),
    ("beside", f"{_is('t.c', 'uty')} AND s.has AND s.de IS NULL AND {_is('s.la', 'uztym')} AND (t.x = '' OR t.x = 's' AND t.c = 'y') AND length({NUMBER}) < 16"),
    ("start", _is("t.c", "uty")),
    ("hundred", f"t.c = 'h' AND s.has AND s.de IS NULL AND s.tot = 0 AND s.cu = '' AND {_is('s.la', 'utd')} AND length({NUMBER}) < 5"),
    ("group hundred", f"t.c = 'h' AND s.has AND s.de IS NULL AND s.pre = '' AND {_is('s.la', 'ut')} AND s.grp < 100"),
    ("start", "t.c = 'h'"),
    ("scaled decimal", f"t.c = 's' AND s.has AND s.de <> '' AND length(s.de) < length(CAST(t.v AS STRING)) AND length({NUMBER}) + length(CAST(t.v AS STRING)) < 19"),
    ("add scale", "t.c = 's' AND s.has AND s.de IS NULL AND s.pre = '' AND s.tot > 0 AND s.grp IS NOT NULL AND t.v < s.sc"),
    ("scale", f"t.c = 's' AND s.has AND s.de IS NULL AND s.la <> 'm' AND length({NUMBER}) + length(CAST(t.v AS STRING)) < 19"),
    ("new scale", "t.c = 's'"),
    ("numeral", "t.c = 'd'"),
    ("ending", "t.c = 'x' AND s.has AND s.la = 'd' AND s.de IS NULL AND s.cu = ''"),
    ("percent", "s.has AND s.cu = '' AND (t.c = 'e' OR t.c = 'r' AND t.nx = 'cent')"),
    ("cents", f"t.c = 'c' AND t.x = '¢' AND s.has AND s.hd AND s.pd AND s.de IS NULL AND s.cu = '' AND length({NUMBER}) <= 2"),
    ("money", "t.c = 'c' AND s.has AND s.cu = '' AND s.sg = ''"),
)
#: Steps that begin a number of their own.
FRESH = "a.act IN ('new digits', 'start', 'new scale', 'numeral', 'sign')"
#: An ordinal or plural closes what it extends, or itself where it begins.
ENDS = _is("t.c", "utyhs") + " AND t.x <> '' AND a.act NOT IN ('skip', 'word')"
#: Steps behind which no number is open.
OVER = f"({ENDS} OR a.act IN ('ending', 'percent', 'cents', 'money', 'word'))"


class _Dialect:
    """Array and struct expressions of an engine."""

    def __init__(self, spark: bool):
        self.spark = spark

    def strings(self, *items: str) -> str:
        if not items:
            return "CAST(array() AS ARRAY<STRING>)" if self.spark else "CAST([] AS VARCHAR[])"
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def joined(self, a: str, b: str) -> str:
        return f"concat({a}, {b})" if self.spark else f"list_concat({a}, {b})"

    def without_last(self, a: str) -> str:
        return f"slice({a}, 1, greatest(size({a}) - 1, 0))" if self.spark else f"{a}[1:len({a}) - 1]"

    def last(self, a: str) -> str:
        return f"coalesce(get({a}, size({a}) - 1), '')" if self.spark else f"coalesce({a}[len({a})], '')"

    def struct(self, fields) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields) + ")"
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields) + ")"

    def divided(self, a: str, b: str) -> str:
        return f"({a} DIV {b})" if self.spark else f"({a} // {b})"

    def let(self, value: str, body: str) -> str:
        """``body`` with ``a`` for a struct that is made once."""
        return f"get(transform(array({value}), a -> {body}), 0)" if self.spark else f"list_transform([{value}], lambda a: {body})[1]"

    def first(self) -> str:
        return self.struct([(k, v.replace("{strings}", self.strings())) for k, v in STATE])

    def held(self) -> str:
        return f"CASE WHEN s.hd THEN {self.joined('s.o', self.strings(repr('and')))} ELSE s.o END"

    def closed(self, shown: str, ending: str = "''") -> str:
        return self.joined(self.held(), self.strings(f"s.sg || s.cu || {shown} || {ending}"))

    def step(self) -> str:
        """The next state, from ``s`` and ``t``."""
        shown = f"{NUMBER} || CASE WHEN coalesce(s.de, '') <> '' THEN '.' || s.de ELSE '' END"
        known = [("act", _case([(c, f"'{k}'") for k, c in ACTIONS], "'word'")), ("num", NUMBER), ("shown", shown),
                 ("bare", "CASE WHEN substr(t.w, 1, 1) BETWEEN '0' AND '9' THEN t.w ELSE substr(t.w, 2) END")]
        return self.let(self.struct(known), self.struct(self._fields()))

    def _fields(self) -> list[tuple[str, str]]:
        done = f"CASE WHEN s.has THEN {self.closed('a.shown')} ELSE s.o END"
        times = "repeat(CAST(t.v AS STRING), CAST(greatest(s.mu, 1) AS INT))"
        scaled = "CAST(a.num || s.de AS BIGINT) * " + self.divided("t.v", "CAST(rpad('1', CAST(length(s.de) + 1 AS INT), '0') AS BIGINT)")
        none = "CAST(NULL AS BIGINT)"
        grown = _case([("a.act = 'add'", "s.pre || CAST(s.tot + coalesce(s.grp, 0) + t.v AS STRING)"), ("a.act = 'beside'", "a.num || CAST(t.v AS STRING)"),
                       ("a.act = 'hundred'", "a.num || '00'"), ("a.act = 'group hundred'", "CAST(s.tot + s.grp * 100 AS STRING)"),
                       ("a.act = 'scale'", "CAST(CAST(a.num AS BIGINT) * t.v AS STRING)"), ("a.act = 'add scale'", "CAST(s.tot + s.grp * t.v AS STRING)"),
                       ("a.act = 'scaled decimal'", f"CAST({scaled} AS STRING)")], "CAST(t.v AS STRING)")
        finished = self.joined(f"CASE WHEN {FRESH} THEN {done} ELSE {self.held()} END",
                               self.strings(f"CASE WHEN {FRESH} AND s.has THEN '' ELSE s.sg || s.cu END || {grown} || t.x"))
        cash = self.joined(self.without_last("s.o"), self.strings(f"{self.last('s.o')} || '.' || lpad(a.num, 2, '0')"))
        decimals = _case([("t.c = 'd'", "s.de || t.w"), ("t.c = 'u' AND s.la = 'y' AND s.mu = 0", "substr(s.de, 1, length(s.de) - 1) || CAST(t.v AS STRING)")],
                         f"s.de || {times}")
        dot = "instr(a.bare, '.')"
        return [
            ("o", _case([("a.act IN ('skip', 'half', 'drop', 'hold', 'point', 'multiple', 'decimal', 'digits')", "s.o"), (ENDS, finished), (FRESH, done),
                         ("a.act IN ('add', 'beside', 'hundred', 'group hundred', 'scaled decimal', 'add scale', 'scale')", "s.o"),
                         ("a.act = 'ending'", self.closed("a.shown", "t.x")), ("a.act = 'percent'", self.closed("a.shown", "'%'")), ("a.act = 'cents'", cash),
                         ("a.act = 'money'", self.joined(self.held(), self.strings("t.x || a.shown")))], self.joined(done, self.strings("t.w")))),
            ("has", _case([(OVER, "false"), ("a.act IN ('skip', 'hold')", "s.has"), ("a.act = 'sign'", "false")], "true")),
            ("sg", _case([(OVER, "''"), ("a.act = 'sign'", "t.x"), (f"{FRESH} AND s.has", "''")], "s.sg")),
            ("pre", _case([(OVER, "''"), ("a.act = 'digits'", f"a.num || {times}"), ("a.act = 'new digits'", times), ("a.act = 'beside'", "a.num"),
                           ("a.act = 'numeral'", f"CASE WHEN {dot} > 0 THEN substr(a.bare, 1, {dot} - 1) ELSE a.bare END"),
                           (f"{FRESH} OR a.act IN ('hundred', 'scale', 'scaled decimal')", "''")], "s.pre")),
            ("tot", _case([(OVER, "0"), ("a.act = 'scale'", "CAST(a.num AS BIGINT) * t.v"), ("a.act = 'add scale'", "s.tot + s.grp * t.v"),
                           ("a.act = 'scaled decimal'", scaled), ("a.act = 'new scale'", "t.v"), (f"{FRESH} OR a.act IN ('digits', 'beside', 'hundred')", "0")], "s.tot")),
            ("grp", _case([(OVER, none), ("a.act = 'add'", "coalesce(s.grp, 0) + t.v"), ("a.act IN ('start', 'beside')", "t.v"),
                           ("a.act = 'hundred'", "CAST(a.num AS BIGINT) * 100"), ("a.act = 'group hundred'", "s.grp * 100"),
                           (f"{FRESH} OR a.act IN ('digits', 'scale', 'add scale', 'scaled decimal')", none)], "s.grp")),
            ("sc", _case([(f"{OVER} OR a.act = 'start'", "0"), ("t.c = 's'", "t.v")], "s.sc")),
            ("la", _case([(OVER, "''"), ("a.act IN ('skip', 'drop', 'hold')", "s.la"), ("a.act = 'half'", "'f'"), ("a.act IN ('digits', 'new digits')", "'z'"),
                          ("a.act = 'multiple'", "CASE WHEN s.has THEN s.la ELSE 'm' END")], "t.c")),
            ("de", _case([(OVER, "CAST(NULL AS STRING)"), ("a.act = 'half'", "'5'"), ("a.act = 'point'", "''"), ("a.act = 'decimal'", decimals),
                          (f"a.act = 'numeral' AND {dot} > 0", f"substr(a.bare, {dot} + 1)"), (f"{FRESH} OR a.act = 'scaled decimal'", "CAST(NULL AS STRING)")], "s.de")),
            ("cu", _case([(OVER, "''"), ("a.act = 'numeral'", "CASE WHEN a.bare = t.w THEN '' ELSE substr(t.w, 1, 1) END"), (FRESH, "''")], "s.cu")),
            ("mu", _case([("a.act = 'multiple'", "t.v"), ("a.act = 'skip'", "s.mu")], "0")),
            ("hd", _case([("a.act = 'hold'", "true"), (f"{OVER} OR {FRESH} AND s.has", "false")], "s.hd")),
            ("sk", _case([("a.act = 'skip'", "s.sk - 1"), ("a.act = 'half'", "2"), ("a.act = 'percent' AND t.c = 'r'", "1")], "0")),
            ("pd", _case([("a.act = 'money' AND t.x <> '¢' AND s.de IS NULL", "true"), (OVER, "false"), ("a.act IN ('skip', 'hold') OR s.hd", "s.pd")], "false")),
        ]

    def finish(self) -> str:
        shown = f"{NUMBER} || CASE WHEN coalesce(s.de, '') <> '' THEN '.' || s.de ELSE '' END"
        return f"CASE WHEN s.has THEN {self.closed(shown)} ELSE s.o END"


def _classes() -> list[str]:
    return sorted(TABLE)


def number_tokens(tokens: str) -> Column:
    """The words of the array column ``tokens`` with their classes; put it in a
    projection of its own before ``spark_fold``."""
    words = F.create_map(*[F.lit(x) for w, k in TABLE.items() for x in (w, "|".join(map(str, k)))])
    column = F.col(tokens)

    def kind(w: Column) -> Column:
        known = F.when(w.isin(_classes()), F.try_element_at(words, w)).when(w.rlike(NUMERAL), F.lit("d|0|")).otherwise(F.lit("w|0|"))
        return F.split(known, r"\|")

    def token(w: Column, i: Column) -> Column:
        nx, k = F.coalesce(F.get(column, i + 1), F.lit("")), kind(w)
        return F.struct(k[0].alias("c"), k[1].cast("long").alias("v"), k[2].alias("x"), w.alias("w"), kind(nx)[0].alias("n"), nx.alias("nx"),
                        F.coalesce(F.get(column, i + 2), F.lit("")).alias("nnx"))
    return F.transform(column, token)


def spark_fold(known: str) -> Column:
    """The words of a column made by ``number_tokens``, numbers as digits."""
    d = _Dialect(True)
    return F.expr(f"aggregate(`{known}`, {d.first()}, (s, t) -> {d.step()}, s -> {d.finish()})")


def duckdb_fold(tokens: str) -> str:
    """The same for a list column in DuckDB."""
    d = _Dialect(False)

    def look(w: str, k: int) -> str:
        whens = " ".join(f"WHEN '{word}' THEN {v[k]!r}" for word, v in TABLE.items())
        other = {0: f"CASE WHEN regexp_matches(coalesce({w}, ''), '{NUMERAL}') THEN 'd' ELSE 'w' END", 1: "0", 2: "''"}[k]
        return f"(CASE {w} {whens} ELSE {other} END)"
    token = d.struct([("c", look("w", 0)), ("v", f"CAST({look('w', 1)} AS BIGINT)"), ("x", look("w", 2)), ("w", "w"),
                      ("nx", f"coalesce({tokens}[i + 1], '')"), ("nnx", f"coalesce({tokens}[i + 2], '')"), ("n", look(f"{tokens}[i + 1]", 0))])
    state = f"list_reduce(list_transform({tokens}, lambda w, i: {token}), lambda s, t: {d.step()}, {d.first()})"
    return f"list_transform([{state}], lambda s: {d.finish()})[1]"
