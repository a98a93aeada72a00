"""English transcript normaliser as a chain of built-in Spark expressions.

The evaluation compares texts after the English normaliser described in
Appendix C of Radford et al. (2022), "Robust Speech Recognition via
Large-Scale Weak Supervision".  This module re-expresses its steps with
``lower``/``translate``/``regexp_replace`` and array functions so that the
whole chain stays inside the JVM (whole-stage codegen, no Python worker):

1. null -> "", lower-case
2. fold Latin diacritics (``translate`` + a few two-letter replacements);
   done first so that every later pattern only meets ASCII letters, which
   keeps Java and RE2 word boundaries identical
3. drop text in <...>, [...] and (...)
4. drop fillers (hmm, mm, mhm, mmm, uh, um)
5. remove blanks before an apostrophe
6. expand contractions that carry an apostrophe (regexes, run only on texts
   that contain one)
7. drop commas between digits, periods not followed by a digit
8. replace remaining symbols/punctuation by blanks (keeping . % $ and
   currency signs next to numbers)
9. collapse blanks, trim
10. token maps: whole-word contractions and titles ("gonna", "mr", ...),
    spelled-out numbers to digits (``numbers.py``), British -> American
    spelling (a small built-in table; callers pass larger tables as
    DataFrames, see ``operators/wordmap.py``).  Titles and whole-word
    contractions only ever match whole words, so mapping them on tokens gives
    the same text as the regex form.

The patterns and word tables are those of the public ``whisper-normalizer``
package (MIT licence), stated below as fixed values.  Parity with it is not
claimed for steps 2 and 10: its 1,700-entry spelling table is not reproduced.
The patterns avoid look-around and back references so that DuckDB (RE2) runs
exactly the same chain in the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import TRIGGERS, duckdb_fold, number_tokens, spark_fold

# --- fixed values -----------------------------------------------------------
# Diacritic folding, one character to one character (lower-case forms).
FOLD_FROM = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž"
FOLD_TO = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorrssstuuuuuuuuyyzzz"
# Letters that fold to two letters.
FOLD_MULTI = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d"), ("đ", "d"))

# Fillers removed as whole words.
FILLERS = ("hmm", "mm", "mhm", "mmm", "uh", "um")

# Contractions and titles (pattern over lower-case ASCII text -> replacement),
# in the order they are applied.
CONTRACTIONS = (
    (r"\bwon't\b", "will not"),
    (r"\bcan't\b", "can not"),
    (r"\blet's\b", "let us"),
    (r"\bain't\b", "aint"),
    (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"),
    (r"\bgotta\b", "got to"),
    (r"\bgonna\b", "going to"),
    (r"\bi'ma\b", "i am going to"),
    (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"),
    (r"\bcoulda\b", "could have"),
    (r"\bshoulda\b", "should have"),
    (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "),
    (r"\bmrs\b", "missus "),
    (r"\bst\b", "saint "),
    (r"\bdr\b", "doctor "),
    (r"\bprof\b", "professor "),
    (r"\bcapt\b", "captain "),
    (r"\bgov\b", "governor "),
    (r"\bald\b", "alderman "),
    (r"\bgen\b", "general "),
    (r"\bsen\b", "senator "),
    (r"\brep\b", "representative "),
    (r"\bpres\b", "president "),
    (r"\brev\b", "reverend "),
    (r"\bhon\b", "honorable "),
    (r"\basst\b", "assistant "),
    (r"\bassoc\b", "associate "),
    (r"\blt\b", "lieutenant "),
    (r"\bcol\b", "colonel "),
    (r"\bjr\b", "junior "),
    (r"\bsr\b", "senior "),
    (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"),
    (r"'s been\b", " has been"),
    (r"'d gone\b", " had gone"),
    (r"'s gone\b", " has gone"),
    (r"'d done\b", " had done"),
    (r"'s got\b", " has got"),
    (r"n't\b", " not"),
    (r"'re\b", " are"),
    (r"'s\b", " is"),
    (r"'d\b", " would"),
    (r"'ll\b", " will"),
    (r"'t\b", " not"),
    (r"'ve\b", " have"),
    (r"'m\b", " am"),
)

# British -> American spellings (small default table).
SPELLINGS = (
    ("colour", "color"), ("colours", "colors"), ("favour", "favor"),
    ("favourite", "favorite"), ("honour", "honor"), ("labour", "labor"),
    ("neighbour", "neighbor"), ("behaviour", "behavior"), ("centre", "center"),
    ("theatre", "theater"), ("metre", "meter"), ("litre", "liter"),
    ("organise", "organize"), ("organised", "organized"), ("realise", "realize"),
    ("realised", "realized"), ("recognise", "recognize"), ("analyse", "analyze"),
    ("defence", "defense"), ("licence", "license"), ("travelling", "traveling"),
    ("travelled", "traveled"), ("cancelled", "canceled"), ("grey", "gray"),
    ("programme", "program"), ("catalogue", "catalog"), ("dialogue", "dialog"),
    ("mum", "mom"), ("aluminium", "aluminum"), ("cheque", "check"),
)
# ---------------------------------------------------------------------------

WS = r"[\t\n\f\r ]"

# Regex steps: (pattern, replacement).  Replacements use \1 for groups
# (RE2 form); ``_java_repl`` converts them for Spark.
REGEX_STEPS_HEAD = (
    (r"[<\[][^>\]]*[>\]]", ""),
    (r"\([^)]+\)", ""),
    (r"\b(" + "|".join(FILLERS) + r")\b", ""),
    (WS + r"+'", "'"),
)
REGEX_STEPS_TAIL = (
    (r"(\d),(\d)", r"\1\2"),
    (r"\.([^0-9]|$)", r" \1"),
    (r"[^\p{L}\p{N}\t\n\f\r .%$¢€£]", " "),
    (r"[.$¢€£]([^0-9])", r" \1"),
    (r"([^0-9])%", r"\1 "),
    (WS + r"+", " "),
)


def _is_word_pattern(p: str) -> bool:
    return p.startswith(r"\b") and p.endswith(r"\b") and "'" not in p


# Contractions that need an apostrophe run as regexes on the text; whole-word
# ones (titles, "gonna" ...) are token maps, applied after punctuation is gone
# (same result: their patterns only ever match whole words).
APOSTROPHE_RULES = tuple((p, r) for p, r in CONTRACTIONS if not _is_word_pattern(p))
WORD_RULES = tuple((p[2:-2], r.strip()) for p, r in CONTRACTIONS if _is_word_pattern(p))


def regex_steps():
    return REGEX_STEPS_HEAD + APOSTROPHE_RULES + REGEX_STEPS_TAIL


def _java_repl(rep: str) -> str:
    out = rep.replace("$", r"\$")
    for g in range(1, 10):
        out = out.replace("\\" + str(g), "$" + str(g))
    return out


def fold_col(c: Column) -> Column:
    c = F.translate(c, FOLD_FROM, FOLD_TO)
    for a, b in FOLD_MULTI:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize_string(c: Column) -> Column:
    """Steps 1-9 as one expression (no guards, no token maps)."""
    c = fold_col(F.lower(F.coalesce(c, F.lit(""))))
    for pat, rep in regex_steps():
        c = F.regexp_replace(c, pat, _java_repl(rep))
    return F.trim(c)


# Literal guards: a step whose pattern needs one of these characters or pieces is
# skipped (cheap substring test) for texts that do not contain any of them.
_GUARDS = {
    r"[<\[][^>\]]*[>\]]": ("[", "<"),
    r"\([^)]+\)": ("(",),
    r"\b(" + "|".join(FILLERS) + r")\b": ("mm", "mhm", "uh", "um"),
    WS + r"+'": ("'",),
    r"(\d),(\d)": (",",),
    r"\.([^0-9]|$)": (".",),
    r"[.$¢€£]([^0-9])": (".", "$", "¢", "€", "£"),
    r"([^0-9])%": ("%",),
}

#: The symbol step, and its form for texts of ASCII characters only: all
#: characters one by one, which Java looks up in a table of bits; ranges and
#: Unicode categories are tests in turn.
SYMBOLS = REGEX_STEPS_TAIL[2][0]
ASCII_SYMBOLS = "[" + "".join(rf"\x{c:02x}" for c in range(128) if not chr(c).isalnum() and chr(c) not in "\t\n\f\r .%$") + "]"
PLAIN_SYMBOLS = ASCII_SYMBOLS[:-1] + ".]"
#: Forms of steps that fail at most characters on their first test (a word
#: boundary or a group is slow there); look-behind is Java's only.
_JAVA_FORMS = {
    r"\b(" + "|".join(FILLERS) + r")\b":
        "[" + "".join(sorted({w[0] for w in FILLERS})) + "](?:" + "|".join(rf"(?<=\b{w[0]}){w[1:]}\b" for w in FILLERS) + ")",
}
#: Tests in front of a step that is dearer than the test and seldom changes a text.
_JAVA_TESTS = {r"(\d),(\d)": "[0-9],[0-9]"}
#: A text (lower-case, folded, without fillers) that has none of these, nor two
#: periods in a row, is plain: of the steps behind the fillers only the symbols can
#: change it, and each of its symbols, periods too, becomes a blank.
NOT_PLAIN = "[^" + "".join(rf"\x{c:02x}" for c in range(128) if chr(c) not in "0123456789[<('$%") + "]"


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _cleaned_stages(df: DataFrame, src: str, out: str) -> DataFrame:
    """Steps 1-8 of ``normalize_string``, one projection per step, each
    guarded by a substring test so most texts skip most regex passes (the
    apostrophe rules run only on texts with an apostrophe; ASCII texts have
    nothing to fold; plain texts need one step behind the fillers).  Separate
    projections keep each step's input evaluated once."""
    flag = f"_{out}_plain"
    d = df.withColumn(out, F.lower(F.coalesce(F.col(src), F.lit(""))))
    c, plain = F.col(out), F.col(flag)
    d = d.withColumn(out, F.when(_ascii(c), c).otherwise(fold_col(c)))

    def guarded(chars, replaced):
        hit = None
        for ch in chars:
            t = F.contains(c, F.lit(ch))
            hit = t if hit is None else (hit | t)
        return F.when(hit, replaced).otherwise(c)

    def step(pat, rep):
        replaced = F.regexp_replace(c, _JAVA_FORMS.get(pat, pat), _java_repl(rep))
        if pat in _JAVA_TESTS:
            replaced = F.when(F.rlike(c, F.lit(_JAVA_TESTS[pat])), replaced).otherwise(c)
        if pat == SYMBOLS:
            replaced = (F.when(plain, F.regexp_replace(c, PLAIN_SYMBOLS, rep))
                        .when(_ascii(c), F.regexp_replace(c, ASCII_SYMBOLS, rep)).otherwise(replaced))
        chars = _GUARDS.get(pat)
        return guarded(chars, replaced) if chars else replaced

    def unless_plain(replaced):
        return F.when(plain, c).otherwise(replaced)

    for pat, rep in REGEX_STEPS_HEAD[:3]:
        d = d.withColumn(out, step(pat, rep))
    # a filler taken out may leave two periods side by side: looked at behind them
    d = d.withColumn(flag, ~(F.rlike(c, F.lit(NOT_PLAIN)) | F.contains(c, F.lit(".."))))
    d = d.withColumn(out, unless_plain(step(*REGEX_STEPS_HEAD[3])))
    chained = c
    for pat, rep in APOSTROPHE_RULES:
        chained = F.regexp_replace(chained, pat, _java_repl(rep))
    d = d.withColumn(out, unless_plain(guarded(("'",), chained)))
    for pat, rep in REGEX_STEPS_TAIL[:-1]:
        d = d.withColumn(out, step(pat, rep) if pat == SYMBOLS else unless_plain(step(pat, rep)))
    return d.drop(flag)


def normalize_stages(df: DataFrame, src: str, out: str) -> DataFrame:
    """Same result as ``normalize_string``, in guarded stages."""
    return _cleaned_stages(df, src, out).withColumn(out, F.array_join(_blank_split(F.col(out)), " "))


def normalized_words(df: DataFrame, src: str, out: str) -> DataFrame:
    """The words of ``normalize_string``; the text with single blanks, whose
    parts they are, is not made."""
    return _cleaned_stages(df, src, out).withColumn(out, _blank_split(F.col(out)))


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _map_words(tokens: Column, pairs) -> Column:
    """Tokens by a small literal map; only its own words are looked up in it."""
    table = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.transform(tokens, lambda t: F.when(t.isin([w for w, _ in pairs]), F.try_element_at(table, t)).otherwise(t))


def with_mapped_tokens(df: DataFrame, src: str, out: str, spellings=SPELLINGS) -> DataFrame:
    """Step 10 on the token array ``src``.  Every stage has its own projection,
    so no lambda makes its input anew; arrays without any word of the tables
    pass after one test, and those without number words skip the number fold."""
    spellings = tuple(spellings or ())
    hit, words, number, known = (f"_{out}_{x}" for x in ("hit", "words", "number", "known"))
    every = [w for w, _ in WORD_RULES] + list(TRIGGERS) + [a for a, _ in spellings]
    d = df.withColumn(hit, F.arrays_overlap(F.col(src), _words(every)))
    # expansions hold blanks: joined and split again
    d = d.withColumn(words, F.when(F.col(hit), F.split(F.array_join(_map_words(F.col(src), WORD_RULES), " "), " ")))
    d = d.withColumn(number, F.arrays_overlap(F.col(words), _words(TRIGGERS)))
    d = d.withColumn(known, F.when(F.col(number), number_tokens(words)))
    d = d.withColumn(words, F.when(F.col(number), spark_fold(known)).otherwise(F.col(words)))
    mapped = _map_words(F.col(words), spellings) if spellings else F.col(words)
    return d.withColumn(out, F.when(F.col(hit), mapped).otherwise(F.col(src))).drop(hit, words, number, known)


def _blank_split(c: Column) -> Column:
    """The pieces of ``c`` (a cheap expression, not null) between blanks, empty
    ones removed: no regex pass over every blank, no per-token lambda."""
    odd = F.contains(c, F.lit("\t")) | F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\f")) | F.contains(c, F.lit("\r"))
    return F.array_remove(F.split(F.when(odd, F.regexp_replace(c, WS, " ")).otherwise(c), " "), "")


def split_words(c: Column) -> Column:
    """Whitespace tokens of any string, empty tokens removed (``str.split()``)."""
    return _blank_split(F.coalesce(c, F.lit("")))


# --- DuckDB form of the same chain (used by the oracle SQL) ------------------

def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duckdb_normalize_string(expr: str) -> str:
    e = f"lower(coalesce({expr}, ''))"
    e = f"translate({e}, {_sql_lit(FOLD_FROM)}, {_sql_lit(FOLD_TO)})"
    for a, b in FOLD_MULTI:
        e = f"replace({e}, {_sql_lit(a)}, {_sql_lit(b)})"
    for pat, rep in regex_steps():
        e = f"regexp_replace({e}, {_sql_lit(pat)}, {_sql_lit(rep)}, 'g')"
    return f"trim({e})"


def duckdb_expand_words(tokens: str) -> str:
    """Whole-word contractions and titles (may expand to several tokens)."""
    whens = " ".join(f"WHEN {_sql_lit(w)} THEN {_sql_lit(r)}" for w, r in WORD_RULES)
    return f"flatten(list_transform({tokens}, lambda t: string_split(CASE t {whens} ELSE t END, ' ')))"


def duckdb_map_tokens(tokens: str, spellings=SPELLINGS) -> str:
    """Numbers and spellings on already expanded tokens (``tokens`` must be
    a column reference: it is used inside the lambda)."""
    triggers = ", ".join(_sql_lit(w) for w in TRIGGERS)
    merged = f"CASE WHEN list_has_any({tokens}, [{triggers}]) THEN {duckdb_fold(tokens)} ELSE {tokens} END"
    if spellings:
        sp = " ".join(f"WHEN {_sql_lit(a)} THEN {_sql_lit(b)}" for a, b in spellings)
        merged = f"list_transform({merged}, lambda t: CASE t {sp} ELSE t END)"
    return merged


def duckdb_split_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), {_sql_lit(WS + '+')}), lambda w: w <> '')"
