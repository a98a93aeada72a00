"""Judge replies (LASER rubric) as column expressions.

The judge itself is an outside language-model call; its replies enter as a
table of raw JSON strings.  Everything around the call is built here:

* ``parse_reply``: alias keys -> canonical keys, list fields given as strings
  parsed as JSON (else a one-element list, "" -> []), required fields and
  types validated, score clamped to [0, 1].  When a reply carries both an
  alias and its canonical key, the canonical key wins (the original keeps
  whichever comes later in the document, which a JSON path cannot see).
* ``shortcut``: empty normalised reference -> perfect score, empty
  hypothesis -> score 0 with the whole reference counted missing; other
  rows need the judge.
* ``feedback``: the reflection text built from the error lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .strings import fmt_fixed

# --- fixed values ---------------------------------------------------------------
FIELD_ALIASES = {
    "no_penalty_errors": ("non_penalizable_errors", "nonpenalizable_errors", "non_penalty_errors"),
    "major_errors": ("major_penalizable_errors",),
    "minor_errors": ("minor_penalizable_errors",),
    "laser_score": ("score",),
    "word_count": (),
    "total_penalty": (),
}
LIST_FIELDS = ("no_penalty_errors", "major_errors", "minor_errors")
MISSING_FMT = "entire sentence missing ({n} words)"
FEEDBACK_MAJOR = ("CRITICAL — {n} major error(s) (word substitutions, omissions, or additions that change "
                  "meaning): {errors}. The prompt should add explicit guidance to prevent these types of errors.")
FEEDBACK_MINOR = "MINOR — {n} minor error(s) (spelling, grammar, or formatting that preserves meaning): {errors}."
FEEDBACK_NOPEN = "ACCEPTABLE — {n} no-penalty difference(s) (variant spellings, discourse markers): {errors}."
FEEDBACK_SCORE = "Score: {score} ({penalty}/{words} word penalties)"
FEEDBACK_PERFECT = "PERFECT — No errors detected. Transcription matches reference exactly."
#: The judge's rubric, word for word: other words would be another judge.
SYSTEM_PROMPT = (
    'You are an expert linguist evaluating an Automatic Speech Recognition (ASR) system. Your task is to compare a Reference (ground truth) with a Hypothesis (ASR prediction). Both inputs have already been text-normalized (lowercased, punctuation stripped, numbers expanded), so ignore any remaining capitalization or punctuation differences.\n'
    '\n'
    'Instructions:\n'
    '1. Align reference and hypothesis word-by-word to find mismatches.\n'
    '2. Classify every mismatch using the rubric below.\n'
    '3. Compute: Score = 1 - (Total Penalty / Number of Reference Words). Clamp to [0, 1].\n'
    '\n'
    'Rubric:\n'
    '\n'
    'A. No Penalty (0 points) — differences that do not change meaning:\n'
    '   - Numbers & formatting: "1300" vs "thirteen hundred"\n'
    '   - Abbreviations: "ATM" vs "A T M", "NBA" vs "N B A"\n'
    '   - Compound words: "healthcare" vs "health care", "info graphic" vs "infographic"\n'
    '   - Proper noun spelling variants (same person/place): "Graeme" vs "Graham", "Archy" vs "Archie", "Jonathan" vs "Johnathan". IMPORTANT: only apply this when both words refer to the same entity. Words that look similar but have different meanings are Major errors (e.g. "July" vs "slide", "cover" vs "COVID").\n'
    '   - Contractions & expansions: "going to" vs "gonna", "I am" vs "I\'m", "All\'s" vs "All is"\n'
    '   - Speech disfluencies & fillers removed by ASR: "uh", "um", "ah", false starts ("c-", "ou-"), and word repetitions ("just just just" → "just") are not errors\n'
    '   - Discourse markers added or removed at sentence boundaries: "well", "so", "and", "but", "you know", "like", "okay" when used as fillers rather than content words. "And" or "so" at the start of a sentence is almost always a discourse marker.\n'
    '   - Singular/plural of the same word: "cancer" vs "cancers", "kid" vs "kids", "panelists" vs "panelist", "death" vs "deaths", "item" vs "items", "adjustment" vs "adjustments". Always No Penalty — never classify singular/plural as Minor or Major.\n'
    '\n'
    'B. Minor Penalty (0.5 points) — small errors that do not alter core meaning:\n'
    '   - Single-character spelling errors: "receive" vs "recieve"\n'
    '   - Minor grammatical markers (tense/number): "He run fast" vs "He runs fast"\n'
    '   - Comparative/base form differences: "narrower" vs "narrow", "largest" vs "large"\n'
    '   - Preposition swaps that preserve meaning: "filter in" vs "filter on", "adamant about" vs "adamant on"\n'
    '   - Minor article omission/addition: "the full commitment" vs "full commitment", "a good point" vs "good point"\n'
    '   - Small proper noun misspellings (1-2 character difference): "Joe" vs "Joel"\n'
    '\n'
    'C. Major Penalty (1.0 points) — errors that significantly alter meaning:\n'
    '   - Incorrect word substitutions: "beautiful" vs "ugly", "dispatching" vs "packaging"\n'
    '   - Meaning-altering spelling errors: "affect" vs "effect", "cover" vs "COVID", "that" vs "than", "then" vs "than"\n'
    '   - Significant omissions or additions of content words. Count each omitted or added content word separately.\n'
    '   - Word reordering that changes intent\n'
    '   - Output in the wrong language: e.g. "Yeah" transcribed as "Ja" (German)'
)
USER_PROMPT = "Reference: {ref}\nHypothesis: {hyp}"
# ---------------------------------------------------------------------------------

LASER_STRUCT = ("word_count", "no_penalty_errors", "major_errors", "minor_errors", "total_penalty", "laser_score")


def reply_schema() -> str:
    keys = [k for canon, alts in FIELD_ALIASES.items() for k in (canon,) + alts]
    return "struct<" + ",".join(f"`{k}`:string" for k in keys) + ">"


def _field(parsed: Column, canon: str) -> Column:
    keys = (canon,) + FIELD_ALIASES[canon]
    return F.coalesce(*[parsed.getField(k) for k in keys])


def _as_list(v: Column, parsed: Column) -> Column:
    """The list that the text ``v`` stands for; ``parsed``: ``v`` read as JSON."""
    return (F.when(v.isNull(), F.lit(None).cast("array<string>"))
            .when(parsed.isNotNull(), parsed)
            .when(v == "", F.array().cast("array<string>"))
            .otherwise(F.array(v)))


def with_parsed_reply(df: DataFrame, raw: str = "raw", out: str = "reply") -> DataFrame:
    """Adds struct ``out``: word_count, three lists, total_penalty,
    laser_score (clamped), raw_score, valid, reason.

    The JSON text is parsed once (``from_json`` with every key read as text:
    numbers keep their literal, lists their JSON text) in its own projection; so
    is each list's text, to which the rules below refer several times."""
    tmp = f"_{out}_json"
    d = df.withColumn(tmp, F.from_json(F.col(raw), reply_schema()))
    p = F.col(tmp)
    texts = {k: f"_{out}_{k}" for k in LIST_FIELDS}
    d = d.withColumns({t: _field(p, k) for k, t in texts.items()})
    d = d.withColumns({f"{t}_json": F.from_json(F.col(t), "array<string>") for t in texts.values()})
    d = d.withColumns({f"{t}_list": _as_list(F.col(t), F.col(f"{t}_json")) for t in texts.values()})
    wc = _field(p, "word_count").try_cast("int")
    lists = {k: F.col(f"{t}_list") for k, t in texts.items()}
    pen = _field(p, "total_penalty").try_cast("double")
    score = _field(p, "laser_score").try_cast("double")
    fields_ok = wc.isNotNull() & pen.isNotNull() & score.isNotNull()
    for k in LIST_FIELDS:
        fields_ok = fields_ok & lists[k].isNotNull()
    reason = (F.when(F.col(raw).isNull(), F.lit("empty content"))
              .when(~fields_ok, F.lit("missing or invalid field")))
    return d.withColumn(out, F.struct(
        wc.alias("word_count"),
        *[lists[k].alias(k) for k in LIST_FIELDS],
        pen.alias("total_penalty"),
        clamp01(score).alias("laser_score"),
        score.alias("raw_score"),
        reason.isNull().alias("valid"),
        reason.alias("reason"),
    )).drop(tmp, *[f"{t}{x}" for t in texts.values() for x in ("", "_json", "_list")])


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def shortcut(norm_ref: Column, norm_hyp: Column) -> Column:
    """The LASER result decided without the judge (null when needed)."""
    wc = F.size(F.filter(F.split(norm_ref, " "), lambda w: w != ""))
    empty = F.array().cast("array<string>")
    perfect = F.struct(F.lit(0).alias("word_count"), empty.alias("no_penalty_errors"),
                       empty.alias("major_errors"), empty.alias("minor_errors"),
                       F.lit(0.0).alias("total_penalty"), F.lit(1.0).alias("laser_score"))
    missing = F.struct(wc.alias("word_count"), empty.alias("no_penalty_errors"),
                       F.array(F.format_string(MISSING_FMT.replace("{n}", "%d"), wc)).alias("major_errors"),
                       empty.alias("minor_errors"), wc.cast("double").alias("total_penalty"),
                       F.lit(0.0).alias("laser_score"))
    return F.when(norm_ref == "", perfect).when(norm_hyp == "", missing)


def error_pct(score: Column) -> Column:
    return (F.lit(1.0) - score) * 100


def user_prompt(norm_ref: Column, norm_hyp: Column) -> Column:
    a, rest = USER_PROMPT.split("{ref}")
    b, c = rest.split("{hyp}")
    return F.concat(F.lit(a), norm_ref, F.lit(b), norm_hyp, F.lit(c))


def messages(system: Column, user: Column) -> Column:
    """The chat request: a system and a user message, as JSON."""
    return F.to_json(F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", system), ("user", user))]))


def error_list(errors: Column) -> Column:
    """A list of strings as the report prints it: ``['a', 'b']``; quotation
    marks are doubles where the text holds single ones only."""
    def quoted(e):
        slashes = F.replace(e, F.lit("\\"), F.lit("\\\\"))
        return F.when(F.contains(e, F.lit("'")) & ~F.contains(e, F.lit('"')), F.concat(F.lit('"'), slashes, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(slashes, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(errors, quoted), ", "), F.lit("]"))


def _fmt(template: str, n: Column, errors: Column) -> Column:
    head, tail = template.split("{n}")
    mid, end = tail.split("{errors}")
    return F.concat(F.lit(head), F.size(errors).cast("string"), F.lit(mid), F.array_join(errors, "; "), F.lit(end))


def feedback(word_count: Column, no_penalty: Column, major: Column, minor: Column,
             total_penalty: Column, score: Column) -> Column:
    s_head, s_rest = FEEDBACK_SCORE.split("{score}")
    s_mid, s_rest = s_rest.split("{penalty}")
    s_mid2, s_end = s_rest.split("{words}")
    score_line = F.concat(F.lit(s_head), fmt_fixed(score, 3), F.lit(s_mid), total_penalty.cast("string"),
                          F.lit(s_mid2), word_count.cast("string"), F.lit(s_end))
    return F.concat_ws(
        "\n",
        F.when(F.size(major) > 0, _fmt(FEEDBACK_MAJOR, None, major)),
        F.when(F.size(minor) > 0, _fmt(FEEDBACK_MINOR, None, minor)),
        F.when(F.size(no_penalty) > 0, _fmt(FEEDBACK_NOPEN, None, no_penalty)),
        score_line,
        F.when((F.size(major) == 0) & (F.size(minor) == 0), F.lit(FEEDBACK_PERFECT)),
    )


def is_perfect(major: Column, minor: Column) -> Column:
    return (F.size(major) == 0) & (F.size(minor) == 0)
