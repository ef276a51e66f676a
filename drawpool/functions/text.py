"""Text helpers: prompt templates, answer extraction, whitespace tokens and
token budgets.  All are Column expressions, so they run inside whole-stage
codegen and never leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's templates) -------------------
# Default answer for a question without answers.
UNANSWERABLE = "unanswerable"
# Q&A instruction template: "Context: " + context + "\n\nQuestion: " + question
# + "\n\nExtract the answer from the context. Extracted answer: "
QA_PREFIX = "Context: "
QA_MIDDLE = "\n\nQuestion: "
QA_SUFFIX = "\n\nExtract the answer from the context. Extracted answer: "
# Quote-in-context template: preceding + '  || The quote: "' + quote
# + '" End of the quote ||  ' + following, nulls as empty strings.
QUOTE_OPEN = '  || The quote: "'
QUOTE_CLOSE = '" End of the quote ||  '
# ---------------------------------------------------------------------------

# Token classes.  Written as explicit classes so that Java regex and RE2
# (the DuckDB oracle) split identically.
WS_SPLIT = "[ \n\t\r]+"
WORD_SPLIT = "[ \n\t\r.,;!?]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_answer(answers_text) -> Column:
    """First answer, or 'unanswerable' when the answer list is empty.

    A non-empty list whose first element is null stays null; ``get`` does not
    raise on an empty array under ANSI mode (``[0]`` would)."""
    a = _c(answers_text)
    return F.when(F.size(a) > 0, F.get(a, 0)).otherwise(F.lit(UNANSWERABLE))


def qa_prompt(context, question) -> Column:
    """Instruction prompt; null in, null out (as string + in pandas)."""
    return F.concat(F.lit(QA_PREFIX), _c(context), F.lit(QA_MIDDLE), _c(question),
                    F.lit(QA_SUFFIX))


def quote_prompt(preceding, quote, following) -> Column:
    """Quote-in-context template with nulls rendered as ''."""
    e = F.lit("")
    return F.concat(F.coalesce(_c(preceding), e), F.lit(QUOTE_OPEN),
                    F.coalesce(_c(quote), e), F.lit(QUOTE_CLOSE),
                    F.coalesce(_c(following), e))


def ws_tokens(text) -> Column:
    """Whitespace tokens, case and punctuation kept, empties dropped."""
    return F.array_remove(F.split(_c(text), WS_SPLIT), "")


def word_tokens(text) -> Column:
    """Lower-cased word tokens split on whitespace and . , ; ! ?"""
    return F.array_remove(F.split(F.lower(_c(text)), WORD_SPLIT), "")


def first_word(text) -> Column:
    """First lower-cased word token without splitting the whole text: the
    first maximal run of non-delimiter characters (null when there is none)."""
    w = F.regexp_extract(_c(text), "[^ \n\t\r.,;!?]+", 0)
    return F.lower(F.nullif(w, F.lit("")))


def once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it: a name
    for an intermediate value inside one expression."""
    return F.get(F.transform(F.array(x), f), 0)


def most_frequent(tokens) -> Column:
    """Most frequent element of a string array, ties to the smallest; null
    for an empty array.  Row-local: sort the row's tokens, find where each run
    of equal ones ends, and take the first of the longest runs."""
    def of_sorted(t):
        n = F.size(t)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.get(t, i - 1).eqNullSafe(F.get(t, i)))
        return once(ends, lambda e: once(F.transform(e, lambda x, i: x - F.coalesce(F.get(e, i - 1), F.lit(0))), lambda run: F.get(
            t, F.get(e, (F.array_position(run, F.array_max(run)) - 1).cast("int")) - 1)))
    return once(F.sort_array(_c(tokens)), lambda t: F.when(F.size(t) > 0, of_sorted(t)))


def first_tokens(text, n: int, pattern: str = WS_SPLIT, lower: bool = False) -> Column:
    """Exactly ``slice(tokens(text), 1, n)`` without splitting the rest of
    the text: strip leading delimiters, split at most n times (piece n+1 is
    the unsplit remainder and is dropped).  Delimiter runs are matched whole,
    so no empty token occurs between tokens; a trailing empty piece is
    filtered.  Lower-casing per token equals lower-casing the text, as every
    delimiter is ASCII."""
    t = F.regexp_replace(_c(text), "^" + pattern, "")
    parts = F.filter(F.slice(F.split(t, pattern, n + 1), 1, n), lambda x: x != F.lit(""))
    return F.transform(parts, lambda x: F.lower(x)) if lower else parts


def truncate_tokens(tokens, budget: int) -> Column:
    """First ``budget`` tokens (the whole array when shorter)."""
    return F.slice(_c(tokens), 1, budget)


def generation_budgets(model_max: int, output_max: int) -> tuple[int, int]:
    """(input budget, label budget) of the generation formulation: the label
    tokens count against the model limit, so input = max - output."""
    if output_max >= model_max:
        raise ValueError("output budget must be below the model limit")
    return model_max - output_max, output_max


def kept_tokens(n_tokens, budget: int) -> Column:
    """Tokens kept after truncation to ``budget`` (special tokens ignored)."""
    return F.least(_c(n_tokens), F.lit(budget)).cast("long")


def pair_budget(n_text, n_hypo, budget: int) -> tuple[Column, Column]:
    """Kept lengths of a (text, hypothesis) pair under longest-first
    truncation to ``budget`` tokens.

    Longest-first removes one token at a time from the longer side (from the
    second side on equal length).  Its end state in closed form:
      a + b <= B          -> (a, b)
      2 * min(a, b) <= B  -> shorter side whole, the other gets B - min
      otherwise           -> text ceil(B/2), hypothesis floor(B/2)
    """
    a, b = _c(n_text), _c(n_hypo)
    B = F.lit(budget)
    m = F.least(a, b)
    fits = (a + b) <= B
    short_whole = (2 * m) <= B
    keep_a = (F.when(fits, a)
              .when(short_whole, F.when(a <= b, a).otherwise(B - b))
              .otherwise(F.lit((budget + 1) // 2)))
    keep_b = (F.when(fits, b)
              .when(short_whole, F.when(a <= b, B - a).otherwise(b))
              .otherwise(F.lit(budget // 2)))
    return keep_a.cast("long"), keep_b.cast("long")
