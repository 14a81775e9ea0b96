"""Text expressions: strip, casefold, low information, embedding input, JSON slicing."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOW_INFO_MAX_CHARS = 15
LOW_INFO_CLOSED_FORM = ("yes", "no", "n/a", "na", "none", "maybe", "unsure", "idk")
ANSWER_ONLY = "answer-only"
QUESTION_ANSWER = "question-answer"

# Every code point Python's str.strip() removes; Spark's trim() alone removes only U+0020.
WHITESPACE = "".join(chr(point) for point in range(0x3001) if chr(point).isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def required(text: Column) -> Column:
    """The stripped text, or NULL where nothing is left."""
    stripped = strip(text)
    return F.when(stripped != "", stripped)


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str]:
    """Lower-case characters whose case fold differs from themselves: those that fold to one
    character, what they fold to, and space-separated entries of those that fold to several."""
    single_from, single_to, expanding = [], [], []
    for point in range(0x80, 0x1FFFF):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        folded = char.casefold()
        if char.lower() != char or folded == char:
            continue
        if len(folded) == 1:
            single_from.append(char)
            single_to.append(folded)
        else:
            expanding.append(char + folded)
    return "".join(single_from), "".join(single_to), " ".join(expanding)


def casefold(text: Column) -> Column:
    """Unicode case folding.  ``lower`` does most of it; the rest is a translation, and the
    few characters that fold to several are replaced only in rows that hold one."""
    single_from, single_to, expanding = _fold_tables()
    folded = F.translate(F.lower(text), single_from, single_to)
    entries = F.split(F.lit(expanding), " ")
    expanded = F.aggregate(
        entries, folded,
        lambda acc, entry: F.replace(acc, F.substring(entry, 1, 1), F.substring(entry, 2, 9)),
    )
    has_expanding = folded.rlike("[" + "".join(entry[0] for entry in expanding.split(" ")) + "]")
    only_ascii = ~text.rlike("[^\\x00-\\x7F]")
    return F.when(only_ascii, F.lower(text)).when(has_expanding, expanded).otherwise(folded)


def low_information(
    text: Column,
    max_chars: int = LOW_INFO_MAX_CHARS,
    closed_form: tuple[str, ...] = LOW_INFO_CLOSED_FORM,
) -> Column:
    """Too short, or one of the closed-form answers.  The length test comes first: it settles
    nearly every row without folding a long text."""
    stripped = strip(text)
    short = F.char_length(stripped) < max_chars
    values = sorted(closed_form)
    if not values:
        return short
    longest = max(len(value) for value in values)
    if longest < max_chars:
        return short
    return short | ((F.char_length(stripped) <= longest) & casefold(stripped).isin(values))


def embedding_input(answer: Column, question: Column) -> Column:
    return F.when(question.isNull(), answer).otherwise(
        F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)
    )


def representation(question: Column) -> Column:
    return F.when(question.isNull(), ANSWER_ONLY).otherwise(QUESTION_ANSWER)


def json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL where there is no such slice."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def merged_name(name: Column, theme_id: Column) -> Column:
    return F.concat(F.substring(name, 1, 80), F.lit(" [merged #"), theme_id.cast("string"), F.lit("]"))
