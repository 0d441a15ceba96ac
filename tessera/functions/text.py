"""Features of a text, as columns over it. White space and patterns follow Unicode, as far as each feature says so."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Feature = Callable[[Column], Column]

#: What counts as white space, punctuation, and the phrases of two probes.
SPACE = r"[\s\x1c-\x1f]"
PUNCTUATION = ".,;:!?\"'()[]{}-—"
HEDGES = r"(?iuU)\b(i think|it'?s important to note|generally|typically|in general|keep in mind|as always)\b"
REFUSALS = r"(?iuU)\b(i cannot|i can'?t|as an ai|i'?m unable|i apolog)"
EMOJI = r"[\x{1F300}-\x{1FAFF}☀-➿]"
TOKEN = r"([a-z0-9']+|\n)"


def words(t: Column) -> Column:
    """Without a lambda, so that several features of a text share one split of it in generated code."""
    return F.array_remove(F.split(t, f"(?U){SPACE}+", -1), "")


def strip(t: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(t, f"(?U)^{SPACE}+", ""), f"(?U){SPACE}+$", "")


def tokens(t: Column) -> Column:
    """Runs of lower-case letters, digits and apostrophes, and newlines."""
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(1))


def count_of(t: Column, piece: str) -> Column:
    return (F.length(t) - F.length(F.replace(t, F.lit(piece), F.lit("")))).cast("bigint")


def unique_word_ratio(t: Column) -> Column:
    w = words(F.lower(t))
    return F.coalesce(F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0)), F.lit(0.0))


def average_word_length(t: Column) -> Column:
    w = words(t)
    return F.coalesce(F.length(F.array_join(w, "")) / F.nullif(F.size(w), F.lit(0)), F.lit(0.0))


#: Numbers that a trivial baseline ranks texts by, in order of precedence.
BASELINES: dict[str, Feature] = {
    "char_length": lambda t: F.length(t).cast("double"),
    "word_count": lambda t: F.size(words(t)).cast("double"),
    "newline_count": lambda t: count_of(t, "\n").cast("double"),
    "punctuation": lambda t: (F.length(t) - F.length(F.translate(t, PUNCTUATION, ""))).cast("double"),
    "unique_word_ratio": unique_word_ratio,
    "avg_word_length": average_word_length,
}

#: Yes-or-no features of the surface, in order.
PROBES: dict[str, Feature] = {
    "has_newline": lambda t: F.contains(t, F.lit("\n")),
    "multi_line": lambda t: F.contains(t, F.lit("\n")),
    "markdown_bold": lambda t: F.contains(t, F.lit("**")),
    "markdown_header": lambda t: t.rlike("(?md)^#{1,6} "),
    "bullet_list": lambda t: t.rlike(r"(?mdU)^\s*[-*+] "),
    "numbered_list": lambda t: t.rlike(r"(?mdU)^\s*\d+[.)] "),
    "code_fence": lambda t: F.contains(t, F.lit("```")),
    "emoji": lambda t: t.rlike(EMOJI),
    "question_mark": lambda t: F.contains(t, F.lit("?")),
    "exclamation": lambda t: F.contains(t, F.lit("!")),
    "hedging": lambda t: t.rlike(HEDGES),
    "refusal": lambda t: t.rlike(REFUSALS),
    "ends_with_period": lambda t: F.endswith(F.regexp_replace(t, f"(?U){SPACE}+$", ""), F.lit(".")),
    "has_comma": lambda t: F.contains(t, F.lit(",")),
    "repetitive": lambda t: unique_word_ratio(t) < 0.5,
}

# --- two-line texts and their end words --------------------------------------------------------------------------------


def text_lines(t: Column) -> Column:
    """Lines without white space at their ends; no empty ones."""
    return F.filter(F.transform(F.split(t, r"\R|[\x1c-\x1e]", -1), strip), lambda x: x != "")


_ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def last_word(line: Column) -> Column:
    """The last word in lower case without ASCII punctuation; null if there is none."""
    return F.try_element_at(words(F.lower(F.translate(line, _ASCII_MARKS, ""))), F.lit(-1))


def common_suffix(a: Column, b: Column) -> Column:
    """How many last characters two words share."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.right(a, k) == F.right(b, k))
    return F.when(n == 0, 0).otherwise(F.size(same)).cast("int")


def near_miss_bucket(n: Column) -> Column:
    return F.when(n >= 3, "3+").otherwise(n.cast("string"))


#: The last word as last_word() finds it: what precedes it with marks before it, and the marks and words of marks after it.
_LAST = rf"(?sU)^((?:|.*{SPACE})[{re.escape(_ASCII_MARKS)}]*)[^{re.escape(_ASCII_MARKS)}\s\x1c-\x1f]\S*?([^\p{{L}}\p{{N}}\p{{M}}]*)$"


def replace_end(line: Column, word: Column) -> Column:
    """line with its last word replaced, and the marks around it kept, such as a column's end that follows with a space before it;
    null if there is no word."""
    return F.when(line.rlike(_LAST), F.concat(F.regexp_extract(line, _LAST, 1), word, F.regexp_extract(line, _LAST, 2)))


def split_constraints(t: Column, separator: str = "|") -> Column:
    return F.filter(F.transform(F.split(t, "\\Q" + separator + "\\E", -1), strip), lambda x: x != "")


def fill_template(template: str, **fields: Column) -> Column:
    """The template with `{name}` replaced by each field, in one pass: braces in a field's own text stay as they are."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in fields if "{" + k + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[: at[0]]), fields[at[1]]]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


def strip_fences(t: Column) -> Column:
    """Without a code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(t), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
