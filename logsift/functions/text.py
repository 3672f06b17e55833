"""Column functions over a single log line. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.functions import catalogue as cat
from logsift.functions.dialect import (
    WHITESPACE,
    Dialect,
    any_at_start,
    ascii_form,
    computed_once,
    per_script,
    unicode_form,
)


def strip_ansi(line: Column) -> Column:
    """Remove terminal colour codes; lines without an escape skip the regex."""
    return F.when(
        F.contains(line, F.lit("\x1b")), F.regexp_replace(line, cat.ANSI, "")
    ).otherwise(line)


def clean(line: Column) -> Column:
    """Remove colour codes, then white space at the end."""
    return F.rtrim(strip_ansi(line), F.lit(WHITESPACE))


def _in_capitals(text: Column, form: Dialect) -> Column:
    """The text in which a stem stands in capitals wherever a pattern finds it in any case."""
    upper = F.upper(text)
    return upper if form is ascii_form else F.replace(upper, *map(F.lit, cat.FOLDED))


def _holds(capitals: Column, stems: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(capitals, F.lit(s)) for s in stems])


def _from_stems(pattern: str, stems: list[str]) -> str:
    """A pattern whose matches all begin with one of the stems; it looks for these first."""
    return f"(?={'|'.join(stems)}){pattern}"


def detect_severity(text: Column) -> Column:
    """The first level, in catalogue order, that has a word anywhere in the line.

    A plain search for the level's stems goes ahead of the regex, which then runs for one
    level of a line instead of up to five. The search reads capitals that are made once.
    """

    def levels(t, form):
        def chosen(capitals):
            chain = F
            for level, pattern in cat.SEVERITY:
                stems = cat.SEVERITY_STEMS[level]
                hit = _holds(capitals, stems) & t.rlike(form(_from_stems(pattern, stems), True))
                chain = chain.when(hit, F.lit(level))
            return chain.otherwise(F.lit("unknown"))

        return computed_once(_in_capitals(t, form), chosen)

    return per_script(text, levels)


def severity_rank(severity: Column) -> Column:
    """fatal 5 down to unknown 0; 0 for anything else."""
    chain = F.when(severity == "fatal", cat.RANK["fatal"])
    for level in cat.LEVELS[1:-1]:
        chain = chain.when(severity == level, cat.RANK[level])
    return chain.otherwise(cat.RANK["unknown"])


def severity_of_rank(rank: Column) -> Column:
    """The level that has this rank."""
    return F.element_at(F.array(*map(F.lit, reversed(cat.LEVELS))), rank + 1)


def _replace_timestamps(text: Column, form: Dialect, by: str) -> Column:
    """Replace all timestamps; the later patterns run only where a clock time is left.

    No pattern runs over a text without a colon, which each of them needs.
    """
    iso, *others = map(form, cat.TIMESTAMP)

    def rest(t):
        more = reduce(lambda u, p: F.regexp_replace(u, p, by), others, t)
        return F.when(t.rlike(form(cat.CLOCK)), more).otherwise(t)

    replaced = computed_once(F.regexp_replace(text, iso, by), rest)
    return F.when(F.contains(text, F.lit(":")), replaced).otherwise(text)


def extract_timestamp(text: Column) -> Column:
    """The text of the first timestamp pattern that matches, else null."""

    def found(t, form):
        iso, *others = [F.regexp_substr(t, F.lit(form(p))) for p in cat.TIMESTAMP]
        first = F.coalesce(iso, F.when(t.rlike(form(cat.CLOCK)), F.coalesce(*others)))
        return F.when(F.contains(t, F.lit(":")), first)

    return per_script(text, found)


def is_noise(text: Column) -> Column:
    """Blank lines, rulers and lone dots."""
    return text.rlike(unicode_form(any_at_start(cat.NOISE)))


def is_stack_line(text: Column) -> Column:
    """Frames and headers of stack traces."""
    return text.rlike(unicode_form(any_at_start(cat.STACK)))


def is_exception_line(text: Column) -> Column:
    """A capitalised, perhaps dotted name that ends the line or a clause."""
    return text.rlike(unicode_form(cat.EXCEPTION))


def template_key(text: Column) -> Column:
    """The line with its variable parts replaced by placeholders."""

    def replaced(t, form):
        # What a text has to hold for the pattern beside it to match.
        steps = [
            (lambda u: F.contains(u, F.lit("-")), form(cat.UUID, True), cat.MARK_UUID),
            (lambda u: F.contains(u, F.lit("0x")) | F.contains(u, F.lit("0X")), form(cat.ADDRESS, True), cat.MARK_ADDRESS),
            (lambda u: u.rlike(form(cat.DIGITS)), form(f"(?={cat.DIGITS}){cat.NUMBER}"), cat.MARK_NUMBER),
        ]
        bare = _replace_timestamps(t, form, cat.MARK_TIMESTAMP)
        return reduce(lambda u, step: computed_once(u, lambda v: _replaced_where(v, *step)), steps, bare)

    return per_script(text, replaced)


def _replaced_where(text: Column, needed: Callable[[Column], Column], pattern: str, by: str) -> Column:
    return F.when(needed(text), F.regexp_replace(text, pattern, by)).otherwise(text)


def display_text(text: Column) -> Column:
    """The line without timestamps, empty brackets and its first severity word."""
    stems = [stem for of_level in cat.SEVERITY_STEMS.values() for stem in of_level]

    def shortened(t, form):
        first_word = form(r"^([\x00-\x{10ffff}]*?)" + cat.SEVERITY_WORD, True)
        bracket = (lambda u: F.contains(u, F.lit("[")), form(cat.EMPTY_BRACKETS), "")
        any_word = form(_from_stems("(?:" + "|".join(p for _, p in cat.SEVERITY) + ")", stems), True)
        has_stem = lambda u: computed_once(_in_capitals(u, form), lambda c: _holds(c, stems))
        worded = (lambda u: has_stem(u) & u.rlike(any_word), first_word, "$1")
        bare = _replace_timestamps(t, form, "")
        shown = reduce(lambda u, step: computed_once(u, lambda v: _replaced_where(v, *step)), (bracket, worded), bare)
        return F.trim(shown, F.lit(WHITESPACE))

    return per_script(text, shortened)
