"""How catalogue patterns and user patterns are handed to Spark's regex functions.

The catalogue is written for an engine whose classes cover Unicode: ``\\s``
includes U+001F and the no-break space, ``\\w`` every letter and number, and
``\\b`` the edge of such a word. Java's classes are ASCII unless told otherwise
and differ for combining marks. Pure-ASCII lines, nearly all of a log, take a
short form that is exact for them; other lines take a spelled-out form that
does not depend on the Java release.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# All characters that count as white space, U+001C..U+001F included.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

Dialect = Callable[..., str]


def ascii_form(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for a line that holds ASCII characters only."""
    return ("(?id)" if ignore_case else "(?d)") + pattern.replace(r"\s", r"[\s\x1f]")


def unicode_form(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for any line."""
    spelled = pattern.replace(r"\s", r"[\s\x1f]").replace(r"\w", _WORD).replace(r"\b", _EDGE)
    return ("(?iUd)" if ignore_case else "(?Ud)") + spelled


def computed_once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` computed once, outside of generated code.

    Functions with a lambda are evaluated by a call, so what is in ``build`` adds
    no bytecode to the method Spark generates for the stage. The JVM does not
    compile methods above 8,000 bytes of bytecode; the regexes of a whole
    classification would exceed that several times over.
    """
    return F.get(F.transform(F.array(value), build), 0)


def per_script(text: Column, build: Callable[[Column, Dialect], Column]) -> Column:
    """``build`` with the short form on ASCII lines and, by a call, the full form elsewhere."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    full = computed_once(text, lambda t: build(t, unicode_form))
    return F.when(is_ascii, build(text, ascii_form)).otherwise(full)


def any_at_start(patterns: list[str]) -> str:
    """One pattern for a list of patterns that all begin with ``^``."""
    return "^(?:" + "|".join(p[1:] for p in patterns) + ")"


def java_form(pattern: str) -> str:
    """A valid pattern in Java's spelling.

    Inside a class Java takes ``[`` and ``&&`` for set operations, so both are escaped;
    ``\v`` and octal escapes name other characters there; group names may hold letters and
    digits only and are numbered instead.
    """
    names: dict[str, str] = {}
    out, at, in_class, first = [], 0, False, False
    while at < len(pattern):
        rest = pattern[at:]
        if octal := re.match(r"\\0[0-7]{0,2}", rest):
            out.append(f"\\x{int(octal[0][1:], 8):02x}")
            at, first = at + octal.end(), False
        elif rest.startswith("\\"):
            pair = rest[:2]
            out.append({r"\v": r"\x0b", r"\Z": r"\z"}.get(pair, pair))
            at, first = at + 2, False
        elif in_class:
            char = rest[0]
            closes = char == "]" and not first
            out.append("\\" + char if char in "[&" or (char == "]" and first) else char)
            in_class, at, first = not closes, at + 1, False
        elif rest.startswith("["):
            opening = "[^" if rest.startswith("[^") else "["
            out.append(opening)
            in_class, at, first = True, at + len(opening), True
        elif upto := re.match(r"\{,(?=\d+\})", rest):
            out.append("{0,")
            at += upto.end()
        elif group := re.match(r"\(\?P<(\w+)>", rest):
            out.append(f"(?<{names.setdefault(group[1], f'g{len(names)}')}>")
            at += group.end()
        elif group := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(f"\\k<{names.get(group[1], group[1])}>")
            at += group.end()
        else:
            out.append(rest[0])
            at += 1
    return "".join(out)


def user_match(spark: SparkSession, text: Column, pattern: str) -> Column:
    """Whether a user's pattern is found in ``text``, ignoring case.

    A pattern that is no valid regex is searched for as plain text. What Java lacks, such as
    conditionals, runs in Arrow batches.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compiled = re.compile(pattern, re.IGNORECASE)
    except re.error:
        return F.contains(F.lower(text), F.lit(pattern.lower()))

    java = "(?iUd)" + java_form(pattern)
    if _java_accepts(spark, java):
        return text.rlike(java)

    @F.pandas_udf("boolean")
    def found(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: compiled.search(line) is not None, na_action="ignore")

    return found(text)


def _java_accepts(spark: SparkSession, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except PySparkException:
        return False
