"""Literal index: which three-character grams each run of lines holds.

A pattern that needs certain literals can match only in runs that hold all grams of these
literals. Whether a line matches is still decided by the pattern itself, so the index only
leaves out lines that can't.
"""

from __future__ import annotations

import re
import warnings
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.drill import RUN_LINES, grep_lines

#: Characters of a gram.
GRAM = 3
#: Alternatives of a pattern that are told apart; beyond, they are taken as not known.
MOST_ALTERNATIVES = 64
#: So many runs or fewer are named to the scan, which then skips the row groups of others.
NAMED_RUNS = 200

# Letters beyond ASCII that match an ASCII letter when case is ignored.
_FOLDED = ("İıſK", "iisk")

try:
    from re import _parser as _regex
except ImportError:  # before Python 3.11
    import sre_parse as _regex


def folded(text: Column) -> Column:
    """The text in which a literal of ASCII characters in lower case stands wherever it matches."""
    return F.lower(F.translate(text, *_FOLDED))


def run_of(line_no: Column) -> Column:
    return F.floor(line_no / RUN_LINES)


def line_grams(lines: DataFrame) -> DataFrame:
    """``(source, run, gram)``: the distinct ASCII grams of every run of ``RUN_LINES`` line numbers.

    One pass of a regex cuts all grams of a line, so a long line costs in proportion to its length.
    Grams of a task's lines are combined before they are shuffled by source, run and gram.
    """
    # Nothing is consumed, so a gram is found at every character.
    gram = F.regexp_extract_all(folded(F.col("line")), F.lit(rf"(?=([\x00-\x7f]{{{GRAM}}}))"), F.lit(1))
    runs = lines.select("source", run_of(F.col("line_no")).alias("run"), F.explode(F.array_distinct(gram)).alias("gram"))
    return runs.distinct()


def required_literals(pattern: str) -> list[list[str]] | None:
    """Literals in lower case that a line must hold to match ``pattern`` in any case.

    One list for each alternative, all of whose literals are needed. None if an alternative
    needs none that is long enough for a gram. A pattern that is no valid regex is itself the
    literal.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = _regex.parse(pattern, re.IGNORECASE)
    except re.error:
        found = [_ascii_parts(pattern.lower())]
    else:
        found = _needed(parsed)
    return found if all(found) else None


def _ascii_parts(text: str) -> list[str]:
    return [part for part in re.split(r"[^\x00-\x7f]+", text) if len(part) >= GRAM]


def _needed(parsed) -> list[list[str]]:
    """Alternatives of a parsed pattern, each with the literals it needs; what isn't known needs none."""
    alternatives: list[list[str]] = [[]]
    literal = ""

    def add(choices: list[list[str]]) -> None:
        nonlocal alternatives
        if len(alternatives) * len(choices) <= MOST_ALTERNATIVES:
            alternatives = [a + b for a, b in product(alternatives, choices)]

    for op, value in [*parsed, (None, None)]:
        kind = str(op)
        if kind == "IN" and len(value) == 1 and str(value[0][0]) == "LITERAL":
            kind, value = "LITERAL", value[0][1]
        if kind == "LITERAL" and value < 128:
            literal += chr(value).lower()
            continue
        if kind in ("AT", "ASSERT_NOT"):  # no character of the line lies in between
            continue
        if len(literal) >= GRAM:
            add([[literal]])
        literal = ""
        if kind == "SUBPATTERN":
            add(_needed(value[3]))
        elif kind == "ATOMIC_GROUP":
            add(_needed(value))
        elif kind == "ASSERT":
            add(_needed(value[1]))
        elif kind == "BRANCH":
            choices = [choice for branch in value[1] for choice in _needed(branch)]
            add(choices if len(choices) <= MOST_ALTERNATIVES else [[]])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            add(_needed(value[2]))
    return alternatives


def _grams(literals: list[str]) -> list[str]:
    return sorted({text[k : k + GRAM] for text in literals for k in range(len(text) - GRAM + 1)})


def runs_with(grams: DataFrame, pattern: str) -> DataFrame | None:
    """``(source, run)`` of the runs in ``line_grams`` that may hold a match; None if all may."""
    needed = required_literals(pattern) if pattern else None
    if needed is None:
        return None
    sets = [_grams(literals) for literals in needed]
    every = sorted({gram for grams_of in sets for gram in grams_of})
    held = [F.count_if(F.col("gram").isin(one)).alias(f"held_{k}") for k, one in enumerate(sets)]
    # A run that grew by appends has its grams once for each of them.
    wanted = grams.where(F.col("gram").isin(every)).select("source", "run", "gram").distinct()
    found = wanted.groupBy("source", "run").agg(*held)
    complete = [F.col(f"held_{k}") == len(one) for k, one in enumerate(sets)]
    return found.where(reduce(Column.__or__, complete)).select("source", "run")


def grep_indexed(lines: DataFrame, grams: DataFrame, pattern: str | None) -> DataFrame:
    """``grep_lines`` that passes over the runs which the grams of ``lines`` rule out.

    Up to ``NAMED_RUNS`` runs are named in a filter that reaches the scan, so that of files
    sorted by source and line number only the row groups of these runs are read; more are
    joined. A pattern that needs no literal reads all lines.
    """
    runs = runs_with(grams, pattern)
    if runs is None:
        return grep_lines(lines, pattern)
    few = runs.limit(NAMED_RUNS + 1).collect()
    if len(few) <= NAMED_RUNS:
        spans = [(F.col("source") == r.source) & _in_run(r.run) for r in few]
        return grep_lines(lines.where(reduce(Column.__or__, spans, F.lit(False))), pattern)
    named = runs.select(F.col("source").alias("of"), F.col("run").alias("at"))
    near = (F.col("source") == F.col("of")) & (run_of(F.col("line_no")) == F.col("at"))
    return grep_lines(lines.join(named, near, "left_semi"), pattern)


def _in_run(run: int) -> Column:
    return F.col("line_no").between(run * RUN_LINES, run * RUN_LINES + RUN_LINES - 1)
