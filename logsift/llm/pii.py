"""Personal data by weak supervision: fixed finders, noisy labelers, a trained span classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# Possessive runs and the look-behind keep long digit runs from being searched again and again.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGNS = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address reaches left from its @ as far as the local part can, not into the last one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", done if domain else at + 1)


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _is_ip(found: str) -> bool:
    return all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in found.split("."))


def _is_card(found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    return 12 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(found: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", found)) <= 15


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of every e-mail address, IP, card and phone number."""
    if not _SIGNS.search(text):
        return []
    found = [(a, "email", b) for a, b in _emails(text)]
    for kind, pattern, accept in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if accept(m[0])]
    return found


# Candidates for further spans are words with a digit or @.
_WORD = re.compile(r"[^\s=\"'<>]+")
_EDGES = ".,;:!?()[]{}*#$%&|`"
_HEX = re.compile(r"(?=[0-9]*[a-fA-F])[0-9a-fA-F]{16,}")
_KEY_ID = re.compile(r"A[KS]IA[A-Z0-9]{12,}")
_LONG_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_/+-]{16,}")
_NUMBER = re.compile(r"[0-9]{1,4}(?:[.,:/-][0-9]{1,4}){0,2}")
_DIGITS = re.compile(r"[0-9]{5,}")
_VERSION = re.compile(r"v?[0-9]{1,3}(?:\.[0-9]{1,3}){0,2}")

#: Words that name private values, unless a caller has others.
PRIVATE_WORDS = frozenset(
    "password passwd pwd token secret key apikey api_key access_key auth bearer login user "
    "iban account passport ssn card phone tel mobile email mail ip".split()
)
#: A word before candidates is harmless if it stands before so many and all but a few of
#: them are short numbers or versions; at most so many words, the most frequent ones.
HARMLESS_FROM, HARMLESS_SHARE, HARMLESS_WORDS = 20, 0.95, 5_000
_WORD_LETTERS = 32


@dataclass(frozen=True)
class Gazetteers:
    """Lower-case words that stand before private values, and before harmless numbers."""

    private: frozenset[str] = PRIVATE_WORDS
    harmless: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier, the words that its features know, and per labeler, class
    and vote, how likely the vote was estimated to be."""

    weights: np.ndarray
    words: Gazetteers = Gazetteers()
    reliability: np.ndarray | None = None

    @classmethod
    def blank(cls) -> Model:
        return cls(np.zeros(1 + sum(FEATURE_SIZES)))

LABELERS = ("finder", "hex", "key_id", "mixed", "card_digits", "named", "harmless_before", "number", "version", "unchecked")
VOTES, YES, NO = 3, 1, 2  # a vote is 0 (none), YES or NO


def _votes(word: str, before: tuple[str, str], found: bool, words: Gazetteers) -> tuple[int, ...]:
    named = before[0] in words.private or before[1] in words.private
    digits = _DIGITS.fullmatch(word)
    card = bool(digits) and _is_card(word)
    return (
        YES if found else 0,
        YES if _HEX.fullmatch(word) else 0,
        YES if _KEY_ID.fullmatch(word) else 0,
        YES if _LONG_MIXED.fullmatch(word) else 0,
        YES if card else 0,
        YES if named else 0,
        NO if before[0] in words.harmless else 0,
        NO if _NUMBER.fullmatch(word) and not found else 0,
        NO if _VERSION.fullmatch(word) and not found else 0,
        NO if digits and not card and not found else 0,
    )


def _features(word: str, before: tuple[str, str], words: Gazetteers) -> tuple[int, ...]:
    """Buckets of length, digit share, letter cases and signs; what stands before."""
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    return (
        min(len(word).bit_length(), 6),
        4 * digits // len(word),
        (letters > 0) + 2 * (word.upper() == word and letters > 0),
        ("@" in word) + 2 * ("." in word),
        int(before[0] in words.private or before[1] in words.private) + 2 * int(before[0] in words.harmless),
        int(bool(_DIGITS.fullmatch(word))) + int(_is_card(word)),
    )


FEATURE_SIZES = (7, 5, 4, 4, 4, 3)


def _words_with_signs(text: str, base: list[tuple[int, str, int]]) -> Iterator[tuple[int, int, str, bool, tuple[str, str]]]:
    """``(start, end, word, in a base span, the two words before)`` of every word with a digit or @."""
    if not _SIGNS.search(text):
        return
    spans = sorted((a, b) for a, _, b in base)
    before, k, reach = ("", ""), 0, -1
    for m in _WORD.finditer(text):
        raw = m[0]
        word = raw.strip(_EDGES)
        if word and _SIGNS.search(word):
            start = m.start() + raw.index(word)
            end = start + len(word)
            while k < len(spans) and spans[k][0] < end:
                reach = max(reach, spans[k][1])
                k += 1
            yield start, end, word, reach > start, before
        before = (word.lower(), before[0])


def candidates(
    text: str, base: list[tuple[int, str, int]], words: Gazetteers
) -> Iterator[tuple[int, int, bool, tuple, tuple]]:
    """``(start, end, in a base span, votes, features)`` of every word with a digit or @."""
    for start, end, word, found, before in _words_with_signs(text, base):
        yield start, end, found, _votes(word, before, found, words), _features(word, before, words)


def _before_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many candidates stand behind each word, and how many of them are short numbers."""
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for text in batch.column(0):
            value = text.as_py()
            for _, _, word, found, before in _words_with_signs(value, base_spans(value)):
                if 0 < len(before[0]) <= _WORD_LETTERS and not _SIGNS.search(before[0]):
                    counts = seen.setdefault(before[0], [0, 0])
                    counts[0] += 1
                    counts[1] += not found and bool(_NUMBER.fullmatch(word) or _VERSION.fullmatch(word))
        arrays = [pa.array(list(seen), pa.string()), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(arrays, ["word", "n", "n_short"])


def learned_words(docs: DataFrame, private: frozenset[str] = PRIVATE_WORDS) -> Gazetteers:
    """The private words, and the harmless ones that all rows of ``docs(text)`` show."""
    counts = docs.where("text is not null").select("text").mapInArrow(_before_numbers, "word string, n long, n_short long")
    sums = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_short").alias("n_short"))
    sure = sums.where((F.col("n") >= HARMLESS_FROM) & (F.col("n_short") >= HARMLESS_SHARE * F.col("n")))
    rows = sure.orderBy(F.desc("n"), "word").limit(HARMLESS_WORDS).collect()
    return Gazetteers(private, frozenset(r.word for r in rows) - private)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: how likely each pattern is private.

    Starts from the majority. Returns these probabilities and, per labeler, class and vote,
    how likely the vote is.
    """
    margin = (votes == YES).sum(axis=1) - (votes == NO).sum(axis=1)
    private = 1 / (1 + np.exp(-2.0 * margin))
    reliability = np.zeros((votes.shape[1], 2, VOTES))
    for _ in range(rounds):
        weight = np.stack([(1 - private) * counts, private * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        for labeler in range(votes.shape[1]):
            for vote in range(VOTES):
                cast = votes[:, labeler] == vote
                reliability[labeler, :, vote] = (weight[:, cast].sum(axis=1) + 0.5) / (weight.sum(axis=1) + 0.5 * VOTES)
        log = np.log(prior)[:, None] + sum(
            np.log(reliability[k][:, votes[:, k]]) for k in range(votes.shape[1])
        )
        private = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return private, reliability


def _design(features: np.ndarray) -> np.ndarray:
    columns = [np.eye(size)[np.minimum(features[:, k], size - 1)] for k, size in enumerate(FEATURE_SIZES)]
    return np.column_stack([np.ones(len(features)), *columns])


def train(features: np.ndarray, private: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic regression on the estimated probabilities, by Newton steps with a ridge."""
    x = _design(features)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (private - p)) - 0.1 * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(np.full(len(w), 0.1))
        w = w + np.clip(np.linalg.solve(curve, slope), -5, 5)
    return w


def _pattern_counts(words: Gazetteers):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                value = text.as_py()
                for _, _, _, votes, features in candidates(value, base_spans(value), words):
                    seen["".join(map(str, votes)), "".join(map(str, features))] += 1
            votes, features = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, pa.string()), pa.array(features, pa.string()), pa.array(list(seen.values()), pa.int64())],
                ["votes", "features", "n"],
            )

    return counted


def fit(docs: DataFrame, words: Gazetteers | None = None) -> Model:
    """The span classifier, from the candidates of all rows of ``docs(text)``.

    Without ``words`` the harmless ones are learned first. Candidates are counted by votes and
    feature buckets before anything is shuffled; each labeler has a vote that it may cast, so
    there are at most 2 ** labelers times the product of ``FEATURE_SIZES`` such patterns, of
    which few occur. Estimation and training run on the counts. Without candidates all
    weights are zero and nothing is added.
    """
    words = learned_words(docs) if words is None else words
    texts = docs.where("text is not null").select("text")
    seen = texts.mapInArrow(_pattern_counts(words), "votes string, features string, n long")
    rows = seen.groupBy("votes", "features").agg(F.sum("n").alias("n")).orderBy("votes", "features").collect()
    if not rows:
        return Model.blank()
    counts = np.array([row.n for row in rows], float)
    private, reliability = estimate(np.array([[int(v) for v in row.votes] for row in rows]), counts)
    weights = train(np.array([[int(f) for f in row.features] for row in rows]), private, counts)
    return Model(weights, words, reliability)


def all_spans(text: str | None, model: Model) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, base)`` by start, then kind as listed.

    Base spans all stay. Words that lie in none and that the classifier takes for private
    are added as ``secret``.
    """
    if not text:
        return []
    base = base_spans(text)
    found = [(kind, start, end, True) for start, kind, end in base]
    rest = [(a, b, f) for a, b, inside, _, f in candidates(text, base, model.words) if not inside]
    if rest:
        private = _design(np.array([f for _, _, f in rest])) @ model.weights > 0
        found += [("secret", a, b, False) for (a, b, _), yes in zip(rest, private) if yes]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
)


def spans(text: Column, model: Model) -> Column:
    """Array of structs kind, start, end (code points, end exclusive), base. Null is empty."""

    @F.pandas_udf(_SPANS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "base")
        for batch in batches:
            yield pd.Series([[dict(zip(names, s)) for s in all_spans(text, model)] for text in batch])

    return found(text)


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlaps merge."""

    @F.pandas_udf(T.StringType())
    def replaced(texts: pd.Series, spans_of: pd.Series) -> pd.Series:
        out = []
        for value, marks in zip(texts, spans_of):
            parts, done = [], 0
            for mark in marks if marks is not None else []:
                if mark["start"] >= done:
                    parts += [value[done : mark["start"]], f"<{mark['kind']}>"]
                done = max(done, mark["end"])
            out.append(None if value is None else "".join(parts) + value[done:])
        return pd.Series(out)

    return replaced(text, found)
