"""Secrets in texts: fixed finders, and a linear-chain CRF that tags tokens as begin, inside or outside."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "secret")
#: Chains of the fitting sample with a secret found by the fixed finders, without one but with a
#: candidate, and from anywhere else.
FIT_SECRET, FIT_PLAIN, FIT_OTHER = 1_500, 3_000, 1_500
#: Tokens of one chain. Longer lines are several chains, cut between words.
CHAIN_TOKENS = 128
#: Characters before and after a candidate that its chain of the fitting sample reaches, on the same line.
BEFORE, AFTER = 120, 60
#: Words that name a secret, put in place of the ones seen, so that the model knows more than one.
NAMES = (
    "password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "access_key",
    "private_key", "client_secret", "credential", "bearer", "passphrase", "signature", "session",
)
BUCKETS = 1 << 14

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run starts where none goes on, so short runs are left at their first character.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: What draws chains into the fitting sample: eight characters or more without a space, one of them a digit.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{8,}+")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_DIGIT = re.compile(r"[0-9]")
_OUT, _BEGIN, _INSIDE = range(3)
_NEVER = -1e9


def _assigned(text: str) -> Iterator[re.Match]:
    return (m for m in _ASSIGN.finditer(text) if len(m[2]) >= 8)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of assigned secrets, access keys and long hexadecimal runs."""
    found = [(m.start(), "assign", m.end()) for m in _assigned(text)]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def _values(text: str) -> list[tuple[int, int]]:
    """Where the fixed finders see the secret itself, without the word that names it."""
    found = [m.span(2) for m in _assigned(text)]
    return sorted(found + [(a, b) for a, kind, b in base_spans(text) if kind != "assign"])


@dataclass(frozen=True)
class Chain:
    """Tokens of one run of text around candidates, as ``(start, end)``, with their file's features."""

    text: str
    tokens: list[tuple[int, int]]
    file: tuple[int, ...]


def file_features(text: str, candidates: int) -> tuple[int, ...]:
    """Buckets of candidates per text, of lines that end in code, and of assignments."""
    size = len(text) + 1
    code = sum(map(text.count, ("{", "}", ";\n", "()")))
    return (
        min(6, (2_000 * candidates // size).bit_length()),
        min(4, (1_000 * code // size).bit_length()),
        min(4, (500 * text.count("=") // size).bit_length()),
    )


def windows_of(text: str) -> list[Chain]:
    """Runs of tokens around every candidate, on its line; runs that touch are one. Only fitting reads them."""
    if not _DIGIT.search(text):
        return []
    runs: list[list[int]] = []
    n = 0
    for m in _CANDIDATE.finditer(text):
        n += 1
        start, end = m.span()
        low = max(0, start - BEFORE)
        line = text.rfind("\n", low, start) + 1
        low = line or ((text.find(" ", low, start) + 1 or low) if low else 0)
        high = min(len(text), end + AFTER)
        line = text.find("\n", end, high)
        if line >= 0:
            high = line
        elif high < len(text):
            space = text.rfind(" ", end, high)
            high = space if space >= 0 else high
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(high, runs[-1][1])
        else:
            runs.append([low, high])
    file = file_features(text, n)
    found = []
    for low, high in runs:
        tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
        found += [Chain(text, tokens[k : k + CHAIN_TOKENS], file) for k in range(0, len(tokens), CHAIN_TOKENS)]
    return found


def candidates_of(text: str) -> int:
    return sum(1 for _ in _CANDIDATE.finditer(text)) if _DIGIT.search(text) else 0


_SPACE, _LOWER, _UPPER, _NUMBER, _SIGN = range(5)
_PLANE = 1 << 16
_POWERS = np.random.default_rng(9).integers(1, 1 << 32, 16, dtype=np.uint32) | np.uint32(1)


class Alphabet:
    """Kind and lower case of characters; those beyond the first plane are looked up when met."""

    def __init__(self) -> None:
        self.kinds = np.array([self.kind(chr(c)) for c in range(_PLANE)], np.uint8)
        self.lows = np.array([self.low(chr(c)) for c in range(_PLANE)], np.uint32)

    @staticmethod
    def kind(c: str) -> int:
        if not c.isalnum():
            return _SPACE if c.isspace() else _SIGN
        return _NUMBER if c.isdigit() else _UPPER if c.isupper() else _LOWER

    @staticmethod
    def low(c: str) -> int:
        low = c.lower()
        return ord(low if len(low) == 1 else c)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.minimum(codes, _PLANE - 1)
        kinds, lows = self.kinds[near], self.lows[near]
        far = np.flatnonzero(codes >= _PLANE)
        if len(far):
            values, at = np.unique(codes[far], return_inverse=True)
            kinds[far] = np.array([self.kind(chr(c)) for c in values], np.uint8)[at]
            lows[far] = np.array([self.low(chr(c)) for c in values], np.uint32)[at]
        return kinds, lows


def _row(salt: int, *values: np.ndarray) -> np.ndarray:
    """A bucket for each combination of values."""
    mixed = np.full(1, salt * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for value in values:
        mixed = (mixed ^ value.astype(np.uint32, copy=False)) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
    mixed = mixed * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(18)).astype(np.int32)


class Tokens:
    """All tokens of some texts, one text after the other with a line break between, and their features."""

    def __init__(self, texts: list[str], alphabet: Alphabet) -> None:
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kinds, self.lows = alphabet.of(codes)
        word = (self.kinds != _SPACE) & (self.kinds != _SIGN)
        sign = self.kinds == _SIGN
        edge = np.diff(word, prepend=False)
        self.start = np.flatnonzero(sign | (word & edge))
        self.end = np.flatnonzero(sign | (word & np.append(edge[1:], True))) + 1
        n = len(self.start)
        self.sign = sign[self.start]
        breaks = np.flatnonzero(codes == 10)
        line = np.searchsorted(breaks, self.start)
        first = np.diff(line, prepend=-1) != 0
        at = np.arange(n)
        #: First token of each token's line.
        self.first = np.maximum.accumulate(np.where(first, at, 0)) if n else at
        self.close = np.zeros(n, bool)
        self.close[1:] = (self.end[:-1] == self.start[1:]) & ~first[1:]
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """First token and length of runs of at most CHAIN_TOKENS tokens of a line, which hold every token."""
        n = len(self.start)
        starts = np.unique(self.first)
        ends = np.append(starts[1:], n) if n else starts
        between = np.maximum.accumulate(np.where(self.close, 0, np.arange(n))) if n else starts
        more = []
        for k in np.flatnonzero(ends - starts > CHAIN_TOKENS):
            at, end = int(starts[k]), int(ends[k])
            while end - at > CHAIN_TOKENS:
                # Between words, but inside of one that is longer than a chain.
                cut = int(between[at + CHAIN_TOKENS])
                at = cut if cut > at else at + CHAIN_TOKENS
                more.append(at)
        starts = np.sort(np.concatenate([starts, np.array(more, np.int64)]))
        return starts, np.diff(np.append(starts, n))

    def features(self, files: np.ndarray) -> np.ndarray:
        """Rows of the weight table, feature x token; ``files`` has the features of each text."""
        n = len(self.start)
        if not n:
            return np.zeros((15, 0), np.int32)
        size = (self.end - self.start).astype(np.int64)
        place = np.arange(len(self.kinds)) - np.repeat(
            np.append(0, self.start), np.diff(np.concatenate([[0], self.start, [len(self.kinds)]]))
        )
        inside = self.kinds != _SPACE
        weighted = self.lows * _POWERS[place & 15]
        weighted[~inside] = 0
        low = np.add.reduceat(weighted, self.start, dtype=np.uint32)
        low[size > 16] = 0
        counted = lambda held: np.add.reduceat(held & inside, self.start, dtype=np.int64)
        upper, digits = counted(self.kinds == _UPPER), counted(self.kinds == _NUMBER)
        hexes = counted(((self.lows >= 97) & (self.lows <= 102) & (self.kinds == _LOWER)) | ((self.lows >= 48) & (self.lows <= 57)))
        change = np.diff(self.kinds, prepend=0) != 0
        change[self.start] = False
        changes = counted(change)
        kinds = (size > digits + upper) + 2 * (upper > 0) + 4 * (digits > 0)
        bits = np.minimum(6, np.ceil(np.log2(size + 1))).astype(np.int64)
        rough = np.where(self.sign, 0, kinds * 8 + bits)
        fine = rough * 256 + 8 * changes // size * 16 + (hexes == size) * 8 + 4 * digits // size
        fine = np.where(self.sign, (1 << 20) + self.lows[self.start], fine)

        at = np.arange(n)
        # The last word before signs, as in `name = "value`, and its last four characters.
        last = np.maximum.accumulate(np.where(self.sign, -1, at))
        last = np.append(-1, last[:-1])
        known = last >= self.first
        gap = np.where(known, np.minimum(at - 1 - last, 4), 5)
        name = np.where(known, low[last], 0)
        ending = np.zeros(n, np.uint32)
        for k in range(4):
            ending += np.where(size > k, self.lows[np.maximum(self.end - 1 - k, 0)] * _POWERS[k], np.uint32(0))
        ending[size > 16] = 0
        ending = np.where(known, ending[last], 0)

        def beside(values: np.ndarray, step: int) -> np.ndarray:
            """Values of the token so many steps ahead, one for all beyond the line."""
            to = at + step
            held = (to >= self.first) & (to < n)
            to = np.clip(to, 0, n - 1)
            return np.where(held & (self.first[to] == self.first), values[to], 0x5BD1E995)

        before, file = beside(low, -1), files[self.text]
        return np.array(
            [
                _row(1, rough), _row(2, fine), _row(3, low, self.sign), _row(4, self.close, rough),
                _row(5, name, rough), _row(6, name, gap), _row(7, ending, gap, rough),
                _row(8, before, rough), _row(9, beside(low, -2), before, rough), _row(10, beside(low, 1), rough),
                _row(11, self.close, beside(rough, -1), rough), _row(12, beside(rough, 1), rough),
                *(_row(13 + i, file[:, i], rough) for i in range(3)),
            ]
        )


def chains_of(text: str, alphabet: Alphabet | None = None) -> list[Chain]:
    """All tokens of a text in chains, each on one line."""
    tokens = Tokens([text], alphabet or Alphabet())
    spans_at, file = list(zip(tokens.start.tolist(), tokens.end.tolist())), file_features(text, candidates_of(text))
    return [Chain(text, spans_at[a : a + n], file) for a, n in zip(*(x.tolist() for x in tokens.chains()))]


def features(chain: Chain, alphabet: Alphabet) -> np.ndarray:
    """Rows of the weight table, one list for each token, of a chain by itself."""
    if not chain.tokens:
        return np.zeros((0, 15), np.int32)
    piece = chain.text[chain.tokens[0][0] : chain.tokens[-1][1]].replace("\n", " ")
    return Tokens([piece], alphabet).features(np.array([chain.file])).T


class _Batch:
    """Chains side by side, padded at their ends."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.lengths = np.array([len(r) for r in rows])
        self.rows = np.full((len(rows), max(self.lengths, default=0), rows[0].shape[1] if rows else 0), BUCKETS, np.int32)
        for k, r in enumerate(rows):
            self.rows[k, : len(r)] = r

    def scores(self, table: np.ndarray) -> np.ndarray:
        return table[self.rows].sum(axis=2)


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # BUCKETS + 1 rows of weights for out, begin, inside; the last one is zero
    moves: np.ndarray  # from, to; the fourth row is the start

    @classmethod
    def blank(cls) -> Model:
        moves = np.zeros((4, 3))
        moves[[_OUT, 3], _INSIDE] = _NEVER
        return cls(np.zeros((BUCKETS + 1, 3)), moves)

    def decode(self, batch: _Batch) -> np.ndarray:
        """The best tags of each chain, by Viterbi; ties go to the earlier tag."""
        return self.best(self.scores(batch), batch.lengths)

    def best(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``decode`` from scores by chain, token and tag."""
        n, longest, _ = scores.shape
        scores = np.ascontiguousarray(scores.transpose(1, 2, 0))
        state = [scores[0, tag] + self.moves[3, tag] for tag in range(3)]
        back = np.zeros((longest, 3, n), np.int8)
        for t in range(1, longest):
            on, new = t < lengths, []
            for tag in range(3):
                value, way = state[0] + self.moves[0, tag], back[t, tag]
                for earlier in (1, 2):
                    other = state[earlier] + self.moves[earlier, tag]
                    way[other > value] = earlier
                    value = np.maximum(value, other)
                way[~on] = tag
                new.append(np.where(on, value + scores[t, tag], state[tag]))
            state = new
        tags = np.zeros((longest, n), np.int8)
        tags[-1] = np.array(state).argmax(axis=0)
        for t in range(longest - 1, 0, -1):
            tags[t - 1] = back[t, tags[t], np.arange(n)]
        return tags.T

    def scores(self, batch: _Batch) -> np.ndarray:
        return batch.scores(self.table)

    def marginals(self, batch: _Batch) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward-backward: tag probabilities, expected moves, and the log of the total weight."""
        scores = self.scores(batch)
        n, longest, _ = scores.shape
        on = np.arange(longest)[None, :] < batch.lengths[:, None]
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0] + self.moves[3]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.moves[None, :3], axis=1) + scores[:, t]
            ahead[:, t] = np.where(on[:, t, None], step, ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(self.moves[None, :3] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(on[:, t + 1, None], step, 0.0)
        found = np.exp(ahead + back - total[:, None, None]) * on[:, :, None]
        pairs = np.zeros((4, 3))
        pairs[3] = found[:, 0].sum(axis=0)
        for t in range(1, longest):
            joint = ahead[:, t - 1, :, None] + self.moves[None, :3] + (scores[:, t] + back[:, t])[:, None, :]
            pairs[:3] += (np.exp(joint - total[:, None, None]) * on[:, t, None, None]).sum(axis=0)
        return found, pairs, float(total.sum())


def train(chains: list[tuple[Chain, list[int]]], rounds: int = 12, size: int = 256) -> Model:
    """Maximises the conditional likelihood of tagged chains by AdaGrad, with a ridge."""
    model = Model.blank()
    chains = [c for c in chains if c[1]]
    if not chains:
        return model
    alphabet = Alphabet()
    order = np.random.default_rng(11).permutation(len(chains))
    batches = []
    for start in range(0, len(order), size):
        part = [chains[k] for k in order[start : start + size]]
        batch = _Batch([features(c, alphabet) for c, _ in part])
        truth, moves = np.zeros((*batch.rows.shape[:2], 3)), np.zeros((4, 3))
        for k, (_, tags) in enumerate(part):
            truth[k, np.arange(len(tags)), tags] = 1
            np.add.at(moves, ([3, *tags[:-1]], tags), 1)
        batches.append((batch, truth, moves))
    table, moves = model.table, model.moves
    squares = [np.full_like(table, 1e-3), np.full_like(moves, 1e-3)]
    for _ in range(rounds):
        for batch, truth, seen in batches:
            found, pairs, _ = model.marginals(batch)
            gap = (found - truth) / len(truth)
            grad = np.zeros_like(table)
            for tag in range(3):
                weights = np.repeat(gap[:, :, tag].ravel(), batch.rows.shape[2])
                grad[:, tag] = np.bincount(batch.rows.ravel(), weights, len(table))
            grad[-1] = 0
            for value, slope, square in ((table, grad, squares[0]), (moves, (pairs - seen) / len(truth), squares[1])):
                square += slope * slope
                value -= 0.3 * slope / np.sqrt(square) + 1e-4 * np.where(value > _NEVER / 2, value, 0)
    return model


def tags_of(chain: Chain, values: list[tuple[int, int]]) -> list[int]:
    """Tags of a chain's tokens where the secrets lie at ``values``, in order."""
    tags, starts, last = [], [a for a, _ in values], -1
    for a, b in chain.tokens:
        k = bisect_right(starts, b - 1) - 1
        inside = k >= 0 and values[k][1] > a
        tags.append(_OUT if not inside else _INSIDE if k == last else _BEGIN)
        last = k if inside else -1
    return tags


_ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
)


def varied(text: str, values: list[tuple[int, int]], random: Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with other secrets, of other alphabets and lengths, under other names."""
    parts, found, done, size = [], [], 0, 0
    for a, b in values:
        if a < done:
            continue
        before = text[done:a]
        m = re.search(r"([\w-]+)(\W{1,4})$", before)
        if m and random.random() < 0.7:
            sign = random.choice((m[2], ": ", "=", " = ", ": '", '="', " "))
            before = before[: m.start()] + random.choice(NAMES) + sign
        value = "".join(random.choices(random.choice(_ALPHABETS), k=random.randint(16, 48)))
        if random.random() < 0.2:
            value = "".join(random.choices("abcdefghkmnprstxyz", k=random.randint(2, 4))) + random.choice("_-") + value
        parts += [before, value]
        size += len(before)
        found.append((size, size + len(value)))
        size += len(value)
        done = b
    return "".join(parts) + text[done:], found


_SECRET, _PLAIN, _OTHER = range(3)


def _sampled(text: str) -> Iterator[tuple[int, Chain, list[tuple[int, int]]]]:
    """Chains of a text for fitting: those around candidates, and one from anywhere else."""
    windows = windows_of(text)
    values = _values(text) if windows else []
    for chain in windows:
        if chain.tokens:
            a, b = chain.tokens[0][0], chain.tokens[-1][1]
            held = [(x, y) for x, y in values if x < b and y > a]
            yield _SECRET if held else _PLAIN, chain, held
    # Where to look is drawn by the text itself.
    start = crc32(text.encode("utf-8", "surrogatepass")) % (len(text) + 1)
    start = text.rfind(" ", max(0, start - 200), start) + 1 or start
    stop = text.find("\n", start)
    stop = len(text) if stop < 0 else stop
    tokens = [m.span() for _, m in zip(range(CHAIN_TOKENS // 2), _TOKEN.finditer(text, start, stop))]
    if tokens:
        a, b = tokens[0][0], tokens[-1][1]
        near = any(c.tokens and c.tokens[0][0] < b and c.tokens[-1][1] > a for c in windows)
        if not near and not base_spans(text[max(0, a - BEFORE) : b + BEFORE]):
            yield _OTHER, Chain(text, tokens, windows[0].file if windows else file_features(text, 0)), []


_SAMPLE = "kind int, draw long, text string, starts array<long>, ends array<long>, file array<int>"


def _samples(batches: Iterator[pa.RecordBatch], most: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The chains of a task that come first by draw and text, at most so many of each kind."""
    kept: list[dict[tuple[int, str], tuple]] = [{} for _ in most]

    def cut(kind: int) -> None:
        kept[kind] = {key: kept[kind][key] for key in sorted(kept[kind])[: most[kind]]}

    for batch in batches:
        for value in batch.column(0):
            for kind, chain, held in _sampled(value.as_py()):
                a, b = chain.tokens[0][0], chain.tokens[-1][1]
                piece = chain.text[a:b]
                starts, ends = [max(x, a) - a for x, _ in held], [min(y, b) - a for _, y in held]
                # Equal chains of other files come in the order of their features.
                row = (starts, ends, chain.file)
                key = (crc32(piece.encode()), piece)
                kept[kind][key] = min(row, kept[kind].get(key, row))
                if len(kept[kind]) > 2 * most[kind] + 100:
                    cut(kind)
    rows: list[list] = [[] for _ in range(6)]
    for kind in range(len(most)):
        cut(kind)
        for (draw, piece), row in kept[kind].items():
            for column, item in zip(rows, (kind, draw, piece, *row)):
                column.append(item)
    long_list = pa.list_(pa.int64())
    types = [pa.int32(), pa.int64(), pa.string(), long_list, long_list, pa.list_(pa.int32())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], [f.split()[0] for f in _SAMPLE.split(", ")])


def fit(docs: DataFrame, with_secret: int = FIT_SECRET, plain: int = FIT_PLAIN, other: int = FIT_OTHER) -> Model:
    """A model of ``docs(text)``, taught by the fixed finders.

    Chains around candidates are tagged where the finders see a secret. At most
    ``with_secret`` chains that hold one, ``plain`` others and ``other`` from elsewhere are
    drawn, by a hash of their text, so copies count once. Each chain with secrets is learned
    as it is and in four forms with other secrets under other names, so that neither the
    finders' words nor their shapes are needed. Where no chain holds a secret, nothing is
    added later. The sample bounds the fitting only: ``tagged_spans`` reads every token.
    """
    texts = docs.where("text is not null").select("text")
    most = (with_secret, plain, other)
    rows = texts.mapInArrow(lambda batches: _samples(batches, most), _SAMPLE)
    # So many rows of each task at most, of which Spark keeps the first ones before it brings them together.
    drawn = rows.groupBy("kind", "draw", "text").agg(F.min(F.struct("starts", "ends", "file")).alias("at"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("draw", "text"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= max(most)).select("kind", "draw", "text", "at.*").collect()
    random, tagged = Random(11), []
    for kind, limit in enumerate(most):
        for row in sorted((r for r in drawn if r.kind == kind), key=lambda r: (r.draw, r.text))[:limit]:
            values, file = list(zip(row.starts, row.ends)), tuple(row.file)
            forms = [(row.text, values)]
            if kind == _SECRET:
                forms += [varied(row.text, values, random) for _ in range(4)]
            for text, spans_at in forms:
                chain = Chain(text, [m.span() for m in _TOKEN.finditer(text)][:CHAIN_TOKENS], file)
                tagged.append((chain, tags_of(chain, spans_at)))
    return train(tagged) if any(_BEGIN in tags for _, tags in tagged) else Model.blank()


def tagged_spans(texts: list[str | None], model: Model, alphabet: Alphabet | None = None) -> list[list[tuple[int, int]]]:
    """Per text the spans from a token tagged begin to the last one inside, base spans left out.

    Every token of every text is tagged.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not model.table.any():
        return found
    whole = [text or "" for text in texts]
    tokens = Tokens(whole, alphabet or Alphabet())
    if not len(tokens.start):
        return found
    scores = np.zeros((len(tokens.start), 3), np.float32)
    table = model.table.astype(np.float32)
    for row in tokens.features(np.array([file_features(t, candidates_of(t)) for t in whole])):
        scores += table[row]
    tags = np.zeros(len(tokens.start), np.int8)
    starts, lengths = tokens.chains()
    order = np.argsort(-lengths, kind="stable")
    for k in range(0, len(order), 1024):
        part = order[k : k + 1024]
        place = np.arange(lengths[part[0]])
        held = place < lengths[part][:, None]
        at = np.where(held, starts[part][:, None] + place, 0)
        best = model.best(scores[at], lengths[part])
        tags[at[held]] = best[held]
    # A span goes on as long as tokens are inside, up to the end of its chain.
    chain_of = np.repeat(np.arange(len(starts)), lengths)
    begins = np.flatnonzero(tags == _BEGIN)
    other = np.flatnonzero(np.append((tags != _INSIDE) | (np.diff(chain_of, prepend=-1) != 0), True))
    stops = other[np.searchsorted(other, begins, side="right")]
    for a, b in zip(begins.tolist(), stops.tolist()):
        k = int(tokens.text[a])
        offset = int(tokens.offsets[k])
        found[k].append((int(tokens.start[a]) - offset, int(tokens.end[b - 1]) - offset))
    return found


def all_spans(texts: list[str | None], model: Model, alphabet: Alphabet | None = None) -> list[list[tuple[str, int, int, bool]]]:
    """``(kind, start, end, base)`` by start, then kind as listed, of each text.

    Base spans all stay. What the model tags and no base span touches is added as ``secret``.
    """
    out = []
    for text, tagged in zip(texts, tagged_spans(texts, model, alphabet)):
        base = base_spans(text) if text else []
        taken = sorted((a, b) for a, _, b in base)
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
        starts = [a for a, _ in taken]
        found = [(kind, a, b, True) for a, kind, b in base]
        for a, b in tagged:
            k = bisect_right(starts, b - 1)
            if k == 0 or reach[k - 1] <= a:
                found.append(("secret", a, b, False))
        out.append(sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


_FIELDS = (("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("base", T.BooleanType()))
_SPANS = T.ArrayType(T.StructType([T.StructField(*f) for f in _FIELDS]))


def spans(text: Column, model: Model) -> Column:
    """Array of structs kind, start, end (code points, end exclusive), base.

    Null and empty texts have none. Texts are read and tagged whole, chains are decoded 1,024 at a time.
    """

    @F.pandas_udf(_SPANS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names, alphabet = [name for name, _ in _FIELDS], Alphabet()
        for batch in batches:
            lists = []
            for start in range(0, len(batch), 200):
                lists += all_spans(batch.iloc[start : start + 200].tolist(), model, alphabet)
            yield pd.Series([[dict(zip(names, s)) for s in row] for row in lists], dtype=object)

    return found(text)
