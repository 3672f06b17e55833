"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.scratch import Scratch

#: Words of one chain. Longer texts are several chains.
CHAIN_WORDS = 64
#: Training chains per language, one per document: the bound of the fitting sample.
FIT_CHAINS = 1_500
#: Words of the lexicon for each language, its most frequent ones in all training documents.
LEXICON_WORDS = 5_000
#: Share of documents of known languages that the least score lets through.
KEPT = 0.999
#: Weight rows for each n-gram length.
BUCKETS = 1 << 15
UNKNOWN = "und"

_ORDERS = (2, 3, 4)
_PIECE_BYTES = _BATCH_BYTES = 1 << 18
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_POWERS = np.random.default_rng(9).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def letters_of(text: str | None) -> str:
    """The words in lower case, one space between; empty if there is no letter."""
    normal = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return normal if normal.isascii() or any(map(str.isalpha, normal)) else ""


@dataclass
class Words:
    """Words of concatenated texts ``" a b c" + " d"``: n-gram rows, word starts, word hashes."""

    rows: np.ndarray  # order x position, row of the weight table; the last row is for no feature
    starts: np.ndarray  # position of the space before each word
    hashes: np.ndarray

    @classmethod
    def of(cls, text: bytes) -> Words:
        """Affixes are the n-grams that hold the space at a word's side; none spans two words."""
        chars = np.frombuffer(text + b"    ", np.uint8).astype(np.uint32)
        n = len(text)
        space = chars == 32
        starts = np.flatnonzero(space[:n])
        code, inner = chars[:n], np.zeros(n, bool)
        rows = np.empty((len(_ORDERS), n), np.int32)
        for k, order in enumerate(_ORDERS):
            if order > 2:
                inner = inner | space[order - 2 : n + order - 2]
            code = code * np.uint32(0x01000193) ^ chars[order - 1 : n + order - 1]
            mixed = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
            rows[k] = np.where(inner, BUCKETS * len(_ORDERS), mixed.astype(np.int32) + k * BUCKETS)
        lengths = np.diff(np.append(starts, n))
        place = np.arange(n) - np.repeat(starts, lengths)
        weighted = chars[:n].astype(np.uint64) * _POWERS[place & 63]
        hashes = np.add.reduceat(weighted, starts) if len(starts) else np.zeros(0, np.uint64)
        return cls(rows, starts, hashes)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Per word, the sum of the table rows of its features."""
        at = np.zeros((self.rows.shape[1], table.shape[1]), np.float32)
        for row in self.rows:
            at += table[row]
        return np.add.reduceat(at, self.starts, axis=0)


@dataclass
class Chains:
    """Runs of at most CHAIN_WORDS words, longest first."""

    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Chains:
        """Chains of texts with so many words each."""
        per = -(-counts // CHAIN_WORDS)
        first = np.repeat(np.cumsum(counts) - counts, per)
        step = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = first + step * CHAIN_WORDS
        length = np.minimum(CHAIN_WORDS, np.repeat(counts, per) - step * CHAIN_WORDS)
        order = np.argsort(-length, kind="stable")
        return cls(start[order], length[order])

    def marginals(self, scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: label probabilities per word, and expected label pairs."""
        labels = scores.shape[1]
        local = np.exp(scores - scores.max(axis=1, keepdims=True))
        moves = np.exp(transitions - transitions.max())
        longest = int(self.length[0]) if len(self.length) else 0
        active = [int(np.searchsorted(-self.length, -t, side="left")) for t in range(longest)]
        ahead = np.empty_like(local)
        state = np.full((len(self.start), labels), 1.0 / labels, np.float32)
        for t in range(longest):
            at = self.start[: active[t]] + t
            state = state[: active[t]] @ moves * local[at] if t else local[at]
            state = state / state.sum(axis=1, keepdims=True)
            ahead[at] = state
        back = np.ones((len(self.start), labels), np.float32)
        found = np.empty_like(local)
        pairs = np.zeros((labels, labels))
        for t in range(longest - 1, -1, -1):
            n = active[t]
            at = self.start[:n] + t
            both = ahead[at] * back[:n]
            found[at] = both / both.sum(axis=1, keepdims=True)
            if t:
                into = local[at] * back[:n]
                joint = ahead[at - 1][:, :, None] * moves * into[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                into = into @ moves.T
                back[:n] = into / into.sum(axis=1, keepdims=True)
        return found, pairs


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (orders * BUCKETS + 1) x languages, last row zero
    bias: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lexicon_scores: np.ndarray
    lexicon_weight: float

    def lexicon_of(self, words: Words) -> np.ndarray:
        found = np.zeros((len(words.hashes), len(self.languages)), np.float32)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, words.hashes), len(self.lexicon) - 1)
            hit = self.lexicon[at] == words.hashes
            found[hit] = self.lexicon_scores[at[hit]]
        return found

    def scores(self, words: Words) -> np.ndarray:
        return words.sums(self.table) + self.bias + self.lexicon_weight * self.lexicon_of(words)

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its mean probability over the words of each text."""
        totals = np.zeros((len(texts), len(self.languages)))
        piece: list[tuple[int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in _pieces(letters_of(text)):
                piece.append((k, part))
                size += len(part)
                if size >= _BATCH_BYTES:
                    self._add(piece, totals)
                    piece, size = [], 0
        self._add(piece, totals)
        weight = totals.sum(axis=1)
        best = totals.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        return [
            (self.languages[b], float(min(1.0, row[b] / w))) if w > 0 else (UNKNOWN, 0.0)
            for row, b, w in zip(totals, best, weight)
        ]

    def _add(self, pieces: list[tuple[int, bytes]], totals: np.ndarray) -> None:
        if not pieces or not self.languages:
            return
        words = Words.of(b"".join(part for _, part in pieces))
        counts = np.array([part.count(b" ") for _, part in pieces])
        found, _ = Chains.of(counts).marginals(self.scores(words), self.transitions)
        sums = np.add.reduceat(found.astype(np.float64), np.cumsum(counts) - counts, axis=0)
        np.add.at(totals, [k for k, _ in pieces], sums)


def _pieces(letters: str) -> Iterator[bytes]:
    """``" a b c"`` in parts of bounded size, cut between words."""
    if not letters:
        return
    text, start = b" " + letters.encode(), 0
    while len(text) - start > _PIECE_BYTES:
        end = text.rfind(b" ", start + 1, start + _PIECE_BYTES)
        end = end if end > 0 else text.find(b" ", start + 1)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _train(chains: list[tuple[str, str]], languages: list[str], lexicon, rounds: int = 5, parts: int = 8) -> Model:
    """Maximises the conditional likelihood by AdaGrad.

    Half of the chains get their second half from another chain, so that the transitions
    see changes of language inside a text.
    """
    rng = np.random.default_rng(0)
    number = {lang: k for k, lang in enumerate(languages)}
    table = np.zeros((BUCKETS * len(_ORDERS) + 1, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    moves = np.zeros((len(languages), len(languages)), np.float32)
    model = Model(languages, table, bias, moves, *lexicon, lexicon_weight=0.5)
    if not chains:
        return model
    labelled = [(number[lang], letters.split(" ")) for lang, letters in chains]
    other = rng.permutation(len(labelled))
    spliced = []
    for k, (label, words) in enumerate(labelled):
        half = len(words) // 2 if k % 2 else len(words)
        tail_label, tail = labelled[other[k]]
        tail = tail[len(tail) - (len(words) - half) :] if half < len(words) else []
        spliced.append((words[:half] + tail, [label] * half + [tail_label] * len(tail)))
    rng.shuffle(spliced)
    squares = [np.full_like(a, 1e-3) for a in (table, bias, moves)]
    batches = []
    for k in range(parts):
        part = spliced[k::parts]
        if part:
            words = Words.of("".join(" " + w for ws, _ in part for w in ws).encode())
            counts = np.array([len(ws) for ws, _ in part])
            truth = np.array([y for _, ys in part for y in ys])
            inside = np.ones(len(truth), bool)
            inside[np.cumsum(counts) - counts] = False
            inside[[k for s, c in zip(np.cumsum(counts) - counts, counts) for k in range(s, s + c, CHAIN_WORDS)]] = False
            seen = np.zeros((len(languages),) * 2)
            np.add.at(seen, (truth[np.flatnonzero(inside) - 1], truth[inside]), 1)
            batches.append((words, Chains.of(counts), truth, seen, counts.sum()))
    for _ in range(rounds):
        for words, runs, truth, seen, total in batches:
            found, pairs = runs.marginals(model.scores(words), model.transitions)
            found[np.arange(len(truth)), truth] -= 1.0
            of_word = np.repeat(np.arange(len(truth)), np.diff(np.append(words.starts, words.rows.shape[1])))
            grad = np.zeros_like(table)
            for row in words.rows:
                for label in range(len(languages)):
                    grad[:, label] += np.bincount(row, found[of_word, label], len(table)).astype(np.float32)
            grad[-1] = 0
            grads = (grad / total, found.sum(axis=0) / total, ((pairs - seen) / total).astype(np.float32))
            for value, g, square, rate in zip((table, bias, moves), grads, squares, (0.3, 0.1, 0.3)):
                square += g * g
                value -= rate * g / np.sqrt(square) + 1e-4 * rate * value
    return model


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def fit(docs: DataFrame, fit_chains: int = FIT_CHAINS, lexicon_words: int = LEXICON_WORDS) -> Model:
    """A model of ``docs(doc_id, text, lang)``; rows without text or lang are passed over.

    The lexicon counts the words of all rows and holds the ``lexicon_words`` most frequent ones
    of each language, so that no language fills it alone; ties at the end are drawn by hash, so
    the number is met about. The weights are fitted on at most
    ``fit_chains`` chains of each language: one chain of each document, drawn by hash.
    """
    scratch = Scratch(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {row.lang: row.n for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    words = known.select("lang", F.explode(F.split(_normal(F.col("text")), " ")).alias("word")).where("word <> ''")
    counts = scratch.table(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "counts")
    # Per language the count from which a word belongs to the top, and how many words of just
    # that count do; they are drawn by hash. Only distinct counts are ordered, no words.
    sizes_of = counts.groupBy("lang", "n").agg(F.count("*").alias("tied"))
    falling = Window.partitionBy("lang").orderBy(F.desc("n"))
    before = F.coalesce(F.sum("tied").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = sizes_of.withColumn("room", lexicon_words - before).where("room > 0").groupBy(F.col("lang").alias("of_lang"))
    bounds = bounds.agg(F.min("n").alias("least"), F.min_by("tied", "n").alias("tied"), F.min_by("room", "n").alias("room"))
    drawn_tie = (F.col("n") == F.col("least")) & (F.pmod(F.xxhash64("word"), F.col("tied")) < F.col("room"))
    # One row for each language.
    top = counts.join(F.broadcast(bounds), F.col("lang") == F.col("of_lang")).where((F.col("n") > F.col("least")) | drawn_tie)
    top = scratch.table(top.select(F.col("word").alias("of")).distinct(), "top")
    # About lexicon_words for each language, and a count of each in every language.
    rows = counts.join(top, F.col("word") == F.col("of")).select("word", "lang", "n").orderBy("word", "lang").collect()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 4 * fit_chains / n) * (1 << 30))).otherwise(share)
    drawn = known.withColumn("draw", draw).where(F.col("draw") < share)
    split = drawn.select("doc_id", "lang", "draw", F.split(_normal(F.col("text")), " ").alias("w"))
    number = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.ceil(F.size("w") / CHAIN_WORDS))
    chain = F.array_join(F.slice("w", (number * CHAIN_WORDS + 1).cast("int"), CHAIN_WORDS), " ")
    sample = split.select("lang", "draw", "doc_id", chain.alias("chain")).where("chain <> ''")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "chain"))
    chains = sample.withColumn("rank", rank).where(F.col("rank") <= fit_chains).orderBy("lang", "rank").collect()
    return _train([(row.lang, row.chain) for row in chains], languages, _lexicon(rows, languages))


def _lexicon(rows, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and centred log shares, clipped, from rows of ``word, lang, n`` by word."""
    words = sorted({row.word for row in rows})
    if not words:
        return np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32)
    hashes = Words.of("".join(" " + word for word in words).encode()).hashes
    counts = np.full((len(words), len(languages)), 0.5)
    at, number = {word: k for k, word in enumerate(words)}, {lang: k for k, lang in enumerate(languages)}
    for row in rows:
        counts[at[row.word], number[row.lang]] += row.n
    logs = np.log(counts / counts.sum(axis=0))
    scores = np.clip(logs - logs.mean(axis=1, keepdims=True), -4, 4).astype(np.float32)
    hashes, first = np.unique(hashes, return_index=True)
    return hashes, scores[first]


_GUESS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def language(text: Column, model: Model) -> Column:
    """A struct of ``lang`` and ``score`` (0 to 1) of a whole text.

    ``score`` is the mean probability of ``lang`` over the words, each word by
    forward-backward in its chain. Texts that are null or hold no letter, and all texts under
    a model without languages, are ``und`` with score 0.
    """

    @F.pandas_udf(_GUESS)
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(model.label(batch.tolist()), columns=["lang", "score"])

    return guess(text)


def least_score(docs: DataFrame, model: Model, kept: float = KEPT) -> float:
    """The score that ``kept`` of the rows of ``docs(text, lang)`` reach whose language is found.

    Meant for rows that the model was not fitted on. Without such rows no score is too low.
    """
    guess = language(F.col("text"), model)
    known = docs.where("lang is not null").select("lang", guess.alias("guess")).where("guess.lang = lang")
    found = known.agg(F.percentile_approx("guess.score", 1 - kept, 1_000_000)).first()[0]
    return 0.0 if found is None else found


def labelled_documents(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of ``docs``, columns unchanged, in a language of the model.

    Texts without letters go, and those in which no language reaches ``least``, as texts in a
    language that was not learned do.
    """
    rows = docs.select(F.struct("*").alias("row"))
    guess = language(F.col("row.text"), model)
    return rows.withColumn("guess", guess).where((F.col("guess.score") >= least) & (F.col("guess.score") > 0)).select("row.*")
