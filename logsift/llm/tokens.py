"""Token counts of a unigram vocabulary: matches by Aho-Corasick, count-only Viterbi."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments whose counts a task keeps.
KEPT_SEGMENTS = 300_000
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; a space is written as U+2581 in them.

    ``byte_fallback``: an unknown character is as many tokens as it has bytes. Else it is
    one, and unknown characters in a row are one together.
    """

    pieces: dict[str, float]
    byte_fallback: bool
    dummy_prefix: bool = True


def read_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a SentencePiece file, read as unigrams with the file's scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = [i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)]
    skipped = set(special)
    pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if i not in skipped}
    return Vocabulary(pieces, byte_fallback=any(model.is_byte(i) for i in special))


class Counter:
    """Best segmentations, of which only score and number of pieces are kept.

    A text is cut where every segmentation has a border: before a run of spaces, if spaces
    stand only at the start of pieces, and around characters that
    occur in no longer piece. Best scores and counts of the cuts add up, so equal cuts are
    computed once.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.cut = self._borders()
        self.known: dict[str, tuple[float, int]] = {}

    def _borders(self) -> re.Pattern[str] | None:
        longer = [p for p in self.vocabulary.pieces if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return None
        used = {c for p in longer for c in p}
        alone = "".join(c for c in map(chr, range(32)) if c not in used) if self.vocabulary.byte_fallback else ""
        alone = re.escape(alone)
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    def count(self, text: str | None) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation; zero for null and empty."""
        if not text:
            return 0.0, 0
        marked = (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE)
        known, total, pieces = self.known, 0.0, 0
        for segment in self.cut.findall(marked) if self.cut else [marked]:
            found = known.get(segment)
            if found is None:
                found = self.best(segment)
                if len(known) >= KEPT_SEGMENTS:
                    known.clear()
                if len(segment) < 64:
                    known[segment] = found
            total += found[0]
            pieces += found[1]
        return total, pieces

    def best(self, segment: str) -> tuple[float, int]:
        """Viterbi from left to right.

        Of pieces that end at one place, the one that starts first wins a tie. A character
        that is no piece by itself can also stand alone, as unknown.
        """
        if not self.single.issuperset(segment):
            return self._best_with_unknown(segment)
        # Matches come by their end, the longest first, and every place ends one.
        scores, counts = [0.0], [0]
        at, top, count = 0, float("-inf"), 0
        for last, (length, score) in self.automaton.iter(segment):
            if last != at:
                scores.append(top)
                counts.append(count)
                at, top = last, float("-inf")
            start = last + 1 - length
            reached = scores[start] + score
            if reached > top:
                top, count = reached, counts[start] + 1
        return top, count

    def _best_with_unknown(self, segment: str) -> tuple[float, int]:
        ends = defaultdict(list)
        for last, match in self.automaton.iter(segment):
            ends[last + 1].append(match)
        fallback = self.vocabulary.byte_fallback
        scores, counts, unknown = [0.0], [0], [False]
        for end in range(1, len(segment) + 1):
            char = segment[end - 1]
            top, count, is_unknown = float("-inf"), 0, False
            matches = ends.get(end, [])
            if char not in self.single:
                matches = [*matches, (1, None)]
            for length, score in matches:
                start = end - length
                reached = scores[start] + (self.unknown if score is None else score)
                if reached > top:
                    top, is_unknown = reached, score is None
                    if not is_unknown:
                        count = counts[start] + 1
                    elif fallback:
                        count = counts[start] + len(char.encode("utf-8", "surrogatepass"))
                    else:
                        count = counts[start] + (not unknown[start])
            scores.append(top)
            counts.append(count)
            unknown.append(is_unknown)
        return scores[-1], counts[-1]


_COUNT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_tokens", T.LongType())])


def token_count(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """A struct of the best score and n_tokens of a whole text; zero for null and empty.

    The vocabulary is broadcast; its size is that of the file it was read from.
    """
    shared = spark.sparkContext.broadcast(astuple(vocabulary))

    @F.pandas_udf(_COUNT)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(Vocabulary(*shared.value))
        for batch in batches:
            yield pd.DataFrame([counter.count(text) for text in batch], columns=["score", "n_tokens"])

    return counted(text)
