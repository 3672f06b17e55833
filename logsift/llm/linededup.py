"""Line dedup: documents that share lines are aligned and the later one gives up the blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.scratch import Scratch

#: A block of aligned lines is deleted from this many words on.
MIN_BLOCK_WORDS = 20

_LINES = "doc_id long, line binary, words int, at array<int>"


def document_lines(text: str | None) -> dict[bytes, tuple[int, list[int]]]:
    """Per distinct line: its words and where it stands among the lines that aren't blank.

    Lines end at a line feed and are compared without white space at their ends, by a
    128-bit hash.
    """
    found: dict[bytes, tuple[int, list[int]]] = {}
    at = 0
    for line in (text or "").split("\n"):
        if line := line.strip():
            key = xxhash.xxh3_128_digest(line.encode())
            if key not in found:
                found[key] = (len(line.split()), [])
            found[key][1].append(at)
            at += 1
    return found


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (doc, line, words, at)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))
            for line, (words, at) in document_lines(text.as_py()).items()
        ]
        columns = zip(*rows) if rows else ([], [], [], [])
        types = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "line", "words", "at"]
        )


def patience(later: list[list[int]], earlier: list[list[int]], unique: bool = True) -> set[int]:
    """Patience diff: positions of the later document that are aligned with the earlier one.

    Entry k of both lists holds where the k-th shared line stands. Lines that stand once in
    both are anchors; the longest run of anchors in the same order in both is aligned, and
    each grows in both directions over neighbouring lines that are equal in both. Between
    two anchors the same is done again. Without anchors, or if they needn't be ``unique``,
    every shared line may start an alignment at its first places.
    """
    line_later = {p: k for k, places in enumerate(later) for p in places}
    line_earlier = {p: k for k, places in enumerate(earlier) for p in places}
    aligned: set[int] = set()
    used: set[int] = set()
    todo = [(later, earlier)]
    while todo:
        those, these = todo.pop()
        pairs = sorted((a[0], b[0]) for a, b in zip(those, these) if unique and len(a) == len(b) == 1)
        if not pairs:
            pairs = sorted((a[0], b[0]) for a, b in zip(those, these))
        chain = _longest_increasing(pairs)
        for a, b in chain:
            for step in (1, -1):
                x, y = a, b
                while (k := line_later.get(x)) is not None and k == line_earlier.get(y):
                    if x in aligned and x != a:
                        break
                    aligned.add(x)
                    used.add(y)
                    x, y = x + step, y + step
        gaps = defaultdict(lambda: ([], []))
        ends = [[pair[side] for pair in chain] for side in (0, 1)]
        for a, b in zip(those, these):
            within = defaultdict(lambda: ([], []))
            for side, places, gone in ((0, a, aligned), (1, b, used)):
                for p in places:
                    if p not in gone:
                        within[bisect_left(ends[side], p)][side].append(p)
            for gap, both in within.items():
                if all(both):
                    for side in (0, 1):
                        gaps[gap][side].append(both[side])
        todo += gaps.values()
    return aligned


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that rises in both places, by piles of smallest ends."""
    ends: list[int] = []
    top: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(ends, b)
        before.append(top[pile - 1] if pile else -1)
        ends[pile : pile + 1] = [b]
        top[pile : pile + 1] = [k]
    chain, k = [], top[-1] if top else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def _blocks_of(aligned: set[int], weight: dict[int, int], min_words: int) -> list[int]:
    """The aligned lines that stand in blocks of at least ``min_words``."""
    found: list[int] = []
    block: list[int] = []
    for p in [*sorted(aligned), None]:
        if block and p != block[-1] + 1:
            if sum(weight[q] for q in block) >= min_words:
                found += block
            block = []
        if p is not None:
            block.append(p)
    return found


def _all_passes(later: list[list[int]], earlier: list[list[int]], weight: dict[int, int], min_words: int) -> set[int]:
    """Aligned lines of two documents: one alignment, then blocks of what is left, until none is found."""
    aligned = patience(later, earlier)
    while True:
        rest = [([p for p in a if p not in aligned], b) for a, b in zip(later, earlier)]
        rest = [(a, b) for a, b in rest if a]
        if sum(weight[p] for a, _ in rest for p in a) < min_words:
            return aligned
        for unique in (True, False):
            if found := _blocks_of(patience(*map(list, zip(*rest)), unique), weight, min_words):
                break
        else:
            return aligned
        aligned |= set(found)


def blocks_to_drop(firsts, words, later, earlier, min_words: int, pairs=()) -> list[int]:
    """Positions of a document's lines to delete.

    The document is aligned with each earlier document that is the first to hold some of its
    lines. Aligned too are lines that are a block by themselves, and those at a place of
    ``pairs`` with the line that follows. Aligned lines that follow each other form a block.
    """
    shared = defaultdict(list)
    for k, first in enumerate(firsts):
        shared[first].append(k)
    weight = {p: words[k] for k, places in enumerate(later) for p in places}
    aligned = {p for p in weight if weight[p] >= min_words} | {p + step for p in pairs for step in (0, 1)}
    for members in shared.values():
        own = [list(later[k]) for k in members], [list(earlier[k]) for k in members]
        aligned |= _all_passes(*own, weight, min_words)
    return _blocks_of(aligned, weight, min_words)


def _blocks(min_words: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def drop(firsts: pd.Series, words: pd.Series, later: pd.Series, earlier: pd.Series, pairs: pd.Series) -> pd.Series:
        rows = zip(firsts, words, later, earlier, pairs)
        return pd.Series([blocks_to_drop(*row, min_words, () if p is None else p) for *row, p in rows])

    return drop


_PAIRS = "doc_id long, pair binary, at array<int>"


def _line_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the pairs of shared lines that follow each other, and where."""
    for batch in batches:
        docs, keys, places = [], [], []
        for doc, lines, at in zip(*(column.to_pylist() for column in batch.columns)):
            line_at = {p: k for k, ps in enumerate(at) for p in ps}
            found = defaultdict(list)
            for p, k in line_at.items():
                if (after := line_at.get(p + 1)) is not None:
                    found[xxhash.xxh3_128_digest(lines[k] + lines[after])].append(p)
            docs += [doc] * len(found)
            keys += found.keys()
            places += found.values()
        arrays = [pa.array(docs, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "pair", "at"])


def dropped_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``(doc_id, drop)``: which lines of ``docs(doc_id, text)`` an earlier document holds.

    Earlier means a smaller doc_id. Each shared line pairs a document with the first one that
    holds it, not with all others, so a line in a third of all documents gives as many pairs
    as it has holders; the first holder keeps the line. Only the rows of shared lines are
    gathered per document, and their number is at most that of its lines. Passages that the
    first holders of their lines hold otherwise are found by pairs of lines that follow each
    other, each with the first document that holds the pair. Rarity sets the
    order only: lines that are unique in both documents anchor the alignment; no line is
    left out for being frequent. Rows with a null doc_id take no part. Rows that repeat a
    doc_id count as one document. Blank lines are passed over.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession)
    held = scratch.table(rows.mapInArrow(_lines, _LINES), "lines")
    firsts = held.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.where("first < last").select(F.col("line").alias("key"), "first")
    is_first = (F.col("line") == F.col("key")) & (F.col("doc_id") == F.col("first"))
    holders = held.join(firsts, is_first).select("key", "first", F.col("at").alias("first_at"))
    # Written, the holders are a plain side of the next join, so that Spark splits hot lines.
    holders = scratch.table(holders.dropDuplicates(["key"]), "holders")
    shared = held.join(holders, F.col("line") == F.col("key"))
    per_doc = shared.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "words", "at", "first_at")).alias("x"))
    per_doc = scratch.table(per_doc, "shared")
    pairs = per_doc.select("doc_id", "x.key", "x.at").mapInArrow(_line_pairs, _PAIRS)
    pairs = scratch.table(pairs, "pairs")
    origins = pairs.groupBy("pair").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last"))
    origins = scratch.table(origins.where("origin < last").select(F.col("pair").alias("of"), "origin"), "origins")
    known = pairs.join(origins, F.col("pair") == F.col("of")).where("doc_id > origin")
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.flatten(F.collect_list("at")).alias("pairs"))
    per_doc = per_doc.withColumn("x", F.filter("x", lambda x: x["first"] < F.col("doc_id"))).where("size(x) > 0")
    per_doc = per_doc.join(known, F.col("doc_id") == F.col("id"), "left")
    drop = _blocks(min_words)(F.col("x.first"), F.col("x.words"), F.col("x.at"), F.col("x.first_at"), F.col("pairs"))
    return per_doc.select("doc_id", drop.alias("drop")).where(F.size("drop") > 0)


def without_lines(text: str, drop) -> str:
    """The text without these lines, and without blank lines between two of them."""
    gone, at, out = set(drop), 0, []
    pending: list[str] = []
    after_dropped = False
    for line in text.split("\n"):
        if not line.strip():
            pending.append(line)
            continue
        if at in gone:
            if not after_dropped:
                out += pending
            after_dropped = True
        else:
            out += [*pending, line]
            after_dropped = False
        pending = []
        at += 1
    return "\n".join(out + pending)


@F.pandas_udf(T.StringType())
def _without_lines(texts: pd.Series, drops: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else without_lines(t, d) for t, d in zip(texts, drops)])


def dedup_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct ``row`` of its columns, ``new_text`` and ``drop``.

    ``drop`` is null and ``new_text`` the text itself where nothing is deleted. Every row
    stays, also one that loses all its lines.
    """
    drops = dropped_lines(docs.select("doc_id", "text"), min_words).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(drops, F.col("row.doc_id") == F.col("id"), "left").drop("id")
    # Texts that lose nothing don't travel to Python.
    cut = _without_lines(F.when(F.col("drop").isNotNull(), F.col("row.text")), F.col("drop"))
    return joined.withColumn("new_text", F.coalesce(cut, F.col("row.text")))


def deduplicated(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` with deleted lines taken out of text; n_chars follows where it exists."""
    found = dedup_lines(docs, min_words)
    changed = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        kept = F.col("row.n_chars")
        new = F.length("new_text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("drop").isNull(), kept).otherwise(new)
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
