"""Benchmark decontamination by Wu-Manber search over words, in one pass at any benchmark size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.scratch import Scratch

WINDOW_WORDS = 10
#: Slots of a shift table and bits of a suffix filter are powers of two: so many for each
#: block or window of the benchmark, and at most so many, whatever its size.
SLOTS_EACH, MOST_SLOT_BITS = 64, 24
BITS_EACH, MOST_FILTER_BITS = 32, 27
#: Entries of a table that travel as one row.
_PART = 1 << 16
#: Places that a task hands on at once.
_FLUSH = 1 << 14

#: Lower-cases A-Z and turns every other ASCII character that is no digit or letter into a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def block_slots(codes: np.ndarray, block: int, bits: int) -> np.ndarray:
    """The table slot of every block of one or two neighbouring words."""
    mixed = codes * np.uint32(0x9E3779B1)
    if block == 2:
        mixed = mixed[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77) + np.uint32(0x27220A95))
        mixed *= np.uint32(0xC2B2AE3D)
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Tables:
    """The search for windows of one length.

    ``shift`` tells for each slot of word blocks how far a window whose last block falls there
    can move on without missing an occurrence; blocks that share a slot give the shorter way.
    ``filter`` holds a bit for each window text of the benchmark. Both have a fixed size, so
    what a task holds does not grow with the benchmark.
    """

    length: int
    slot_bits: int
    filter_bits: int
    shift: bytes
    filter: bytes

    @property
    def block(self) -> int:
        return min(2, self.length)

    def search(self, words: list[bytes], codes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Start and text of the places that may be occurrences: no other place is one."""
        length, block, total = self.length, self.block, len(words)
        if total < length:
            return
        table = np.frombuffer(self.shift, np.uint8)
        steps = table[block_slots(codes, block, self.slot_bits)].tolist()
        held, mask, end = self.filter, (1 << self.filter_bits) - 1, length
        while end <= total:
            if step := steps[end - block]:
                end += step
                continue
            text = b" ".join(words[end - length : end])
            bit = crc32(text) & mask
            if held[bit >> 3] >> (bit & 7) & 1:
                yield end - length, text
            end += 1


_WINDOWS = "item string, size int, w binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the items, in batches of bounded size."""
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1)):
            words = words_of(text.as_py())
            size = min(WINDOW_WORDS, len(words))
            for first in range(0, len(words) - size + 1 if words else 0, _FLUSH):
                starts = range(first, min(first + _FLUSH, len(words) - size + 1))
                texts = [b" ".join(words[k : k + size]) for k in starts]
                columns = [pa.array([item.as_py()] * len(texts), pa.string()), pa.array([size] * len(texts), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], ["item", "size", "w"])


_ENTRIES = "size int, is_shift boolean, at int, value int"


def _entries(bits: dict[int, tuple[int, int]]):
    """Table entries of window texts: a shift for each block, a bit for each window."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], []]
            for size, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                slot_bits, filter_bits = bits[size]
                window = text.as_py()
                slots = block_slots(word_codes(window.split(b" ")), min(2, size), slot_bits).tolist()
                bit = crc32(window) & ((1 << filter_bits) - 1)
                n = len(slots)
                for column, items in zip(rows, ([size] * (n + 1), [True] * n + [False], [*slots, bit >> 3], [*range(n - 1, -1, -1), 1 << (bit & 7)])):
                    column += items
            types = (pa.int32(), pa.bool_(), pa.int32(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(rows, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["size", "is_shift", "at", "value"])

    return entries


def _power(n: int, least: int, most: int) -> int:
    return min(most, max(least, (n - 1).bit_length()))


def tables_of(windows: DataFrame) -> list[Tables]:
    """The tables for ``windows(size, w)``, one for each length.

    Entries are combined on the cluster. What comes to the driver are the finished tables in
    parts, whose size is fixed: at most 16 MB each for whole windows.
    """
    counts = {r["size"]: r.n for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bits = {
        size: (
            _power(SLOTS_EACH * n * max(1, size - 1), 8, MOST_SLOT_BITS if size == WINDOW_WORDS else 20),
            _power(BITS_EACH * n, 8, MOST_FILTER_BITS if size == WINDOW_WORDS else 20),
        )
        for size, n in counts.items()
    }
    entries = windows.select("size", "w").mapInArrow(_entries(bits), _ENTRIES)
    value = F.when(F.col("is_shift"), F.min("value")).otherwise(F.bit_or("value")).alias("value")
    merged = entries.groupBy("size", "is_shift", "at").agg(value)
    part = F.floor(F.col("at") / _PART).cast("int").alias("part")

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size, is_shift, number = (k.as_py() for k in key)
        cells = np.full(_PART, max(1, size - 1) if is_shift else 0, np.uint8)
        cells[table.column("at").to_numpy() % _PART] = table.column("value").to_numpy()
        row = {"size": [size], "is_shift": [is_shift], "part": [number], "cells": [cells.tobytes()]}
        return pa.table(row, schema=pa.schema([("size", pa.int32()), ("is_shift", pa.bool_()), ("part", pa.int32()), ("cells", pa.binary())]))

    parts = merged.select("*", part).groupBy("size", "is_shift", "part").applyInArrow(
        packed, "size int, is_shift boolean, part int, cells binary"
    )
    held = {(r["size"], r.is_shift, r.part): bytes(r.cells) for r in parts.collect()}
    found = []
    for size, (slot_bits, filter_bits) in sorted(bits.items()):
        blank = bytes([max(1, size - 1)]) * _PART, bytes(_PART)
        shift, kept = (
            b"".join(held.get((size, of, k), blank[not of]) for k in range(-(-cells // _PART)))
            for of, cells in ((True, 1 << slot_bits), (False, (1 << filter_bits) // 8))
        )
        found.append(Tables(size, slot_bits, filter_bits, shift, kept))
    return found


def _scan(shared, id_type: pa.DataType):
    """Per document a row with its words, then a row for each place that may be an occurrence."""
    names = ["row", "doc_id", "text_hash", "n_bytes", "n_words", "size", "start", "w"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, numbers = shared.value, count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            rows, words_in = [], []
            places: list[list] = [[], [], [], []]
            for text in batch.column(1):
                words = words_of(text.as_py())
                codes, row = word_codes(words), next(numbers)
                rows.append(row)
                words_in.append(len(words))
                for table in tables:
                    for start, found in table.search(words, codes):
                        for column, value in zip(places, (row, table.length, start, found)):
                            column.append(value)
                        if len(places[0]) == _FLUSH:
                            yield _places(places)
                            places = [[], [], [], []]
            if places[0]:
                yield _places(places)
            n = len(rows)
            held = [pa.array(rows, pa.int64()), batch.column(0), batch.column(2), batch.column(3), pa.array(words_in, pa.int64())]
            blank = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*held, *blank], names)

    def _places(places: list[list]) -> pa.RecordBatch:
        n = len(places[0])
        blank = [pa.nulls(n, t) for t in (id_type, pa.int64(), pa.int32(), pa.int64())]
        arrays = [pa.array(c, t) for c, t in zip(places, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([arrays[0], *blank, *arrays[1:]], names)

    return scan


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents ``(row, doc_id, text_hash, n_bytes, n_words)`` and occurrences ``(row, start, size, item)``.

    A window is ``WINDOW_WORDS`` consecutive words of an item of ``benchmark(item_id, text)``;
    an item of fewer words, but not none, is one window. Texts are read once, whatever the
    size of the benchmark: tables of a fixed size rule out nearly all places, and the few that
    are left are joined to the windows by their hash and compared as a whole. A passage that
    very many documents hold is a hot key of that join, whose sides are written, so that Spark
    splits it. ``row`` numbers the rows of ``docs(doc_id, text)``; nulls have no words. Items
    without an id count under the empty string, items that repeat an id or a text count once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    items = benchmark.select(item, F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct()
    held = scratch.table(items.mapInArrow(_windows, _WINDOWS).distinct(), "windows")
    tables = tables_of(held.select("size", "w").distinct())
    shared = spark.sparkContext.broadcast(tables)
    text = F.coalesce("text", F.lit("")).cast("binary")
    given = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("text_hash"), F.octet_length(text).alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType
    schema = f"row long, doc_id {kind.simpleString()}, text_hash long, n_bytes int, n_words long, size int, start long, w binary"
    scanned = scratch.table(given.mapInArrow(_scan(shared, _arrow_type(kind)), schema), "scanned")
    places = scanned.where("size is not null").select("row", "start", "size", "w")
    windows = held.select(F.col("item"), F.col("size").alias("s"), F.col("w").alias("text"))
    found = places.join(windows, (F.col("size") == F.col("s")) & (F.xxhash64("w") == F.xxhash64("text")) & (F.col("w") == F.col("text")))
    rows = scanned.where("size is null").select("row", "doc_id", "text_hash", "n_bytes", "n_words")
    return rows, found.select("row", "start", "size", "item")


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _covered() -> Column:
    """The words that occurrences of one row cover."""
    return F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("place")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, n_items, items, contaminated.

    ``n_hit`` are the words inside an occurrence, ``items`` the sorted ids, as strings, of the
    items with occurrences. Null and empty texts have no words; an empty benchmark finds
    nothing, an empty table gives none.
    """
    rows, found = occurrences(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    found = Scratch(docs.sparkSession).table(found, "found")
    spans = found.select("row", "start", "size").distinct()
    n_hit = spans.select("row", _covered()).distinct().groupBy(F.col("row").alias("r")).agg(F.count("*").alias("n_hit"))
    items = found.select("row", "item").distinct().groupBy(F.col("row").alias("i")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    all_of = rows.join(n_hit, F.col("row") == F.col("r"), "left").join(items, F.col("row") == F.col("i"), "left")
    hits = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return all_of.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        (hits > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, columns unchanged.

    Rows are left out by doc_id, length and hash of the text, so no text is written or moved
    but by a join that is too large for Spark to broadcast its other side.
    """
    rows, found = occurrences(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    hit = found.select(F.col("row").alias("r")).distinct()
    bad = rows.join(hit, F.col("row") == F.col("r")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("n_bytes").alias("n"))
    bad = Scratch(docs.sparkSession).table(bad.distinct(), "bad")
    held = docs.select(F.struct("*").alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    same = F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("h")) & (F.octet_length(text) == F.col("n"))
    return held.join(bad, same, "left_anti").select("row.*")


def oracle(window: int = WINDOW_WORDS) -> str:
    """DuckDB SQL for the contract's query over ``documents`` and ``benchmark``."""

    def words(text: str) -> str:
        lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"regexp_extract_all(coalesce({lowered}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    return f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("text")} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, least({window}, len(ws)) AS size,
    array_to_string(list_slice(ws, start, start + least({window}, len(ws)) - 1), ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {window} + 1, 1) + 1)) AS start FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS ws FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, start, array_to_string(list_slice(ws, start, start + size - 1), ' ') AS w
  FROM (SELECT r, ws, size, unnest(range(1, greatest(len(ws) - size + 1, 0) + 1)) AS start FROM d, sizes)),
found AS (SELECT r, start, p.size, item FROM places p JOIN windows q ON p.w = q.w AND p.size = q.size),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(start, start + size)) AS place FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""
