"""Near-duplicates by SimHash: segment bit counts, a grid over them, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.components import components
from logsift.llm.scratch import Scratch

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Bands of the 32 two-bit segments. A grid cell fixes all but RADIUS of them.
BANDS = 6
#: Fingerprints of a cell that one task compares with as many others at once.
CELL_CHUNK = 512

_SHINGLES_AT_ONCE = 1 << 16
_LOW_BITS = 0x5555555555555555


def fingerprint_bits(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text, as a signed integer.

    Words are the runs between ASCII white space after lower-casing A-Z; a text with fewer
    words than a shingle is one shingle; a text without words has fingerprint 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    size = min(shingle_words, len(words))
    total = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, total, _SHINGLES_AT_ONCE):
        part = words[start : start + _SHINGLES_AT_ONCE + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size))))
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
        counts += _bit_counts(np.frombuffer(digests, np.uint8).reshape(-1, 8))
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, highest bit first."""
    if len(rows) < 400:
        return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_bits(text) for text in batch], dtype="int64")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a long; null counts as a text without words."""
    return _fingerprints(F.coalesce(text, F.lit("")).cast("binary"))


def unary_counts(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each written in unary in its own two bits.

    The Manhattan distance of two count vectors is then the number of differing bits.
    It never exceeds the Hamming distance of the fingerprints.
    """
    low = np.uint64(_LOW_BITS)
    shifted = prints >> np.uint64(1)
    return ((prints | shifted) & low) | (((prints & shifted) & low) << np.uint64(1))


def _unary_counts(prints: Column) -> Column:
    low = F.lit(_LOW_BITS)
    shifted = F.shiftrightunsigned(prints, 1)
    some = prints.bitwiseOR(shifted).bitwiseAND(low)
    both = prints.bitwiseAND(shifted).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def grid_masks(bands: int = BANDS, radius: int = RADIUS) -> list[int]:
    """For each choice of ``bands - radius`` bands, the bits of their segments (signed)."""
    edges = [32 * k // bands for k in range(bands + 1)]
    bits = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(kept) for kept in combinations(bits, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest of index pairs that joins exactly what links within ``radius`` join.

    Manhattan distance of the count vectors rules out, the fingerprints decide.
    """
    counts, found = unary_counts(prints), []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            near = np.bitwise_count(counts[rest] ^ counts[i]) <= radius
            if near.any():
                near &= np.bitwise_count(prints[rest] ^ prints[i]) <= radius
                hits = rest[near]
                found += [(int(i), int(j)) for j in hits]
                front += hits.tolist()
                rest = rest[~near]
    return found


def _cell_links(radius: int):
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def of_cells(prints: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"a": x[i], "b": x[j]} for i, j in spanning_links(np.asarray(x, np.int64).view(np.uint64), radius)]
                for x in prints
            ]
        )

    return of_cells


def links(prints: DataFrame, radius: int = RADIUS, bands: int = BANDS, chunk: int = CELL_CHUNK) -> DataFrame:
    """``(a, b)``: distinct fingerprints of ``prints(fp)`` at ``radius`` or fewer differing bits.

    The 32 segment counts are cut into ``bands``. Counts at Manhattan
    distance ``radius`` or less differ in at most ``radius`` bands, so the two share a cell
    of the grid over the other bands; there are ``bands`` over ``radius`` such grids. Cells
    of more than ``chunk`` fingerprints are dealt out as pairs of chunks, each compared in
    its own task. A task returns a spanning forest of the links it finds, never all pairs.
    """
    counts = _unary_counts(F.col("fp"))
    cells = [F.xxhash64(F.lit(k), counts.bitwiseAND(F.lit(m))) for k, m in enumerate(grid_masks(bands, radius))]
    placed = prints.select("fp", F.explode(F.array(*cells)).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    n = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    shared = placed.join(sizes, "cell").withColumn("chunks", n)
    dealt = shared.select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    groups = dealt.groupBy("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    lists = groups.agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    found = lists.select(F.explode(_cell_links(radius)(F.col("members"))).alias("link"))
    return found.select("link.a", "link.b")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bands: int = BANDS, chunk: int = CELL_CHUNK) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that chains of links reach. Nodes are the distinct
    fingerprints, so a row without a doc_id links its neighbours like any other. Null and
    empty texts have fingerprint 0 and are linked like any other. Rows with a null doc_id get
    the component of their fingerprint, which is null if no row of the component has an id.
    An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.table(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "prints")
    nodes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    found = scratch.table(links(nodes, radius, bands, chunk).distinct(), "links")
    labels = components(found, scratch)
    rooted = nodes.join(labels, F.col("fp") == F.col("node"), "left")
    rooted = scratch.table(rooted.select("fp", "id", F.coalesce("component", "fp").alias("root")), "rooted")
    # Written, like the aggregate in ``components``, so that a root of many fingerprints is split.
    firsts = rooted.groupBy(F.col("root").alias("of")).agg(F.min("id").alias("component_id"))
    firsts = scratch.table(firsts, "firsts")
    named = rooted.join(firsts, F.col("root") == F.col("of")).select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, as ``first_rows`` takes it."""
    return first_rows(docs, near_duplicates(docs.select("doc_id", "text"), radius))


def first_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each component of ``groups(doc_id, component_id)``: that of the smallest doc_id.

    Columns stay as they are. Of rows that repeat this doc_id one stays. Rows with a null
    doc_id stay, as nothing names them.
    """
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    named = rows.where("row.doc_id is not null").join(first, F.col("row.doc_id") == F.col("kept"))
    one = named.groupBy("kept").agg(F.first("row").alias("row")).select("row.*")
    return one.union(rows.where("row.doc_id is null").select("row.*"))
