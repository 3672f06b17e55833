"""Hard negatives from an inverted multi-index: cells of two half-space codebooks, best cells first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.scratch import Scratch

POSITIVES, NEGATIVES = 5, 10
#: A negative scores between these percentages of its positive.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Codewords of each half, at most, and rows that they are fitted on.
CODEWORDS, SAMPLE = 64, 16_384
#: Rows that an anchor's first cells hold together, before anything is known about its scores.
FIRST_ROWS = 4_096
#: Rows are dealt into at least so many segments, none larger than so many bytes of vectors.
SEGMENTS, SEGMENT_BYTES = 64, 1 << 24
#: Anchors of one group, and rows that are compared with them at once.
ANCHORS, COMPARED = 1_024, 2_048


def quantised(embedding: Column) -> Column:
    """Every component as floor(256 x), x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 256))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of ``vectors(vec_id, label, embedding)`` that have all three, all components finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where("vec_id is not null and label is not null and embedding is not null").where(~bad)


@dataclass(frozen=True)
class Index:
    """Codewords of both halves, how far the rows of a codeword lie from it, rows of each cell.

    ``first`` and ``parts`` give the segments of a cell: small cells share one, a cell that is
    too large has several.
    """

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    dtype: str
    exact: bool  # inner products are whole in double precision

    def unpacked(self, packed) -> np.ndarray:
        """Integer vectors, one a row."""
        dims = sum(book.shape[1] for book in self.books)
        return np.frombuffer(b"".join(packed), self.dtype).reshape(len(packed), dims)

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector and codeword of each half, what no row of it scores above in this half."""
        cut = self.books[0].shape[1]
        found = []
        for part, book, radius in zip((vectors[:, :cut], vectors[:, cut:]), self.books, self.radii):
            part = part.astype(float)
            found.append(part @ book.T + np.linalg.norm(part, axis=1)[:, None] * radius)
        return tuple(found)

    @staticmethod
    def slack(bound: np.ndarray | float):
        """Room for rounding in a bound; scores are whole numbers."""
        return 0.5 + 1e-9 * np.abs(bound)

    def visit(self, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, float]]:
        """Every cell with its bound, highest first: both halves sorted, merged by a heap."""
        rows, columns = np.argsort(-u, kind="stable").tolist(), np.argsort(-v, kind="stable").tolist()
        u, v = u.tolist(), v.tolist()
        heap = [(-u[rows[0]] - v[columns[0]], 0, 0)]
        while heap:
            bound, i, j = heappop(heap)
            yield rows[i] * len(v) + columns[j], -bound
            if j + 1 < len(columns):
                heappush(heap, (-u[rows[i]] - v[columns[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(rows):
                heappush(heap, (-u[rows[i + 1]] - v[columns[0]], i + 1, 0))

    def route(self, vectors: np.ndarray, bounds: list[float | None], first_rows: int) -> list[dict]:
        """Per vector how far the heap went, and the segments of the cells it visited.

        With a bound it stops at the first cell below; without, as soon as the cells hold
        ``first_rows``. Empty cells are passed over.
        """
        found = []
        for u, v, least in zip(*self.bounds(vectors), bounds):
            seen, reached, segments = 0, np.inf, set()
            stop = None if least is None else least - self.slack(least)
            for cell, bound in self.visit(u, v):
                if (seen >= first_rows and bound < reached) if stop is None else bound < stop:
                    break
                reached = bound
                if n := int(self.counts[cell]):
                    seen += n
                    segments.update(range(self.first[cell], self.first[cell] + self.parts[cell]))
            else:
                reached = -np.inf
            found.append({"reached": reached if stop is None or reached == -np.inf else least, "segments": sorted(segments)})
        return found


def _codebook(sample: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Codewords by k-means, from rows of the sample that differ."""
    rng = np.random.default_rng(12)
    distinct = np.unique(sample, axis=0)
    book = distinct[np.sort(rng.permutation(len(distinct))[:size])].astype(float)
    for _ in range(rounds):
        near = _nearest(sample, book)
        counts = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, sample)
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * rows @ book.T).argmin(axis=1)


_SQL = "vec_id long, label long, asks boolean, packed binary, cell int, far0 double, far1 double"


def _celled(rows: DataFrame, books: tuple[np.ndarray, np.ndarray], dtype: str) -> DataFrame:
    """Rows with their vector packed, their cell and how far each half lies from its codeword."""
    cut, dims = books[0].shape[1], sum(book.shape[1] for book in books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, dims)
            halves, cells, far = (vectors[:, :cut].astype(float), vectors[:, cut:].astype(float)), [], []
            for part, book in zip(halves, books):
                near = _nearest(part, book)
                cells.append(near)
                far.append(np.linalg.norm(part - book[near], axis=1))
            packed = [row.tobytes() for row in vectors.astype(dtype)]
            columns = [
                *(batch.column(c) for c in ("vec_id", "label", "asks")), pa.array(packed, pa.binary()),
                pa.array(cells[0] * len(books[1]) + cells[1], pa.int32()), *map(pa.array, far),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "asks", "packed", "cell", "far0", "far1"])

    return rows.select("vec_id", "label", "asks", "vector").mapInArrow(assign, _SQL)


def _segments(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First segment and number of segments of every cell, neighbouring small cells together."""
    first, parts = np.zeros(len(counts), int), np.ones(len(counts), int)
    segment, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > most:
            segment, held = segment + 1, 0
        first[cell], parts[cell] = segment, max(1, -(-n // most))
        held += n
        if parts[cell] > 1:
            segment, held = segment + int(parts[cell]), 0
    return first, parts


def build(rows: DataFrame, scratch: Scratch, n: int, dims: int, most: int) -> tuple[Index, DataFrame]:
    """The index, and ``(vec_id, label, asks, packed, cell, segment)`` of every row.

    ``rows(vec_id, label, asks, vector)`` are ``n`` rows with integer components of at most
    ``most``. Codewords are fitted on at most ``SAMPLE`` rows, drawn by hash; every row is indexed.
    """
    draw = F.pmod(F.xxhash64("vec_id", F.lit(12)), F.lit(1 << 30))
    drawn = rows.where(draw < int(min(1.0, 2 * SAMPLE / n) * (1 << 30))).orderBy(draw, "vec_id").limit(SAMPLE)
    sample = [r.vector for r in drawn.select("vector").collect()] or [[0] * dims]
    sample = np.array(sample, float).reshape(len(sample), dims)
    size, cut = max(1, min(CODEWORDS, int(len(sample) ** 0.5 / 2))), dims // 2
    books = (_codebook(sample[:, :cut], size), _codebook(sample[:, cut:], size))
    dtype = next(t for t, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < top)
    celled = scratch.table(_celled(rows, books, dtype), "celled")
    # At most CODEWORDS ** 2 rows.
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far0").alias("far0"), F.max("far1").alias("far1")).collect()
    counts = np.zeros(len(books[0]) * len(books[1]), int)
    radii = (np.zeros(len(books[0])), np.zeros(len(books[1])))
    for cell in cells:
        counts[cell.cell] = cell.n
        for radius, word, far in zip(radii, divmod(cell.cell, len(books[1])), (cell.far0, cell.far1)):
            radius[word] = max(radius[word], far)
    width = max(1, dims) * np.dtype(dtype).itemsize
    first, parts = _segments(counts, max(1, min(-(-n // SEGMENTS), SEGMENT_BYTES // width)))
    index = Index(books, radii, counts, first, parts, dtype, exact=dims * most * most < 1 << 53)
    places = celled.sparkSession.createDataFrame(
        [(int(c.cell), int(first[c.cell]), int(parts[c.cell])) for c in cells], "at int, first int, parts int"
    )
    held = celled.join(F.broadcast(places), F.col("cell") == F.col("at"))
    segment = F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(13)), "parts")
    return index, held.select("vec_id", "label", "asks", "packed", "cell", segment.cast("int").alias("segment"))


def _top(scores: np.ndarray, valid: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``keep`` highest valid scores of every row; ties go to the first columns."""
    floor = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    work = np.where(valid, scores, floor)
    if work.shape[1] > keep:
        bar = np.partition(work, -keep, axis=1)[:, -keep][:, None]
    else:
        bar = work.min(axis=1, keepdims=True)
    above, level = work > bar, work == bar
    level &= np.cumsum(level, axis=1) <= keep - above.sum(axis=1, keepdims=True)
    return np.nonzero((above | level) & valid)


def window_of(positive: int, least: int, most: int) -> tuple[int, int]:
    """Lowest and highest whole score between two percentages of a positive's score."""
    return -(-least * positive // 100), most * positive // 100


def _best_of(parts: list[tuple], keep: int) -> tuple:
    """The ``keep`` best of every (anchor, place) from lists of anchor, place, id, score."""
    anchor, place, ids, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, -score, place, anchor))
    anchor, place, ids, score = anchor[order], place[order], ids[order], score[order]
    key = anchor * (int(place.max(initial=0)) + 1) + place
    best = np.arange(len(key)) - np.searchsorted(key, key) < keep
    return anchor[best], place[best], ids[best], score[best]


_FOUND = "anchor_id long, place int, vec_id long, score long"


def _searched(
    index: Index, held: DataFrame, asking: DataFrame, same: bool, keep: int, percents: tuple[int, int], group: int
) -> DataFrame:
    """``(anchor_id, place, vec_id, score)``: the best rows of each anchor in the cells on its route.

    ``asking(anchor_id, label, packed, of, reached, segments)``. With ``same`` the rows have the
    anchor's label and there is one place; without, they have another one, and place k is the
    window of the k-th score in ``of``.
    """
    asks = asking.select("*", F.explode("segments").alias("segment")).drop("segments")
    sizes = asks.groupBy("segment").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
    sizes = sizes.withColumnRenamed("segment", "s")
    block = F.pmod(F.xxhash64("anchor_id", F.lit(14)), F.col("blocks")).cast("int").alias("block")
    asks = asks.join(sizes, F.col("segment") == F.col("s")).select(
        "segment", block, F.lit(True).alias("asks"), F.col("anchor_id").alias("vec_id"), "label", "packed",
        F.lit(-1).alias("cell"), "of", "reached",
    )
    rows = held.join(sizes, F.col("segment") == F.col("s")).select(
        "segment", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"),
        "vec_id", "label", "packed", "cell", F.lit(None).cast("array<long>").alias("of"),
        F.lit(None).cast("double").alias("reached"),
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
        is_ask = table.column("asks").to_numpy()
        ids, labels, cells = (table.column(c).to_numpy() for c in ("vec_id", "label", "cell"))
        vectors = index.unpacked(table.column("packed").to_pylist()).astype(float if index.exact else np.int64)
        asked, rest = vectors[is_ask], vectors[~is_ask]
        ask_ids, ask_labels, rest_ids, rest_labels = ids[is_ask], labels[is_ask], ids[~is_ask], labels[~is_ask]
        cells = cells[~is_ask]
        reached = table.filter(table.column("asks")).column("reached").to_numpy()
        stop = np.where(np.isinf(reached), reached, reached - index.slack(np.where(np.isinf(reached), 0, reached)))
        places = 1
        if not same:
            of = table.filter(table.column("asks")).column("of").to_pylist()
            places = max(map(len, of), default=0)
            ranges = np.array([[window_of(p, *percents) for p in x] + [(1, 0)] * (places - len(x)) for x in of])
        u, v = index.bounds(asked)
        cuts = np.flatnonzero(np.diff(cells, prepend=-1))
        found, held_rows = [tuple(np.zeros(0, np.int64) for _ in range(4))], 0
        for start, end in zip(cuts, [*cuts[1:], len(cells)]):
            i, j = divmod(int(cells[start]), len(index.books[1]))
            on = np.flatnonzero(u[:, i] + v[:, j] >= stop)
            for at in range(start, end if len(on) else start, COMPARED):
                to = min(end, at + COMPARED)
                scores = asked[on] @ rest[at:to].T
                alike = ask_labels[on][:, None] == rest_labels[None, at:to]
                valid = alike & (ask_ids[on][:, None] != rest_ids[None, at:to]) if same else ~alike
                for place in range(places):
                    inside = valid
                    if not same:
                        low, high = ranges[on, place].T[:, :, None]
                        inside = valid & (scores >= low) & (scores <= high)
                    row, column = _top(scores, inside, keep)
                    found.append((on[row], np.full(len(row), place), rest_ids[at:to][column], scores[row, column].astype(np.int64)))
                    held_rows += len(row)
                if held_rows > 1_000_000:
                    found = [_best_of(found, keep)]
                    held_rows = 0
        anchor, place, near, score = _best_of(found, keep)
        arrays = [pa.array(ask_ids[anchor]), pa.array(place, pa.int32()), pa.array(near), pa.array(score)]
        return pa.Table.from_arrays(arrays, ["anchor_id", "place", "vec_id", "score"])

    found = asks.union(rows).groupBy("segment", "block").applyInArrow(compare, _FOUND)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _routed(asking: DataFrame, index: Index, bound: Column | None) -> DataFrame:
    """Adds the segments on each anchor's way down to ``bound``, and how far it went."""
    first_rows = FIRST_ROWS

    @F.pandas_udf(T.StructType([T.StructField("reached", T.DoubleType()), T.StructField("segments", T.ArrayType(T.IntegerType()))]))
    def way(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for packed, least in batches:
            bounds = [None if x is None or x != x else float(x) for x in least.tolist()]
            yield pd.DataFrame(index.route(index.unpacked(packed.tolist()), bounds, first_rows), columns=["reached", "segments"])

    least = F.lit(None).cast("double") if bound is None else bound.cast("double")
    routed = asking.drop("reached").withColumn("way", way(F.col("packed"), least))
    return routed.select("anchor_id", "label", "packed", "of", "way.reached", "way.segments")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percents: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT),
    group: int = ANCHORS,
) -> DataFrame:
    """Negatives of each anchor and positive that score within a window below the positive.

    ``vectors(vec_id, label, vector)`` hold arrays of integers; a score is an inner product with
    the anchor, ties go to the smaller vec_id. An anchor's positives are its best other rows of
    the same label. For each, the result has the best rows of other labels whose score lies
    between ``percents`` of the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. Fewer rows than asked for give fewer, none give none.

    The result is exact. Every row lies in a cell of two half-space codewords. The sum of both
    halves' scores, each with the radius of its codeword, bounds what a cell's rows score; a
    heap walks the cells of an anchor in the order of these sums. Four passes, each a join of
    anchors and the segments on their way: the first cells give positives; cells that may
    hold better ones follow; the same cells give negatives; cells that may change a window
    follow. An anchor stops as soon as no cell ahead can change its result.

    Rows lacking vec_id, label, vector or a component take no part, nor do vectors of another
    length than the most frequent one, nor those with components so large that a score may
    leave 64 bits. Of rows that repeat a vec_id the smallest by label, then vector, counts.
    Other columns are not read. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    given = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), is_anchor.alias("asks"), F.col("vector").cast("array<long>").alias("vector")
    ).where("vec_id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    one = F.min(F.struct("label", "vector", F.coalesce("asks", F.lit(False)).alias("asks"))).alias("row")
    given = scratch.table(given.groupBy("vec_id").agg(one).select("vec_id", "row.*"), "given")
    length = given.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if length is None:
        return spark.createDataFrame([], empty)
    room = int(((1 << 63) - 1) // max(1, length.d)) ** 0.5 * (1 - 1e-9)
    given = given.where((F.size("vector") == length.d) & ~F.exists("vector", lambda x: (x > int(room)) | (x < -int(room))))
    most = F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))
    shape = given.agg(F.count("*").alias("n"), F.coalesce(most, F.lit(0)).alias("most")).first()
    if not shape.n:
        return spark.createDataFrame([], empty)
    index, held = build(given, scratch, shape.n, length.d, shape.most)
    held = scratch.table(held, "held")
    anchors = held.where("asks").select(
        F.col("vec_id").alias("anchor_id"), "label", "packed", F.lit(None).cast("array<long>").alias("of")
    )

    def search(asking: DataFrame, same: bool, keep: int) -> DataFrame:
        return _searched(index, held, asking, same, keep, percents, group)

    # Positives in the first cells, then in all cells that may hold better ones.
    way = scratch.table(_routed(anchors, index, None), "way-0")
    near = scratch.table(search(way, True, positives), "near-0")
    worst = near.groupBy(F.col("anchor_id").alias("a")).agg(F.count("*").alias("n"), F.min("score").alias("score"))
    least = F.when(F.col("n") >= positives, F.col("score")).otherwise(F.lit(float("-inf")))
    reach = way.select("anchor_id", "reached").join(worst, F.col("anchor_id") == F.col("a"), "left").select(
        F.col("anchor_id").alias("a"), "reached", F.coalesce(least.cast("double"), F.lit(float("-inf"))).alias("least")
    )
    reach = scratch.table(reach, "reach-0")
    ahead = reach.where("least < reached")
    on = anchors.join(ahead.select("a", "least"), F.col("anchor_id") == F.col("a"))
    way_on = scratch.table(_routed(on, index, F.col("least")), "way-1")
    again = search(way_on, True, positives)
    near = scratch.table(near.join(ahead, F.col("anchor_id") == F.col("a"), "left_anti").union(again), "near-1")

    # Negatives in the same cells, then in all cells that may change a window.
    of = near.groupBy(F.col("anchor_id").alias("p")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    of = scratch.table(of, "positives")
    asking = anchors.drop("of").join(of.select("p", F.col("found.score").alias("of")), F.col("anchor_id") == F.col("p")).drop("p")
    both = way.join(ahead, F.col("anchor_id") == F.col("a"), "left_anti").select("anchor_id", "reached", "segments")
    both = both.union(way_on.select("anchor_id", "reached", "segments")).withColumnRenamed("anchor_id", "w")
    asking = scratch.table(asking.join(both, F.col("anchor_id") == F.col("w")).drop("w"), "asking-0")
    far = scratch.table(search(asking, False, negatives), "far-0")
    low, high = (F.col("score").cast("decimal(20,0)") * p / 100 for p in percents)
    windows = of.select(F.col("p"), F.posexplode("found.score").alias("k", "score")).select(
        "p", "k", F.ceil(low).cast("long").alias("low"), F.floor(high).cast("long").alias("high")
    )
    had = far.groupBy(F.col("anchor_id").alias("a"), F.col("place")).agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    met = windows.where("low <= high").join(had, (F.col("p") == F.col("a")) & (F.col("k") == F.col("place")), "left")
    need = met.groupBy("p").agg(F.min(F.when(F.col("n") >= negatives, F.col("worst")).otherwise(F.col("low"))).alias("need"))
    open_ = asking.select("anchor_id", "reached").join(need, F.col("anchor_id") == F.col("p")).where("need < reached")
    open_ = scratch.table(open_.select("p", "need"), "open")
    on = asking.drop("segments", "reached").join(open_, F.col("anchor_id") == F.col("p"))
    way_on = scratch.table(_routed(on, index, F.col("need")), "way-2")
    again = search(way_on, False, negatives)
    far = far.join(open_, F.col("anchor_id") == F.col("p"), "left_anti").union(again)
    listed = of.select("p", F.posexplode("found").alias("k", "positive"))
    joined = far.join(listed, (F.col("anchor_id") == F.col("p")) & (F.col("place") == F.col("k")))
    return joined.select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def oracle() -> str:
    """DuckDB SQL for the contract's query over ``embeddings``."""
    return f"""
WITH shaped AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT DISTINCT ON (vec_id) * FROM shaped ORDER BY vec_id, label, v),
r AS (SELECT * FROM one WHERE len(v) = (SELECT len(v) FROM one GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND {LEAST_PERCENT} * p.score <= 100 * n.score AND 100 * n.score <= {MOST_PERCENT} * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= {NEGATIVES}"""
