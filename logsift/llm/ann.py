"""Approximate nearest neighbours by cross-polytope hashing with multiprobe."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.scratch import Scratch

TABLES = 8
NEIGHBOURS = 20
#: Sampled queries whose true neighbours set the number of probes, and the recall to reach.
SAMPLE_QUERIES, RECALL = 64, 0.96
#: A query whose found neighbours let expect less recall than this is compared with all vectors.
LEAST_RECALL = 0.9
#: Rotations that one table may join, and probes of a table that joins several.
JOINED, MOST_PROBES = 3, 256
#: Vectors whose buckets tell how many candidates a choice of rotations and probes gives, and
#: comparisons that cost as much as sending a query to one more bucket.
SHARE_ROWS, ROW_COST = 4096, 30
#: Random pairs at each cosine from which the chance to be found is estimated.
TRIED_PAIRS = 300
#: Vectors and queries of a bucket that one task compares at once.
CHUNK = 2048
SEED = 8


@dataclass(frozen=True)
class Hashing:
    """Pseudo-rotations: three rounds of random signs and a fast Hadamard transform.

    ``reach`` is the largest norm. Where norms differ, a coordinate is added that brings
    every vector to it, so that the largest inner product is the nearest direction.
    """

    dims: int
    reach: float
    lifted: bool
    tables: int = TABLES
    joined: int = 1

    @property
    def width(self) -> int:
        return 1 << max(0, (self.dims + self.lifted - 1).bit_length())

    @property
    def axes(self) -> int:
        """Signed axes of one rotation; a table has as many buckets to the power of ``joined``."""
        return 2 * self.width

    def rotated(self, vectors: np.ndarray, lift: bool) -> Iterator[list[np.ndarray]]:
        """The vectors under the rotations of each table."""
        padded = np.zeros((len(vectors), self.width))
        padded[:, : self.dims] = vectors
        if self.lifted and lift:
            rest = self.reach**2 - (padded**2).sum(axis=1)
            padded[:, self.dims] = np.sqrt(np.maximum(rest, 0))
        signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (self.tables, self.joined, 3, self.width))
        for table in signs:
            turned_by = []
            for rounds in table:
                turned = padded
                for flips in rounds:
                    turned = _hadamard(turned * flips)
                turned_by.append(turned)
            yield turned_by

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Per vector and table its bucket: of every rotation the nearest signed axis, which is
        2 * axis, plus 1 if negative, as one number."""
        found = []
        for rotations in self.rotated(vectors, lift=True):
            code = np.zeros(len(vectors), np.int64)
            for turned in rotations:
                axis = np.abs(turned).argmax(axis=1)
                code = code * self.axes + 2 * axis + (turned[np.arange(len(turned)), axis] < 0)
            found.append(code)
        return np.stack(found, axis=1)

    def probes(self, queries: np.ndarray, most: int) -> np.ndarray:
        """Per query and table the ``most`` nearest buckets: those whose gaps between the nearest
        signed axis and their own, added over the rotations, are smallest."""
        found = []
        for rotations in self.rotated(queries, lift=False):
            codes = sums = None
            for turned in rotations:
                both = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :most]
                score = np.take_along_axis(both, order, axis=1)
                if codes is None:
                    codes, sums = order, score
                    continue
                # Of two falling lists, the best sums are at places whose product is small.
                i, j = np.meshgrid(np.arange(codes.shape[1]), np.arange(order.shape[1]), indexing="ij")
                near = (i + 1) * (j + 1) <= most
                i, j = i[near], j[near]
                total = sums[:, i] + score[:, j]
                best = np.argsort(-total, axis=1, kind="stable")[:, :most]
                codes = np.take_along_axis(codes[:, i] * self.axes + order[:, j], best, axis=1)
                sums = np.take_along_axis(total, best, axis=1)
            found.append(codes)
        return np.stack(found, axis=1)


def _hadamard(rows: np.ndarray) -> np.ndarray:
    n, width, step = len(rows), rows.shape[1], 1
    while step < width:
        pairs = rows.reshape(n, -1, 2, step)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2)
        rows, step = rows.reshape(n, width), 2 * step
    return rows


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b in double precision, summed left to right, so
    that equal vectors always score the same."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k].astype(float) * b[:, k]
    return total


def nearest(queries, query_ids, vectors, ids, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, vector id and score of the k best vectors of each query, itself left out.

    Ties go to the smaller id. Blocked products only preselect, with room for their error.
    """
    out_q, out_v, out_s = [], [], []
    for start in range(0, len(queries), 256):
        part, part_ids = queries[start : start + 256], query_ids[start : start + 256]
        rough = part.astype(float) @ vectors.T.astype(float)
        rough[part_ids[:, None] == ids[None, :]] = -np.inf
        if rough.shape[1] > k:
            bar = np.partition(rough, -k, axis=1)[:, -k]
        else:
            bar = np.full(len(part), -np.inf)
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))
        row, col = np.nonzero((rough >= (bar - slack)[:, None]) & (rough > -np.inf))
        score = exact_products(part[row], vectors[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out_q.append(part_ids[row[keep]])
        out_v.append(ids[col[keep]])
        out_s.append(score[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_v, out_s))


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that take part, as arrays of doubles.

    Left out are rows without vec_id or vector, zero vectors, those that hold null or
    non-finite components, and those whose length is not the most frequent one.
    """
    rows = vectors.where("vec_id is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (length.d if length else 0))


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


_SCORED = "query_id long, vec_id long, score double"


def _scored(found) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.float64())
    arrays = [pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(found, types)]
    return pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with rank; a vector counts once."""
    once = scored.repartition("query_id").dropDuplicates(["query_id", "vec_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exhaustive(vectors: DataFrame, queries: list, k: int = NEIGHBOURS) -> DataFrame:
    """The true neighbours of a bounded list of ``(vec_id, embedding)`` among all vectors."""
    query_ids = np.array([q[0] for q in queries], np.int64)
    query_rows = np.array([q[1] for q in queries], float)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _scored(nearest(query_rows, query_ids, _stack(batch.column(1)), batch.column(0).to_numpy(), k))

    return _best(vectors.mapInArrow(compare, _SCORED), k)


@dataclass(frozen=True)
class Plan:
    """Rotations, probes a table, and candidates a query in shares of all vectors.

    A vector counts in ``share`` once for each table in which a query meets it.
    """

    hashing: Hashing
    probes: int
    share: float


def plan(hashing: Hashing, vectors: DataFrame, queries: DataFrame, n: int, recall: float, k: int) -> Plan:
    """How many rotations a table joins, and the fewest probes at which sampled queries find
    ``recall`` of their neighbours.

    The sample is the first ``SAMPLE_QUERIES`` queries by hash; their neighbours are found by
    comparing them with all vectors. More rotations make smaller buckets, and more of them to
    probe; the choice with the fewest comparisons is taken, by the buckets of ``SHARE_ROWS``
    vectors. So it follows the number of vectors and how they lie.
    """
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    if not sample:
        return Plan(hashing, 1, 0.0)
    rows = {q.vec_id: np.array(q.embedding) for q in sample}
    true = exhaustive(vectors, [(i, v) for i, v in rows.items()], k)
    found = true.join(vectors.dropDuplicates(["vec_id"]), "vec_id").select("query_id", "embedding").collect()
    if not found:
        return Plan(hashing, 1, 0.0)
    some = vectors.orderBy(F.xxhash64("vec_id", F.lit(6)), "vec_id").limit(SHARE_ROWS).select("embedding").collect()
    some = np.array([r.embedding for r in some])
    asking, near = np.array([rows[r.query_id] for r in found]), np.array([r.embedding for r in found])
    plans = []
    for joined in range(1, JOINED + 1):
        tried = replace(hashing, joined=joined)
        most = tried.axes if joined == 1 else min(MOST_PROBES, tried.axes**joined)
        probes = int(np.quantile(probes_needed(tried, asking, near, most), recall, method="higher"))
        if probes <= most:
            plans.append(Plan(tried, probes, candidate_share(tried, np.array(list(rows.values())), some, probes)))
    return min(plans, key=lambda p: p.share * n + p.probes * p.hashing.tables * ROW_COST)


def probes_needed(hashing: Hashing, queries: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Per row the fewest probes a table at which the query finds the vector; ``most`` + 1 if it doesn't."""
    found = []
    for start in range(0, len(queries), 128):
        held = hashing.buckets(vectors[start : start + 128])
        hit = hashing.probes(queries[start : start + 128], most) == held[:, :, None]
        place = np.where(hit.any(axis=2), hit.argmax(axis=2), most)
        found.append(place.min(axis=1) + 1)
    return np.concatenate(found) if found else np.zeros(0, int)


def candidate_share(hashing: Hashing, queries: np.ndarray, vectors: np.ndarray, probes: int) -> float:
    """Comparisons of a query, in shares of the vectors."""
    held, probed = hashing.buckets(vectors), hashing.probes(queries, probes)
    met = sum(np.isin(held[:, t], of[t]).sum() for of in probed for t in range(hashing.tables))
    return met / max(1, len(queries) * len(vectors))


def chances(hashing: Hashing, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines from -1 to 1 and how often random pairs at each are found by ``probes``.

    Under random rotations the chance of a pair depends on its cosine alone.
    """
    dims = hashing.dims + hashing.lifted
    rng = np.random.default_rng(SEED + 1)
    plain = Hashing(dims, 1.0, lifted=False, tables=hashing.tables, joined=hashing.joined)
    cosines, found = np.linspace(-1, 1, 41), []
    for cosine in cosines:
        a, b = rng.normal(size=(2, TRIED_PAIRS, dims))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        pairs = cosine * a + np.sqrt(1 - cosine**2) * b
        found.append((probes_needed(plain, a, pairs, probes) <= probes).mean())
    return cosines, np.maximum.accumulate(found)


def unfinished(found: DataFrame, queries: DataFrame, hashing: Hashing, probes: int, want: int) -> DataFrame:
    """Queries with fewer than ``want`` rows, and those that may have missed too many.

    True neighbours score at least as high as the ones found, so the chance at the scores
    found, summed over ``want``, bounds the expected recall of a query from below.
    """
    cosines, chance = (x.tolist() for x in chances(hashing, probes))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    asked = queries.select(F.col("vec_id").alias("q"), (norm * hashing.reach).alias("most")).dropDuplicates(["q"])
    step = cosines[1] - cosines[0]
    place = F.least(F.greatest((F.col("score") / F.col("most") + 1) / step, F.lit(0.0)), F.lit(len(cosines) - 1.0))
    low = F.least(F.floor(place), F.lit(len(cosines) - 2)).cast("int")
    table = F.array(*map(F.lit, chance))
    at = F.get(table, low) + (place - low) * (F.get(table, low + 1) - F.get(table, low))
    scored = asked.join(found, F.col("q") == F.col("query_id"), "left")
    per_query = scored.groupBy("q").agg(F.count("query_id").alias("n"), F.sum(at).alias("sum"))
    return per_query.where((F.col("n") < want) | (F.col("sum") < LEAST_RECALL * want)).select("q")


def _codes(hashing: Hashing, probes: int | None) -> Column:
    """Per vector the number of its bucket, or of a query's probes, in each table."""
    base = hashing.axes**hashing.joined * np.arange(hashing.tables)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for start in range(0, len(batch), 256):
                rows = np.stack(batch.iloc[start : start + 256].to_list())
                if probes is None:
                    codes = hashing.buckets(rows) + base
                else:
                    codes = (hashing.probes(rows, probes) + base[:, None]).reshape(len(rows), -1)
                out += list(codes)
            yield pd.Series(out, dtype=object)

    return coded(F.col("embedding"))


def _dealt(placed: DataFrame, own: str, other: str, chunk: int, groups: int) -> DataFrame:
    """Rows of a bucket in chunks, each copied for every chunk of the other side.

    Buckets that are one chunk on both sides share ``groups`` groups; the others have their own.
    """
    parts = {n: F.ceil(F.col(n) / chunk).cast("int") for n in (own, other)}
    small = (F.col("nv") <= chunk) & (F.col("nq") <= chunk)
    group = F.when(small, F.pmod(F.xxhash64("code", F.lit(9)), F.lit(groups))).otherwise(F.col("code") + groups + 1)
    dealt = placed.select(
        group.alias("bunch"), "code", "vec_id", "embedding",
        F.pmod(F.xxhash64("vec_id", F.lit(5)), parts[own]).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), parts[other] - 1)).alias(other), F.lit(own == "nq").alias("asks"),
    )
    return dealt.select("bunch", "code", "nv", "nq", "asks", "vec_id", "embedding")


def _compared(held: DataFrame, asking: DataFrame, k: int, chunk: int, groups: int = 1) -> DataFrame:
    """The k best of each query in the buckets of ``(code, vec_id, embedding, nv, nq)``."""
    both = _dealt(held, "nv", "nq", chunk, groups).union(_dealt(asking, "nq", "nv", chunk, groups))

    def compare(group: pa.Table) -> pa.Table:
        codes = group.column("code").to_numpy()
        order = np.argsort(codes, kind="stable")
        asks, ids = group.column("asks").to_numpy()[order], group.column("vec_id").to_numpy()[order]
        rows = _stack(group.column("embedding").combine_chunks())[order]
        starts = np.flatnonzero(np.diff(codes[order], prepend=codes.min() - 1))
        found = []
        for a, b in zip(starts, [*starts[1:], len(codes)]):
            q = a + np.flatnonzero(asks[a:b])
            v = a + np.flatnonzero(~asks[a:b])
            if len(q) and len(v):
                found.append(nearest(rows[q], ids[q], rows[v], ids[v], k))
        merged = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0)] * 3
        return pa.Table.from_batches([_scored(merged)])

    return _best(both.groupBy("bunch", "nv", "nq").applyInArrow(compare, _SCORED), k)


def search(
    vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, recall: float = RECALL, chunk: int = CHUNK
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for each row with ``is_query``.

    ``vectors(vec_id, embedding)`` are all candidates but the query's own row. Nearness is the
    largest inner product in double precision, ties go to the smaller vec_id. Every vector
    lies in one bucket of each table, named by its nearest signed axes under one rotation or
    several (see ``plan``); a query looks into the nearest buckets. Small buckets share a group,
    of a large one each pair of chunks of its vectors and queries is a group; a group returns
    at most k rows for a query and bucket. Equal vectors share their buckets and are all compared. Queries that
    are ``unfinished`` then are compared with all vectors, chunk by chunk in the same way.
    Rows that repeat a vec_id count once. See ``usable`` for vectors that take no part. Fewer
    candidates than k, or none, give fewer rows; an empty table gives none.
    """
    scratch = Scratch(vectors.sparkSession)
    asked = vectors.select("vec_id", "embedding", is_query.alias("asks"))
    rows = usable(asked).select("vec_id", "embedding")
    ids = asked.where("asks and vec_id is not null").select(F.col("vec_id").cast("long").alias("q")).distinct()
    rows = scratch.table(rows, "vectors")
    queries = rows.join(ids, F.col("vec_id") == F.col("q"), "left_semi")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    shape = rows.agg(F.max(norm).alias("most"), F.min(norm).alias("least"), F.max(F.size("embedding")).alias("dims")).first()
    if shape.dims is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashing = Hashing(shape.dims, shape.most, lifted=shape.most - shape.least > 1e-5 * shape.most)
    n, ids_of = rows.agg(F.count("*"), F.count_distinct("vec_id")).first()
    chosen = plan(hashing, rows, queries, n, recall, k)
    hashing, probes = chosen.hashing, chosen.probes
    held = rows.select("vec_id", "embedding", F.explode(_codes(hashing, None)).alias("code"))
    asking = queries.select("vec_id", "embedding", F.explode(_codes(hashing, probes)).alias("code"))
    n_held = held.groupBy("code").agg(F.count("*").alias("nv"))
    n_asking = asking.groupBy("code").agg(F.count("*").alias("nq"))
    sizes = scratch.table(n_held.join(n_asking, "code"), "sizes")
    rows_in = sizes.agg(F.sum(F.least("nv", F.lit(chunk)) + F.least("nq", F.lit(chunk)))).first()[0] or 0
    found = _compared(held.join(sizes, "code"), asking.join(sizes, "code"), k, chunk, max(1, -(-rows_in // chunk)))
    found = scratch.table(found, "found")
    again = unfinished(found, queries, hashing, probes, min(k, ids_of - 1))
    again = scratch.table(queries.join(again, F.col("vec_id") == F.col("q"), "left_semi"), "again")
    if not (n_again := again.count()):
        return found
    whole = [F.lit(-1).alias("code"), "vec_id", "embedding", F.lit(n).alias("nv"), F.lit(n_again).alias("nq")]
    exact = _compared(rows.select(*whole), again.select(*whole), k, chunk)
    redone = again.select(F.col("vec_id").alias("query_id")).distinct()
    return found.join(redone, "query_id", "left_anti").union(exact)
