from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import hardneg, queries

SCHEMA = "vec_id long, label int, vector array<long>, segment int, score double, asks string, cell int, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, 0.5, "x", 2, "y") for i, y, v in rows], SCHEMA)


def brute_force(rows, positives, negatives, percents):
    """Python integers, every row against every anchor."""
    first = {}
    for i, y, v in rows:
        if i is not None and y is not None and v is not None and None not in v:
            first[i] = min(first.get(i, (y, v)), (y, v))
    if not first:
        return []
    sizes = [len(v) for _, v in first.values()]
    size = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    first = {i: r for i, r in first.items() if len(r[1]) == size}
    out = []
    for a, (y, v) in first.items():
        if a % 10:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, z) for i, (z, w) in first.items() if i != a]
        near = sorted(x for x in scored if x[2] == y)[:positives]
        for score, i, _ in near:
            inside = [x for x in scored if x[2] != y and percents[0] * -score <= 100 * -x[0] <= percents[1] * -score]
            out += [(a, i, k + 1, x[1], -score, -x[0]) for k, x in enumerate(sorted(inside)[:negatives])]
    return sorted(out)


def found(spark, rows, positives=3, negatives=4, percents=(30, 90), **more):
    got = hardneg.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, positives, negatives, percents, **more)
    return sorted(map(tuple, got.collect()))


def random_rows(seed, n, dims, spread, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, dims))
    return [
        (i, int(rng.integers(labels)), [int(x) for x in centres[rng.integers(6)] + rng.integers(-spread, spread + 1, dims)])
        for i in range(n)
    ]


@pytest.mark.parametrize(("seed", "n", "dims", "spread"), [(1, 300, 8, 5), (2, 200, 5, 250), (3, 120, 1, 40), (4, 90, 2, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, n, dims, spread):
    monkeypatch.setattr(hardneg, "FIRST_ROWS", 20)  # so that later passes have work left
    rows = random_rows(seed, n, dims, spread)
    assert found(spark, rows) == brute_force(rows, 3, 4, (30, 90))
    assert found(spark, rows, group=2) == brute_force(rows, 3, 4, (30, 90))


def test_far_windows_in_one_cluster(spark, monkeypatch):
    """Windows far below the best cells, which only the last pass reaches."""
    monkeypatch.setattr(hardneg, "FIRST_ROWS", 5)
    rows = random_rows(5, 250, 6, 3, labels=2)
    assert found(spark, rows, percents=(10, 20)) == brute_force(rows, 3, 4, (10, 20))


def test_hot_group_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "SEGMENTS", 4)
    rows = random_rows(6, 150, 4, 60) + [(1000 + i, i % 2, [100, 90, 80, 70]) for i in range(400)]
    assert found(spark, rows) == brute_force(rows, 3, 4, (30, 90))


def test_odd_rows(spark):
    rows = [
        (0, 1, [3, 4]), (1, 1, [5, 5]), (2, 0, [2, 2]), (3, 0, [2, 2]), (3, 0, [2, 2]), (3, 1, [9, 9]),
        (None, 0, [2, 2]), (4, None, [2, 2]), (5, 0, None), (6, 0, [1, None]), (7, 0, [1, 2, 3]), (8, 0, []),
        (10, 7, [1, 1]), (20, 1, [0, 0]), (30, 1, [-3, -4]),
    ]
    assert found(spark, rows) == brute_force(rows, 3, 4, (30, 90))
    assert found(spark, []) == []
    assert found(spark, [(0, 1, None)]) == []
    assert found(spark, [(0, 1, [1, 2]), (1, 1, [2, 3])]) == []
    assert found(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]


def test_large_components(spark):
    big = 1 << 30
    rows = [(0, 1, [big, 5]), (1, 1, [big, 1]), (2, 2, [big // 2, 3]), (3, 2, [big // 2, 2]), (4, 2, [1 << 40, 1])]
    assert found(spark, rows) == brute_force(rows[:4], 3, 4, (30, 90))


def test_cells_come_in_order_of_their_bounds(spark):
    rng = np.random.default_rng(0)
    books = (rng.normal(size=(5, 2)), rng.normal(size=(4, 2)))
    index = hardneg.Index(books, (rng.random(5), rng.random(4)), np.ones(20, int), np.arange(20), np.ones(20, int), "<i2", True)
    u, v = index.bounds(rng.normal(size=(1, 4)))
    walked = list(index.visit(u[0], v[0]))
    assert sorted(c for c, _ in walked) == list(range(20))
    assert [b for _, b in walked] == sorted((b for _, b in walked), reverse=True)
    assert all(abs(b - (u[0][c // 4] + v[0][c % 4])) < 1e-12 for c, b in walked)


def test_bounds_hold(spark, tmp_path):
    from logsift.llm.scratch import Scratch

    rows = random_rows(7, 400, 6, 30)
    given = table(spark, rows).select("vec_id", F.col("label").cast("long"), F.lit(False).alias("asks"), "vector")
    index, held = hardneg.build(given, Scratch(spark), 400, 6, 230)
    vectors = {i: np.array(v) for i, _, v in rows}
    ask = np.array([vectors[0], vectors[1]])
    u, v = index.bounds(ask)
    for row in held.collect():
        i, j = divmod(row.cell, len(index.books[1]))
        assert (ask @ vectors[row.vec_id] <= u[:, i] + v[:, j] + 1e-6).all()


def test_clustered_vectors_are_not_all_visited(spark):
    """On vectors in tight groups, most cells stay unvisited."""
    rows = random_rows(8, 2000, 8, 2)
    scores = np.array([v for _, _, v in rows], float)
    given = table(spark, rows).select("vec_id", F.col("label").cast("long"), F.lit(False).alias("asks"), "vector")
    from logsift.llm.scratch import Scratch

    index, _ = hardneg.build(given, Scratch(spark), 2000, 8, 210)
    anchor = scores[:1]
    best = np.sort(anchor @ scores.T)[0, -6]
    u, v = index.bounds(anchor)
    visited = sum(index.counts[c] for c, b in index.visit(u[0], v[0]) if b >= best)
    assert visited < 0.5 * len(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    name = "op12_hard_negatives"
    got = queries.QUERIES[name](spark, path)
    sql = con.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(sql.columns)
    assert sorted(map(tuple, got.select(sql.columns).collect())) == sorted(sql.fetchall())
