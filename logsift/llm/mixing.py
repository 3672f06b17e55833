"""Mixing sources by temperature: weights from token shares, draws as block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logsift.llm.scratch import Scratch

REPETITION_LIMIT = 2.0
SEED = 17
#: Bits of the exponent, and how many one pass over the source totals settles.
EXPONENT_BITS, BITS_A_PASS = 20, 5
#: Documents of one block of a permutation, about.
BLOCK_DOCS = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw_key(doc_id: Column, epoch: Column, seed: int = SEED) -> Column:
    """The place of a document in the permutation of an epoch, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def exponent(
    totals: DataFrame, target_entropy: float | None = None, limit: float = REPETITION_LIMIT, budget: int | None = None
) -> float:
    """The exponent of the shares, by bisection in [0, 1] to ``EXPONENT_BITS`` bits.

    With a target entropy (nats): the largest exponent whose weights reach it, or 0 if none
    does. Else the smallest one at which no source is repeated more than ``limit`` times, or
    1 if none is. A pass evaluates all midpoints of the next few bisection steps in one
    aggregation over ``totals(source, tokens)`` and returns one row for each.
    """
    low, high = 0.0, 1.0
    fits = _fits(totals, [0.0, 1.0], target_entropy, limit, budget)
    if target_entropy is None:
        if fits[0.0] or not fits[1.0]:
            return 0.0 if fits[0.0] else 1.0
    elif fits[1.0] or not fits[0.0]:
        return 1.0 if fits[1.0] else 0.0
    for _ in range(EXPONENT_BITS // BITS_A_PASS):
        parts = 2**BITS_A_PASS
        points = [low + (high - low) * k / parts for k in range(parts + 1)]
        fits = _fits(totals, points[1:-1], target_entropy, limit, budget) | {
            low: target_entropy is not None,
            high: target_entropy is None,
        }
        k = next(k for k in range(parts) if fits[points[k]] != fits[points[k + 1]])
        low, high = points[k], points[k + 1]
    return high if target_entropy is None else low


def _fits(totals: DataFrame, points: list[float], entropy, limit, budget) -> dict[float, bool]:
    """For each exponent, whether it meets the target."""
    a, n = F.col("a"), F.col("tokens").cast("double")
    at = totals.withColumn("a", F.explode(F.array(*[F.lit(p) for p in points])))
    rows = at.groupBy("a").agg(
        F.sum(F.pow(n, a)).alias("z"),
        F.sum(F.pow(n, a) * a * F.log(n)).alias("zl"),
        F.max(F.pow(n, 1 - a)).alias("down"),
        F.max(F.pow(n, a - 1)).alias("up"),
    )
    found = dict.fromkeys(points, True)
    for row in rows.collect():
        if entropy is not None:
            found[row.a] = math.log(row.z) - row.zl / row.z >= entropy
        else:
            most = row.up * (row.down if budget is None else budget / row.z)
            found[row.a] = most <= limit
    return found


def quotas(totals: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """``(source, docs, epochs, rest)``: full epochs of a source and tokens beyond them.

    Without a budget the total is the least under which every document is drawn once.
    """
    n = F.col("tokens").cast("double")
    sums = totals.agg(F.sum(F.pow(n, F.lit(alpha))).alias("z"), F.max(F.pow(n, F.lit(1 - alpha))).alias("down")).first()
    scale = (sums.down or 0.0) if budget is None else budget / (sums.z or 1.0)
    quota = F.round(F.pow(n, F.lit(alpha)) * F.lit(float(scale))).cast("long")
    planned = totals.select("source", "tokens", "docs", quota.alias("quota"))
    return planned.select("source", "docs", F.expr("quota div tokens AS epochs"), F.expr("quota % tokens AS rest"))


def cuts(sizes: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``(source, epochs, cut)``: the last epoch of a source ends with the draw key ``cut``.

    Documents of the last epoch are taken in the order of their keys as long as their tokens
    fit. A key's first digits are its block: token sums of whole blocks show in which block
    the source's budget ends, and only the documents of that block are summed one by one.
    """
    most = plan.agg(F.max("docs")).first()[0] or 1
    digits = min(12, max(1, math.ceil(math.log(max(1.0, most / BLOCK_DOCS), 16))))
    of = plan.select(F.col("source").alias("s"), "epochs", "rest").where("rest > 0")
    placed = sizes.join(of, F.col("source").eqNullSafe(F.col("s"))).where("n_tokens > 0")
    placed = placed.select("source", "n_tokens", "rest", draw_key(F.col("doc_id"), F.col("epochs"), seed).alias("key"))
    placed = placed.withColumn("block", F.substring("key", 1, digits))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("block"))
    ends = blocks.withColumn("run", run).where("run > rest and run - n <= rest")
    ends = ends.select(F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - F.col("run") + F.col("n")).alias("left"))
    last = placed.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "b").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("sum", within).groupBy("source", "b").agg(F.max(F.when(F.col("sum") <= F.col("left"), F.col("key"))).alias("k"))
    found = last.select(F.col("source").alias("s"), F.coalesce("k", "b").alias("cut"))
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "epochs", F.coalesce("cut", F.lit("")).alias("cut"))


def draws(
    docs: DataFrame,
    target_entropy: float | None = None,
    limit: float = REPETITION_LIMIT,
    budget: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One row for each time a document is drawn: struct ``row``, n_tokens, epoch, draw_key.

    Weights are the sources' shares of all tokens to the power of ``exponent``. Each source
    is drawn in whole epochs and a last one that ends before its budget does; an epoch is a
    permutation by ``draw_key``, the order of the mixture is epoch, draw_key. Without a
    budget every document with a word is drawn at least once. Documents without words and
    null texts are never drawn. Null is a source like others. Rows that repeat a doc_id,
    and rows with a null doc_id, have equal keys and are drawn or not together.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.table(docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens")), "sizes")
    totals = sizes.where("n_tokens > 0").groupBy("source")
    totals = scratch.table(totals.agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "totals")
    plan = quotas(totals, exponent(totals, target_entropy, limit, budget), budget)
    ends = scratch.table(cuts(sizes, plan, seed), "cuts").withColumnRenamed("source", "s")
    rows = docs.select(F.struct("*").alias("row"), token_count(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    found = rows.join(ends, F.col("row.source").eqNullSafe(F.col("s")))
    in_last = draw_key(F.col("row.doc_id"), F.col("epochs"), seed) <= F.col("cut")
    copies = F.col("epochs") + F.when(in_last, 1).otherwise(0)
    found = found.select("row", "n_tokens", copies.alias("copies")).where("copies > 0")
    found = found.select("row", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))
    return found.select("row", "n_tokens", "epoch", draw_key(F.col("row.doc_id"), F.col("epoch"), seed).alias("draw_key"))


def oracle(limit: float = REPETITION_LIMIT, seed: int = SEED) -> str:
    """DuckDB SQL for ``draws`` of ``documents`` without a budget: ids, sizes and places."""
    steps = ", ".join(
        f"s{k + 1} AS (SELECT CASE WHEN r <= {limit} THEN lo ELSE mid END AS lo, "
        f"CASE WHEN r <= {limit} THEN mid ELSE hi END AS hi FROM (SELECT any_value(lo) AS lo, any_value(hi) AS hi, "
        f"any_value((lo + hi) / 2) AS mid, max(pow(n, 1 - (lo + hi) / 2)) * max(pow(n, (lo + hi) / 2 - 1)) AS r "
        f"FROM s{k}, t))"
        for k in range(EXPONENT_BITS)
    )
    key = f"md5(concat_ws(':', '{seed}', CAST({{epoch}} AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), '')))"
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens
  FROM documents),
w AS (SELECT * FROM d WHERE n_tokens > 0),
t AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS n, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM w GROUP BY source),
s0 AS (SELECT CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi), {steps},
e AS (SELECT CASE WHEN (SELECT max(n) / min(n) FROM t) <= {limit} THEN 0 ELSE hi END AS a FROM s{EXPONENT_BITS}),
q AS (SELECT source, tokens, CAST(round(pow(n, a) * (SELECT max(pow(n, 1 - a)) FROM t, e)) AS BIGINT) AS quota FROM t, e),
p AS (SELECT source, quota // tokens AS epochs, quota % tokens AS rest FROM q),
k AS (SELECT w.*, epochs, rest, {key.format(epoch="epochs")} AS last_key
  FROM w JOIN p ON w.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY last_key RANGE UNBOUNDED PRECEDING) AS run FROM k),
x AS (SELECT doc_id, source, n_tokens, unnest(range(epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, {key.format(epoch="epoch")} AS draw_key FROM x"""
