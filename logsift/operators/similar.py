"""Sources with the same failures: a similarity join over their sets of templates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.templates import templates_of
from logsift.plans.staging import Stage

SIMILARITY = 0.5
#: Sets with a template in common that one task compares with as many others.
CHUNK = 512


def template_sets(groups: DataFrame, stage: Stage, levels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal template sets: ``(source, class)`` and ``(class, size, tokens)``.

    ``groups`` are line groups; with ``levels`` only templates of these levels count. Tokens
    are hashes of templates, the rarest one first; ``class`` is a hash of the set. Sources
    without a template have no class.
    """
    templates = templates_of(groups)
    chosen = templates if levels is None else templates.where(F.col("severity").isin(levels))
    held = stage(chosen.select("source", F.xxhash64("template").alias("token")).distinct(), "held")
    # Written, the sizes are a plain side of the join, so that Spark splits a template of all sources.
    sizes = stage(held.groupBy("token").agg(F.count("*").alias("n_sources")), "token-sizes")
    ranked = held.join(sizes, "token")
    ordered = F.sort_array(F.collect_list(F.struct("n_sources", "token")))
    sets = ranked.groupBy("source").agg(ordered.getField("token").alias("tokens"))
    sets = stage(sets.withColumn("class", F.xxhash64("tokens")), "sets")
    one = sets.groupBy("class").agg(F.first("tokens").alias("tokens"), F.min("source").alias("source"))
    classes = one.select("class", F.size("tokens").alias("size"), "tokens", F.col("source").alias("first_source"))
    return sets.select("source", "class"), stage(classes, "classes")


def _prefix(similarity: float) -> Column:
    """The tokens of which two sets that are similar enough share at least one."""
    kept = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - 1e-9) + 1
    return F.slice("tokens", 1, F.least(kept, F.col("size")).cast("int"))


def similar_pairs(
    a: list[np.ndarray], similarity: float, split: np.ndarray | None = None, token: int | None = None
) -> list[tuple[int, int, float]]:
    """Index pairs of sets, as arrays, whose Jaccard similarity is high enough.

    A set is held against all others at once, by the tokens that they share with it. With
    ``split`` only pairs of which one has it and the other has not. With ``token``, which all
    sets hold, only pairs that share none ahead of it; sets then have one order of tokens.
    """
    if not a:
        return []
    sizes = np.array([len(x) for x in a])
    values, flat = np.unique(np.concatenate(a), return_inverse=True)
    owner = np.repeat(np.arange(len(a)), sizes)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    marked, found = np.zeros(len(values), bool), []
    if token is not None:
        place = [int(np.flatnonzero(x == token)[0]) for x in a]
        ahead = [mine[:k] for mine, k in zip(own, place)]
        ahead_flat, ahead_owner = np.concatenate(ahead), np.repeat(np.arange(len(a)), place)
    for i, mine in enumerate(own):
        marked[mine] = True
        common = np.bincount(owner[marked[flat]], minlength=len(a))
        marked[mine] = False
        alike = common / (sizes + sizes[i] - common)
        hits = alike >= similarity - 1e-12
        hits[: i + 1] = False
        if split is not None:
            hits &= split != split[i]
        if token is not None and place[i]:
            marked[ahead[i]] = True
            hits[ahead_owner[marked[ahead_flat]]] = False
            marked[ahead[i]] = False
        found += [(i, int(j), float(alike[j])) for j in np.flatnonzero(hits)]
    return found


def similar_sources(
    groups: DataFrame, stage: Stage, similarity: float = SIMILARITY, levels: list[str] | None = None, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """Members ``(source, first_source)`` and pairs ``(a, b, similarity)`` of their classes.

    Sources with equal sets of templates are one class, named by its first source. Pairs are
    classes whose sets have a Jaccard similarity of at least ``similarity``, ``a`` before ``b``.
    Two such sets share one of their rarest templates, as many as may be missing and one more;
    only sets that do are compared, and a pair is given by the first one that they share, so
    nothing is left to join or to drop over the pairs. A template of many sets is dealt out as pairs of chunks,
    each compared in a group of its own, so one that all sources share is no hot key, and it
    is among the rarest of a set only where the set has little else.
    """
    members, classes = template_sets(groups, stage, levels)
    placed = classes.select("class", "first_source", "tokens", F.explode(_prefix(similarity)).alias("token"))
    sizes = placed.groupBy("token").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.count("*").alias("n"))
    sizes = stage(sizes.where("n > 1").select(F.col("token").alias("of"), "chunks"), "sizes")
    own = F.pmod(F.xxhash64("class", F.lit(3)), F.col("chunks")).cast("int")
    dealt = placed.join(sizes, F.col("token") == F.col("of")).select(
        "token", "first_source", "tokens", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    dealt = dealt.select("token", i, j, "first_source", "tokens", "own")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(x) for x in rows["tokens"]]
        # Pairs within a chunk are found in the group of that chunk with itself.
        split = None if rows["i"].iloc[0] == rows["j"].iloc[0] else rows["own"].to_numpy()
        names = rows["first_source"].to_numpy()
        found = similar_pairs(sets, similarity, split, rows["token"].iloc[0])
        columns = [names[np.array([f[0] for f in found], int)], names[np.array([f[1] for f in found], int)], [f[2] for f in found]]
        return pd.DataFrame(dict(zip(("x", "y", "similarity"), columns))).astype({"similarity": "float64"})

    pairs = dealt.groupBy("token", "i", "j").applyInPandas(compare, "x string, y string, similarity double")
    firsts = classes.select("class", "first_source")
    members = members.join(firsts, "class").select("source", "first_source")
    return members, pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
