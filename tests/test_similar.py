"""Similar sources against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from logsift.operators import similar
from logsift.operators import templates as tp
from logsift.plans.staging import parquet_stage


def brute_force(sets, similarity):
    first: dict = {}
    for source in sorted(sets):
        first.setdefault(frozenset(sets[source]), source)
    classes = sorted((name, tokens) for tokens, name in first.items() if tokens)
    pairs = {}
    for k, (a, x) in enumerate(classes):
        for b, y in classes[k + 1 :]:
            alike = len(x & y) / len(x | y)
            if alike >= similarity:
                pairs[a, b] = alike
    return {s: first[frozenset(t)] for s, t in sets.items() if t}, pairs


def groups_of(spark, sets, severity="error"):
    rank = {"error": 4, "info": 2}[severity]
    rows = [(s, "text", t, rank) for s, tokens in sets.items() for t in tokens]
    rows += [(s, "noise", None, 0) for s in sets]
    table = spark.createDataFrame(rows, "source string, kind string, template string, rank int")
    return table.selectExpr("*", "1L AS n", "1L AS first_line")


def random_sets(seed, hot):
    """Sets that grow from one another; with ``hot`` templates that all of them hold."""
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(60)]
    sets, last = {}, []
    for k in range(90):
        if k % 5 == 0 or not last:
            last = rng.sample(words, rng.randint(0, 12))
        else:
            last = [t for t in last if rng.random() < 0.85] + rng.sample(words, rng.randint(0, 2))
        sets[f"s{k:03d}"] = set(last) | set(hot)
    return sets


@pytest.mark.parametrize("chunk", [3, 512])
@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8, 1.0])
def test_equals_brute_force(spark, chunk, similarity):
    for seed, hot in ((1, []), (2, ["everywhere", "too"])):
        sets = random_sets(seed, hot)
        members, pairs = similar.similar_sources(groups_of(spark, sets), parquet_stage(spark), similarity, chunk=chunk)
        want_members, want_pairs = brute_force(sets, similarity)
        assert {r.source: r.first_source for r in members.collect()} == want_members
        found = pairs.collect()
        assert {(r.a, r.b): pytest.approx(r.similarity) for r in found} == want_pairs and len(found) == len(want_pairs)


def test_equal_sets_are_one_class_and_levels_count(spark):
    sets = {"a": {"x", "y"}, "b": {"x", "y"}, "c": {"x", "y", "z"}, "d": set()}
    groups = groups_of(spark, sets).union(groups_of(spark, {"a": {"only info"}, "d": {"only info"}}, "info"))
    members, pairs = similar.similar_sources(groups, parquet_stage(spark), 0.6, ["error", "fatal"])
    assert {r.source: r.first_source for r in members.collect()} == {"a": "a", "b": "a", "c": "c"}
    assert [(r.a, r.b) for r in pairs.collect()] == [("a", "c")]


def test_empty(spark):
    members, pairs = similar.similar_sources(groups_of(spark, {"a": set()}), parquet_stage(spark))
    assert members.collect() == [] and pairs.collect() == []


def test_a_template_of_all_sources_makes_no_large_group(spark):
    """Thousands of sources share a template, beside rare ones of their own."""
    sets = {f"s{k}": {"hot", f"own{k}", f"pair{k // 2}"} for k in range(3_000)}
    classes = similar.template_sets(groups_of(spark, sets), parquet_stage(spark))[1]
    tokens = classes.select("class", similar._prefix(0.5).alias("p")).selectExpr("class", "explode(p) AS token")
    assert max(r["count"] for r in tokens.groupBy("token").count().collect()) == 2
    _, pairs = similar.similar_sources(groups_of(spark, sets), parquet_stage(spark), 0.5)
    assert pairs.count() == 1_500


def test_similar_pairs():
    sets = [np.array([1, 2, 3]), np.array([2, 3, 4]), np.array([9])]
    assert similar.similar_pairs(sets, 0.5) == [(0, 1, 0.5)]
    assert similar.similar_pairs(sets, 0.5, np.array([1, 1, 0])) == []


def test_template_sets_are_rarest_first(spark):
    sets = {"a": {"rare", "hot"}, "b": {"hot"}, "c": {"hot"}}
    classes = similar.template_sets(groups_of(spark, sets), parquet_stage(spark))[1]
    sizes = {r.first_source: len(r.tokens) for r in classes.collect()}
    assert sizes == {"a": 2, "b": 1}
    hot = {r.first_source: r.tokens for r in classes.collect()}
    assert hot["a"][1] == hot["b"][0]


def test_on_line_groups(spark, lines_of):
    groups = tp.line_groups(lines_of(a="ERROR x 12345\nINFO y", b="INFO y\nERROR x 99999", c="INFO z"))
    members, _ = similar.similar_sources(groups, parquet_stage(spark))
    assert {r.source: r.first_source for r in members.collect()} == {"a": "a", "b": "a", "c": "c"}


@pytest.mark.parametrize("seed", range(3))
def test_pairs_come_once_with_the_first_token_they_share(seed):
    rng = np.random.default_rng(seed)
    sets = [np.sort(rng.choice(30, rng.integers(2, 9), replace=False)) for _ in range(60)]
    found = []
    for token in range(30):
        at = [k for k, x in enumerate(sets) if token in x]
        found += [(at[i], at[j], alike) for i, j, alike in similar.similar_pairs([sets[k] for k in at], 0.2, token=token)]
    assert sorted(found) == sorted(similar.similar_pairs(sets, 0.2)) and found


def test_pairs_leave_the_comparison_without_another_shuffle(spark):
    lines = spark.createDataFrame([(f"s{k}", 1, f"same line {k % 2}") for k in range(4)], "source string, line_no long, line string")
    _, pairs = similar.similar_sources(tp.line_groups(lines), lambda df, name: df, 0.5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInPandas")[0] and "Aggregate" not in plan.split("FlatMapGroupsInPandas")[0]
