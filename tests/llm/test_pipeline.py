from __future__ import annotations

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from logsift.llm.queries import ORACLE, QUERIES
from tests.compare import duck_rows, spark_rows, tables

SF_DIR = "/root/testdata/sf0.001"
FINNISH = "Hyvää huomenta kaikille, tänään menemme yhdessä metsään keräämään sieniä ja marjoja syksyn iloksi. " * 4
NOISE = "xqzv kjwp zzqx vvkw qpxz jjkq wwzx kqvz pxqj zvkw qqxj kzwv " * 8


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    types, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    sql_types, sql_rows = duck_rows(tables(SF_DIR), ORACLE[name])
    assert types == sql_types and rows == sql_rows and rows


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert queries().keys() >= QUERIES.keys() | {"pipeline"} and oracle_sql().keys() >= ORACLE.keys()


def test_stages(spark, documents):
    """Planted cases go where they should, clean documents come through."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    clean = docs.orderBy("doc_id").limit(120)
    own = "\n".join(f"the and of {k} {'abcdefghij'[k % 10] * 3} in that to for {k * k} was" for k in range(40))
    passage = "\n".join(f"shared line number {k} of the long passage with words in it" for k in range(6))
    planted = [
        (10_001, own), (10_002, own), (10_003, own.replace("the and of 7 ", "the and of seven ")),
        (10_004, "before the leak\n" + item), (10_005, "12 34 ??"), (10_006, None),
        (10_009, FINNISH), (10_010, NOISE),
        (10_007, "the first one has this\n" + passage), (10_008, "and another that has this\n" + passage + "\nthe end"),
    ]
    given = clean.union(spark.createDataFrame([(i, t, None, "p", 0) for i, t in planted], docs.schema))
    after, now = [], given
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
        now = now.persist()
        after.append({r.doc_id: r.text for r in now.collect()})
    language, lines, near, leaks, mixed = after
    ids = {r.doc_id for r in clean.collect()}
    assert language.keys() == ids | {i for i, _ in planted} - {10_005, 10_006, 10_009, 10_010}
    assert lines.keys() == language.keys()
    assert lines[10_001] == own and lines[10_002] == "" and passage not in lines[10_008]
    assert lines[10_008] == "and another that has this\nthe end" and passage in lines[10_007]
    assert 10_001 in near and not {10_002} & near.keys()
    assert 10_004 in near and 10_004 not in leaks
    assert mixed.keys() == {i for i, t in leaks.items() if t}


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_epoch", "mix_key"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert spark_rows(docs)[1] == spark_rows(rows)[1]
