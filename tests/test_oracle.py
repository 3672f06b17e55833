from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry
from tests.compare import duck_rows, spark_rows, tables
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return tables(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    types, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    sql_types, sql_rows = duck_rows(duck, ORACLE[name])
    assert types == sql_types
    assert rows == sql_rows
    assert rows


def test_entry(spark):
    assert entry(spark).count() == 8


def test_known_totals(spark):
    from logsift.operators.templates import source_metrics
    from pyspark.sql import functions as F

    from workload.derive import log_lines

    names = ["total_lines", "noise_lines", "n_fatal", "n_error", "n_warning", "n_info", "n_debug"]
    # Numbering in small chunks must not change anything.
    metrics = source_metrics(log_lines(spark, SF_DIR, chunk_events=37))
    row = metrics.agg(*[F.sum(n).alias(n) for n in names]).first()
    assert [row[n] for n in names] == [2302, 622, 75, 201, 199, 188, 210]
