"""Log lines, texts and model replies that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.numbering import add_position
from logsift.sources.text_column import lines_from_text

# Events per numbering chunk; one chunk of one source is at most 6 times as many lines.
CHUNK_EVENTS = 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Which lines an event writes: the first test that holds decides.
_TIME = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
_APACHE = "date_format(ts, 'EEE MMM dd HH:mm:ss yyyy')"
_HASH = "md5(CAST(event_id AS STRING))"
_UUID = "concat_ws('-', " + ", ".join(
    f"substr({_HASH}, {at}, {n})" for at, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
) + ")"
_SHAPES = [
    ("event_type = 'view'",
     [f"concat({_TIME}, ' INFO  [api-gateway] GET /item/',"
      " CAST(1000 + event_id % 9000 AS STRING), ' 200')"]),
    ("event_type = 'click'",
     [f"concat({_TIME}, ' DEBUG [cache] hit ptr=0x', substr({_HASH}, 1, 8))", "'---'", "''"]),
    ("event_type = 'signup'",
     [f"concat('[', {_APACHE}, '] ', chr(27), '[33m[warn]', chr(27), '[0m request ', {_UUID},"
      " ' token expired  ')"]),
    ("event_type = 'purchase'",
     [f"concat({_TIME}, ' worker checkpoint user_', CAST(user_id AS STRING))", "'   ...'"]),
    ("event_id % 3 = 0",
     [f"concat({_TIME}, ' ERROR [db-pool] Failed to acquire (timeout=5000ms)')",
      "'Traceback (most recent call last):'",
      "'  File \"db/pool.py\", line 42, in query'",
      "'    conn = pool.acquire()'",
      "'    raise TimeoutError(msg)'",
      "'TimeoutError: No connections available'"]),
    ("event_id % 3 = 1",
     [f"concat({_TIME}, ' ERROR [api] handler failed')",
      "'    at com.example.A.f(A.java:42)'",
      "'    at com.example.B.g(B.java:7)'",
      "'Caused by: java.io.IOException: x'",
      "'    ... 12 more'",
      f"concat({_TIME}, ' FATAL [worker] Retry limit exceeded, job ',"
      " CAST(10000 + event_id AS STRING))"]),
    ("true",
     [f"concat({_TIME}, ' ERROR [auth] denied for user_', CAST(user_id AS STRING))"]),
]


def _choose(value) -> Column:
    tests = " ".join(f"WHEN {test} THEN {value(lines)}" for test, lines in _SHAPES)
    return F.expr(f"CASE {tests} END")


def log_lines(
    spark: SparkSession, sf_dir: str, chunk_events: int = CHUNK_EVENTS, where: str = "true"
) -> DataFrame:
    """``(source, chunk, line_no, line)``: eight services that log every event.

    The narrow events are shuffled and numbered before they become text, and the
    lines keep the partitioning by ``(source, chunk)`` for the sequence operators.
    """
    events = table(spark, sf_dir, "events").where(where).selectExpr(
        "concat('svc-', CAST(user_id % 8 AS STRING)) AS source",
        f"event_id DIV {chunk_events} AS chunk",
        "event_id",
        "user_id",
        "event_type",
        "ts",
    )
    n_lines = _choose(lambda lines: f"{len(lines)}L")
    texts = _choose(lambda lines: f"array({', '.join(lines)})")
    return (
        add_position(events, ["event_id"], n_lines, "lines_before")
        .select("source", "chunk", "lines_before", F.posexplode(texts).alias("p", "line"))
        .selectExpr("source", "chunk", "lines_before + p + 1 AS line_no", "line")
    )


def log_parts(spark: SparkSession, sf_dir: str, parts: int) -> list[DataFrame]:
    """``log_lines`` in parts that follow each other, each numbered from 1 in every source."""
    low, high = table(spark, sf_dir, "events").selectExpr("min(event_id)", "max(event_id)").first()
    edges = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
    spans = [f"event_id >= {a} AND event_id < {b}" for a, b in zip(edges, edges[1:])]
    return [log_lines(spark, sf_dir, where=span) for span in spans]


# Times run three hours an event, so that years pass; some lines are 40 days late. Most name no year.
_LATE = "timestampadd(DAY, IF(event_id % 17 = 0, -40, 0), timestampadd(HOUR, event_id * 3, ts))"
_STAMP = """CASE WHEN event_id % 40 = 3 THEN 'Foo 31 10:11:12'
  WHEN user_id % 8 = 3 OR event_id % 40 > 2 THEN date_format(t, 'MMM d HH:mm:ss')
  WHEN event_id % 40 = 0 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
  WHEN event_id % 40 = 1 THEN concat('[', date_format(t, 'EEE MMM d HH:mm:ss yyyy'), ']')
  ELSE date_format(t, 'dd/MMM/yyyy:HH:mm:ss') END"""


def syslog_lines(spark: SparkSession, sf_dir: str, chunk_events: int = 200) -> DataFrame:
    """``(source, chunk, line_no, line)``: a line for each event, in eight logs over some years."""
    events = table(spark, sf_dir, "events").selectExpr(
        "concat('dc-', user_id % 8 % 3, '/rack-', user_id % 8 % 2, '/svc-', user_id % 8) AS source",
        f"event_id DIV {chunk_events} AS chunk", "event_id", "user_id", "event_type", f"{_LATE} AS t",
    )
    placed = add_position(events, ["event_id"], F.lit(1), "before")
    line = f"""concat({_STAMP}, ' host-', user_id % 4, CASE event_type WHEN 'error' THEN ' ERROR '
      WHEN 'signup' THEN ' WARN ' ELSE ' INFO ' END, event_type) AS line"""
    return placed.selectExpr("source", "chunk", "before + 1 AS line_no", line)


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, text)``: every document as a log of its own."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), "text"
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, chunk, line_no, line)``: all lines of all documents, most of them dressed as
    log lines whose words and numbers touch letters beyond ASCII."""
    lines = lines_from_text(document_texts(spark, sf_dir))
    dressed = """CASE (CAST(substr(source, 5) AS BIGINT) + line_no) % 9
        WHEN 0 THEN concat('ERROR ', line) WHEN 1 THEN concat('    at ', line)
        WHEN 2 THEN concat('éERROR ', line) WHEN 3 THEN concat('fév 12 10:11:12 ', line)
        WHEN 4 THEN concat('Épo: ', line) WHEN 5 THEN concat('Oué: ', line)
        WHEN 6 THEN concat(line, ' é12345 67890 12345') ELSE line END"""
    return lines.withColumn("line", F.expr(dressed))


def texts_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_texts`` where some are blank or missing."""
    doc = F.substring("source", 5, 20).cast("bigint")
    text = (
        F.when(doc % 7 == 0, F.lit(" \n\t ")).when(doc % 11 == 0, F.lit(None)).otherwise(
            F.col("text")
        )
    )
    return document_texts(spark, sf_dir).withColumn("text", text)


def order_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, reply)``: one reply per order, in all the forms a model answers in."""
    date = "date_format(o_orderdate, 'yyyy-MM-dd')"
    whole = f"""concat(
        '{{"primary_issue": "order ', o_orderkey, ' is late", "error_signatures": [',
        '{{"pattern": "late ', o_orderpriority, '", "category": "timeout", "count": ',
        o_orderkey % 90, ', "first_seen_timestamp": "', {date},
        '", "affected_component": "cust-', o_custkey, '"}}, {{"pattern": "status ', o_orderstatus,
        '"}}], "root_cause": "priority ', o_orderpriority,
        '", "timeline": [{{"timestamp": "', {date},
        '", "event": "placed"}}, {{"event": "late"}}], "attention_needed": ["order ', o_orderkey,
        '", "customer"], "noise_assessment": "low"}}')"""
    partial = """concat(
        '{"primary_issue": null, "root_cause": "see ', o_orderkey,
        '", "error_signatures": [{"category": "crash", "count": "', o_orderkey,
        '"}], "timeline": [{"timestamp": null, "event": null}], "extra": [1, 2]}')"""
    some_items = """concat(
        '{"timeline": [{"event": "placed"}, 3, null, "x"], "attention_needed": [null, "order ',
        o_orderkey, '", 7], "error_signatures": ["no object", {"pattern": "late"}]}')"""
    reply = f"""CASE o_orderkey % 11
        WHEN 0 THEN concat('```json', chr(10), {whole}, chr(10), '```')
        WHEN 1 THEN concat('```', {whole}, '```')
        WHEN 2 THEN concat('no analysis for order ', o_orderkey)
        WHEN 3 THEN concat('[', {whole}, ']')
        WHEN 4 THEN '{{}}'
        WHEN 5 THEN concat('  ', chr(10), {whole}, chr(10), chr(9))
        WHEN 6 THEN {partial}
        WHEN 7 THEN {some_items}
        WHEN 8 THEN '{{"root_cause": "a", "root_cause": "b"}}'
        WHEN 9 THEN '{{"primary_issue": NaN}}'
        ELSE {whole} END AS reply"""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('order-', o_orderkey) AS source", reply
    )


def service_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, reply)`` for six of the eight services, from counts over all events."""
    reply = """concat('{"primary_issue": "', errors, ' errors", "root_cause": "pool of ', service,
        '", "error_signatures": [{"pattern": "error", "count": ', errors,
        '}], "attention_needed": ["svc-', service, '"]}') AS reply"""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.expr("user_id % 8 AS service"))
        .agg(F.expr("count_if(event_type = 'error') AS errors"))
        .filter("service < 6")
        .selectExpr("concat('svc-', service) AS source", reply)
    )
