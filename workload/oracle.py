"""The registered queries as plain SQL over the same tables, for DuckDB."""

from __future__ import annotations

from logsift.functions import catalogue as cat
from logsift.plans import wording as w
from workload import queries as q


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(wording: str, *values: str) -> str:
    """SQL for a wording with its marks filled; null if a value is null."""
    parts = [lit(p) for p in wording.split("{}")]
    sql = parts[0]
    for value, part in zip(values, parts[1:], strict=True):
        sql += f" || CAST({value} AS VARCHAR) || {part}"
    return f"({sql})"


def replaced(expr: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(by)}, {lit(flags)})"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def any_of(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(matches(expr, p) for p in patterns) + ")"


# -- log lines --------------------------------------------------------------

LOG_LINES = """
e AS (
  SELECT event_id, user_id, event_type, concat('svc-', CAST(user_id % 8 AS VARCHAR)) AS source,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, strftime(ts, '%a %b %d %H:%M:%S %Y') AS apache_ts,
    md5(CAST(event_id AS VARCHAR)) AS h, chr(27) AS esc
  FROM events),
a AS (
  SELECT source, event_id, CASE event_type
    WHEN 'view' THEN list_value(
      concat(t, ' INFO  [api-gateway] GET /item/', CAST(1000 + event_id % 9000 AS VARCHAR), ' 200'))
    WHEN 'click' THEN list_value(concat(t, ' DEBUG [cache] hit ptr=0x', substr(h,1,8)), '---', '')
    WHEN 'signup' THEN list_value(concat('[', apache_ts, '] ', esc, '[33m[warn]', esc,
      '[0m request ', substr(h,1,8), '-', substr(h,9,4), '-', substr(h,13,4), '-',
      substr(h,17,4), '-', substr(h,21,12), ' token expired  '))
    WHEN 'purchase' THEN list_value(
      concat(t, ' worker checkpoint user_', CAST(user_id AS VARCHAR)), '   ...')
    ELSE CASE event_id % 3
      WHEN 0 THEN list_value(concat(t, ' ERROR [db-pool] Failed to acquire (timeout=5000ms)'),
        'Traceback (most recent call last):', '  File "db/pool.py", line 42, in query',
        '    conn = pool.acquire()', '    raise TimeoutError(msg)',
        'TimeoutError: No connections available')
      WHEN 1 THEN list_value(concat(t, ' ERROR [api] handler failed'),
        '    at com.example.A.f(A.java:42)', '    at com.example.B.g(B.java:7)',
        'Caused by: java.io.IOException: x', '    ... 12 more',
        concat(t, ' FATAL [worker] Retry limit exceeded, job ', CAST(10000 + event_id AS VARCHAR)))
      ELSE list_value(concat(t, ' ERROR [auth] denied for user_', CAST(user_id AS VARCHAR)))
    END END AS ls
  FROM e),
x AS (SELECT source, event_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS l FROM a),
log_lines AS (
  SELECT source,
    CAST(row_number() OVER (PARTITION BY source ORDER BY event_id, p) AS BIGINT) AS line_no,
    l AS line
  FROM x)"""

# The services with an odd number were stored again, with every third line.
_EVEN = "CAST(substr(source, 5) AS BIGINT) % 2 = 0"
SESSION = LOG_LINES.replace("log_lines AS (", "all_lines AS (") + f""",
log_lines AS (
  SELECT source, line_no, line FROM all_lines WHERE {_EVEN}
  UNION ALL SELECT source, line_no // 3, line FROM all_lines WHERE NOT {_EVEN} AND line_no % 3 = 0)"""

_severity = (
    "CASE "
    + " ".join(f"WHEN {matches('cleaned', '(?i)' + p)} THEN '{lv}'" for lv, p in cat.SEVERITY)
    + " ELSE 'unknown' END"
)
_timestamp = (
    "coalesce("
    + ", ".join(f"nullif(regexp_extract(cleaned, {lit(p)}, 0), '')" for p in cat.TIMESTAMP)
    + ")"
)
_template = "cleaned"
for _p in cat.TIMESTAMP:
    _template = replaced(_template, _p, cat.MARK_TIMESTAMP)
_template = replaced(_template, cat.UUID, cat.MARK_UUID, "gi")
_template = replaced(_template, cat.ADDRESS, cat.MARK_ADDRESS, "gi")
_template = replaced(_template, cat.NUMBER, cat.MARK_NUMBER)


def shown(expr: str) -> str:
    for p in [*cat.TIMESTAMP, cat.EMPTY_BRACKETS]:
        expr = replaced(expr, p)
    return replaced(replaced(expr, cat.SEVERITY_WORD, "", "i"), r"^\s+|\s+$")


ANNOTATED = f"""{LOG_LINES},
cleaned_lines AS (
  SELECT *, {replaced(replaced("line", cat.ANSI), r"\s+$")} AS cleaned FROM log_lines),
annotated AS (
  SELECT *, {any_of("cleaned", cat.NOISE)} AS is_noise, {_severity} AS severity,
    {_timestamp} AS ts_text, {any_of("cleaned", cat.STACK)} AS is_stack
  FROM cleaned_lines),
classified AS (SELECT * FROM annotated WHERE NOT is_noise)"""

# -- traces -----------------------------------------------------------------

MEMBERS = f"""{ANNOTATED},
kinds AS (
  SELECT *, CASE WHEN is_stack THEN 'S'
    WHEN cleaned LIKE ' %' OR cleaned LIKE chr(9) || '%' THEN 'I'
    WHEN {matches("cleaned", cat.EXCEPTION)} THEN 'X'
    WHEN severity IN ('error', 'fatal') THEN 'E' ELSE 'N' END AS kind
  FROM classified),
opened AS (
  SELECT *, coalesce(last_value(CASE WHEN kind <> 'I' THEN kind = 'S' END IGNORE NULLS) OVER (
    PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    AS is_open
  FROM kinds),
counted AS (
  SELECT *, CAST(sum(CASE WHEN kind = 'S' AND NOT is_open THEN 1 ELSE 0 END) OVER (
    PARTITION BY source ORDER BY line_no) AS BIGINT) AS trace_id
  FROM opened),
members AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source, trace_id ORDER BY line_no) AS BIGINT)
    AS pos, min(line_no) OVER (PARTITION BY source, trace_id) AS header_line
  FROM counted WHERE kind = 'S' OR (is_open AND kind IN ('I', 'X', 'E'))),
traces AS (
  SELECT source, trace_id, header_line, count(*) AS n_lines,
    coalesce(max(CASE WHEN kind = 'E' THEN severity END), 'error') AS severity,
    CASE WHEN count(*) <= 4 THEN string_agg(cleaned, chr(10) ORDER BY pos)
      ELSE max(CASE WHEN pos = 1 THEN cleaned END) || chr(10)
        || max(CASE WHEN pos = 2 THEN cleaned END) || chr(10)
        || '  ... (' || CAST(count(*) - 4 AS VARCHAR) || ' frames omitted)' || chr(10)
        || string_agg(CASE WHEN pos > n - 2 THEN cleaned END, chr(10) ORDER BY pos)
    END AS summary
  FROM (SELECT *, count(*) OVER (PARTITION BY source, trace_id) AS n FROM members)
  GROUP BY source, trace_id, header_line),
trace_counts AS (SELECT source, count(*) AS n_traces FROM traces GROUP BY source)"""

# -- lines of documents, with the classes of other scripts spelled out -------

_W = r"[\p{L}\p{N}_]"
_NOT_W = r"[^\p{L}\p{N}_]"


def _spelled(pattern: str) -> str:
    """Word classes written out; an edge of a word at either end of the pattern consumes."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    inner = inner.replace(r"\w", _W).replace(r"\d", r"\p{Nd}")
    return (f"(^|{_NOT_W})" if pattern.startswith(r"\b") else "") + inner + (
        f"($|{_NOT_W})" if pattern.endswith(r"\b") else ""
    )


_doc_severity = (
    "CASE "
    + " ".join(
        f"WHEN {matches('cleaned', '(?i)' + _spelled(p))} THEN '{lv}'" for lv, p in cat.SEVERITY
    )
    + " ELSE 'unknown' END"
)
_doc_timestamp = (
    "coalesce("
    + ", ".join(f"nullif(regexp_extract(cleaned, {lit(_spelled(p))}, 0), '')" for p in cat.TIMESTAMP)
    + ")"
)
_doc_template = "cleaned"
for _p in cat.TIMESTAMP:
    _doc_template = replaced(_doc_template, _spelled(_p), cat.MARK_TIMESTAMP)
_doc_template = replaced(_doc_template, cat.UUID, cat.MARK_UUID, "gi")
_doc_template = replaced(_doc_template, cat.ADDRESS, cat.MARK_ADDRESS, "gi")
for _ in range(2):  # neighbouring numbers share the character between them
    _doc_template = replaced(_doc_template, _spelled(cat.NUMBER), rf"\1{cat.MARK_NUMBER}\2")


def _doc_shown(expr: str) -> str:
    for p in [*cat.TIMESTAMP, cat.EMPTY_BRACKETS]:
        expr = replaced(expr, _spelled(p))
    # The only level words in these lines are those that they were dressed with.
    return replaced(replaced(expr, rf"(^|{_NOT_W})ERROR\s*", r"\1", ""), r"^\s+|\s+$")


DOC_LINES = f"""
split_docs AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(text, '({cat.LINE_BREAK})$', ''),
    {lit(cat.LINE_BREAK)}) AS ls
  FROM documents WHERE trim(text) <> ''),
doc_lines AS (
  SELECT doc_id, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no, unnest(ls) AS line
  FROM split_docs),
log_lines AS (
  SELECT concat('doc-', doc_id) AS source, line_no, CASE (doc_id + line_no) % 9
    WHEN 0 THEN concat('ERROR ', line) WHEN 1 THEN concat('    at ', line)
    WHEN 2 THEN concat('éERROR ', line) WHEN 3 THEN concat('fév 12 10:11:12 ', line)
    WHEN 4 THEN concat('Épo: ', line) WHEN 5 THEN concat('Oué: ', line)
    WHEN 6 THEN concat(line, ' é12345 67890 12345') ELSE line END AS line
  FROM doc_lines)"""


def _of_documents(tables: str) -> str:
    """The same steps over the lines of documents."""
    for here, there in (
        (LOG_LINES, DOC_LINES),
        (_severity, _doc_severity),
        (_timestamp, _doc_timestamp),
        (lit(cat.EXCEPTION), lit(_spelled(cat.EXCEPTION))),
    ):
        tables = tables.replace(here, there)
    return tables


# -- event times ------------------------------------------------------------

SYSLOG_LINES = """
e AS (
  SELECT event_id, user_id, event_type, ts + to_hours(event_id * 3)
      - to_days(CASE WHEN event_id % 17 = 0 THEN 40 ELSE 0 END) AS t,
    concat('dc-', user_id % 8 % 3, '/rack-', user_id % 8 % 2, '/svc-', user_id % 8) AS source
  FROM events),
log_lines AS (
  SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY event_id) AS BIGINT) AS line_no,
    concat(CASE WHEN event_id % 40 = 3 THEN 'Foo 31 10:11:12'
      WHEN user_id % 8 = 3 OR event_id % 40 > 2 THEN strftime(t, '%b %-d %H:%M:%S')
      WHEN event_id % 40 = 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S')
      WHEN event_id % 40 = 1 THEN strftime(t, '[%a %b %-d %H:%M:%S %Y]')
      ELSE strftime(t, '%d/%b/%Y:%H:%M:%S') END, ' host-', user_id % 4,
      CASE event_type WHEN 'error' THEN ' ERROR ' WHEN 'signup' THEN ' WARN ' ELSE ' INFO ' END, event_type) AS line
  FROM e)"""


def _timed(tables: str) -> str:
    """Adds ``timed``: event times by windows over whole sources."""
    order = "(PARTITION BY source ORDER BY line_no ROWS BETWEEN"
    return f"""{tables},
parts AS (
  SELECT *, CASE
      WHEN regexp_matches(ts_text, '^[0-9]{{4}}-') THEN CAST(substr(ts_text, 6, 2) AS INT)
      ELSE CAST(nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'],
        lower(CASE WHEN regexp_matches(ts_text, '^[0-9]{{2}}/') THEN substr(ts_text, 4, 3)
          ELSE regexp_extract(ts_text, '([A-Za-z]{{3}}) +[0-9]', 1) END)), 0) AS INT) END AS month,
    CASE WHEN regexp_matches(ts_text, '^[0-9]{{2}}/') THEN CAST(substr(ts_text, 8, 4) AS INT)
      WHEN regexp_matches(ts_text, '[0-9]{{4}}[]]?$') THEN CAST(regexp_extract(ts_text, '([0-9]{{4}})[]]?$', 1) AS INT)
      WHEN regexp_matches(ts_text, '^[0-9]{{4}}-') THEN CAST(substr(ts_text, 1, 4) AS INT) END AS year,
    CASE WHEN regexp_matches(ts_text, '^[0-9]{{2}}/') THEN substr(ts_text, 1, 2)
      WHEN regexp_matches(ts_text, '^[0-9]{{4}}-') THEN substr(ts_text, 9, 2)
      ELSE regexp_extract(ts_text, '[A-Za-z]{{3}} +([0-9]{{1,2}}) ', 1) END AS day,
    CASE WHEN regexp_matches(ts_text, '^[0-9]{{2}}/') THEN substr(ts_text, 13, 8)
      ELSE regexp_extract(ts_text, '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}', 0) END AS clock
  FROM classified WHERE ts_text IS NOT NULL),
gaps AS (
  SELECT *, month - last_value(month IGNORE NULLS) OVER {order} UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM parts),
turned AS (
  SELECT *, sum(CASE WHEN gap <= -6 THEN 1 WHEN gap >= 6 THEN -1 ELSE 0 END) OVER {order} UNBOUNDED PRECEDING
    AND CURRENT ROW) AS turns FROM gaps),
fixes AS (SELECT *, CASE WHEN month IS NOT NULL THEN year - turns END AS fixed FROM turned),
years AS (
  SELECT *, coalesce(year, turns + coalesce(
    last_value(fixed IGNORE NULLS) OVER {order} UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(fixed IGNORE NULLS) OVER {order} CURRENT ROW AND UNBOUNDED FOLLOWING),
    {q.LAST_YEAR} - last_value(turns) OVER {order} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) AS y FROM fixes),
times AS (
  SELECT *, try_strptime(concat(CAST(y AS INT), '-', month, '-', CAST(day AS INT), ' ', clock), '%Y-%-m-%-d %H:%M:%S') AS tm
  FROM years),
timed AS (
  SELECT *, CASE WHEN tm IS NOT NULL THEN CAST(greatest(coalesce(epoch(max(tm) OVER {order} UNBOUNDED PRECEDING
    AND 1 PRECEDING)) - epoch(tm), 0), 0) AS BIGINT) END AS behind FROM times)"""


# -- templates and metrics --------------------------------------------------

_rank = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cat.RANK.items()) + " END"
_of_rank = "CASE rank " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in cat.RANK.items()) + " END"
_level_counts = ", ".join(
    f"count(*) FILTER (NOT is_noise AND severity = '{lv}') AS n_{lv}" for lv in cat.LEVELS
)

_TABLES = f"""
keyed AS (SELECT *, {_template} AS template FROM classified WHERE NOT is_stack),
grouped AS (
  SELECT source, template, arg_min(cleaned, line_no) AS sample, count(*) AS n,
    max({_rank}) AS rank, min(line_no) AS first_line
  FROM keyed GROUP BY source, template),
templates AS (
  SELECT source, template, sample, n, {_of_rank} AS severity, first_line FROM grouped),
uniques AS (
  SELECT source, count(*) AS u, count(*) FILTER (rank >= 3) AS important,
    count(*) FILTER (rank = 0) AS unclassified
  FROM grouped GROUP BY source),
totals AS (
  SELECT source, count(*) AS total_lines, count(*) FILTER (is_noise) AS noise_lines,
    arg_min(ts_text, line_no) FILTER (NOT is_noise AND ts_text IS NOT NULL) AS first_ts,
    arg_max(ts_text, line_no) FILTER (NOT is_noise AND ts_text IS NOT NULL) AS last_ts,
    {_level_counts}
  FROM annotated GROUP BY source),
metrics AS (
  SELECT totals.*, coalesce(u, 0) AS unique_lines, coalesce(important, 0) AS important,
    coalesce(unclassified, 0) AS unclassified,
    CAST((2000 * (total_lines - coalesce(u, 0)) + total_lines) // (2 * total_lines) AS DOUBLE)
      / 10 AS reduction_pct
  FROM totals LEFT JOIN uniques USING (source))"""
TEMPLATES = f"{ANNOTATED},{_TABLES}"
EVERYTHING = f"{MEMBERS},{_TABLES}"

_GRAVE = "severity IN ('fatal', 'error', 'warning')"
_FREQUENT = f"NOT {_GRAVE} AND n >= {cat.FREQUENT_FROM}"


def first_templates(where: str, k: int) -> str:
    return (
        "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_line)"
        f" AS pos FROM templates WHERE {where}) WHERE pos <= {k})"
    )


def _joined(sections: list[str], name: str) -> str:
    union = "\nUNION ALL\n".join(sections)
    return (
        f"SELECT source, string_agg(text, chr(10) ORDER BY section, pos) AS {name} FROM (\n"
        f"{union}\n) WHERE text IS NOT NULL GROUP BY source"
    )


def _row(section: int, pos: int | str, text: str, source: str) -> str:
    return f"SELECT source, {section} AS section, {pos} AS pos, {text} AS text FROM {source}"


_shown = fill(w.TEMPLATE, "upper(severity)", shown("sample"))
_times = fill(w.TIMES, "n")
_times_if = f"(CASE WHEN n > 1 THEN {_times} ELSE '' END)"
_traces_n = "(SELECT * FROM traces JOIN trace_counts USING (source) WHERE trace_id <= {})"
_levels = " UNION ALL ".join(
    f"SELECT source, {i} AS pos, '{lv}' AS severity, n_{lv} AS n FROM metrics WHERE n_{lv} > 0"
    for i, lv in enumerate(cat.LEVELS, 1)
)

SUMMARY = _joined(
    [
        _row(1, 1, lit(w.SUMMARY), "metrics"),
        _row(1, 2, fill(w.TOTAL, "total_lines"), "metrics"),
        _row(1, 3, fill(w.UNIQUE, "unique_lines", "reduction_pct"), "metrics"),
        _row(1, 4, fill(w.NOISE, "noise_lines"), "metrics"),
        _row(1, 5, fill(w.TIME_RANGE, "first_ts", "last_ts"), "metrics"),
        _row(2, 0, lit(w.BREAKDOWN), "metrics"),
        _row(2, "pos", fill(w.BREAKDOWN_LEVEL, "upper(severity)", "n"), f"({_levels})"),
        _row(3, 0, fill(w.TRACES, "n_traces"), "trace_counts"),
        _row(3, "trace_id", fill(w.TRACE, "trace_id", "header_line", "summary"),
             _traces_n.format(cat.SUMMARY_TRACES)),
        _row(3, cat.SUMMARY_TRACES + 1,
             fill(w.MORE_TRACES, f"n_traces - {cat.SUMMARY_TRACES}"),
             f"trace_counts WHERE n_traces > {cat.SUMMARY_TRACES}"),
        _row(4, 0, lit(w.IMPORTANT), "metrics WHERE important > 0"),
        _row(4, "pos", f"{_shown} || {_times_if}", first_templates(_GRAVE, cat.SUMMARY_TEMPLATES)),
        _row(5, 0, lit(w.FREQUENT),
             f"(SELECT DISTINCT source FROM templates WHERE {_FREQUENT})"),
        _row(5, "pos", f"{_shown} || {_times}", first_templates(_FREQUENT, cat.SUMMARY_FREQUENT)),
    ],
    "summary",
)

_level_json = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN n_{lv} > 0 THEN {fill(w.DIGEST_LEVEL, lit(lv), f'n_{lv}')} END" for lv in cat.LEVELS
) + ")"

DIGEST = _joined(
    [
        _row(1, 1, fill(w.DIGEST_TOTALS, "total_lines", "unique_lines", "noise_lines"), "metrics"),
        _row(1, 2, fill(w.DIGEST_RANGE, "first_ts", "last_ts"), "metrics"),
        _row(1, 3, fill(w.DIGEST_LEVELS, "'{' || " + _level_json + " || '}'"), "metrics"),
        _row(2, 0, fill(w.DIGEST_IMPORTANT, "important"), "metrics WHERE important > 0"),
        _row(2, "pos", fill(w.DIGEST_TEMPLATE, "upper(severity)", "n", "sample"),
             first_templates(_GRAVE, cat.DIGEST_TEMPLATES)),
        _row(3, 0, fill(w.DIGEST_TRACES, "n_traces"), "trace_counts"),
        _row(3, "trace_id", fill(w.DIGEST_TRACE, "trace_id", "header_line", "summary"),
             _traces_n.format(cat.DIGEST_TRACES)),
        _row(4, 0, fill(w.DIGEST_UNKNOWN, f"least(unclassified, {cat.DIGEST_UNKNOWN})"),
             "metrics WHERE unclassified > 0"),
        _row(4, "pos", f"sample || {_times_if}",
             first_templates("severity = 'unknown'", cat.DIGEST_UNKNOWN)),
    ],
    "digest",
)

# -- replies ----------------------------------------------------------------

_WHOLE = """concat(
  '{"primary_issue": "order ', o_orderkey, ' is late", "error_signatures": [{"pattern": "late ',
  o_orderpriority, '", "category": "timeout", "count": ', o_orderkey % 90,
  ', "first_seen_timestamp": "', strftime(o_orderdate, '%Y-%m-%d'),
  '", "affected_component": "cust-', o_custkey, '"}, {"pattern": "status ', o_orderstatus,
  '"}], "root_cause": "priority ', o_orderpriority,
  '", "timeline": [{"timestamp": "', strftime(o_orderdate, '%Y-%m-%d'),
  '", "event": "placed"}, {"event": "late"}], "attention_needed": ["order ', o_orderkey,
  '", "customer"], "noise_assessment": "low"}')"""

_PARSING = r"""
unfenced AS (
  SELECT source, reply, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    reply, '^\s+|\s+$', '', 'g'), '^```json', ''), '```$', ''), '^\s+|\s+$', '', 'g') AS raw_json
  FROM replies),
typed AS (
  SELECT *, CASE WHEN json_valid(raw_json) AND NOT regexp_matches(raw_json, ': NaN')
    THEN json_type(raw_json) END AS kind
  FROM unfenced),
keyed_objects AS (
  SELECT *, coalesce(len(keys) <> len(list_distinct(keys)), false) AS repeated
  FROM (SELECT *, json_keys(CASE WHEN kind = 'OBJECT' THEN raw_json END) AS keys FROM typed)),
checked AS (
  SELECT *, coalesce(kind = 'OBJECT' AND NOT repeated, false) AS is_object,
    CASE WHEN repeated THEN 'repeated key' WHEN kind IS NULL THEN 'not JSON'
      ELSE 'not an object' END AS reason
  FROM keyed_objects),
objects AS (SELECT source, raw_json, CAST(raw_json AS JSON) AS j FROM checked WHERE is_object),
analyses AS (
  SELECT source, raw_json, coalesce(j->>'primary_issue', 'Unknown') AS primary_issue,
    coalesce(j->>'root_cause', 'Unknown') AS root_cause,
    coalesce(j->>'noise_assessment', 'Unknown') AS noise_assessment, j
  FROM objects),
signatures AS (
  SELECT source, pos, coalesce(item->>'pattern', '?') AS pattern,
    coalesce(item->>'category', 'unknown') AS category, coalesce(item->>'count', '1') AS "count",
    item->>'first_seen_timestamp' AS first_seen_timestamp,
    coalesce(item->>'affected_component', 'unknown') AS affected_component
  FROM (SELECT source, unnest(ls) AS item, CAST(generate_subscripts(ls, 1) AS BIGINT) AS pos
    FROM (SELECT source, list_filter(CAST(j->'error_signatures' AS JSON[]),
      lambda x: json_type(x) = 'OBJECT') AS ls FROM analyses))),
timelines AS (
  SELECT source, pos, coalesce(item->>'timestamp', '?') AS "timestamp",
    coalesce(item->>'event', '?') AS event
  FROM (SELECT source, unnest(ls) AS item, CAST(generate_subscripts(ls, 1) AS BIGINT) AS pos
    FROM (SELECT source, list_filter(CAST(j->'timeline' AS JSON[]),
      lambda x: json_type(x) = 'OBJECT') AS ls FROM analyses))),
attentions AS (
  SELECT source, pos, item->>'$' AS item
  FROM (SELECT source, unnest(ls) AS item, CAST(generate_subscripts(ls, 1) AS BIGINT) AS pos
    FROM (SELECT source, list_filter(CAST(j->'attention_needed' AS JSON[]),
      lambda x: json_type(x) <> 'NULL') AS ls FROM analyses)))"""

ORDER_REPLIES = f"""
whole AS (SELECT *, {_WHOLE} AS w FROM orders),
replies AS (
  SELECT concat('order-', o_orderkey) AS source, CASE o_orderkey % 11
    WHEN 0 THEN '```json' || chr(10) || w || chr(10) || '```'
    WHEN 1 THEN '```' || w || '```'
    WHEN 2 THEN concat('no analysis for order ', o_orderkey)
    WHEN 3 THEN '[' || w || ']'
    WHEN 4 THEN '{{}}'
    WHEN 5 THEN '  ' || chr(10) || w || chr(10) || chr(9)
    WHEN 6 THEN concat('{{"primary_issue": null, "root_cause": "see ', o_orderkey,
      '", "error_signatures": [{{"category": "crash", "count": "', o_orderkey,
      '"}}], "timeline": [{{"timestamp": null, "event": null}}], "extra": [1, 2]}}')
    WHEN 7 THEN concat('{{"timeline": [{{"event": "placed"}}, 3, null, "x"], "attention_needed": [null, "order ',
      o_orderkey, '", 7], "error_signatures": ["no object", {{"pattern": "late"}}]}}')
    WHEN 8 THEN '{{"root_cause": "a", "root_cause": "b"}}'
    WHEN 9 THEN '{{"primary_issue": NaN}}'
    ELSE w END AS reply
  FROM whole),{_PARSING}"""

_SERVICE_REPLIES = """
replies AS (
  SELECT concat('svc-', s) AS source, concat('{"primary_issue": "', n,
    ' errors", "root_cause": "pool of ', s, '", "error_signatures": [{"pattern": "error", "count": ',
    n, '}], "attention_needed": ["svc-', s, '"]}') AS reply
  FROM (SELECT user_id % 8 AS s, count(*) FILTER (event_type = 'error') AS n
    FROM events GROUP BY 1) WHERE s < 6)"""
SERVICE_REPLIES = f"{_SERVICE_REPLIES},{_PARSING}"

SEMANTIC = _joined(
    [
        _row(1, 1, lit(w.SEMANTIC), "analyses"),
        _row(1, 2, fill(w.PRIMARY, "primary_issue"), "analyses"),
        _row(1, 3, fill(w.CAUSE, "root_cause"), "analyses"),
        _row(2, 0, lit(w.SIGNATURES), "(SELECT DISTINCT source FROM signatures)"),
        _row(2, "pos",
             fill(w.SIGNATURE, "pattern", "category", "affected_component", '"count"'),
             "signatures"),
        _row(3, 0, lit(w.TIMELINE), "(SELECT DISTINCT source FROM timelines)"),
        _row(3, "pos", fill(w.EVENT, '"timestamp"', "event"), "timelines"),
        _row(4, 0, lit(w.ATTENTION), "(SELECT DISTINCT source FROM attentions)"),
        _row(4, "pos", fill(w.ATTENTION_ITEM, "item"), "attentions"),
        _row(5, 1, fill(w.NOISE_NOTE, "noise_assessment"), "analyses"),
    ],
    "semantic",
)

# -- the queries ------------------------------------------------------------

_MATCH = f"regexp_matches(line, {lit(q.PATTERN)}, 'i')"
_RAW_SEVERITY = _severity.replace("cleaned", f"({replaced('line', cat.ANSI)})")
_BREAK = lit(cat.LINE_BREAK)
_AROUND = f"line_no BETWEEN {q.AROUND_LINE - q.AROUND_CONTEXT} AND {q.AROUND_LINE + q.AROUND_CONTEXT}"


def _matched(where: str) -> str:
    return (
        f"(SELECT source, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY source"
        f" ORDER BY line_no) AS r FROM log_lines WHERE {where}) WHERE r <= {q.FIRST_LINES})"
    )


def _over(tables: str, select: str) -> str:
    return f"WITH {tables}\n{select}"


def _classified(expr: str, name: str) -> str:
    return _over(ANNOTATED, f"SELECT source, line_no, {expr} AS {name} FROM classified")


def parts_of_traces(name: str, part_lines: int) -> str:
    return (
        f"SELECT m.source, m.trace_id, m.header_line, (pos - 1) // {part_lines} AS part,"
        f" (n_lines + {part_lines - 1}) // {part_lines} AS n_parts, count(*) AS part_lines, n_lines,"
        f" string_agg(cleaned, chr(10) ORDER BY pos) AS {name}"
        " FROM members m JOIN traces USING (source, trace_id) GROUP BY 1, 2, 3, 4, 5, 7"
    )


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_ROLLUP = """
SELECT CAST(level AS BIGINT) AS level, folder, sliced,
  strftime(slice, '%Y-%m-%d %H:%M:%S') AS slice, severity, count(*) AS n
FROM (
  SELECT l.level, array_to_string(list_slice(string_split(source, '/'), 1, l.level), '/') AS folder, s.sliced,
    CASE WHEN s.sliced THEN date_trunc('month', tm) END AS slice, severity
  FROM timed, (SELECT unnest([1, 2, 3]) AS level) l, (SELECT unnest([true, false]) AS sliced) s
  UNION ALL
  SELECT 0, NULL, s.sliced, CASE WHEN s.sliced THEN date_trunc('month', tm) END, severity
  FROM timed, (SELECT unnest([true, false]) AS sliced) s)
GROUP BY ALL"""

# The lines of documents as they are, and the sets of their templates.
_PLAIN_DOCS = """split_docs AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(text, '({b})$', ''), {q}) AS ls
  FROM documents WHERE trim(text) <> ''),
log_lines AS (
  SELECT concat('doc-', doc_id) AS source, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no, unnest(ls) AS line
  FROM split_docs)""".format(b=cat.LINE_BREAK, q=_BREAK)
_SETS = f"""{_of_documents(ANNOTATED).replace(DOC_LINES, _PLAIN_DOCS)},
sets AS (
  SELECT source, list_sort(list_distinct(list({_doc_template}))) AS tokens
  FROM classified WHERE NOT is_stack GROUP BY source),
classes AS (SELECT tokens, len(tokens) AS size, min(source) AS name FROM sets GROUP BY tokens)"""
_PAIRS = f"""
SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(common AS DOUBLE) / (na + nb - common) AS similarity
FROM (
  SELECT x.name AS a, y.name AS b, any_value(x.size) AS na, any_value(y.size) AS nb, count(*) AS common
  FROM (SELECT name, size, unnest(tokens) AS token FROM classes) x
  JOIN (SELECT name, size, unnest(tokens) AS token FROM classes) y ON x.token = y.token AND x.name < y.name
  GROUP BY 1, 2)
WHERE CAST(common AS DOUBLE) / (na + nb - common) >= {q.SIMILAR}"""

_DOCS = "docs AS (SELECT concat('doc-', doc_id) AS source, doc_id, text FROM documents)"
_TEMPLATE_COLUMNS = "source, template, sample, n, severity, first_line"
_INGEST = f"""
SELECT m.source, concat_ws(chr(10), summary,
  coalesce(chr(10) || semantic, {lit(w.NO_ANALYSIS)}), {lit(w.RULE)}, {lit(w.DRILL_HINT)},
  {fill(w.STORED, "m.source", "total_lines")}) AS report
FROM metrics m JOIN summaries USING (source) LEFT JOIN semantics USING (source)"""

ORACLE: dict[str, str] = {
    "log_lines": _over(LOG_LINES, "SELECT source, line_no, line FROM log_lines"),
    "log_lines_chunked": _over(LOG_LINES, "SELECT source, line_no, line FROM log_lines"),
    "log_files": _over(LOG_LINES, "SELECT source, line_no, line FROM log_lines"),
    "stored_lines": _over(SESSION, "SELECT source, line_no, line FROM log_lines"),
    "unknown_labels": "SELECT DISTINCT concat('svc-', user_id) AS source FROM events"
    " WHERE user_id >= 8",
    "lines_from_text": _over(
        _DOCS,
        "SELECT source, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no, unnest(ls) AS line"
        f" FROM (SELECT source, regexp_split_to_array(regexp_replace(text, '({cat.LINE_BREAK})$',"
        f" ''), {_BREAK}) AS ls FROM docs WHERE trim(text) <> '')",
    ),
    "rejected_sources": _over(
        _DOCS,
        "SELECT source, CASE WHEN doc_id % 7 = 0 THEN 'empty input' ELSE 'no input' END AS reason"
        " FROM docs WHERE doc_id % 7 = 0 OR doc_id % 11 = 0",
    ),
    "appended_lines": _over(
        ANNOTATED, "SELECT source, line_no, line, cleaned, is_noise, severity, ts_text, is_stack FROM annotated"
    ),
    "appended_traces": _over(
        MEMBERS, "SELECT source, trace_id, header_line, n_lines, severity, summary FROM traces"
    ),
    "appended_templates": _over(TEMPLATES, "SELECT source, template, n, severity, first_line FROM templates"),
    "appended_report": _over(
        f"{EVERYTHING},\nsummaries AS ({SUMMARY}),\nsemantics AS (SELECT '' AS source, '' AS semantic WHERE false)",
        _INGEST,
    ),
    "compacted_lines": _over(SESSION, "SELECT source, line_no, line FROM log_lines"),
    "followed_lines": _over(LOG_LINES, "SELECT source, line_no, line FROM log_lines"),
    "indexed_search": _over(
        LOG_LINES,
        f"SELECT *, count(*) OVER (PARTITION BY source) >= {q.FIRST_LINES} AS capped FROM " + _matched(_MATCH),
    ),
    "event_times": _over(
        _timed(ANNOTATED.replace(LOG_LINES, SYSLOG_LINES)),
        f"SELECT source, line_no, ts_text, {_TIME.format('tm')} AS event_time, behind FROM timed",
    ),
    "event_ranges": _over(
        _timed(ANNOTATED.replace(LOG_LINES, SYSLOG_LINES)),
        f"SELECT source, {_TIME.format('min(tm)')} AS first_event, {_TIME.format('max(tm)')} AS last_event,"
        " count(tm) AS timed_lines, count(*) FILTER (behind > 0) AS late_lines, max(behind) AS most_behind"
        " FROM timed GROUP BY source",
    ),
    "severity_rollup": _over(_timed(ANNOTATED.replace(LOG_LINES, SYSLOG_LINES)), _ROLLUP),
    "severity_by_time": _over(
        _timed(ANNOTATED),
        f"SELECT source, {_TIME.format("date_trunc('hour', tm)")} AS slice, severity, count(*) AS n FROM"
        " (SELECT source, severity, tm FROM timed UNION ALL"
        " SELECT source, severity, NULL FROM classified WHERE ts_text IS NULL) GROUP BY 1, 2, 3",
    ),
    "similar_sources": _over(_SETS, _PAIRS),
    "similar_source_classes": _over(
        _SETS, "SELECT source, name AS first_source FROM sets JOIN classes USING (tokens)"
    ),
    "clean_lines": _over(ANNOTATED, "SELECT source, line_no, cleaned FROM annotated"),
    "severity_detect": _classified("severity", "severity"),
    "timestamp_extract": _classified("ts_text", "ts_text"),
    "noise_lines": _over(
        ANNOTATED, "SELECT source, line_no, cleaned FROM annotated WHERE is_noise"
    ),
    "stack_lines": _over(
        ANNOTATED, "SELECT source, line_no, cleaned FROM annotated WHERE is_stack"
    ),
    "exception_lines": _over(
        ANNOTATED,
        "SELECT source, line_no, cleaned FROM classified WHERE "
        + matches("cleaned", cat.EXCEPTION),
    ),
    "template_key": _classified(_template, "template"),
    "display_text": _classified(shown("cleaned"), "shown"),
    "classify_lines": _over(
        ANNOTATED,
        "SELECT source, line_no, line, cleaned, severity, ts_text, is_stack FROM classified",
    ),
    "document_severity": _over(
        _of_documents(ANNOTATED), "SELECT source, line_no, severity, ts_text FROM classified"
    ),
    "document_templates": _over(
        _of_documents(ANNOTATED),
        f"SELECT source, line_no, {_doc_template} AS template, {_doc_shown('cleaned')} AS shown"
        " FROM classified",
    ),
    "document_traces": _over(
        _of_documents(MEMBERS), "SELECT source, trace_id, severity, n_lines, summary FROM traces"
    ),
    "trace_lines": _over(
        MEMBERS,
        "SELECT source, trace_id, header_line, pos, line_no, cleaned AS line FROM members",
    ),
    "stack_traces": _over(
        MEMBERS,
        parts_of_traces("lines", q.PART_LINES),
    ),
    "stack_traces_chunked": _over(MEMBERS, parts_of_traces("lines", q.SMALL_PART_LINES)),
    "trace_summary_chunked": _over(MEMBERS, "SELECT source, trace_id, summary FROM traces"),
    "trace_text": _over(
        MEMBERS,
        parts_of_traces("text", q.PART_LINES),
    ),
    "trace_severity": _over(
        MEMBERS, "SELECT source, trace_id, header_line, n_lines, severity FROM traces"
    ),
    "trace_summary": _over(MEMBERS, "SELECT source, trace_id, summary FROM traces"),
    "dedup_templates": _over(TEMPLATES, f"SELECT {_TEMPLATE_COLUMNS} FROM templates"),
    "severity_counts": _over(
        ANNOTATED, "SELECT source, severity, count(*) AS n FROM classified GROUP BY 1, 2"
    ),
    "timestamps_seen": _over(
        ANNOTATED,
        "SELECT source, line_no, ts_text FROM classified WHERE ts_text IS NOT NULL",
    ),
    "time_range": _over(TEMPLATES, "SELECT source, first_ts, last_ts FROM totals"),
    "source_metrics": _over(TEMPLATES, "SELECT * FROM metrics"),
    "important_templates": _over(
        TEMPLATES,
        f"SELECT {_TEMPLATE_COLUMNS}, pos FROM {first_templates(_GRAVE, cat.SUMMARY_TEMPLATES)}",
    ),
    "high_frequency_templates": _over(
        TEMPLATES,
        f"SELECT {_TEMPLATE_COLUMNS}, pos FROM {first_templates(_FREQUENT, cat.SUMMARY_FREQUENT)}",
    ),
    "top_traces": _over(
        MEMBERS,
        "SELECT source, trace_id, header_line, summary, n_traces FROM traces"
        f" JOIN trace_counts USING (source) WHERE trace_id <= {cat.SUMMARY_TRACES}",
    ),
    "severity_breakdown": _over(
        TEMPLATES, f"SELECT source, CAST(pos AS BIGINT) AS pos, severity, n FROM ({_levels})"
    ),
    "summary_report": _over(EVERYTHING, SUMMARY),
    "ingest_report": _over(
        f"{EVERYTHING},\n{SERVICE_REPLIES},\nsummaries AS ({SUMMARY}),\nsemantics AS ({SEMANTIC})",
        _INGEST,
    ),
    "analysis_digest": _over(EVERYTHING, DIGEST),
    "list_sources": _over(
        f"{TEMPLATES},\n{SERVICE_REPLIES}",
        "SELECT source, total_lines, unique_lines, n_error + n_fatal AS errors,"
        " source IN (SELECT source FROM analyses) AS has_semantic FROM metrics",
    ),
    "listing": _over(
        f"{TEMPLATES.replace(LOG_LINES, SESSION)},\n{SERVICE_REPLIES}",
        "SELECT source, "
        + fill(
            w.LISTING,
            "source",
            "total_lines",
            "unique_lines",
            "n_error + n_fatal",
            f"CASE WHEN {_EVEN} AND source IN (SELECT source FROM analyses) THEN '✓' ELSE '✗' END",
        )
        + " AS text FROM metrics",
    ),
    "compacted_listing": _over(
        f"{TEMPLATES.replace(LOG_LINES, SESSION)},\n{SERVICE_REPLIES}",
        "SELECT source, "
        + fill(
            w.LISTING,
            "source",
            "total_lines",
            "unique_lines",
            "n_error + n_fatal",
            f"CASE WHEN {_EVEN} AND source IN (SELECT source FROM analyses) THEN '✓' ELSE '✗' END",
        )
        + " AS text FROM metrics",
    ),
    "lines_around": _over(
        LOG_LINES,
        f"SELECT source, line_no, line, line_no = {q.AROUND_LINE} AS is_center FROM log_lines"
        f" WHERE source = {lit(q.AROUND_SOURCE)} AND {_AROUND}",
    ),
    "lines_around_hits": _over(
        ANNOTATED,
        "SELECT l.source, h.line_no AS center, l.line_no, l.line, l.line_no = h.line_no"
        " AS is_center FROM annotated h JOIN log_lines l ON l.source = h.source AND l.line_no"
        f" BETWEEN h.line_no - {q.HIT_CONTEXT} AND h.line_no + {q.HIT_CONTEXT}"
        " WHERE h.severity = 'fatal'",
    ),
    "grep_lines": _over(LOG_LINES, f"SELECT source, line_no, line FROM log_lines WHERE {_MATCH}"),
    "grep_literal": _over(
        LOG_LINES,
        f"SELECT source, line_no, line FROM log_lines WHERE contains(lower(line), {lit(q.LITERAL)})",
    ),
    "lines_by_severity": _over(
        LOG_LINES,
        f"SELECT source, line_no, line FROM log_lines WHERE ({_RAW_SEVERITY}) = 'fatal'",
    ),
    "first_matches": _over(
        LOG_LINES,
        f"SELECT *, count(*) OVER (PARTITION BY source) >= {q.FIRST_LINES} AS capped FROM "
        + _matched(f"{_MATCH} AND ({_RAW_SEVERITY}) = 'error'"),
    ),
    "render_lines": _over(
        LOG_LINES,
        f"SELECT source, {fill(w.MATCH_HEADER, 'count(*)')} || CASE WHEN count(*) >="
        f" {q.FIRST_LINES} THEN {fill(w.CAPPED, str(q.FIRST_LINES))} ELSE '' END || ':' || chr(10)"
        " || string_agg('  ' || repeat(' ', 6 - length(CAST(line_no AS VARCHAR)))"
        " || CAST(line_no AS VARCHAR) || ' | ' || line, chr(10) ORDER BY line_no)"
        f" AS text FROM {_matched(f'({_RAW_SEVERITY}) = ' + lit('error'))} GROUP BY source",
    ),
    "parse_analyses": _over(
        ORDER_REPLIES,
        "SELECT source, primary_issue, coalesce(s.n, 0) AS error_signatures, root_cause,"
        " coalesce(t.n, 0) AS timeline, coalesce(x.n, 0) AS attention_needed, noise_assessment,"
        " CAST(coalesce(json_array_length(j->'error_signatures'), 0)"
        " + coalesce(json_array_length(j->'timeline'), 0)"
        " + coalesce(json_array_length(j->'attention_needed'), 0) AS BIGINT)"
        " - coalesce(s.n, 0) - coalesce(t.n, 0) - coalesce(x.n, 0) AS dropped, raw_json"
        " FROM analyses"
        + "".join(
            f" LEFT JOIN (SELECT source, count(*) AS n FROM {table} GROUP BY 1) {name} USING (source)"
            for table, name in (("signatures", "s"), ("timelines", "t"), ("attentions", "x"))
        ),
    ),
    "bad_replies": _over(ORDER_REPLIES, "SELECT source, reply, reason FROM checked WHERE NOT is_object"),
    "error_signatures": _over(ORDER_REPLIES, "SELECT * FROM signatures"),
    "timeline": _over(ORDER_REPLIES, "SELECT * FROM timelines"),
    "attention_lines": _over(ORDER_REPLIES, "SELECT * FROM attentions"),
    "semantic_report": _over(ORDER_REPLIES, SEMANTIC),
    "get_analysis": _over(
        SERVICE_REPLIES, "SELECT source, raw_json FROM analyses WHERE source = 'svc-2'"
    ),
}
