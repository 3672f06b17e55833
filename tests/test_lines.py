from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logsift.functions import catalogue as cat
from logsift.functions import text as tx
from logsift.functions.dialect import unicode_form, user_match
from tests import plain


def test_ansi(apply):
    coloured = {
        "\x1b[36mcache\x1b[0m": "cache",
        "\x1b[7;33mdisk\x1b[m full \x1b[4mnow\x1b[24m": "disk full now",
        "a\x1b[48;5;17mb": "ab",
        "[31mno escape": "[31mno escape",
    }
    assert apply(tx.strip_ansi, list(coloured)) == list(coloured.values())
    assert apply(tx.clean, ["  a \t  ", "\x1b[0m \x1f", ""]) == ["  a", "", ""]


@pytest.mark.parametrize(
    "level, lines",
    [
        ("fatal", ["emerg: kernel halted", "node-3 CRITICAL quorum lost", "<crit> fan", "Alert 7"]),
        ("error", ["job 9 err", "worker(Error) exit 1", "ERROR=socket", "warn then error"]),
        ("warning", ["disk warn 91%", "Warning! clock drift", "info: warn"]),
        ("info", ["INFO boot took 3s", "systemd notice", "debug info"]),
        ("debug", ["debug=on", "trace id 4", "-- verbose --"]),
        ("unknown", ["hello", "errors", "informal", "traces", "2031-05-06 up", "war ning"]),
    ],
)
def test_severity(apply, level, lines):
    assert apply(tx.detect_severity, lines) == [level] * len(lines)


def test_timestamp(apply):
    cases = {
        "started 2031-02-03T04:05:06.700Z pid 8": "2031-02-03T04:05:06",
        "<6>1999-12-31 23:59:59,001 tick": "1999-12-31 23:59:59",
        '10.0.0.9 - - [07/Aug/2019:08:09:10 -0200] "PUT /v1"': "07/Aug/2019:08:09:10",
        "Mar  3 21:22:23 gw7 dhcpd: lease": "Mar  3 21:22:23",
        "[Tue Feb 29 00:00:01 2028] [warn] child": "[Tue Feb 29 00:00:01 2028]",
        "at 21:22:23 nothing": None,
        "2031-02-03": None,
        "Mar  3 21:22:23 relayed 2031-02-03 04:05:06": "2031-02-03 04:05:06",
    }
    assert apply(tx.extract_timestamp, list(cases)) == list(cases.values())


def test_noise(apply):
    noise = ["", " ", "\t \t", "-----------", "======", " ...", "...\t", "---", "==="]
    real = ["- -", "--", "==", "---|---", "=== x", "....", ". . .", "0"]
    assert apply(tx.is_noise, noise) == [True] * len(noise)
    assert apply(tx.is_noise, real) == [False] * len(real)


def test_stack_lines(apply):
    stack = [
        "\tat org.demo.Pool$Task.run(Pool.java:88)",
        "  at async next (app.js:7:3)",
        '    File "lib/io.py", line 300, in read',
        "\traise ValueError(name) from None",
        "   7: core::panicking::panic",
        "      ^^",
        "Caused by: org.demo.Closed",
        "   Caused by: eof",
        "Traceback (innermost last):",
        " ... 3 common frames",
        "|  let x = 1;",
        "  | note",
    ]
    other = ["at noon", "File \"x\"", "7: core", "^^", "raise it", "because", "a | b", "...3"]
    assert apply(tx.is_stack_line, stack) == [True] * len(stack)
    assert apply(tx.is_stack_line, other) == [False] * len(other)


def test_exception_lines(apply):
    yes = ["TimeoutError: No", "java.lang.NullPointerException: x", "KeyError", "WARN: x"]
    no = ["panic: x", "A b", "timeout: x", "  KeyError: x"]
    assert apply(tx.is_exception_line, yes + no) == [True] * len(yes) + [False] * len(no)


def test_template(apply):
    cases = {
        "ERR 12 10:30:45 x": "<TS> x",
        "Jan 12 10:30:45 x": "<TS> x",
        "2024-01-15T10:00:00.123Z y": "<TS>.123Z y",
        "15/Jan/2024:10:30:45 +0000": "<TS> +<NUM>",
        "ptr 0xDEADBEEF job 12345 5000ms req-0001": "ptr <ADDR> job <NUM> 5000ms req-<NUM>",
        "id A1B2C3D4-E5F6-4789-0123-456789ABCDEF": "id <UUID>",
        "[2024-01-15 10:00:00] in": "[<TS>] in",
    }
    assert apply(tx.template_key, list(cases)) == list(cases.values())


def test_display(apply):
    cases = {
        "[ERROR] a ERROR b": "a ERROR b",
        "[2024-01-15 10:00:00] [WARN] slow": "slow",
        "[Sun Dec 04 04:47:44 2005] [error] mod_x": "mod_x",
        "started ok INFO: yes": "started ok: yes",
        "none": "none",
    }
    assert apply(tx.display_text, list(cases)) == list(cases.values())


def _random_lines(count, seed):
    rng = random.Random(seed)
    words = [
        "ERROR", "err", "Warn", "WARNING", "info", "NOTICE", "fatal", "alert", "trace", "VERBOSE",
        "ınfo", "éerror", "x́DEBUG", "2024-01-15 10:30:45", "٢٠٢٤-٠١-١٥ ١٠:٣٠:٤٥",
        "Jan 5 01:02:03", "fév 1 01:02:03", "15/Jan/2024:10:30:45", "[Sun Dec 04 04:47:44 2005]",
        "0xBEEF", "12345", "99999999999", "١٢٣٤٥", "A1B2C3D4-E5F6-4789-0123-456789ABCDEF",
        "[", "]", "[]", "at", "File \"x\"", "...", "|", "7:", "Traceback (", "raise", "Caused by:",
        "^^^", "---", "===", "KeyError:", "a.b.Cd,", "\xc9", "\xe9.Ab", "\xdcnder", "\xb2", "\u203f",
        "x\u0301DEBUG", "_", "\xa0", "\u2003", "\x1f", "\u3000", " ", "  ", "\t", "\x1b[31m",
        "\x1b[0m", "\u65e5\u672c", "\U0001f600", "\u0130NFO", "NOT\u0131CE", "\uff11\uff12\uff13\uff14",
    ]
    for _ in range(count):
        joiner = rng.choice(["", " ", " "])
        yield joiner.join(rng.choices(words, k=rng.randint(0, 6)))


def test_functions_equal_plain_python_on_any_script(apply):
    lines = list(_random_lines(4_000, seed=3))
    cleaned = apply(tx.clean, lines)
    assert cleaned == [plain.clean(line) for line in lines]
    for function, expected in [
        (tx.detect_severity, plain.severity),
        (tx.extract_timestamp, plain.timestamp),
        (tx.is_noise, plain.noise),
        (tx.is_stack_line, plain.stack),
        (tx.is_exception_line, plain.exception),
        (tx.template_key, plain.template),
        (tx.display_text, plain.display),
    ]:
        got = apply(function, cleaned)
        wrong = [(t, g, expected(t)) for t, g in zip(cleaned, got, strict=True) if g != expected(t)]
        assert not wrong, (function.__name__, len(wrong), wrong[:3])


@pytest.mark.parametrize(
    "pattern",
    [
        r"err", r"^\s*at", r"(?P<word>t)(?P=word)", r"[", r"(?P<a_b>err)", r"[[a]", r"a{,2}b",
        r"x\Z", r"é", r"\bwarn\b", r"\d{4}", r"(a)?(?(1)t|r)", r"a&&b", r"\p{L}", r"[a&&b]",
    ],
)
def test_user_pattern(spark, apply, pattern):
    import re
    import warnings

    lines = [*_random_lines(300, seed=5), "a&&b", "tt", "[", "x", "aab", "[[a]", r"\p{L}", "é É"]
    got = apply(lambda c: user_match(spark, c, pattern), lines)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            found = re.compile(pattern, re.I).search
        except re.error:
            found = lambda s: pattern.lower() in s.lower()
    assert got == [bool(found(line)) for line in lines]


@pytest.mark.parametrize(
    "pattern",
    [r"(?P<a_b>err)(?P=a_b)?", r"[[a]", r"[a&&b]", r"[]a]+", r"[^][x]", r"x\v?\Z", r"[\v\01]", r"\0", r"[&[]"],
)
def test_common_differences_run_in_the_jvm(spark, apply, pattern):
    import re
    import warnings

    from pyspark.sql import functions as F

    lines = ["err", "errerr", "[", "a", "&", "b", "]", "x", "x\x0b", "\x01", "\x00", "a]", "é"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    plan = df.where(user_match(spark, F.col("line"), pattern))._jdf.queryExecution().toString()
    assert "Python" not in plan
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = re.compile(pattern, re.I).search
    assert apply(lambda c: user_match(spark, c, pattern), lines) == [bool(found(x)) for x in lines]


def test_classification_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from logsift.operators.lines import classify

    (tmp_path / "a.log").write_text("ERROR x\n\nplain\n")
    lines = spark.readStream.format("text").load(str(tmp_path)).select(F.col("value").alias("line"))
    query = classify(lines).writeStream.format("memory").queryName("classified").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.table("classified").select("cleaned", "severity").collect()
    assert sorted(map(tuple, rows)) == [("ERROR x", "error"), ("plain", "unknown")]


def test_plain_searches_stand_ahead_of_regexes_beyond_ascii(spark):
    """Also of letters that only match in some case, and of words that only begin with a stem."""
    texts = ["crİt é", "CRıT é", "ınfo é", "İNFO é", "NOTıce", "notİce é", "éERROR", "x errors é", "a warnıng", "ß err", "trace_é", "\u212aerr err"]
    texts += [f"{t} 12:34:56 0Xab٣٤٥٦ 1234 é12345 [ ]" for t in texts] + ["é١٢٣٤ ١٢٣٤ x", "é-0x1F -"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F
    for level, pattern in cat.SEVERITY:
        plain = plain.when(t.rlike(unicode_form(pattern, True)), level)
    shown = tx.detect_severity(t)
    found = rows.select("t", shown.alias("found"), plain.otherwise("unknown").alias("plain")).collect()
    assert [(r.t, r.found) for r in found] == [(r.t, r.plain) for r in found]
    in_unicode = str(shown._jc).split("(?iUd)")
    assert all(before.count("contains(") for before in in_unicode[:-1]) and all(after.startswith("(?=") for after in in_unicode[1:])
