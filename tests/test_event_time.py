"""Event times against a plain loop, slices of time, severity by folder and time."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logsift.functions import catalogue as cat
from logsift.operators import event_time as et
from logsift.operators import rollup
from logsift.operators import slices as sl
from logsift.operators import templates as tp
from logsift.operators.lines import classify
from logsift.plans.triage import Triage


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("2024-01-15T10:00:01", (2024, 1, 15, 10, 0, 1)),
        ("2024-01-15 10:00:01", (2024, 1, 15, 10, 0, 1)),
        ("15/Feb/2024:10:20:30", (2024, 2, 15, 10, 20, 30)),
        ("[Mon Mar  4 01:02:03 2024]", (2024, 3, 4, 1, 2, 3)),
        ("Dec  9 23:59:59", (None, 12, 9, 23, 59, 59)),
        ("Foo 31 10:11:12", (None, None, 31, 10, 11, 12)),
        ("2024-13-40 99:99:99", (2024, 13, 40, 99, 99, 99)),
        ("no time", None),
    ],
)
def test_time_parts(spark, text, parts):
    row = spark.createDataFrame([(text,)], "s string").select(et.time_parts(F.col("s")).alias("t")).first().t
    assert row == parts


def plain_times(rows, last_year):
    """``rows`` of (line_no, kind, time): the year counted along the lines, one after the other."""
    month, turns, seen = None, 0, []
    for line_no, named, time in rows:
        if time is not None:
            if month is not None and time.month - month <= -6:
                turns += 1
            elif month is not None and time.month - month >= 6:
                turns -= 1
            month = time.month
        seen.append((line_no, named, time, turns))
    fixed = [time.year - turns if named and time else None for _, named, time, turns in seen]
    out, latest = [], None
    for k, (line_no, named, time, turns) in enumerate(seen):
        before = [f for f in fixed[: k + 1] if f is not None]
        after = [f for f in fixed[k:] if f is not None]
        base = before[-1] if before else after[0] if after else None if last_year is None else last_year - seen[-1][3]
        found = None
        if time is not None:
            year = time.year if named else None if base is None else base + turns
            try:
                found = time.replace(year=year) if year is not None else None
            except ValueError:
                found = None
        behind = None if found is None else max(0, int((latest - found).total_seconds())) if latest else 0
        out.append((line_no, found, behind))
        latest = max(filter(None, (latest, found)), default=None)
    return out


def random_log(seed, n, dated, late):
    rng = random.Random(seed)
    time, rows, lines = dt.datetime(2019, 10, 3), [], []
    for k in range(1, n + 1):
        time += dt.timedelta(hours=rng.randrange(1, 900))
        at = time - dt.timedelta(days=rng.randrange(1, 80)) if rng.random() < late else time
        if rng.random() < 0.1:
            lines.append(f"no time here {k}")
            continue
        if rng.random() < 0.05:
            lines.append("Foo 12 10:10:10 odd")
            rows.append((k, False, None))
            continue
        named = rng.random() < dated
        lines.append(at.strftime("%Y-%m-%d %H:%M:%S x" if named else "%b %d %H:%M:%S x"))
        rows.append((k, named, at))
    return "\n".join(lines), rows


@pytest.mark.parametrize("chunk", [3, 17, 10_000])
def test_equals_a_plain_loop(spark, lines_of, chunk):
    """Years turn and lines come late within chunks, at their borders and across empty ones."""
    logs = {f"s{k}": random_log(k, 120, dated, late) for k, (dated, late) in enumerate([(0.1, 0.2), (0, 0), (0.02, 0.4), (0.6, 0.1), (0, 0.3)])}
    lines = lines_of(**{name: text for name, (text, _) in logs.items()}).drop("chunk")
    found: dict = {}
    for r in et.event_times(lines, 2030, chunk).collect():
        found.setdefault(r.source, []).append((r.line_no, r.event_time, r.behind))
    for name, (_, rows) in logs.items():
        assert sorted(found[name], key=lambda r: r[0]) == plain_times(rows, 2030), name


def test_year_turns_at_a_border_of_chunks(spark, lines_of):
    text = "2023-12-30 10:00:00 a\nDec 31 23:59:58 b\nJan 1 00:00:01 c\nDec 31 23:59:59 late\nJan 2 00:00:00 d"
    for chunk in (1, 2, 3, 9):
        rows = et.event_times(lines_of(a=text).drop("chunk"), None, chunk).orderBy("line_no").collect()
        assert [str(r.event_time) for r in rows] == [
            "2023-12-30 10:00:00", "2023-12-31 23:59:58", "2024-01-01 00:00:01", "2023-12-31 23:59:59", "2024-01-02 00:00:00",
        ]
        assert [r.behind for r in rows] == [0, 0, 0, 2, 0]


def test_no_year_and_no_date(lines_of):
    rows = et.event_times(lines_of(a="Feb 30 10:00:00 x\nFeb 3 10:00:00 y", b="plain")).collect()
    assert [(r.event_time, r.behind) for r in rows] == [(None, None), (None, None)]
    row = et.event_ranges(et.event_times(lines_of(a="Feb 30 10:00:00 x\nFeb 3 10:00:00 y"), 2024)).first()
    assert (row.timed_lines, row.late_lines, row.most_behind) == (1, 0, 0)


# -- slices -----------------------------------------------------------------------


def many_lines(n, words):
    rng = random.Random(n)
    out = []
    for k in range(n):
        time = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=3 * k)
        level = rng.choice(["ERROR", "INFO", "WARN", "nothing"])
        word = words[min(int(rng.expovariate(0.02)), len(words) - 1)]
        out.append(f"{time:%Y-%m-%d %H:%M:%S} {level} {word}" if rng.random() < 0.9 else f"{level} {word}")
    return out


WORDS = [f"{a}{b}{c}" for a in "abcdefgh" for b in "klmnopqr" for c in "uvwxyzst"]


def test_slices_of_parts_merge_into_those_of_the_whole(spark, lines_of):
    text = many_lines(1_200, WORDS)
    whole = sl.time_slices(lines_of(a="\n".join(text)))
    parts = [sl.time_slices(lines_of(a="\n".join(text[k : k + 300]))) for k in range(0, 1_200, 300)]
    union = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    key = lambda r: tuple(map(str, r))
    shown = lambda df: sorted(map(tuple, sl.severity_by_time(df).collect()), key=key)
    assert shown(union) == shown(whole)
    lines = classify(lines_of(a="\n".join(text)))
    counts = Counter(r.severity for r in lines.collect())
    merged = sl.merged_slices(union, "source").first()
    assert {lv: merged[f"n_{lv}"] for lv in cat.LEVELS if merged[f"n_{lv}"]} == dict(counts)


def test_sketches_are_close(spark, lines_of):
    """Distinct templates within 5 %, and no heavy hitter missed, from merged sketches alone."""
    text = many_lines(6_000, WORDS)
    parts = [sl.time_slices(lines_of(a="\n".join(text[k : k + 2_000]))) for k in range(0, 6_000, 2_000)]
    merged = sl.merged_slices(parts[0].union(parts[1]).union(parts[2]), "source")
    groups = tp.templates_of(tp.line_groups(lines_of(a="\n".join(text))))
    exact = {r.template: r.n for r in groups.collect()}
    estimate = sl.distinct_templates(merged).first().n_templates
    assert abs(estimate - len(exact)) <= 0.05 * len(exact)
    found = {r.template: r.n for r in sl.heavy_hitters(merged, 20).collect()}
    most = sorted(exact.values(), reverse=True)[:20]
    assert len(found) == 20 and min(exact[t] for t in found) >= most[-1]
    assert all(abs(n - exact[t]) <= sum(exact.values()) * 3 / sl.TRACKED for t, n in found.items())


def test_late_lines_of_a_store(spark, tmp_path, lines_of):
    """Whatever the order of arrival, the counts are those of the whole log; late lines are told."""
    hours = [f"2024-01-01 {h:02d}:10:00 ERROR at {h}\n2024-01-01 {h:02d}:20:00 INFO at {h}" for h in range(6)]
    want = None
    for order, late in (([0, 1, 2, 3, 4, 5], 0), ([5, 0, 1, 2, 3, 4], 6), ([1, 0, 3, 2, 5, 4], 0)):
        triage = Triage(spark, str(tmp_path / f"store-{order[0]}"), slices="hour")
        for h in order:
            triage.add_lines(lines_of(a=hours[h]))
        shown = sorted(map(tuple, triage.severity_by_time().collect()))
        want = want or shown
        assert shown == want and len(shown) == 12
        rows = triage.late_lines("2 hours").collect()
        assert sum(r.n_late for r in rows) == late


# -- rollup -----------------------------------------------------------------------


def test_rollup_equals_counting(spark):
    rng = random.Random(4)
    paths = ["a/b/c/d/e", "a/b/c/x", "a/b", "z", "a/q/r"]
    rows = [
        (rng.choice(paths), None if rng.random() < 0.2 else dt.datetime(2024, 1, 1, rng.randrange(3), 5), rng.choice(["error", "info"]))
        for _ in range(300)
    ]
    table = spark.createDataFrame(rows, "source string, event_time timestamp, severity string")
    want: Counter = Counter()
    for path, time, severity in rows:
        hour = time and time.replace(minute=0)
        names = path.split("/")
        for level in range(min(4, len(names)) + 1):
            folder = "/".join(names[:level]) if level else None
            want[level, folder, False, None, severity] += 1
            want[level, folder, True, hour, severity] += 1
    found = {tuple(r)[:5]: r.n for r in rollup.severity_rollup(table).collect()}
    assert found == dict(want)
    worst = rollup.worst_folders(rollup.severity_rollup(table), 1, ["error"]).where("level = 1").collect()
    errors = Counter(p.split("/")[0] for p, _, s in rows if s == "error")
    assert [(r.folder, r.n) for r in worst] == [errors.most_common(1)[0]]


def test_rollup_reads_its_input_once(spark):
    table = spark.createDataFrame([("a/b", None, "info")], "source string, event_time timestamp, severity string")
    plan = rollup.severity_rollup(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Scan ExistingRDD") == 1 and "Expand" in plan
