from __future__ import annotations

import json

import pytest

from logsift.operators import semantic

WHOLE = {
    "primary_issue": "pool exhausted",
    "error_signatures": [
        {"pattern": "timeout", "category": "timeout", "count": 3, "first_seen_timestamp": None,
         "affected_component": "db"},
        {"pattern": "half", "count": 2.5},
    ],
    "root_cause": "leak",
    "timeline": [{"timestamp": "10:00", "event": "start"}, {"event": "end"}, {"timestamp": None}],
    "attention_needed": ["line 5"],
    "noise_assessment": "low",
}


@pytest.fixture
def replies(spark):
    rows = {
        "plain": json.dumps(WHOLE),
        "fenced": "  ```json\n" + json.dumps(WHOLE, indent=2) + "\n```\n",
        "bare": "```\n" + json.dumps(WHOLE) + "\n```",
        "prose": "I could not find anything.",
        "list": json.dumps([WHOLE]),
        "python": str(WHOLE),
        "chatty": json.dumps(WHOLE) + " Hope this helps!",
        "twice": "{}{}",
        "two": "{}, {}",
        "cut": json.dumps(WHOLE)[:-9],
        "empty": "{}",
        "missing": None,
        "repeated": '{"root_cause": "a", "root_cause": "b"}',
        "nan": '{"root_cause": NaN}',
        "some": '{"timeline": [{"event": "x"}, 3, null], "attention_needed": [null, "y", 7],'
        ' "error_signatures": "none", "root_cause": {"k": 1}}',
    }
    return spark.createDataFrame(list(rows.items()), "source string, reply string")


def test_parsing(replies):
    got = {r.source: r for r in semantic.parse_analyses(replies).collect()}
    assert got.keys() == {"plain", "fenced", "empty", "some"}
    some = got["some"]
    assert [(e.timestamp, e.event) for e in some.timeline] == [(None, "x")]
    assert some.attention_needed == ["y", "7"] and some.error_signatures == []
    assert some.dropped == ["timeline: 3", "timeline: null", "attention_needed: null"]
    assert some.root_cause == '{"k":1}' and got["plain"].dropped == []
    assert got["plain"].primary_issue == got["fenced"].primary_issue == "pool exhausted"
    assert [s["count"] for s in got["fenced"].error_signatures] == ["3", "2.5"]
    assert json.loads(got["fenced"].raw_json) == WHOLE
    empty = got["empty"]
    assert (empty.primary_issue, empty.root_cause, empty.noise_assessment) == ("Unknown",) * 3
    assert empty.error_signatures == empty.timeline == empty.attention_needed == []
    bad = {r.source: r.reason for r in semantic.bad_replies(replies).collect()}
    not_json = ["bare", "prose", "python", "chatty", "twice", "two", "cut", "nan"]
    assert bad == dict.fromkeys(not_json, "not JSON") | {
        "list": "not an object", "missing": "no reply", "repeated": "repeated key",
    }


def test_tables(replies):
    analyses = semantic.parse_analyses(replies).filter("source = 'plain'")
    signatures = semantic.error_signatures(analyses).orderBy("pos").collect()
    assert [(s.pattern, s.category, s["count"], s.affected_component) for s in signatures] == [
        ("timeout", "timeout", "3", "db"), ("half", "unknown", "2.5", "unknown"),
    ]
    events = semantic.timeline(analyses).orderBy("pos").collect()
    assert [(e.timestamp, e.event) for e in events] == [
        ("10:00", "start"), ("?", "end"), ("?", "?"),
    ]
    assert [r.item for r in semantic.attention_lines(analyses).collect()] == ["line 5"]
    assert semantic.get_analysis(analyses, "nobody").collect() == []


def test_report(replies):
    texts = {
        r.source: r.semantic
        for r in semantic.semantic_report(semantic.parse_analyses(replies)).collect()
    }
    assert texts["plain"] == (
        "### Semantic Analysis\n**Primary Issue**: pool exhausted\n**Root Cause**: leak\n"
        "\n**Error Signatures**:\n- `timeout` [timeout] in db (×3)\n"
        "- `half` [unknown] in unknown (×2.5)\n"
        "\n**Timeline**:\n- [10:00] start\n- [?] end\n- [?] ?\n"
        "\n**Needs Attention**:\n- ⚠️ line 5\n\n**Noise Assessment**: low"
    )
    assert texts["empty"] == (
        "### Semantic Analysis\n**Primary Issue**: Unknown\n**Root Cause**: Unknown\n"
        "\n**Noise Assessment**: Unknown"
    )


def test_replies_are_parsed_once(spark):
    replies = spark.createDataFrame([("a", "{}")], "source string, reply string")
    for found in (semantic.parse_analyses(replies), semantic.semantic_report(semantic.parse_analyses(replies))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson(") == 1
