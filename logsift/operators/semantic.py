"""Tables around an external analysis: replies in, structured tables out.

No model is called here. ``replies`` holds ``(source, reply)``, one per source,
where the reply is the text that came back for a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.dialect import WHITESPACE, computed_once
from logsift.plans import wording as w
from logsift.plans.sections import fill

# The fields of a reply's items. Counts stay text, as a reply may hold any number.
SIGNATURE = ("pattern", "category", "count", "first_seen_timestamp", "affected_component")
EVENT = ("timestamp", "event")

#: Bytes from which a JSON text may be too large for a variant.
LARGE = 1 << 24


# What may enclose a reply.
OPENING, CLOSING = "```json", "```"


def _unfenced(reply: Column) -> Column:
    """The reply without white space, a leading json fence and a trailing fence."""
    blank = F.lit(WHITESPACE)

    def without_opening(t):
        rest = F.substr(t, F.lit(len(OPENING) + 1))
        return F.when(F.startswith(t, F.lit(OPENING)), rest).otherwise(t)

    def without_closing(t):
        rest = F.left(t, F.length(t) - len(CLOSING))
        return F.when(F.endswith(t, F.lit(CLOSING)), rest).otherwise(t)

    opened = computed_once(F.trim(reply, blank), without_opening)
    return F.trim(computed_once(opened, without_closing), blank)


def _object(text: Column) -> Column:
    """The JSON object that the text is, as a variant, or null.

    The strict parser of variants decides. It stops at the end of the first
    value, so the text is parsed as the only item of an array: anything behind
    the object then makes it invalid or gives a second item.
    """
    items = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))

    def alone(v):
        item = F.try_variant_get(v, "$[0]", "variant")
        single = F.try_variant_get(v, "$[1]", "variant").isNull()
        return F.when(F.startswith(text, F.lit("{")) & single, item)

    return computed_once(items, alone)


def _parsed(replies: DataFrame) -> DataFrame:
    """Adds ``raw_json`` and ``object``."""
    return replies.withColumn("raw_json", _unfenced(F.col("reply"))).withColumn(
        "object", _object(F.col("raw_json"))
    )


def _text(item: Column, path: str = "$") -> Column:
    return F.try_variant_get(item, path, "string")


def _is_map(item: Column) -> Column:
    return F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))


def parse_analyses(replies: DataFrame) -> DataFrame:
    """Replies that are JSON objects, as columns with defaults for what is missing.

    A field that isn't of the kind asked for counts as missing. Items are taken one by one:
    a signature or event that is no object, and a null among the lines for review, stand
    in ``dropped`` as ``field: item``; the other items are kept.
    """

    def text(name):
        return F.coalesce(_text(F.col("object"), f"$.{name}"), F.lit("Unknown")).alias(name)

    def listed(name):
        items = F.try_variant_get("object", f"$.{name}", "array<variant>")
        return F.coalesce(items, F.array().cast("array<variant>"))

    lists = ("error_signatures", "timeline", "attention_needed")

    def maps(name, fields):
        kept = F.filter(name, _is_map)
        return F.transform(kept, lambda x: F.struct(*[_text(x, f"$.{n}").alias(n) for n in fields])).alias(name)

    def others(name, test):
        shown = F.transform(
            F.filter(name, lambda x: ~test(x)),
            lambda x: F.concat(F.lit(f"{name}: "), F.coalesce(_text(x), F.lit("null"))),
        )
        return shown

    attention = F.filter(F.transform("attention_needed", lambda x: _text(x)), lambda x: x.isNotNull())
    dropped = F.concat(
        others("error_signatures", _is_map),
        others("timeline", _is_map),
        others("attention_needed", lambda x: _text(x).isNotNull()),
    )
    # A filter on the object would be pushed below the parse, which then runs twice; a
    # generator over one object or none stays where it is.
    found = F.explode(F.array_compact(F.array(_object(F.col("raw_json")))))
    return (
        replies.select("source", _unfenced(F.col("reply")).alias("raw_json"))
        .select("source", "raw_json", found.alias("object"))
        # Each list is taken from the variant once.
        .withColumns({name: listed(name) for name in lists})
        .select(
            "source",
            text("primary_issue"),
            maps("error_signatures", SIGNATURE),
            text("root_cause"),
            maps("timeline", EVENT),
            attention.alias("attention_needed"),
            text("noise_assessment"),
            dropped.alias("dropped"),
            "raw_json",
        )
    )


def bad_replies(replies: DataFrame) -> DataFrame:
    """``(source, reply, reason)`` of the replies that give no analysis.

    The reason is ``no reply``, ``not JSON``, ``not an object``, ``repeated key`` or ``too
    large``. Numbers that JSON lacks, such as NaN, make a reply not JSON.
    """
    raw = F.col("raw_json")
    keys = F.json_object_keys(raw)
    repeated = F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))
    reason = (
        F.when(raw.isNull(), "no reply")
        .when(repeated, "repeated key")
        .when(F.octet_length(raw) >= LARGE, "too large")
        .when(F.startswith(raw, F.lit("{")) | F.try_parse_json(raw).isNull(), "not JSON")
        .otherwise("not an object")
    )
    bad = _parsed(replies).filter(F.col("object").isNull())
    return bad.select("source", "reply", reason.alias("reason"))


def error_signatures(analyses: DataFrame) -> DataFrame:
    """One row per signature, in the order of the reply."""
    defaults = {
        "pattern": "?",
        "category": "unknown",
        "count": "1",
        "first_seen_timestamp": None,
        "affected_component": "unknown",
    }
    return analyses.select("source", F.posexplode("error_signatures").alias("p", "item")).select(
        "source",
        (F.col("p") + 1).cast("bigint").alias("pos"),
        *[F.coalesce(F.col(f"item.{n}"), F.lit(d)).alias(n) for n, d in defaults.items()],
    )


def timeline(analyses: DataFrame) -> DataFrame:
    """One row per event, in the order of the reply."""
    return analyses.select("source", F.posexplode("timeline").alias("p", "item")).select(
        "source",
        (F.col("p") + 1).cast("bigint").alias("pos"),
        F.coalesce("item.timestamp", F.lit("?")).alias("timestamp"),
        F.coalesce("item.event", F.lit("?")).alias("event"),
    )


def attention_lines(analyses: DataFrame) -> DataFrame:
    """One row per line that was flagged for review."""
    return analyses.select("source", F.posexplode("attention_needed").alias("p", "item")).select(
        "source", (F.col("p") + 1).cast("bigint").alias("pos"), "item"
    )


def semantic_report(analyses: DataFrame) -> DataFrame:
    """``(source, semantic)``: one text per analysis, built within its row."""

    def shown(name, default="?"):
        return lambda item: F.coalesce(item[name], F.lit(default))

    def section(items, header, line):
        body = F.concat(F.array(F.lit(header)), F.transform(items, line))
        return F.when(F.size(items) > 0, body).otherwise(F.array().cast("array<string>"))

    pattern, event = shown("pattern"), shown("event")
    category, component = shown("category", "unknown"), shown("affected_component", "unknown")
    count, time = shown("count", "1"), shown("timestamp")
    lines = F.concat(
        F.array(F.lit(w.SEMANTIC), fill(w.PRIMARY, "primary_issue"), fill(w.CAUSE, "root_cause")),
        section(
            "error_signatures",
            w.SIGNATURES,
            lambda s: fill(w.SIGNATURE, pattern(s), category(s), component(s), count(s)),
        ),
        section("timeline", w.TIMELINE, lambda e: fill(w.EVENT, time(e), event(e))),
        section("attention_needed", w.ATTENTION, lambda item: fill(w.ATTENTION_ITEM, item)),
        F.array(fill(w.NOISE_NOTE, "noise_assessment")),
    )
    return analyses.select("source", F.array_join(lines, "\n").alias("semantic"))


def get_analysis(analyses: DataFrame, source: str) -> DataFrame:
    """``(source, raw_json)`` of one source; no row if it has no analysis."""
    return analyses.filter(F.col("source") == source).select("source", "raw_json")
