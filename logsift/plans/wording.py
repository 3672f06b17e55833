"""The wording of reports. ``{}`` marks are filled per row."""

# Summary report.
SUMMARY = "## Log Preprocessing Summary"
TOTAL = "- **Total lines**: {}"
UNIQUE = "- **Unique lines**: {} ({}% reduction)"
NOISE = "- **Noise removed**: {}"
TIME_RANGE = "- **Time range**: {} → {}"
BREAKDOWN = "\n### Severity Breakdown"
BREAKDOWN_LEVEL = "- {}: {}"
TRACES = "\n### Stack Traces ({} found)"
TRACE = "\n**Trace {}** (line {}):\n```\n{}\n```"
MORE_TRACES = "\n... and {} more traces"
IMPORTANT = "\n### Error/Warning Lines (deduplicated)"
FREQUENT = "\n### High-Frequency Lines (≥5 occurrences)"
TEMPLATE = "- [{}] {}"
TIMES = " (×{})"

# Ingest report.
NO_ANALYSIS = "\n*No analysis is stored for this log. Hand its digest to an analyst and add the reply.*"
RULE = "\n---"
DRILL_HINT = "💡 **Raw lines**: `get_lines` takes a pattern, a severity or a line number."
STORED = "📋 **Source**: `{}` ({} lines stored)"

# Digest for an external analysis.
DIGEST_TOTALS = "Total lines: {}, Unique: {}, Noise removed: {}"
DIGEST_RANGE = "Time range: {} → {}"
DIGEST_LEVELS = "\nSeverity counts: {}"
DIGEST_LEVEL = '"{}": {}'
DIGEST_IMPORTANT = "\n--- ERROR/WARNING/FATAL LINES ({} unique) ---"
DIGEST_TEMPLATE = "[{} ×{}] {}"
DIGEST_TRACES = "\n--- STACK TRACES ({}) ---"
DIGEST_TRACE = "\nTrace {} (line {}):\n{}"
DIGEST_UNKNOWN = "\n--- UNCLASSIFIED LINES (sample of {}) ---"

# Semantic report.
SEMANTIC = "### Semantic Analysis"
PRIMARY = "**Primary Issue**: {}"
CAUSE = "**Root Cause**: {}"
SIGNATURES = "\n**Error Signatures**:"
SIGNATURE = "- `{}` [{}] in {} (×{})"
TIMELINE = "\n**Timeline**:"
EVENT = "- [{}] {}"
ATTENTION = "\n**Needs Attention**:"
ATTENTION_ITEM = "- ⚠️ {}"
NOISE_NOTE = "\n**Noise Assessment**: {}"

# Drill-down.
WINDOW_HEADER = "Lines {}-{} (centered on line {}):"
MATCH_HEADER = "Found {} matching lines"
CAPPED = " (capped at {} — increase max_lines for more)"
NO_MATCH = "No lines matched the filters (pattern={}, severity={}). Try broader filters."
UNKNOWN_SOURCE = "No source is stored as '{}'. Stored are {}: {}. `list_sources` gives all."
#: Labels that the message for an unknown one names.
LABELS_SHOWN = 20
NO_STORED_ANALYSIS = "No analysis is stored for this log. `digests` gives the text for one, `add_replies` takes it."
LISTING = "- **{}**: {} lines, {} unique, {} errors, semantic={}"
SOURCES = "Stored sources:"
NO_SOURCES = "No source is stored. `ingest` adds one."
MORE_SOURCES = "... and {} more"
