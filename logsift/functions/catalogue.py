"""The patterns, levels and limits that decide every result.

They are stated once, as plain text, in the order in which they apply. How a
pattern is handed to Spark is decided in ``dialect.py``.
"""

# Terminal colour codes.
ANSI = r"\x1b\[[0-9;]*[a-zA-Z]"

# Severity words, tried in this order, ignoring case.
SEVERITY = [
    ("fatal", r"\b(FATAL|CRITICAL|CRIT|EMERG|ALERT)\b"),
    ("error", r"\b(ERROR|ERR)\b"),
    ("warning", r"\b(WARN(?:ING)?)\b"),
    ("info", r"\b(INFO|NOTICE)\b"),
    ("debug", r"\b(DEBUG|TRACE|VERBOSE)\b"),
]

# Every match of a level's pattern holds one of these, in some case.
SEVERITY_STEMS = {
    "fatal": ["FATAL", "CRIT", "EMERG", "ALERT"],
    "error": ["ERR"],
    "warning": ["WARN"],
    "info": ["INFO", "NOTICE"],
    "debug": ["DEBUG", "TRACE", "VERBOSE"],
}

# Of the letters beyond ASCII that match one of a stem when case is ignored, the one that is no
# such letter in capitals, and that letter.
FOLDED = ("İ", "I")

# Lines that belong to a stack trace, matched at line start.
STACK = [
    r"^\s+at\s+",
    r'^\s+File\s+"',
    r"^\s+\.\.\.",
    r"^\s*\|",
    r"^\s+\d+:\s",
    r"^Traceback \(",
    r"^\s+raise\s",
    r"^\s*Caused by:",
    r"^\s+\^+",
]

# Fixed value: a bare exception line, matched at line start.
EXCEPTION = r"^(?:[a-z]+\.)*[A-Z]\w*(?:[:,]\s|\s*$)"

# Lines without content.
NOISE = [
    r"^\s*$",
    r"^-{3,}$",
    r"^={3,}$",
    r"^\s*\.\.\.\s*$",
]

# Timestamps, tried in this order.
TIMESTAMP = [
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}",
    r"\[?\w{3}\s+\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\]?",
    r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
]

# Every timestamp pattern holds a clock time, so a text without one needs no further search.
CLOCK = r"\d{2}:\d{2}:\d{2}"

# Variable parts of a line and their placeholders, after the timestamps.
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"  # any case
ADDRESS = r"0x[0-9a-f]+"  # any case
NUMBER = r"\b\d{4,}\b"
DIGITS = r"\d{4}"  # what every such number holds
MARK_TIMESTAMP, MARK_UUID, MARK_ADDRESS, MARK_NUMBER = "<TS>", "<UUID>", "<ADDR>", "<NUM>"

# What is left out when a line is shown.
SEVERITY_WORD = (
    r"\[?\s*\b(FATAL|CRITICAL|CRIT|ALERT|EMERG|NOTICE|ERROR|ERR|WARN(?:ING)?"
    r"|INFO|DEBUG|TRACE|VERBOSE)\b\s*\]?\s*"
)  # any case
EMPTY_BRACKETS = r"\[\s*\]"

# Levels from the gravest down; the rank grows with gravity.
LEVELS = ["fatal", "error", "warning", "info", "debug", "unknown"]
RANK = {"fatal": 5, "error": 4, "warning": 3, "info": 2, "debug": 1, "unknown": 0}
GRAVE = ["fatal", "error", "warning"]

# Fixed value: where a text is cut into lines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Limits of reports and drill-down.
SUMMARY_TEMPLATES = 50
SUMMARY_FREQUENT = 20
FREQUENT_FROM = 5
SUMMARY_TRACES = 5
DIGEST_TEMPLATES = 100
DIGEST_TRACES = 10
DIGEST_UNKNOWN = 20
LABEL_CHARS = 64
DRILL_LINES, DRILL_LINES_MAX = 30, 200
DRILL_CONTEXT, DRILL_CONTEXT_MAX = 5, 50
