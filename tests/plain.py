"""What the engine must compute, in plain Python over one log; for tests only."""

from __future__ import annotations

import re

from logsift.functions import catalogue as cat



def clean(line):
    return re.sub(cat.ANSI, "", line).rstrip()


def severity(text):
    return next((lv for lv, p in cat.SEVERITY if re.search(p, text, re.I)), "unknown")


def timestamp(text):
    found = [m.group(0) for m in (re.search(p, text) for p in cat.TIMESTAMP) if m]
    return found[0] if found else None


def noise(text):
    return any(re.match(p, text) for p in cat.NOISE)


def stack(text):
    return any(re.match(p, text) for p in cat.STACK)


def exception(text):
    return re.match(cat.EXCEPTION, text) is not None


def template(text):
    steps = [(p, cat.MARK_TIMESTAMP, 0) for p in cat.TIMESTAMP]
    steps += [(cat.UUID, cat.MARK_UUID, re.I), (cat.ADDRESS, cat.MARK_ADDRESS, re.I)]
    for pattern, mark, flags in [*steps, (cat.NUMBER, cat.MARK_NUMBER, 0)]:
        text = re.sub(pattern, mark, text, flags=flags)
    return text


def display(text):
    for pattern in [*cat.TIMESTAMP, cat.EMPTY_BRACKETS]:
        text = re.sub(pattern, "", text)
    return re.sub(cat.SEVERITY_WORD, "", text, count=1, flags=re.I).strip()


def kind(text):
    if stack(text):
        return "S"
    if text[0] in " \t":
        return "I"
    if exception(text):
        return "X"
    return "E" if severity(text) in ("error", "fatal") else "N"


def traces(lines):
    """``[(header_line, [text], severity)]`` by walking the lines once."""
    done, is_open = [], False
    for number, line in enumerate(lines, 1):
        text = clean(line)
        if noise(text):
            continue
        k = kind(text)
        if k == "S" and not is_open:
            done.append([number, [], "error"])
            is_open = True
        if not is_open:
            continue
        if k != "N":
            done[-1][1].append(text)
        if k == "E":
            done[-1][2] = severity(text)
        is_open = k in "SI"
    return [tuple(t) for t in done]


def trace_summary(texts):
    if len(texts) <= 4:
        return "\n".join(texts)
    cut = f"  ... ({len(texts) - 4} frames omitted)"
    return "\n".join([*texts[:2], cut, *texts[-2:]])


def templates(lines):
    """``{template: [sample, n, severity, first_line]}`` in order of appearance."""
    found = {}
    for number, line in enumerate(lines, 1):
        text = clean(line)
        if noise(text) or stack(text):
            continue
        entry = found.setdefault(template(text), [text, 0, "unknown", number])
        entry[1] += 1
        entry[2] = max(entry[2], severity(text), key=cat.RANK.get)
    return found
