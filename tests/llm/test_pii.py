from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from logsift.llm import pii, queries

SF_DIR = "/root/testdata/sf0.01"

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = 0
        for k, c in enumerate(reversed(digits)):
            d = int(c) * (1 + k % 2)
            total += d - 9 if d > 9 else d
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text: str) -> list:
    found = [(m.start(), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if accepted(k, m[0])]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+1", "+", "(555)", "12", "4111111111111111", "255.1.2.3", "999", "_", "%", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        got = sorted(pii.base_spans(text), key=lambda s: (s[0], pii.KINDS.index(s[1])))
        assert got == plain(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "@" * 300_000])
def test_long_runs_take_linear_time(text):
    pii.all_spans(text, pii.Model.blank())


def test_estimation_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    noise = [0.05, 0.1, 0.4]
    votes = np.stack([np.where(rng.random(20_000) < e, ~truth, truth) for e in noise], axis=1)
    patterns, inverse, counts = np.unique(np.where(votes, pii.YES, pii.NO), axis=0, return_inverse=True, return_counts=True)
    private, reliability = pii.estimate(patterns, counts.astype(float))
    assert np.mean((private[inverse.ravel()] > 0.5) == truth) > 0.93
    right = reliability[:, 1, pii.YES]
    assert right[0] > right[1] > right[2]


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    rows = docs.select("doc_id", pii.spans(docs.text, pii.fit(docs)).alias("s")).collect()
    assert len(rows) == len(odd_rows)
    empty = documents([])
    assert not pii.fit(empty).weights.any() and empty.select(pii.spans(empty.text, pii.fit(empty))).count() == 0


WORDS = "river stone morning paper garden window yellow seven bridge table over under with and the".split()


def planted(rng, kind):
    """A text with one value that no base pattern finds, or with a harmless number."""
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    code = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    value = {
        "hex": lambda: "token " + code("0123456789abcdef", 40),
        "mixed": lambda: "password " + code("abcdefghABCDEFGH0123456789", 24),
        "key_id": lambda: "AKIA" + code("ABCDEFGH01234567", 16),
        "number": lambda: rng.choice(["page ", "chapter ", "step "]) + str(rng.randrange(1, 500)),
        "version": lambda: "version " + f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}",
    }[kind]()
    return f"{some(5)} {value} {some(5)}", value.split()[-1]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    kinds = ["hex", "mixed", "key_id", "number", "version"]
    return [(kind, *planted(rng, kind)) for kind in kinds for _ in range(120)]


def test_added_spans_on_planted_values(spark, corpus):
    """Recall of each kind of secret, and how often a harmless number is taken for one."""
    docs = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(corpus)], "doc_id long, text string")
    model = pii.fit(docs.where("doc_id % 2 = 0"))
    hits = {}
    for kind, text, value in corpus[1::2]:
        added = [text[a:b] for _, a, b, base in pii.all_spans(text, model) if not base]
        hits.setdefault(kind, []).append(value in added)
    rates = {kind: np.mean(found) for kind, found in hits.items()}
    assert min(rates[k] for k in ("hex", "mixed", "key_id")) >= 0.95
    assert max(rates[k] for k in ("number", "version")) <= 0.05
    yes = model.reliability[:, :, pii.YES]
    named = pii.LABELERS.index("named")
    assert yes[named, 1] > yes[named, 0]


def test_words_are_learned_or_given(spark, corpus):
    docs = spark.createDataFrame([(t,) for _, t, _ in corpus], "text string")
    learned = pii.learned_words(docs)
    assert learned.harmless == {"page", "chapter", "step", "version"} and learned.private == pii.PRIVATE_WORDS
    given = pii.Gazetteers(frozenset({"losung"}), frozenset({"seite"}))
    votes = [v for *_, v, _ in pii.candidates("losung 12345abc seite 12", [], given)]
    assert votes[0][pii.LABELERS.index("named")] == pii.YES
    assert votes[1][pii.LABELERS.index("harmless_before")] == pii.NO
    assert pii.fit(docs, given).words == given


def test_redaction(spark):
    docs = spark.createDataFrame([("mail a.b@c.de or 10.0.0.1 x",), (None,)], "text string")
    found = pii.spans(docs.text, pii.Model.blank())
    texts = [r.t for r in docs.select(pii.redacted(docs.text, found).alias("t")).collect()]
    assert texts == ["mail <email> or <ip> x", None]


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.personal_data(spark, SF_DIR).collect()}
    assert rows.keys() == docs.keys()
    secrets = 0
    for i, text in docs.items():
        base = plain(text)
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        row = rows[i]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[1] == k for s in base) for k in pii.BASE_KINDS]
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if not s.startswith("secret")] == (listed.split(",") if listed else [])
        for kind, a, b in (s.split(":") for s in spans if s.startswith("secret")):
            secrets += 1
            assert not re.fullmatch(r"[0-9.]{1,5}", text[int(a) : int(b)])
        # Values after a name for them, which no base pattern finds.
        for m in re.finditer(r'(?:password=|token = ")([0-9a-f]{16,})', text):
            assert f"secret:{m.start(1)}:{m.end(1)}" in spans
    assert secrets
