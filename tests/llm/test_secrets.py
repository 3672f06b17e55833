from __future__ import annotations

import hashlib
import itertools
import re
from random import Random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.llm import queries, secrets

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|""" \
    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ORDER = {"assign": 0, "access": 1, "hex": 2}


def plain_base(text):
    """The contract's patterns as they stand, short matches dropped afterwards."""
    found = [(m.start(), "assign", m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], ORDER[s[1]]))


PARTS = [
    "password", "PassWd", "secret", "toKen", "token", "api_key", "APIKEY", "apikey", '"', "'", " ", "  ", ":", "=",
    "==", "AKIA", "AKIAAKIA", "ABCDEF012345", "0123456789abcdef", "deadbeefdeadbeef", "A", "é", "\n", "x", "1", "-", ".",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    found = sorted(secrets.base_spans(text), key=lambda s: (s[0], ORDER[s[1]]))
    assert found == plain_base(text)


def paths(model, batch):
    """Score of every tag sequence of the single chain of a batch."""
    scores = model.scores(batch)[0]
    for tags in itertools.product(range(3), repeat=len(scores)):
        moves = [3, *tags[:-1]]
        yield tags, sum(scores[t][y] + model.moves[m][y] for t, (m, y) in enumerate(zip(moves, tags)))


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_and_marginals_equal_all_paths(seed):
    rng = np.random.default_rng(seed)
    model = secrets.Model.blank()
    model.table[:40] = rng.normal(size=(40, 3))
    allowed = model.moves > -1e8
    model.moves[allowed] = rng.normal(size=allowed.sum())
    rows = [rng.integers(0, 40, (n, 4)).astype(np.int32) for n in (5, 3, 1)]
    batch = secrets._Batch(rows)
    tags = model.decode(batch)
    found, pairs, total = model.marginals(batch)
    all_pairs, all_total = np.zeros((4, 3)), 0.0
    for k, row in enumerate(rows):
        every = list(paths(model, secrets._Batch([row])))
        assert tuple(tags[k, : len(row)]) == max(every, key=lambda p: p[1])[0]
        weight = np.exp([s for _, s in every])
        all_total += np.log(weight.sum())
        weight /= weight.sum()
        mean = np.zeros((len(row), 3))
        for (path, _), w in zip(every, weight):
            mean[np.arange(len(row)), path] += w
            np.add.at(all_pairs, ([3, *path[:-1]], path), w)
        assert np.allclose(found[k, : len(row)], mean)
    assert np.allclose(pairs, all_pairs) and np.isclose(total, all_total)


def test_inside_never_follows_outside():
    rng = np.random.default_rng(5)
    model = secrets.Model.blank()
    model.table[:40] = rng.normal(size=(40, 3)) + [0, 0, 9]
    tags = model.decode(secrets._Batch([rng.integers(0, 40, (9, 3)).astype(np.int32)]))[0]
    assert all(b != 2 or a != 0 for a, b in zip([0, *tags], tags))


ALPHABET = secrets.Alphabet()
WORDS = "the of and house water river stone morning paper garden window yellow seven bridge table".split()
CODES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def planted(n, seed, secret):
    """Texts with one secret, or one harmless number, each, and where it lies."""
    random, out = Random(seed), []
    for k in range(n):
        before, after = (" ".join(random.choices(WORDS, k=random.randint(3, 12))) for _ in range(2))
        mark = secret(random)
        at = mark.index("\0") if "\0" in mark else 0
        text = f"{before} {mark.replace(chr(0), '')} {after}."
        out.append((k, text, len(before) + 1 + at, len(before) + 1 + len(mark.replace("\0", "").rstrip('"'))))
    return out


def code(random, alphabet=CODES, low=20, high=40):
    return "".join(random.choices(alphabet, k=random.randint(low, high)))


def known(random):
    return f'token = "\0{code(random, "0123456789abcdef", 40, 40)}"'


def unknown(random):
    """Secrets that the fixed finders pass over."""
    return random.choice(
        [
            lambda: f"pwd: \0{code(random)}",
            lambda: f"Authorization: Bearer \0{code(random)}",
            lambda: f"\0{code(random, CODES + '+/')}",
            lambda: f'signature = "\0{code(random)}"',
            lambda: f"auth=\0{code(random, CODES[:36])}",
        ]
    )()


def harmless(random):
    number = lambda n: "".join(random.choices("0123456789", k=n))
    return random.choice(
        [
            lambda: number(16),
            lambda: f"555-{number(4)}",
            lambda: f"+49 {number(3)} {number(7)}",
            lambda: f"{random.choice(WORDS)}.{number(2)}@mail{number(1)}.example.com",
            lambda: ".".join(number(2) for _ in range(4)),
            lambda: f"20{number(2)}-{number(2)}-{number(2)}",
            lambda: f"chapter{number(2)}-{random.choice(WORDS)}",
        ]
    )()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.fixture(scope="module")
def model(spark):
    train = [t for _, t, _, _ in planted(150, 1, known) + planted(450, 2, harmless)]
    return secrets.fit(docs_of(spark, train))


def test_model_finds_other_secrets_and_leaves_numbers(model):
    hits = 0
    for _, text, start, end in planted(200, 3, unknown):
        added = [s for s in secrets.all_spans([text], model)[0] if not s[3]]
        assert not secrets.base_spans(text)
        hits += any(a < end and b > start and min(b, end) - max(a, start) >= 0.8 * (end - start) for _, a, b, _ in added)
    wrong = sum(bool(secrets.all_spans([text], model)[0]) for _, text, _, _ in planted(200, 4, harmless))
    assert hits >= 180 and wrong <= 6


def test_base_spans_stay_and_added_ones_do_not_touch_them(model):
    text = f"token = {'ab12' * 10} and pwd: Zx81kQp0LmN7tR5v99 and {'0' * 40}"
    found = secrets.all_spans([text], model)[0]
    assert [s[:3] for s in found if s[3]] == [(k, a, b) for a, k, b in plain_base(text)]
    added = [s for s in found if not s[3]]
    assert added and all(b <= x or a >= y for _, a, b, _ in added for x, _, y in plain_base(text))


def test_odd_texts(spark, documents, odd_rows, model):
    docs = documents(odd_rows + [(8, "a1" * 60_000), (9, "x1-y2_z3+q4=" * 3_000), (10, "퟿ \U0001f511 token='éabcdefgh1")])
    rows = docs.select("doc_id", "text", secrets.spans(F.col("text"), model).alias("found")).collect()
    assert len(rows) == len(odd_rows) + 3
    for row in rows:
        base = [(s.kind, s.start, s.end) for s in row.found if s.base]
        assert base == [(k, a, b) for a, k, b in plain_base(row.text or "")]
        assert all(0 <= s.start < s.end <= len(row.text) for s in row.found)


def test_same_chain_and_long_chains(model):
    """A line of many tokens is decoded in chains; every token comes once and in order."""
    text = " ".join(f"word{i}x77y" for i in range(700))
    chains = secrets.chains_of(text)
    tokens = [t for c in chains for t in c.tokens]
    assert tokens == [m.span() for m in secrets._TOKEN.finditer(text)]
    assert all(len(c.tokens) <= secrets.CHAIN_TOKENS for c in chains)


def test_every_token_is_tagged():
    """Also of words without a digit, short ones, and ones far from both."""
    value = "Qx-Kd/Zp"
    text = " ".join(WORDS * 40) + f"\n\n  pwd: {value} then " + " ".join(WORDS)
    tokens = [t for c in secrets.chains_of(text) for t in c.tokens]
    assert tokens == [m.span() for m in secrets._TOKEN.finditer(text)]
    tagged = []
    for k, word in enumerate(WORDS):
        line = f"{word} pwd: {value} {word}"
        chain = secrets.Chain(line, [m.span() for m in secrets._TOKEN.finditer(line)], (0, 0, 0))
        start = line.index(value)
        tagged.append((chain, secrets.tags_of(chain, [(start, start + len(value))])))
        line = " ".join(WORDS[k:] + WORDS[:k])
        chain = secrets.Chain(line, [m.span() for m in secrets._TOKEN.finditer(line)], (0, 0, 0))
        tagged.append((chain, secrets.tags_of(chain, [])))
    start = text.index(value)
    assert secrets.tagged_spans(["", text, None], secrets.train(tagged)) == [[], [(start, start + len(value))], []]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from(["a_b-1", "\n", " \x1c\x85", "\U0001f511Z9\U00010400"]), max_size=4))
def test_tokens_of_texts_side_by_side(texts):
    tokens = secrets.Tokens(texts, ALPHABET)
    found = zip(tokens.text.tolist(), (tokens.start - tokens.offsets[tokens.text]).tolist(), (tokens.end - tokens.offsets[tokens.text]).tolist())
    assert list(found) == [(k, *m.span()) for k, t in enumerate(texts) for m in secrets._TOKEN.finditer(t)]
    together = tokens.features(np.zeros((len(texts), 3), int))
    alone = [secrets.Tokens([t], ALPHABET).features(np.zeros((1, 3), int)) for t in texts]
    assert np.array_equal(together, np.concatenate([np.zeros((15, 0), int), *alone], axis=1))


def test_fit_without_secrets_or_rows(spark, documents):
    for rows in ([], [(1, None)], [(1, "")], [(1, "nothing here 2024-10-11 to learn")]):
        blank = secrets.fit(documents(rows))
        assert secrets.all_spans(["pwd: Zx81kQp0LmN7tR5v99", None, ""], blank) == [[], [], []]


def test_tags_of_a_chain():
    text = 'token = "abc-12" end'
    chain = secrets.Chain(text, [m.span() for m in secrets._TOKEN.finditer(text)], (0, 0, 0))
    assert secrets.tags_of(chain, [(9, 15)]) == [0, 0, 0, 1, 2, 2, 0, 0]


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op11_secret_scan"](spark, path).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        base = plain_base(texts[row.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        kinds = [k for _, k, _ in base]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(map(kinds.count, ORDER))
        assert [s for s in row.spans.split(",") if s and not s.startswith("secret")] == [s for s in listed.split(",") if s]
