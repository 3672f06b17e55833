from __future__ import annotations

import itertools

import numpy as np
import pytest

from logsift.llm import langid, queries

SF_DIR = "/root/testdata/sf0.01"


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    moves = rng.normal(size=(3, 3)).astype(np.float32)
    got, pairs = langid.Chains.of(np.array([4, 5])).marginals(scores, moves)
    want, want_pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for start, length in ((0, 4), (4, 5)):
        total, part, part_pairs = 0.0, np.zeros((length, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=length):
            steps = list(zip(path, path[1:]))
            weight = np.exp(sum(scores[start + t, y] for t, y in enumerate(path)) + sum(moves[s] for s in steps))
            total += weight
            part[range(length), path] += weight
            for s in steps:
                part_pairs[s] += weight
        want[start : start + length] = part / total
        want_pairs += part_pairs / total
    assert np.allclose(got, want, atol=1e-5) and np.allclose(pairs, want_pairs, atol=1e-4)


def test_features_stay_inside_a_word():
    words = langid.Words.of(b" ab c ab")
    per_word = [sorted(words.rows[:, a:b].ravel()) for a, b in zip(words.starts, [3, 5, 8])]
    alone = langid.Words.of(b" ab")
    assert per_word[0] == per_word[2] == sorted(alone.rows.ravel())
    assert words.hashes[0] == words.hashes[2] != words.hashes[1]


def test_chains_cover_every_word_once():
    chains = langid.Chains.of(np.array([130, 1, 64, 65]))
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(chains.start, chains.length)])
    assert sorted(covered) == list(range(260)) and chains.length.max() == 64


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("uno dos tres quatro", "es"), ("one two three four", "en")] * 40)]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_code_switched_words(model):
    words = langid.Words.of(b" one two three uno dos tres")
    found, _ = langid.Chains.of(np.array([6])).marginals(model.scores(words), model.transitions)
    assert [model.languages[k] for k in found.argmax(axis=1)] == ["en"] * 3 + ["es"] * 3


def test_long_texts_in_pieces(model, monkeypatch):
    text = "one two three four " * 3_000 + "uno " * 500
    whole = model.label([text, "dos tres", None])
    monkeypatch.setattr(langid, "_PIECE_BYTES", 64 * 19)
    monkeypatch.setattr(langid, "_BATCH_BYTES", 500)
    pieces = model.label([text, "dos tres", None])
    assert [w[0] for w in whole] == [p[0] for p in pieces] == ["en", "es", "und"]
    assert abs(whole[0][1] - pieces[0][1]) < 0.01


def test_odd_rows(spark, documents, odd_rows, model):
    docs = documents(odd_rows)
    rows = docs.select("doc_id", langid.language(docs.text, model).alias("g")).collect()
    guess = {r.doc_id: r.g for r in rows if r.doc_id}
    assert all(guess[i].lang == "und" and guess[i].score == 0 for i in (1, 2, 3))
    assert all(r.g.lang in ("en", "es", "und") and 0 <= r.g.score <= 1 for r in rows)
    kept = langid.labelled_documents(docs, model, 0.3)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {4, 5, 6} and not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_without_training_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    empty = langid.fit(docs.where("false"))
    assert {r.g.lang for r in docs.select(langid.language(docs.text, empty).alias("g")).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    found = queries.languages(spark, SF_DIR).join(docs, "doc_id")
    rows = found.where("held_out").collect()
    assert found.count() == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_no_language_fills_the_lexicon(spark):
    """A language of many words and rows leaves the words of a small one, however long."""
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + k)}x" for k in range(26)), "big") for i in range(400)]
    rows += [(1_000, "donaudampfschifffahrt kapitänsmütze", "small")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table, lexicon_words=30)
    words = langid.Words.of(" donaudampfschifffahrt kapitänsmütze".encode())
    assert np.isin(words.hashes, model.lexicon).all() and 17 <= len(model.lexicon) <= 52
    assert model.lexicon_of(words).argmax(axis=1).tolist() == [1, 1]


def test_least_score(spark, model):
    rows = [(i, "one two three four " * 5, "en") for i in range(50)] + [(99, "tres one dos two", "en"), (98, None, "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.least_score(table, model, 0.9) > 0.8
    assert langid.least_score(table, model, 1.0) < langid.least_score(table, model, 0.5) + 1e-9
    assert langid.least_score(table.where("false"), model) == 0.0
