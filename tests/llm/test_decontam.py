from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from logsift.llm import decontam, queries

SF_DIR = "/root/testdata/sf0.001"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain(text, items):
    """n_words, n_hit, item ids, by comparing every place with every window."""
    words, hit, found = plain_words(text), set(), set()
    for item, of in items:
        want = plain_words(of)
        size = min(10, len(want))
        for k in range(len(want) - size + 1 if want else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == want[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add(str(item) if item is not None else "")
    return len(words), len(hit), sorted(found)


def got(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, list(r["items"])) for r in frame.collect())


@pytest.mark.parametrize("bits", [2, 24])
def test_random_texts(spark, documents, monkeypatch, bits):
    """Also with tables so small that nearly every place has to be compared."""
    monkeypatch.setattr(decontam, "MOST_SLOT_BITS", max(8, bits))
    monkeypatch.setattr(decontam, "SLOTS_EACH", bits)
    monkeypatch.setattr(decontam, "BITS_EACH", bits)
    monkeypatch.setattr(decontam, "_FLUSH", 7 if bits == 2 else 1 << 14)
    rng = random.Random(3)
    words = ["A", "b", "c-d", "é", "7"]
    some = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, some(n)) for k, n in enumerate([0, 1, 2, 9, 10, 11, 14, 25, 3])]
    items = [(k, "z " + t if len(t) < 9 else t) for k, t in items] + [(3, "b b b b b b b b b b b"), (None, "é é é é"), (40, None)]
    docs = [(k, some(rng.randint(0, 60))) for k in range(60)]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(documents(docs), table)
    assert got(found) == sorted((False, i, *plain(t, items)) for i, t in docs)


def test_odd_rows_and_empty_tables(spark, documents, odd_rows):
    items = [(1, odd_rows[3][1]), (2, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.contamination(documents(odd_rows), table).collect() if r.doc_id}
    assert rows[4].n_hit == rows[4].n_words == 60_000
    assert rows[1].n_words == rows[2].n_words == rows[3].n_words == 0
    assert not rows[5].contaminated
    none = decontam.contamination(documents(odd_rows), table.limit(0))
    assert none.count() == len(odd_rows) and none.where("contaminated").count() == 0
    assert decontam.contamination(documents([]), table).count() == 0


def test_clean_documents_keep_their_columns(spark, documents):
    table = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = documents([(1, "x One, two; three four y"), (2, "one two three"), (None, None)])
    kept = decontam.clean_documents(docs, table)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_no_occurrence_is_skipped():
    """Shifts of blocks that share a slot are the shorter ones, so a small table only slows down."""
    rng = random.Random(5)
    words = [b"%d" % rng.randrange(6) for _ in range(3_000)]
    windows = {b" ".join(words[k : k + 4]) for k in range(0, 400, 7)}
    for bits in (3, 16):
        shift, held = np.full(1 << bits, 3, np.uint8), bytearray(1 << 13)
        for window in windows:
            slots = decontam.block_slots(decontam.word_codes(window.split(b" ")), 2, bits)
            for place, slot in enumerate(slots):
                shift[slot] = min(shift[slot], 2 - place)
            bit = decontam.crc32(window) & 0xFFFF
            held[bit >> 3] |= 1 << (bit & 7)
        tables = decontam.Tables(4, bits, 16, shift.tobytes(), bytes(held))
        found = {start for start, _ in tables.search(words, decontam.word_codes(words))}
        assert found >= {k for k in range(len(words) - 3) if b" ".join(words[k : k + 4]) in windows}


def test_tables_have_a_fixed_size(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_SLOT_BITS", 17)
    monkeypatch.setattr(decontam, "MOST_FILTER_BITS", 20)
    rows = spark.range(5_000).selectExpr("10 AS size", "cast(concat_ws(' ', transform(sequence(0, 9), k -> id * 7 + k)) AS binary) AS w")
    table = decontam.tables_of(rows)[0]
    assert len(table.shift) == 1 << 17 and len(table.filter) <= 1 << 17
    text = [b"%d" % (7 * 4_321 + k) for k in range(-5, 15)]
    assert b" ".join(text[5:15]) in {t for _, t in table.search(text, decontam.word_codes(text))}


def test_repeated_items_and_rows(spark, documents):
    """Many copies of an item, with one id and with many, and rows that repeat."""
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = [(1, passage)] * 500 + [(k, passage) for k in range(100, 120)]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([(1, "x " + passage), (1, "x " + passage), (1, "other"), (None, passage), (None, "clean")])
    rows = decontam.contamination(docs, table).collect()
    assert sorted((r.n_hit, r.n_items) for r in rows) == [(0, 0), (0, 0), (11, 21), (11, 21), (11, 21)]
    kept = decontam.clean_documents(docs, table).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "other"), ("None", "clean")]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    windows = {}
    for item, text in items:
        words = plain_words(text)
        for k in range(max(1, len(words) - 9)):
            windows.setdefault(tuple(words[k : k + 10]), set()).add(str(item))
    rows = {r.doc_id: r for r in queries.contamination(spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for doc in docs:
        words, hit, found = plain_words(doc.text), set(), set()
        for at in range(len(words)):
            for size in {len(w) for w in windows}:
                if at + size <= len(words) and (ids := windows.get(tuple(words[at : at + size]))):
                    hit |= set(range(at, at + size))
                    found |= ids
        row = rows[doc.doc_id]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (row.n_words, row.n_hit, row.n_items) == (len(words), len(hit), len(found))
        assert row.items_sha256 == digest and row.contaminated == bool(hit)
