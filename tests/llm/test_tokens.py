from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from logsift.llm import queries, tokens

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(text, pieces, unknown):
    """Best score over every way to cut the text, and the counts that reach it."""
    best = {0: (0.0, {0})}
    for end in range(1, len(text) + 1):
        options = []
        for start in range(end):
            part = text[start:end]
            if part in pieces:
                options.append((best[start][0] + pieces[part], {c + 1 for c in best[start][1]}))
            elif end - start == 1:
                options.append((best[start][0] + unknown, {c + len(part.encode()) for c in best[start][1]}))
        top = max(o[0] for o in options)
        best[end] = (top, set().union(*(o[1] for o in options if o[0] == top)))
    return best[len(text)]


def test_small_vocabularies_equal_all_segmentations():
    rng = random.Random(5)
    for _ in range(300):
        alphabet = "ab▁é\n"
        pieces = {"".join(rng.choices("abé", k=rng.randint(1, 4))): -float(rng.randint(1, 9)) for _ in range(8)}
        pieces |= {"▁" + p: s - 1 for p, s in list(pieces.items())[:3]} | {"▁": -3.0, "▁▁": -4.0}
        vocabulary = tokens.Vocabulary(pieces, byte_fallback=True)
        counter = tokens.Counter(vocabulary)
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 14)))
        score, counts = all_segmentations("▁" + text, pieces, counter.unknown)
        got = counter.count(text.replace("▁", " "))
        assert got[0] == pytest.approx(score) and got[1] in counts


def test_ties_go_to_the_piece_that_starts_first():
    pieces = {"a": -1.0, "aa": -2.0, "aaa": -3.0, "▁": -1.0}
    assert tokens.Counter(tokens.Vocabulary(pieces, True, dummy_prefix=False)).count("aaa") == (-3.0, 1)


def test_unknown_runs_are_one_token_without_byte_fallback():
    counter = tokens.Counter(tokens.Vocabulary({"a": -1.0, "▁": -1.0}, False, dummy_prefix=False))
    assert counter.count("xxaxx")[1] == 3


def as_unigrams(path: str) -> bytes:
    """The same file, marked as a unigram model: field 3 of the trainer settings (field 2)."""
    data, out, at = open(path, "rb").read(), bytearray(), 0

    def number(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    def written(value):
        parts = bytearray()
        while value > 127:
            parts.append(value & 127 | 128)
            value >>= 7
        return parts + bytes([value])

    while at < len(data):
        start = at
        key, at = number(at)
        size, at = number(at)
        if key == 2 << 3 | 2:
            inner, end, fields = at, at + size, bytearray()
            while inner < end:
                begin = inner
                tag, inner = number(inner)
                if tag & 7 == 0:
                    _, inner = number(inner)
                elif tag & 7 == 2:
                    length, inner = number(inner)
                    inner += length
                else:
                    inner += 4 if tag & 7 == 5 else 8
                if tag >> 3 != 3:
                    fields += data[begin:inner]
            fields += bytes([3 << 3, 1])
            out += written(key) + written(len(fields)) + fields
        else:
            out += data[start : at + size]
        at += size
    return bytes(out)


def test_counts_equal_the_library_on_the_same_pieces(spark):
    """Short texts, as the library adds up scores in single precision."""
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigrams(PATH))
    counter = tokens.Counter(tokens.read_vocabulary(PATH))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").limit(60).collect()
    words = sorted({w for d in docs for w in d.text.split()})[:4000]
    for word in [*words, "日本語", "a  b", "x\ny", " lead", "½é\t"]:
        assert counter.count(word)[1] == len(library.encode(word)), word


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    vocabulary = tokens.read_vocabulary(PATH)
    rows = docs.select("doc_id", tokens.token_count(spark, F.col("text"), vocabulary).alias("c")).collect()
    counts = {r.doc_id: r.c.n_tokens for r in rows if r.doc_id}
    assert counts[1] == counts[2] == 0 and counts[3] > 0 and counts[4] > 60_000 and len(rows) == len(odd_rows)


def test_query_counts_every_document(spark):
    counter = tokens.Counter(tokens.read_vocabulary(PATH))
    counter.cut = None  # whole texts, without the cuts
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries.token_counts(spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for doc in docs[:40]:
        score, count = counter.count(doc.text)
        assert rows[doc.doc_id].score == pytest.approx(score)
        if abs(score) < 1e6:
            assert rows[doc.doc_id].n_tokens == count
