from __future__ import annotations

import hashlib
import sys
from collections import Counter
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsift.llm import alignment, queries

A, B = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.ByteLevel.read(A), alignment.Pieces.read(B)


def brute_force(rows):
    """Every pair of token occurrences is held against every other, by bytes."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    out, all_links = [], []
    for doc_id, text in rows:
        a, b, spans = [], [], []
        if text:
            whole = (" " + text).encode()
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            for ids, piece in ((a, lambda i: tok.decode([i], skip_special_tokens=False)), (b, None)):
                at, found = 0, []
                for i in ids:
                    if piece:
                        name = tok.id_to_token(i)
                        size = len(name)  # one character for each byte
                    else:
                        size = 1 if model.is_byte(i) else len(model.id_to_piece(i).replace("▁", " ").encode())
                    found.append((at, at + size))
                    at += size
                spans.append(found)
                if at != len(whole):
                    a, b = [], []
            if not a:
                spans = [[], []]
        else:
            spans = [[], []]
        links = [
            (a[i], b[j])
            for i, (s, e) in enumerate(spans[0])
            for j, (t, u) in enumerate(spans[1])
            if max(s, t) < min(e, u)
        ]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            sides = [[i for i, (s, e) in zip(ids, sp) if s >= start and e <= end] for ids, sp in zip((a, b), spans)]
            groups.append("|".join(",".join(map(str, side)) for side in sides))
            start = end
        out.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
        all_links += links
    count = Counter(all_links)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    done = [
        (i, na, nb, ng, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), digest(g))
        for i, na, nb, ng, ls, g in out
    ]
    return done, count, most


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, " \t\n\n  x   y "),
    (5, "Same text twice, same text twice."),
    (5, "Same text twice, same text twice."),
    (None, "A row without an id"),
    (6, "<|endoftext|> and </s><s> [INST] are plain"),
    (7, "日本語のテキスト 😀😀 é ½ \x00   \U0010ffff"),
    (8, "▁ is a piece mark ▁▁"),
    (9, "a" * 700 + "é" * 200),
]


@pytest.mark.parametrize("block_chars", [1, 60, 1 << 22])
def test_equals_brute_force(documents, tokenizers, block_chars):
    found = alignment.align(documents(ODD), *tokenizers, block_chars=block_chars)
    rows, count, most = brute_force(ODD)
    as_key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.documents.select(COLUMNS).collect()), key=as_key) == sorted(rows, key=as_key)
    pairs = {(r.id_a, r.id_b): (r.pair_count, r.is_best) for r in found.pairs.collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in count.items()}


def test_equals_brute_force_on_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 1500)
    rows, _, _ = brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()])
    found = alignment.align(docs, *tokenizers, block_chars=20_000).documents.select(COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(rows)


def test_groups_are_the_token_ids_in_order(documents, tokenizers):
    rows = alignment.align(documents(ODD), *tokenizers, groups=True).documents.collect()
    for row in rows:
        text = ";".join(alignment.written(tuple(g.a), tuple(g.b)) for g in row.groups)
        assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == row.groups_sha256
        assert sum(len(g.a) for g in row.groups) == row.n_a and sum(len(g.b) for g in row.groups) == row.n_b


def test_texts_a_tokenizer_does_not_give_back_have_no_tokens(documents, tokenizers):
    row = alignment.align(documents([(1, "▁")]), *tokenizers).documents.first()
    assert (row.n_a, row.n_b, row.n_links, row.groups_sha256) == (0, 0, 0, "")


def test_one_such_character_among_many_words(documents, tokenizers):
    rows = [(i, " ".join(f"w{i}x{k * k}" for k in range(60))) for i in range(40)]
    rows[17] = (17, rows[17][1] + " a▁b w3x4")
    rows.append((40, "a▁b"))
    found = alignment.align(documents(rows), *tokenizers).documents.select(COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(brute_force(rows)[0])


def test_forgetting_segments_changes_nothing(documents, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "_KNOWN_BYTES", 1)
    monkeypatch.setattr(alignment, "_CALL_CHARS", 40)
    rows = ODD + [(i, f"again and again w{i % 3} \t x{i} ") for i in range(20, 40)]
    found = alignment.align(documents(rows).coalesce(1), *tokenizers).documents.select(COLUMNS).collect()
    as_key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=as_key) == sorted(brute_force(rows)[0], key=as_key)


def test_new_words_take_few_calls_of_python(spark, tokenizers, monkeypatch):
    class Docs:
        """Takes the function that tasks run over Arrow batches."""

        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def select(self, *_):
            return self

        def mapInArrow(self, encode, _):
            return encode

    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    encode = alignment._blocks(Docs(), *tokenizers, False, alignment.BLOCK_CHARS)

    def calls(n_words):
        texts = [" ".join(f"{7919 * i:x}q" for i in range(at, at + 500)) for at in range(0, n_words, 500)]
        batch, made = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts}), 0

        def count(_, event, __):
            nonlocal made
            made += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            assert sum(b.num_rows for b in encode(iter([batch]))) == len(texts) + 1
        finally:
            sys.setprofile(None)
        return made

    assert calls(12_000) - calls(2_000) < 10 * 10_000


def test_long_text(documents, tokenizers):
    text = " ".join(f"w{i % 977}" for i in range(60_000))
    found = alignment.align(documents([(1, text), (2, "w1")]), *tokenizers).documents.orderBy("doc_id").collect()
    assert found[0].n_a > 60_000 and found[0].n_links >= max(found[0].n_a, found[0].n_b)
    assert found[1].n_links == 2 or found[1].n_groups >= 1


def test_empty_table(documents, tokenizers):
    found = alignment.align(documents([]), *tokenizers)
    assert found.documents.collect() == [] and found.pairs.collect() == []


def test_slices_by_hand():
    # Bytes " abcd": one side cuts " a|bc|d", the other " a|b|cd".
    lengths = [2, 2, 1, 1, 2]
    cut = alignment.slices_of([0, 1, 2], [0, 3, 4], lengths, lengths)
    assert cut == ([2, 5], [((0,), (0,)), ((1, 2), (3, 4))])
    assert alignment.links_of((1, 2), (3, 4), lengths, lengths) == [(1, 3), (1, 4), (2, 4)]


def test_registered_query(spark):
    rows = queries.QUERIES["op13_tokenizer_alignment"](spark, "/root/testdata/sf0.001")
    assert rows.columns == COLUMNS
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
