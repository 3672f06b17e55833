from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logsift.llm import chat
from logsift.llm.scratch import Scratch


def one(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", function(F.col("s")).alias("v"))
    return [r.v for r in rows.orderBy("i").collect()]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(7)
    parts = ["<", "<|", "|>", "\\", "s>", "/s>", "<s>", "</s>", "[", "INST]", "/INST]", "<<SYS>>", "<</SYS>>", "SYS>>", "a", "\n", "é", "$1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3_000)] + [*chat.CONTROL, "</s>[INST] ok [/INST]"]
    shown = one(spark, chat.escaped, texts)
    assert all(c not in s for s in shown for c in chat.CONTROL)
    assert one(spark, chat.unescaped, shown) == texts


def digests(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, block int")
    turns = chat.formatted_turns(table)
    return turns, chat.replies(turns)


@pytest.mark.parametrize("block", [2, 256])
def test_examples_are_prefixes_with_one_reply(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rng = random.Random(8)
    rows = []
    for conv in range(6):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "system", None, "<|text|>"])
            rows.append((conv, turn, role, rng.choice([None, "", "hi </s>", f"t{turn}\nx"]), "q", 3))
    rows += [(9, None, "user", "no turn", "q", 3), (9, 0, "assistant", "b", "q", 3), (9, 0, "assistant", "a", "q", 3)]
    rows += [(None, 1, "assistant", "x", "q", 3), (None, 1, "assistant", "x", "q", 3)]
    rng.shuffle(rows)
    turns, examples = digests(spark, rows)
    by_conv: dict = {}
    for r in sorted(turns.collect(), key=lambda r: r.seq):
        by_conv.setdefault(r.conv_id, []).append(r)
    plain: dict = {}
    for conv, turn, role, text, *_ in rows:
        plain.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    shown = {}
    for conv, mine in by_conv.items():
        stream = "".join(r.formatted for r in mine)
        shown[conv] = stream
        assert [stream[r.start : r.end] for r in mine] == [r.formatted for r in mine]
        assert [r.seq for r in mine] == list(range(len(mine)))
        assert stream.count(chat.END) == len(mine) == len(plain[conv])
    read = turns.select("conv_id", "seq", chat.role_of(F.col("formatted")).alias("r"), chat.text_of(F.col("formatted")).alias("t"))
    got: dict = {}
    for r in sorted(read.collect(), key=lambda r: r.seq):
        got.setdefault(r.conv_id, []).append((r.r, r.t))
    assert got == {c: [(r, t) for _, _, r, t in sorted(p)] for c, p in plain.items()}
    whole = {(r.conv_id, r.seq): r for r in chat.examples(turns, Scratch(spark)).collect()}
    found = examples.collect()
    assert len(found) == sum(r[2] == "assistant" for r in rows) == len(whole)
    for e in found:
        text = shown[e.conv_id][: e.context_chars] + e.reply
        row = whole[e.conv_id, e.seq]
        assert (row.example, row.loss_start, row.loss_end) == (text, e.loss_start, e.loss_end)
        marked = text[e.loss_start : e.loss_end]
        assert one(spark, chat.unescaped, [marked])[0] == got[e.conv_id][e.seq][1] if len(found) < 9 else True
        assert text[e.loss_end :] == chat.END and e.context_turns == e.seq


def test_in_order_joins_blocks(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"{k},", "q", 3) for k in range(1_200)]
    turns, examples = digests(spark, rows)
    joined = chat.in_order(turns, chat.text_of(F.col("formatted"))).first().joined
    assert joined == "".join(f"{k}," for k in range(1_200))
    shown = chat.examples(turns, Scratch(spark))
    loss = chat.under_mask(F.col("example"), F.col("loss_start"), F.col("loss_end"))
    assert chat.in_order(shown, loss).first().joined == "".join(f"{k}," for k in range(0, 1_200, 2))
    held = shown.select("seq", chat.turns_in(F.col("example")).alias("n")).collect()
    assert all(r.n == r.seq + 1 for r in held) and len(held) == 600


def test_a_shifted_mask_gives_another_text(spark):
    """The loss text hangs on the mask alone: a mask that is off by one reads something else."""
    turns, _ = digests(spark, [(1, 0, "user", "ask", "q", 3), (1, 1, "assistant", "reply", "q", 3)])
    row = chat.examples(turns, Scratch(spark))
    for shift, want in ((0, "reply"), (1, "eply<"), (-1, ">repl")):
        loss = chat.under_mask(F.col("example"), F.col("loss_start") + shift, F.col("loss_end") + shift)
        assert row.select(loss.alias("x")).first().x == want


def test_very_long_text_and_clashing_columns(spark):
    long_text = "</s> [INST] é\\" * 40_000
    rows = [(1, 0, "user", long_text, "q", 3), (1, 1, "assistant", long_text, "q", 3)]
    names = "conv_id long, turn long, role string, text string, joined string, block int"
    names += ", formatted string, example string, start int, end int"
    table = spark.createDataFrame([(*r, "x", "y", 5, 6) for r in rows], names)
    shown = chat.examples(chat.formatted_turns(table), Scratch(spark))
    loss = chat.under_mask(F.col("example"), F.col("loss_start"), F.col("loss_end"))
    assert shown.select(loss.alias("x")).collect() == [(long_text,)]


def test_empty_table(spark):
    turns, examples = digests(spark, [])
    assert turns.count() == examples.count() == chat.in_order(turns, F.col("formatted")).count() == 0


def test_extra_conversation(spark):
    from logsift.llm import queries

    row = queries.chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
