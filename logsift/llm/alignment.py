"""Alignment of two tokenizers over the same text: groups between shared token ends, links, counts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsift.llm.scratch import Scratch

#: Characters of the documents of one block, which one group of a shuffle holds. A longer
#: document is a block of its own.
BLOCK_CHARS = 8_000_000
#: Blocks whose pairs are summed first, so that a pair of all blocks is no hot key.
SPAN_BLOCKS = 256
#: Characters of the texts that are cut at once, and of segments that are encoded as one text.
_CALL_CHARS, _JOINT_CHARS = 1_000_000, 4_000
#: Bytes of written groups beyond which a task ends a block and forgets the segments that it has met.
_KNOWN_BYTES = 24_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BESIDE = re.compile(r" [^\S ]|[^\S ] ")

Encode = Callable[[list[str]], list[list[int]]]


def byte_level_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: visible Latin-1
    characters stand for themselves, the other bytes, in order, for those from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in visible)
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class ByteLevel:
    """A byte-level BPE file of ``tokenizers``; a space is put before the text."""

    file: str

    @classmethod
    def read(cls, path: str) -> ByteLevel:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def cuts_at_spaces(self, pieces: list[bytes]) -> bool:
        """Whether words are merged each by itself, a space before a word being its first byte."""
        shape = json.loads(self.file)
        before = shape.get("pre_tokenizer") or {}
        return before.get("type") == "ByteLevel" and before.get("use_regex", True) and not shape.get("normalizer")

    def load(self) -> tuple[Encode, list[bytes]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = Tokenizer.from_str(self.file)
        tokenizer.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        pieces = {i: bytes(alphabet[c] for c in p) for p, i in tokenizer.get_vocab(with_added_tokens=False).items()}
        special = {int(t["id"]): t["content"].encode() for t in json.loads(self.file).get("added_tokens", [])}
        pieces = special | pieces

        def encode(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

        return encode, [pieces.get(i, b"") for i in range(max(pieces) + 1)]


@dataclass(frozen=True)
class Pieces:
    """A sentencepiece model, which puts the space before the text itself."""

    file: bytes

    @classmethod
    def read(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            return cls(f.read())

    def cuts_at_spaces(self, pieces: list[bytes]) -> bool:
        """Whether no piece holds a space behind another character, so that none spans two words."""
        return not any(b" " in piece.lstrip(b" ") for piece in pieces)

    def load(self) -> tuple[Encode, list[bytes]]:
        model = sentencepiece.SentencePieceProcessor(model_proto=self.file)

        def piece(i: int) -> bytes:
            name = model.id_to_piece(i)
            return bytes([int(name[1:-1], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()

        return lambda texts: model.encode(texts, num_threads=1), [piece(i) for i in range(model.get_piece_size())]


@dataclass(frozen=True)
class Overlaps:
    """Two rows of tokens laid over the same bytes."""

    #: Byte offsets where tokens of both sides end, and how many tokens of each side lie before them.
    ends: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    #: For every two tokens that overlap the byte offset where that ends, and their places.
    link_ends: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def overlaps(size_a: np.ndarray, size_b: np.ndarray) -> Overlaps:
    """Shared ends and overlapping tokens of two rows of tokens with these sizes in bytes."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    marks = np.zeros(1 + max(end_a.max(initial=0), end_b.max(initial=0)), np.uint8)
    marks[end_a] = 1
    marks[end_b] |= 2
    # Between one end and the next, whichever side's, one token of each side lies.
    ends, link_ends = np.flatnonzero(marks == 3), 1 + np.flatnonzero(marks[1:])
    link_ends = link_ends[link_ends <= min(end_a.max(initial=0), end_b.max(initial=0))]
    return Overlaps(
        ends, np.searchsorted(end_a, ends, "right"), np.searchsorted(end_b, ends, "right"),
        link_ends, np.searchsorted(end_a, link_ends), np.searchsorted(end_b, link_ends),
    )


def slices_of(
    a: list[int], b: list[int], len_a: list[int], len_b: list[int]
) -> tuple[list[int], list[tuple[tuple, tuple]]]:
    """Byte offsets where tokens of both sides end, and the id lists cut there."""
    found = overlaps(np.array(len_a)[a], np.array(len_b)[b])
    at_a, at_b = found.at_a.tolist(), found.at_b.tolist()
    a, b = tuple(a), tuple(b)
    return found.ends.tolist(), [(a[i:k], b[j:m]) for i, k, j, m in zip([0, *at_a], at_a, [0, *at_b], at_b)]


def links_of(a: tuple, b: tuple, len_a: list[int], len_b: list[int]) -> list[tuple[int, int]]:
    """Id pairs of the tokens of one slice whose byte ranges overlap."""
    found = overlaps(np.array(len_a)[list(a)], np.array(len_b)[list(b)])
    return [(a[i], b[j]) for i, j in zip(found.link_a.tolist(), found.link_b.tolist())]


def written(a: tuple, b: tuple) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def read_groups(text: str) -> list[dict[str, list[int]]]:
    """The id lists of groups that are written and joined by semicolons."""
    return [
        {side: [int(i) for i in ids.split(",")] for side, ids in zip("ab", group.split("|"))} for group in text.split(";")
    ]


def _values(array: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """Where the values of an array that is not sliced begin and end, and their bytes, one after the other."""
    if not len(array):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = array.buffers()
    return np.frombuffer(offsets, np.int64, len(array) + 1), memoryview(data or b"").cast("B")


class _Segments:
    """Segments that a task has met, numbered, with their tokens, groups and links under both tokenizers."""

    def __init__(self, a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> None:
        (encode_a, bytes_a), (encode_b, bytes_b) = a.load(), b.load()
        self.cuts = a.cuts_at_spaces(bytes_a) and b.cuts_at_spaces(bytes_b)
        self.sides = [(encode_a, pa.array(bytes_a, pa.large_binary())), (encode_b, pa.array(bytes_b, pa.large_binary()))]
        #: Every id with what may follow it in writing.
        ids = range(max(len(bytes_a), len(bytes_b)))
        self.written = pa.array([f"{i}{after}".encode() for i in ids for after in ",|;"], pa.large_binary())
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        #: The groups of each segment, written, with a semicolon behind each; nothing if it has no tokens.
        self.names = pa.array([], pa.large_binary())
        #: Tokens of both sides, groups and links of each segment.
        self.sums = np.zeros((0, 4), np.int64)
        #: Numbers of the linked id pairs, one segment behind the other.
        self.links = np.zeros(0, np.int32)
        self.pairs: dict[int, int] = {}

    def of(self, text: str) -> list[str]:
        """A text cut at each space between two characters that are none, where tokens of both
        sides end; the space itself belongs to the next segment. An empty text has none."""
        if not text or not self.cuts:
            return [text] if text else []
        parts = text.split(" ")
        # Most texts have no other white space beside a space.
        if "" in parts or _BESIDE.search(text):
            return _CUT.split(text)
        return parts

    def learn(self, segments: Iterable[str]) -> None:
        """Segments, each given once; those that the task has not met are encoded."""
        # Joined again, segments without white space at their ends are cut at the same places.
        joints, joint, chars, size = [], [], 0, 0
        for s in [s for s in segments if s not in self.numbers]:
            chars += len(s)
            if self.cuts and s.strip() == s:
                joint.append(s)
                size += len(s)
                if size >= _JOINT_CHARS:
                    joints.append(joint)
                    joint, size = [], 0
            else:
                joints.append([s])
            if chars >= _CALL_CHARS:
                self._learn([*joints, joint] if joint else joints)
                joints, joint, chars, size = [], [], 0, 0
        if joint:
            joints.append(joint)
        if joints:
            self._learn(joints)

    def _learn(self, joints: list[list[str]]) -> None:
        texts = [" ".join(joint) for joint in joints]
        given, found = np.ones(len(texts), bool), []
        for encode, pieces in self.sides:
            ids = encode(texts)
            sizes = np.array(list(map(len, ids)), np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum())
            offsets, data = _values(pieces.take(pa.array(flat)))
            stops = np.cumsum(sizes)
            for k, (text, start, stop) in enumerate(zip(texts, offsets[stops - sizes], offsets[stops])):
                given[k] &= data[start:stop] == b" " + text.encode()
            found.append((flat, np.diff(offsets), sizes))
        if not given.all():
            # A character that a tokenizer does not give back: find the segments that hold it.
            found = [(flat[kept], lengths[kept], sizes) for flat, lengths, sizes in found for kept in [np.repeat(given, sizes)]]
            lost = [joint for joint, whole in zip(joints, given) if not whole]
            self._without_tokens([joint[0] for joint in lost if len(joint) == 1])
            if parts := [[s] for joint in lost if len(joint) > 1 for s in joint]:
                self._learn(parts)
            joints = [joint for joint, whole in zip(joints, given) if whole]
        if joints:
            (a, size_a, _), (b, size_b, _) = found
            self._add(list(chain.from_iterable(joints)), a, b, overlaps(size_a, size_b))

    def _without_tokens(self, segments: list[str]) -> None:
        none = np.zeros(len(segments), np.int64)
        self._keep(segments, pa.array([b""] * len(segments), pa.large_binary()), np.stack([none] * 4, axis=1), none[:0])

    def _add(self, segments: list[str], a: np.ndarray, b: np.ndarray, found: Overlaps) -> None:
        lengths = pc.binary_length(pa.array(segments, pa.large_string())).to_numpy()
        ends = np.cumsum(1 + lengths)
        groups, links = np.searchsorted(found.ends, ends, "right"), np.searchsorted(found.link_ends, ends, "right")
        if not np.array_equal(found.ends[groups - 1], ends):
            raise ValueError("A token spans two segments")
        # Ids in the order in which they are written: those of a group's one side, then those of its other side.
        sizes_a, sizes_b = np.diff(found.at_a, prepend=0), np.diff(found.at_b, prepend=0)
        codes_a, codes_b = 3 * a, 3 * b
        codes_a[found.at_a - 1] += 1
        codes_b[found.at_b - 1] += 2
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(found.at_b - sizes_b, sizes_a)] = codes_a
        codes[np.arange(len(b)) + np.repeat(found.at_a, sizes_b)] = codes_b
        at = [np.concatenate([[0], x])[groups] for x in (found.at_a, found.at_b)]
        taken = self.written.take(pa.array(codes))
        starts = np.concatenate([[0], _values(taken)[0][at[0] + at[1]]])
        names = pa.Array.from_buffers(pa.large_binary(), len(segments), [None, pa.py_buffer(starts), taken.buffers()[2]])
        pairs, links_of_pairs = np.unique(a[found.link_a] << 32 | b[found.link_b], return_inverse=True)
        pairs = np.array([self.pairs.setdefault(p, len(self.pairs)) for p in pairs.tolist()], np.int32)
        sums = np.stack([np.diff(x, prepend=0) for x in (*at, groups, links)], axis=1)
        self._keep(segments, names, sums, pairs[links_of_pairs])

    def _keep(self, segments: list[str], names: pa.Array, sums: np.ndarray, links: np.ndarray) -> None:
        self.numbers.update(zip(segments, count(len(self.numbers))))
        self.names = pa.concat_arrays([self.names, names])
        self.sums = np.concatenate([self.sums, sums])
        self.links = np.concatenate([self.links, links.astype(np.int32)])


_IDS = pa.list_(pa.int32())
_GROUPS = pa.list_(pa.struct([("a", _IDS), ("b", _IDS)]))
#: A row per document and one per block, which has no document and holds the block's pairs.
_BLOCK_ROW = pa.schema(
    [
        ("block", pa.int64()), ("is_doc", pa.bool_()), ("doc_id", pa.int64()),
        ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string()), ("groups", _GROUPS),
        # Of a document its segments and how often it has them, of a block the segment and pair of each link.
        ("held", pa.binary()),
        ("a", _IDS), ("b", _IDS), ("n", pa.list_(pa.int64())),  # of a block: ids and count of its pairs
    ]
)
_BLOCK_SQL = (
    "block long, is_doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "groups array<struct<a: array<int>, b: array<int>>>, held binary, a array<int>, b array<int>, n array<long>"
)


def packed(numbers: np.ndarray, values: np.ndarray) -> bytes:
    """Two equally long arrays, the first one ascending, as differences, byte planes and zlib."""
    both = np.concatenate([np.diff(numbers, prepend=0), values]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(held), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of runs of these sizes, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class _Block:
    """Documents whose distinct segments and pairs are numbered together."""

    def __init__(self, number: int, with_groups: bool, segments: _Segments) -> None:
        self.number, self.with_groups, self.segments = number, with_groups, segments
        self.rows: list[dict] = []
        #: Of each document its segments, ascending, and how often it has them.
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.chars = 0

    def add(self, doc_id: int | None, numbers: np.ndarray, groups: memoryview, chars: int) -> None:
        """A document by its segments and how their groups are written; both are empty without tokens."""
        numbers_of, times_of = np.unique(numbers, return_counts=True)
        row = {"block": self.number, "is_doc": True, "doc_id": doc_id}
        row["n_a"], row["n_b"], row["n_groups"], row["n_links"] = (times_of @ self.segments.sums[numbers_of]).tolist()
        row["groups_sha256"] = hashlib.sha256(groups).hexdigest() if groups else ""
        if self.with_groups:
            row["groups"] = read_groups(groups.tobytes().decode()) if groups else []
        self.rows.append(row)
        self.held.append((numbers_of, times_of))
        self.chars += chars

    def batch(self) -> pa.RecordBatch:
        known = self.segments
        times = np.zeros(len(known.sums), np.int64)
        for numbers_of, times_of in self.held:
            times[numbers_of] += times_of
        # The block's own numbers of its segments.
        used = np.flatnonzero(times)
        place = np.cumsum(times > 0) - 1
        for row, (numbers_of, times_of) in zip(self.rows, self.held):
            row["held"] = packed(place[numbers_of], times_of)
        n_links = known.sums[:, 3]
        link_pair = known.links[_runs((np.cumsum(n_links) - n_links)[used], n_links[used])]
        link_segment = np.repeat(np.arange(len(used)), n_links[used])
        # Pairs of segments that are not used are not counted; small numbers for frequent pairs pack well.
        n_of = np.bincount(link_pair, minlength=len(known.pairs))
        seen = np.argsort(-n_of, kind="stable")[: np.count_nonzero(n_of)]
        number = np.empty(len(n_of), np.int64)
        number[seen] = np.arange(len(seen))
        link_pair = number[link_pair]
        ids = np.fromiter(known.pairs, np.int64, len(known.pairs))[seen]
        totals = np.bincount(link_pair, times[used][link_segment], len(ids))
        self.rows.append(
            {
                "block": self.number, "is_doc": False, "held": packed(link_segment, link_pair),
                "a": (ids >> 32).astype(np.int32), "b": ids.astype(np.int32), "n": totals.astype(np.int64),
            }
        )
        columns = [pa.array([row.get(f.name) for row in self.rows], f.type) for f in _BLOCK_ROW]
        return pa.RecordBatch.from_arrays(columns, schema=_BLOCK_ROW)


def _documents(known: _Segments, texts: list[str]) -> Iterator[tuple[np.ndarray, memoryview]]:
    """Of each text its segments and how their groups are written; both are empty without tokens."""
    cut = [known.of(text) for text in texts]
    known.learn(dict.fromkeys(chain.from_iterable(cut)))
    stops = np.cumsum(list(map(len, cut)))
    numbers = np.fromiter(map(known.numbers.__getitem__, chain.from_iterable(cut)), np.int64, stops[-1])
    offsets, data = _values(known.names.take(pa.array(numbers)))
    # Where segments without tokens are, the whole text has none.
    lost = np.searchsorted(stops, np.flatnonzero(np.diff(offsets) == 0), "right")
    kept = np.ones(len(texts), bool)
    kept[lost] = False
    for start, stop, whole in zip([0, *stops.tolist()], stops.tolist(), kept.tolist()):
        stop = stop if whole else start
        # Without the last semicolon.
        yield numbers[start:stop], data[offsets[start] : max(offsets[start], offsets[stop] - 1)]


def _calls(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in runs of about ``_CALL_CHARS`` characters."""
    ids, texts, chars = [], [], 0
    for doc_id, value in zip(batch.column(0), batch.column(1)):
        text = value.as_py() or ""
        ids.append(doc_id.as_py())
        texts.append(text)
        chars += len(text)
        if chars >= _CALL_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _blocks(docs: DataFrame, a: ByteLevel | Pieces, b: ByteLevel | Pieces, with_groups: bool, block_chars: int) -> DataFrame:
    # Files of about two MB.
    sent_a, sent_b = (docs.sparkSession.sparkContext.broadcast(x) for x in (a, b))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Segments(sent_a.value, sent_b.value)
        numbers = count(TaskContext.get().partitionId() << 32)
        block = None
        for batch in batches:
            for ids, texts in _calls(batch):
                for doc_id, text, found in zip(ids, texts, _documents(known, texts)):
                    block = block or _Block(next(numbers), with_groups, known)
                    block.add(doc_id, *found, len(text) + 1)
                    if block.chars >= block_chars:
                        yield block.batch()
                        block = None
                if known.names.nbytes > _KNOWN_BYTES:
                    if block:
                        yield block.batch()
                        block = None
                    known.forget()
        if block:
            yield block.batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _BLOCK_SQL)


def _summed(group: pa.Table, of_pairs: pa.Table) -> pa.Table:
    """The sums of each document of a block from the corpus-wide values of the block's pairs."""
    header = group.filter(pc.invert(group.column("is_doc")))
    docs = group.filter(group.column("is_doc"))
    pair = of_pairs.column("pair").to_numpy()
    values = np.zeros((2, len(pair)), np.int64)
    values[0, pair] = of_pairs.column("pair_count").to_numpy()
    values[1, pair] = of_pairs.column("is_best").to_numpy()
    link_segment, link_pair = unpacked(header.column("held")[0].as_py())
    of_segment = np.zeros((2, int(link_segment.max()) + 1 if len(link_segment) else 0), np.int64)
    np.add.at(of_segment, (slice(None), link_segment), values[:, link_pair])
    sums = np.zeros((2, docs.num_rows), np.int64)
    for k, held in enumerate(docs.column("held")):
        numbers, times = unpacked(held.as_py())
        sums[:, k] = of_segment[:, numbers] @ times
    out = docs.select(_KEPT).append_column("n_best", pa.array(sums[1])).append_column("count_sum", pa.array(sums[0]))
    return out


_KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]


@dataclass(frozen=True)
class Aligned:
    """``documents`` has a row for each row of the input, ``pairs`` one for each linked id pair."""

    documents: DataFrame
    pairs: DataFrame


def align(
    docs: DataFrame, a: ByteLevel | Pieces, b: ByteLevel | Pieces, groups: bool = False, block_chars: int = BLOCK_CHARS
) -> Aligned:
    """Groups and links between the tokens of ``docs(doc_id, text)`` under two tokenizers.

    A document's token ends are byte offsets; where both sides have one, both id lists are cut,
    which gives its groups in order. Inside a group, tokens whose byte ranges overlap are
    linked. ``documents`` holds doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256, and with ``groups`` the id lists of every group. ``pairs`` holds id_a, id_b,
    pair_count (links in all documents) and is_best (no pair of its id_b counts more).

    Where no token of either side spans two words, a text is cut at its single spaces, and equal
    segments are encoded and aligned once. Tasks number the distinct segments of a block of
    documents and write, for each document, how often it has which, and, for the block, its pairs. Counting shuffles one row for each pair
    of a block. Values return to a block in two steps, over spans of blocks, so a pair that
    all documents hold has a row per span and not one per document.

    Texts that are null or empty, or that a tokenizer does not give back byte for byte, have no
    tokens: numbers are zero, lists and digest empty. Rows repeat as often as in the input, a
    null doc_id stays. Other columns are not read. An empty table gives empty tables.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(_blocks(docs, a, b, groups, block_chars), "blocks")
    span = F.shiftright("block", 32) * (1 << 20) + F.floor(F.col("block").bitwiseAND((1 << 32) - 1) / SPAN_BLOCKS)
    held = rows.where("not is_doc").select(
        "block", F.pmod(F.xxhash64(span), F.lit(1 << 20)).alias("span"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("pair", "x")
    )
    held = held.select("block", "span", "pair", F.col("x.a").alias("id_a"), F.col("x.b").alias("id_b"), F.col("x.n").alias("n"))
    spans = held.groupBy("span", "id_a", "id_b").agg(F.sum("n").alias("n"))
    spans = scratch.table(spans, "spans")
    counts = spans.groupBy("id_a", "id_b").agg(F.sum("n").alias("pair_count"))
    most = counts.groupBy("id_b").agg(F.max("pair_count").alias("most")).withColumnRenamed("id_b", "of_b")
    pairs = counts.join(most, F.col("id_b") == F.col("of_b")).select(
        "id_a", "id_b", "pair_count", (F.col("pair_count") == F.col("most")).alias("is_best")
    )
    pairs = scratch.table(pairs, "pairs")
    known = spans.select("span", "id_a", "id_b").join(pairs, ["id_a", "id_b"])
    values = held.join(known, ["span", "id_a", "id_b"]).select(
        F.col("block").alias("of_block"), "pair", "pair_count", F.col("is_best").cast("long").alias("is_best")
    )
    given = rows.select("block", "is_doc", *_KEPT, "held")
    summed = given.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(
        _summed,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "groups array<struct<a: array<int>, b: array<int>>>, n_best long, count_sum long",
    )
    return Aligned(summed if groups else summed.drop("groups"), pairs)
