from __future__ import annotations

from collections import Counter

from logsift.llm import linededup, queries

SF_DIR = "/root/testdata/sf0.001"


def longest_common_run(a: list, b: list) -> list:
    """Longest common subsequence by the textbook table, for documents without repeats."""
    table = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j]:
                table[i + 1][j + 1] = [*table[i][j], a[i]]
            else:
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], key=len)
    return table[-1][-1]


def test_patience_aligns_as_many_unique_lines_as_possible():
    a = list("qabxcdzef")
    b = list("abycdwefg")
    shared = [c for c in a if c in b]
    aligned = linededup.patience([[a.index(c)] for c in shared], [[b.index(c)] for c in shared])
    assert [a[p] for p in sorted(aligned)] == longest_common_run(a, b)
    moved = list("defabc")
    shared = list("abcdef")
    aligned = linededup.patience([[moved.index(c)] for c in shared], [["abcdef".index(c)] for c in shared])
    assert len(aligned) == 3


def test_repeated_lines_join_a_block_through_an_anchor():
    # later: r A r B, earlier: A r B r
    aligned = linededup.patience([[0, 2], [1], [3]], [[1, 3], [0], [2]])
    assert aligned == {1, 2, 3}


LINE = "the quick brown fox jumps over the lazy dog number"


def passage(k: int, lines: int = 3) -> list[str]:
    return [f"{LINE} {k} {i}" for i in range(lines)]


def test_blocks_go_from_later_documents(spark, documents):
    docs = documents(
        [
            (1, "\n".join(["first", *passage(1), "end"])),
            (2, "\n".join(["own line", "", *passage(1), "", "tail"])),
            (3, "\n".join(passage(1)[:1] + ["short shared"])),
            (4, "\n".join([*passage(2), "short shared"])),
            (5, "\n".join([*passage(1), *passage(2)])),
            (6, "\n".join(["  " + passage(2)[0], *passage(2)[1:], "new"])),
        ]
    )
    kept = linededup.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert rows[1].text.startswith("first") and len(rows[1].text.split("\n")) == 5
    assert rows[2].text == "own line\n\n\ntail" and rows[2].n_chars == len(rows[2].text)
    # One line of eleven words is below the least block.
    assert rows[3].text == passage(1)[0] + "\nshort shared"
    assert rows[4].text.endswith("short shared")
    assert rows[5].text == "" and rows[6].text == "new"


def test_every_line_stays_somewhere(spark):
    """No line of the corpus is lost, and what goes stands in an earlier document."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.deduplicated_lines(spark, SF_DIR).collect()}
    assert rows.keys() == docs.keys()
    lines = {i: [x.strip() for x in t.split("\n") if x.strip()] for i, t in docs.items()}
    first = {}
    for i in sorted(lines):
        for x in lines[i]:
            first.setdefault(x, i)
    kept = set()
    for i, row in rows.items():
        drop = set(row.drop or [])
        assert all(first[lines[i][p]] < i for p in drop) and len(drop) == row.n_dropped
        left = [x for p, x in enumerate(lines[i]) if p not in drop]
        assert left == [x.strip() for x in row.text.split("\n") if x.strip()]
        kept |= set(left)
        if not drop:
            assert row.text == docs[i]
        # Passages of an earlier document that the later one holds in one piece are gone.
        for other in {first[x] for x in left} - {i}:
            run = best = 0
            place = {x: p for p, x in enumerate(lines[other])}
            for p, x in enumerate(lines[i]):
                follows = p and place.get(lines[i][p - 1]) == place.get(x, -9) - 1
                run = len(x.split()) + (run if follows else 0) if first[x] == other and p not in drop else 0
                best = max(best, run)
            unique = all(Counter(lines[d])[x] == 1 for d in (i, other) for x in left if first[x] == other)
            assert best < 20 or not unique
    assert kept == first.keys()


def test_a_line_of_most_documents(spark, documents):
    """One passage in 300 documents makes 299 rows of shared lines, not their pairs."""
    docs = documents([(i, "\n".join([f"own {i}", *passage(9)])) for i in range(300)])
    drops = linededup.dropped_lines(docs).collect()
    assert {r.doc_id: list(r.drop) for r in drops} == {i: [1, 2, 3] for i in range(1, 300)}


def test_odd_rows_and_empty_table(spark, documents, odd_rows):
    docs = documents(odd_rows)
    rows = linededup.deduplicated(docs).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(odd_rows)
    assert linededup.deduplicated(documents([])).count() == 0
    twice = documents([(1, "\n".join(passage(1))), (1, "\n".join(passage(1))), (2, "\n".join(passage(1)))])
    got = sorted((r.doc_id, len(r.text)) for r in linededup.deduplicated(twice).collect())
    assert got[0][1] > 0 and got[1][1] > 0 and got[2] == (2, 0)


def test_moved_and_repeated_passages_go(spark, documents):
    p, q, r = passage(1, 4), passage(2, 3), passage(3, 3)
    docs = documents(
        [
            (1, "\n".join([*p, *q, "unique line"])),
            (2, "\n".join(["own", *q, *p, "tail"])),
            (3, "\n".join(["unique line", "x", *p, "y", *p])),
            (4, "\n".join(reversed(r))),
            (5, "\n".join(["five", *r])),
            (6, "\n".join(["six", *r, "end"])),
        ]
    )
    texts = {d.doc_id: d.text for d in linededup.deduplicated(docs).collect()}
    assert texts[2] == "own\ntail"
    assert texts[3] == "unique line\nx\ny"
    # The first holder has r in reverse; the second one has it as the sixth document does.
    assert texts[6] == "six\nend"
    later = [[k + 3] for k in range(4)] + [[k] for k in range(3)]
    gapped = [[2 * k] for k in range(4)] + [[8 + 2 * k] for k in range(3)]
    assert linededup.blocks_to_drop([1] * 7, [11] * 7, later, gapped, 20) == list(range(7))


def test_a_long_text_of_one_repeated_pair_of_lines_ends():
    """Every pass aligns a block of its own, so the passes are at most the words by the least block."""
    pair = ["alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda mu"]
    earlier = [list(range(0, 4_000, 2)), list(range(1, 4_000, 2))]
    later = [list(range(0, 3_000, 2)), list(range(1, 3_000, 2))]
    dropped = linededup.blocks_to_drop([1, 1], [len(x.split()) for x in pair], later, earlier, 20)
    assert dropped == list(range(3_000))
