from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from conftest import rows_of

from nearfield.llm import repeats

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def figures(docs):
    return rows_of(repeats.kept_bytes(docs), *COLUMNS)


def test_shared_passages(make_docs, prose):
    draw = random.Random(6)
    passages = [prose(draw.randint(8, 60), 900 + i) for i in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(draw.randint(0, 40), i)]
        for _ in range(draw.randint(0, 3)):
            passage = draw.choice(passages)
            start = draw.randint(0, len(passage) // 2)
            parts += [passage[start : start + draw.randint(50, 400)], prose(draw.randint(0, 15), i + 7)]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500, rows[4][1]), (2, rows[4][1]), (501, rows[4][1][:150]), (502, rows[4][1] + "x")]
    draw.shuffle(rows)
    assert figures(make_docs(rows, parts=5)) == brute.repeated_bytes(rows)


def test_repeats_inside_a_text(make_docs, prose):
    line = prose(25, 1)
    rows = [
        (1, "a" * 500),
        (2, "ab" * 300 + prose(9, 2) + "ab" * 80),
        (3, "\n".join([line] * 6)),
        (4, "a" * 99),
        (5, "a" * 100),
        (6, "x" + "a" * 101 + "y"),
        (7, (line[:37] + "é") * 12),
        (8, line + "|" + line[:110] + "|" + line[5:]),
    ]
    assert figures(make_docs(rows)) == brute.repeated_bytes(rows)


def test_small_alphabets(make_docs):
    draw = random.Random(9)
    for size in (2, 3):
        pieces = ["".join(draw.choices("abc"[:size], k=draw.randint(20, 140))) for _ in range(6)]
        rows = [(i, "".join(draw.choices(pieces, k=draw.randint(1, 6)))) for i in range(40)]
        assert figures(make_docs(rows)) == brute.repeated_bytes(rows)


def test_edges(make_docs, prose):
    rows = [(1, None), (2, ""), (3, "é" * 49), (4, "é" * 50), (5, "é" * 51), (6, prose(9000, 3)), (7, "z " + prose(9000, 3)[100:40_000])]
    assert figures(make_docs(rows)) == brute.repeated_bytes(rows)
    assert figures(make_docs(rows).limit(0)) == []


def test_ids_that_repeat_or_are_null(make_docs, prose):
    text, other = prose(40, 1), prose(40, 2)
    rows = [(5, text), (5, text), (9, text), (None, text + "!"), (7, other), (7, other + " more")]
    got = repeats.kept_bytes(make_docs(rows)).collect()
    gone = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_bytes"], r["n_removed"] > 0) for r in got)
    n, m = len(text.encode()), len(other.encode())
    assert gone[0:2] == [((False, 5), n, False)] * 2
    assert gone[-2:] == [((False, 9), n, True), ((True, 0), n + 1, True)]
    # Of two texts of one id, one counts as the earlier.
    assert sorted(g[2] for g in gone if g[0] == (False, 7)) == [False, True] and m


def test_blocks_of_long_texts(monkeypatch, make_docs, prose):
    monkeypatch.setattr(repeats, "BLOCK", 500)
    shared = prose(300, 5)
    for text in (shared, shared * 2):
        parts = repeats.segments(text.encode(), 100, 48)
        assert parts[3].sum() == len(text.encode()) - 99


@pytest.mark.parametrize("letters", ["ab", "abc"])
def test_maximal_repeats(letters):
    """All left- and right-diverse strings that occur twice, with every occurrence."""
    draw = random.Random(len(letters))
    contents = ["".join(draw.choices(letters, k=draw.randint(5, 40))).encode() for _ in range(5)]
    suffixes = repeats.Suffixes(contents, 3)
    groups, places, matches = repeats.repeat_scan(suffixes, 3, np.arange(len(suffixes.symbols)))
    whole = b"".join(contents)
    firsts = suffixes.firsts.tolist()

    def at(place):
        k = int(suffixes.owner[place])
        return k, place - firsts[k]

    occurrences = {}
    for k, c in enumerate(contents):
        for i in range(len(c)):
            for j in range(i + 3, len(c) + 1):
                occurrences.setdefault(c[i:j], []).append((k, i))
    expected = {}
    for s, where in occurrences.items():
        left = {contents[k][i - 1] if i else (k, "start") for k, i in where}
        right = {contents[k][i + len(s)] if i + len(s) < len(contents[k]) else (k, "end") for k, i in where}
        if len(where) > 1 and len(left) > 1 and len(right) > 1:
            expected[s] = sorted(where)
    found = {}
    for length, a, b in groups:
        some = [at(int(p)) for p in suffixes.order[a:b]]
        k, i = some[0]
        found[contents[k][i : i + length]] = sorted(some)
    assert found == expected
    longest = {}
    for p in range(len(whole)):
        k, i = at(p)
        for q in range(p):
            other, j = at(q)
            n = 0
            while i + n < len(contents[k]) and j + n < len(contents[other]) and contents[k][i + n] == contents[other][j + n]:
                n += 1
            longest[p] = max(longest.get(p, 0), n)
    covered, wanted = set(), set()
    for p, n in zip(places.tolist(), matches.tolist(), strict=True):
        assert n <= longest[p]
        covered |= set(range(p, p + n))
    for p, n in longest.items():
        if n >= 3:
            wanted |= set(range(p, p + n))
    assert covered == wanted


def test_a_passage_in_a_third_of_the_texts(make_docs, prose, monkeypatch):
    """Its ends give anchors with a content per text: settled by windows, whatever their number."""
    monkeypatch.setattr(repeats, "CROWDED_BYTES", 2_000)
    passage = prose(60, 77)
    rows = [
        (i, prose(12, i) + (passage[i % 5 :] if i % 3 == 0 else "") + prose(12, i + 5000))
        for i in range(240)
    ]
    rows += [(300, rows[3][1]), (301, passage), (302, passage + passage)]
    assert figures(make_docs(rows, parts=6)) == brute.repeated_bytes(rows)


@pytest.mark.parametrize("crowded", [0, 300])
def test_windows_settle_like_suffix_arrays(make_docs, prose, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED_BYTES", crowded)
    monkeypatch.setattr(repeats, "CUT_BYTES", 3_000)
    draw = random.Random(crowded)
    pieces = ["".join(draw.choices("ab", k=draw.randint(30, 160))) for _ in range(5)] + [prose(30, 3)]
    rows = [(i, "".join(draw.choices(pieces, k=draw.randint(1, 6)))) for i in range(60)]
    assert figures(make_docs(rows, parts=4)) == brute.repeated_bytes(rows)
