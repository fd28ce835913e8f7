from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import catalog, packing
from nearfield.llm.vocab import Rows, Stretches, json_tokenizer, word_stretches

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def ids_of(text):
    encoding = json_tokenizer(packing.TOKENIZER).encode(text or "", add_special_tokens=False)
    return [*encoding.ids, packing.END]


def check(pieces, rows, length):
    """Pieces are gapless in documents and sequences, carry the right ids, and leave one sequence short."""
    docs, windows = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    want = {}
    for key, text in rows:
        want.setdefault(key, []).append(ids_of(text))
    assert docs.keys() == want.keys()
    for key, own in docs.items():
        got = []
        for p in sorted(own, key=lambda p: (p.start, p.sequence_id)):
            ids = np.frombuffer(p.ids, "<u4").tolist()
            assert len(ids) == p.length > 0
            if len(want[key]) == 1:
                assert p.start == len(got) and p.doc_tokens == len(want[key][0])
            got += ids
        if len(want[key]) == 1:
            assert got == want[key][0]
        else:
            assert sorted(got) == sorted(i for ids in want[key] for i in ids)
    sizes = []
    for number in sorted(windows):
        at = 0
        for p in sorted(windows[number], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert sorted(windows) == list(range(len(windows)))
    assert all(size == length for size in sizes[:-1]) and 0 < sizes[-1] <= length


ROWS = [
    (1, "Hello world, it's 1234 café"),
    (2, None),
    (3, ""),
    (4, "<|endoftext|> and <|startoftext|> are text"),
    (5, "x" * 3000 + " \n\n\t end  two hard spaces"),
    (6, "twin"),
    (6, "another of that id"),
    (None, "no id"),
    (8, "naïve 東京 🙂 ΣΑΣ " * 500),
    (9, " leading and trailing "),
    (10, "a\x1cb \x1c ć ́d"),
]


@pytest.mark.parametrize(("length", "parts"), [(16, 3), (7, 1), (4096, 2)])
def test_every_id_lies_in_one_piece(make_docs, length, parts):
    pieces = packing.packed(make_docs(ROWS, parts=parts), length)
    check(pieces.collect(), ROWS, length)


def test_an_empty_table_has_no_pieces(make_docs):
    assert packing.packed(make_docs(ROWS).limit(0)).collect() == []


def test_repeated_rows_are_documents_of_their_own(make_docs):
    pieces = packing.packed(make_docs([(1, "one two")] * 5, parts=2), 8).collect()
    assert sum(p.length for p in pieces) == 15


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB sS'’.\n\t   \x85\x1f́Σ東9½🙂</w>"), max_size=40) | st.text(max_size=40))
def test_stretches_encode_like_the_whole_text(text):
    text = text.encode("utf-8", "replace").decode()
    got = word_stretches(packing.TOKENIZER).texts([text, "", text])
    want = json_tokenizer(packing.TOKENIZER).encode(text, add_special_tokens=False).ids
    assert got[0][0].ids.tolist() == want + want
    assert np.diff(got[0][0].bounds).tolist() == [len(want), 0, len(want)]


def test_the_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("nearfield.llm.vocab.CACHE_STRETCHES", 3)
    coder = Stretches(
        lambda new: (new, [Rows.of([[len(s)] for s in new])], np.array([s != "bb" for s in new])), 1, str.split
    )
    for _ in range(3):
        (rows,), flagged = coder.texts(["a bb ccc dddd", "", "ccc eeeee"])
        assert rows.ids.tolist() == [1, 2, 3, 4, 3, 5] and flagged.tolist() == [False, True, True]


def test_sequences_are_padded(make_docs):
    pieces = packing.packed(make_docs([(i, "word " * i) for i in range(9)], parts=2), 16)
    rows = sorted(packing.sequences(pieces, 16, pad=7).collect())
    assert [r.n_tokens for r in rows] == [16, 16, 13]
    assert all(len(r.ids) == 64 for r in rows)
    assert np.frombuffer(rows[-1].ids, "<u4")[13:].tolist() == [7, 7, 7]
    short = packing.packed(make_docs([(1, "one two three")]), 16)
    assert [(r.n_tokens, len(r.ids)) for r in packing.sequences(short, 16).collect()] == [(4, 16)]


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = catalog.QUERIES["op12_packing"](spark, folder)
    assert got.columns == list(COLUMNS)
    pieces = got.collect()
    want = {key: ids_of(text) for key, text in rows}
    for p in pieces:
        part = np.array(want[p.doc_id][p.start : p.start + p.length], "<u4")
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(want[p.doc_id])
    assert sum(p.length for p in pieces) == sum(map(len, want.values()))
    assert len({p.sequence_id for p in pieces}) == -(-sum(map(len, want.values())) // 4096)
    assert len(rows_of(got, *COLUMNS)) == len(pieces)


def test_random_lengths(make_docs):
    draw = random.Random(4)
    rows = [(i, "ab " * draw.randint(0, 60)) for i in range(200)]
    check(packing.packed(make_docs(rows, parts=7), 32).collect(), rows, 32)
