from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import align, catalog, vocab
from nearfield.llm.vocab import Rows, json_tokenizer, piece_model

PAIR = (align.BYTE_TOKENIZER, align.PIECE_TOKENIZER)
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def encode(text):
    """Both tokenisations of a text, none where it does not come back."""
    if not text:
        return [], []
    a = json_tokenizer(align.BYTE_TOKENIZER).encode(" " + text, add_special_tokens=False).ids
    b = piece_model(align.PIECE_TOKENIZER).encode(text)
    sides = align.byte_entries(align.BYTE_TOKENIZER), align.piece_entries(align.PIECE_TOKENIZER)
    for ids, entries in zip((a, b), sides, strict=True):
        if b"".join(entries[i] for i in ids) != (" " + text).encode():
            return [], []
    return a, b


def spans(ids, entries):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(entries[i]), i))
        at += len(entries[i])
    return out


def brute(rows):
    """The figures of each row by plain loops over all pairs of tokens."""
    entries = align.byte_entries(align.BYTE_TOKENIZER), align.piece_entries(align.PIECE_TOKENIZER)
    tokens = [encode(text) for _, text in rows]
    links, groups = [], []
    for a, b in tokens:
        left, right = spans(a, entries[0]), spans(b, entries[1])
        own, at = [], 0
        for start, stop, i in left:
            while at < len(right) and right[at][1] <= start:
                at += 1
            over = at
            while over < len(right) and right[over][0] < stop:
                own.append((i, right[over][2]))
                over += 1
        links.append(own)
        cuts = sorted({s[1] for s in left} & {s[1] for s in right})
        place, texts = [0, 0], []
        for cut in cuts:
            sides = [[], []]
            for side, own_tokens, out in zip((0, 1), (left, right), sides, strict=True):
                while place[side] < len(own_tokens) and own_tokens[place[side]][1] <= cut:
                    out.append(str(own_tokens[place[side]][2]))
                    place[side] += 1
            texts.append(",".join(sides[0]) + "|" + ",".join(sides[1]))
        groups.append(texts)
    counts = Counter(pair for own in links for pair in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (
            *(key, len(a), len(b), len(texts), len(own)),
            sum(counts[p] == best[p[1]] for p in own),
            sum(counts[p] for p in own),
            ";".join(texts),
        )
        for (key, _), (a, b), own, texts in zip(rows, tokens, links, groups, strict=True)
    ]


ROWS = [
    (1, "Hello world, it's  1234 café"),
    (2, None),
    (3, ""),
    (4, "<|endoftext|> <s> </s> <unk> <0x41> are text"),
    (5, "x" * 3000 + " \n\n\t end"),
    (6, "a lower block ▁ does not come back"),
    (6, "the twin of that id"),
    (None, "no id"),
    (8, "naïve 東京 🙂 unbelievable tokenization " * 60),
    (9, "  leading and trailing  "),
    (10, "the the the cat"),
    (11, "the the the cat"),
    (12, " "),
    (13, "▁"),
    (14, "a\x00b \x1c c"),
]


@pytest.mark.parametrize("parts", [1, 4])
def test_against_plain_loops(make_docs, parts):
    got = align.aligned(make_docs(ROWS, parts=parts)).fillna(-1, ["doc_id"])
    want = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in brute(ROWS))
    assert rows_of(got, "doc_id", *FIGURES, "groups") == want


def test_small_slices_and_shards_change_nothing(make_docs, monkeypatch):
    want = rows_of(align.aligned(make_docs(ROWS)).fillna(-1), "doc_id", *FIGURES, "groups")
    monkeypatch.setattr(align, "SHARD_PAIRS", 20)
    got = align.aligned(make_docs(ROWS)).fillna(-1)
    assert rows_of(got, "doc_id", *FIGURES, "groups") == want


def test_gathered_counts_are_handed_on(make_docs, monkeypatch):
    monkeypatch.setattr(align, "GATHERED_PAIRS", 5)
    monkeypatch.setattr(align, "SLICE_TOKENS", 20)
    ids = align.encoded(make_docs(ROWS, parts=1)).toArrow().to_batches()
    kept = [pa.RecordBatch.from_arrays(b.columns[1:], ["a", "b"]) for b in ids]
    got = Counter()
    for batch in align._partial(align.BYTE_TOKENIZER, align.PIECE_TOKENIZER)(iter(kept)):
        for row in batch.to_pylist():
            got[row["a"], row["b"]] += row["n"]
    assert sum(got.values()) == sum(r[4] for r in brute(ROWS))


def test_a_worker_that_reads_ids_keeps_no_tokenizer():
    align.tokenised(["a b"], [b"a b"], *PAIR)
    align._vocabulary(*PAIR)
    assert not align._coders and not align._entries and not vocab._loaded


@pytest.mark.parametrize("kind", [align.id_type(1 << 16), align.id_type((1 << 16) + 1)])
def test_ids_come_back_from_their_bytes(kind):
    lists = [[1, 2, 65535], [], [7], [], [4, 4]]
    batch = pa.RecordBatch.from_arrays([align._packed(Rows.of(lists), kind)], ["a"])
    assert batch.column("a").nbytes <= 4 * 6 + kind.bit_width // 8 * 6
    for at in range(len(lists)):
        for size in range(1, len(lists) - at + 1):
            assert align._of(batch.slice(at, size), "a", kind).to_pylist() == lists[at : at + size]


def test_an_empty_table_has_no_rows(make_docs):
    assert align.aligned(make_docs(ROWS).limit(0)).collect() == []


def test_texts_without_tokens_only(make_docs):
    got = align.aligned(make_docs([(1, None), (2, "")]))
    assert rows_of(got, "doc_id", *FIGURES, "groups") == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_a_long_text(make_docs, prose):
    rows = [(1, prose(20_000, 3)), (2, "y" * 50_000), (3, "short")]
    assert rows_of(align.aligned(make_docs(rows)), "doc_id", *FIGURES[:4]) == [
        r[:5] for r in brute(rows)
    ]


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet=st.sampled_from("aB sS'’.\n\t   \x85\x1f　́Σ東9½🙂</w>▁"), max_size=40)
    | st.text(max_size=40)
)
def test_stretches_encode_like_the_whole_text(text):
    text = text.encode("utf-8", "replace").decode()
    got = align.tokenised([text, "", text], [text.encode(), b"", text.encode()], *PAIR)
    for rows, ids in zip(got, encode(text), strict=True):
        assert rows.ids.tolist() == ids * 2 and np.diff(rows.bounds).tolist() == [len(ids), 0, len(ids)]


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [
        (*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in sorted(brute(rows))
    ]
    got = catalog.QUERIES["op11_tokenizer_alignment"](spark, folder)
    assert rows_of(got, "doc_id", *FIGURES, "groups_sha256") == want
