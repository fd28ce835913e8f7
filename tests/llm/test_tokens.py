from __future__ import annotations

import numpy as np
from conftest import rows_of

from nearfield.llm import tokens
from nearfield.llm.common import scratch
from nearfield.llm.files import output

ROWS = [
    (1, "Hello world, it's  1234 café"),
    (2, None),
    (3, ""),
    (4, "<|endoftext|> is text"),
    (5, "x" * 3000 + " \n\n\t end"),
    (5, "five again"),
    (None, "no id"),
    (7, "naïve 東京 🙂" * 50),
]


def test_against_direct_encoding(make_docs):
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    got = rows_of(tokens.document_tokens(make_docs(ROWS, parts=3)).fillna(-1, ["doc_id"]), "doc_id", "n_tokens")
    assert got == sorted((-1 if i is None else i, len(encode(t or ""))) for i, t in ROWS)
    assert tokens.document_tokens(make_docs(ROWS).limit(0)).collect() == []


def by_loop(file):
    documents, current, start = [], 0, 0
    for place, token in enumerate(file):
        if token == 9:
            documents.append((start, current))
            current, start = 0, place + 1
        else:
            current += 1
    return documents + ([(start, current)] if current else [])


def test_blocks_of_any_size_are_stitched(spark):
    draw = np.random.default_rng(4)
    files = [
        draw.integers(0, 10, 997),
        np.full(50, 9),
        np.full(70, 1),
        np.array([9]),
        np.array([], np.int64),
        np.concatenate([draw.integers(0, 9, 300), [9], draw.integers(0, 9, 200)]),
    ]
    folder = scratch(spark, "flat")
    for i, file in enumerate(files):
        with output(f"{folder}/f{i}.bin") as stream:
            stream.write(file.astype("<u2").tobytes())
    expected = sorted(
        (f"f{i}.bin", n, start, size)
        for i, file in enumerate(files)
        for n, (start, size) in enumerate(by_loop(file.tolist()))
    )
    for block, span in ((1, 2), (7, 3), (50, 4096), (1 << 20, 4096)):
        got = tokens.count_tokens(spark, folder, end=9, block=block, span=span)
        assert rows_of(got, "file", "nth", "start", "n_tokens") == expected
