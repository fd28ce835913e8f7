from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import rows_of

from nearfield.llm import catalog, trie

COLUMNS = (
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
)


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    children = {p: set() for p in members}
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves = dict.fromkeys(members, 0)
    saved = dict.fromkeys(members, 0)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words[p] + sum(saved[q] for q in children[p])
    return sorted(
        (
            min(own),
            len(p),
            min(members[p[:-1]]) if p else -1,
            len(own),
            len(children[p]),
            leaves[p],
            saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p)).encode()).hexdigest(),
        )
        for p, own in members.items()
    )


SCHEMA = (
    "conv_id bigint, turn bigint, role string, text string, depth int, seq string, above string,"
    " digests int, words string, n int, cut int, own string, key string, conv int"
)


@pytest.fixture
def make(spark):
    def build(rows, parts=3):
        full = [(*r, 1, "s", "a", 2, "w", 3, 4, "o", "k", 5) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


def found(frame):
    return rows_of(frame.fillna(-1, ["parent_conv_id"]), *COLUMNS)


ROWS = [
    (0, 0, "user", "hello there you"),
    (0, 1, "bot", "hi"),
    (0, 2, "user", "what now"),
    (0, 3, "bot", ""),
    (3, 0, "user", "something else"),
    (3, 1, "bot", "yes"),
    (3, 2, "user", "x y z"),
    (3, 3, "bot", "end"),
    (7, None, None, None),
    (7, 5, "user", "after null"),
    (7, 5, "bot", "tie by role"),
    (9, 0, "user", "hello there you"),
    (9, 0, "user", "hello there you"),
    (None, 0, "user", "nobody"),
    (45, 0, "user", "no base"),
    (46, 0, "user", "no base"),
    (-5, 0, "user", "negative id"),
    (-5, 1, "bot", "more"),
]


def test_against_plain_loops(make):
    assert found(trie.prefix_trie(make(ROWS))) == brute(ROWS)


def test_an_empty_table_has_no_nodes(make):
    assert trie.prefix_trie(make(ROWS).limit(0)).collect() == []
    assert trie.prefix_trie(make([(None, 1, "a", "b")])).collect() == []


def crowded(seed, n=150):
    """Conversations that share long prefixes, with equal ones, a hot first turn and a long one."""
    draw = random.Random(seed)
    rows = []
    stem = [f"stem {i}" for i in range(12)]
    for c in range(n):
        if c % 3 == 0:
            turns = stem[: draw.randint(1, 12)] + [f"t {draw.randint(0, 3)}" for _ in range(draw.randint(0, 4))]
        elif c % 7 == 0:
            turns = ["all the same"] * 3
        else:
            turns = [f"w {draw.randint(0, 5)}" for _ in range(draw.randint(1, 6))]
        rows += [(c, i, "user", t) for i, t in enumerate(turns)]
    return rows + [(20 * n, i, "user", f"turn {i % 5}") for i in range(600)]


@pytest.mark.parametrize(("shared", "shard_turns"), [(1, 10), (3, 50), (10_000, 10_000)])
def test_crowded_prefixes_are_split_and_merged(make, shared, shard_turns):
    rows = crowded(shared)
    got = trie.prefix_trie(make(rows), shared=shared, shard_turns=shard_turns)
    assert found(got) == brute(rows)


def test_ranges_of_ids_hash_like_one_list(make, monkeypatch):
    monkeypatch.setattr(trie, "LEAST_WIDTH", 4)
    monkeypatch.setattr(trie, "MOST_WIDTH", 8)
    rows = [(c, 0, "user", "same" if c % 3 else "other") for c in range(-40, 200)]
    assert found(trie.prefix_trie(make(rows))) == brute(rows)


def test_very_long_texts(make, prose):
    rows = [(0, 0, "user", prose(50_000, 1)), (1, 0, "user", "z" * 300_000), (20, 0, "u", None)]
    assert found(trie.prefix_trie(make(rows))) == brute(rows)


def test_double_array_holds_what_was_put_in():
    draw = np.random.default_rng(3)
    sizes = draw.integers(0, 9, 400)
    labels = draw.integers(0, 12, sizes.sum()) ** 2
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    array = trie.DoubleArray(labels, bounds)
    seen = {}
    for level, (active, slots) in enumerate(array.walk()):
        for row, slot in zip(active.tolist(), slots.tolist(), strict=True):
            prefix = tuple(labels[bounds[row] : bounds[row] + level + 1].tolist())
            assert seen.setdefault(prefix, slot) == slot
    assert len(set(seen.values())) == len(seen)
    assert (array.check >= 0).sum() == len(seen) + 1


def test_query_against_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = found(catalog.QUERIES["op13_conversation_trie"](spark, folder))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS FROM '{folder}/conversations.parquet'")
        names = ", ".join(c if c != "parent_conv_id" else "coalesce(parent_conv_id, -1)" for c in COLUMNS)
        want = sorted(db.execute(f"SELECT {names} FROM ({catalog.SQL['op13_conversation_trie']})").fetchall())
    assert got == want
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert got == brute(rows)
