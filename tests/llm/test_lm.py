from __future__ import annotations

import zlib

import brute
import numpy as np
import pytest

from nearfield.llm import lm

EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "One one ONE"), (9005, "é \x1c x"), (None, "odd id")]


def held_out(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 10 == 0


def test_against_plain_counts(make_docs, prose):
    rows = [(i, prose(30 + i % 50, i % 40)) for i in range(150)] + EDGES + [(3, "again three")]
    got = lm.held_out_scores(make_docs(rows, parts=3)).collect()
    expected = brute.kneser_ney([t for d, t in rows if not held_out(d)], [t for _, t in rows])
    found = sorted(
        (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        for r in got
    )
    wanted = sorted((held_out(d), *e) for (d, _), e in zip(rows, expected, strict=True))
    for one, two in zip(found, wanted, strict=True):
        assert one == pytest.approx(two, rel=1e-9)


def test_many_shards_give_the_same_scores(make_docs, prose):
    docs = make_docs([(i, prose(40, i % 9) + " the the a the") for i in range(60)], parts=4)
    rows = docs.selectExpr("doc_id", "true AS held_out", "text")
    one = lm.scored(rows, lm.train(docs.select("text"))).orderBy("doc_id").collect()
    few = lm.train(docs.select("text").repartition(7), shard_words=40, shard_tokens=100)
    assert len(few.pairs) > 5 and len(few.words.hashes) > 2
    two = lm.scored(rows, few).orderBy("doc_id").collect()
    assert [tuple(r)[:5] for r in one] == [tuple(r)[:5] for r in two]
    for column in ("base_score", "score"):
        assert [r[column] for r in one] == pytest.approx([r[column] for r in two], rel=1e-9)


def test_probabilities_sum_to_one(make_docs):
    """Over all words, the end and one unknown word, behind a seen word."""
    docs = make_docs([(i, t) for i, t in enumerate(["a b c", "a b d", "b a a", "c a b b"])])
    model = lm.train(docs.select("text"))
    totals = []
    for word in (b"a", b"b", b"d"):
        hashes, ids, sizes = lm.tokenise([word + b" a b c d unseen"])
        numbers, counts = model.words.look_up(hashes)
        v = numbers[ids[0]]
        ahead = model.figures(model.precede, numbers, 1)[:, 0]
        lower = np.maximum(ahead - model.word_discounts[np.minimum(ahead, 3).astype(int)], 0)
        lower = lower / model.different + model.word_rest / (model.words.size + 1)
        rest = float((model.figures(model.follow, np.array([v]), 3) @ model.pair_discounts[1:])[0])
        seen = model.pair_count(np.full(len(numbers), v), numbers, np.full(len(numbers), counts[ids[0]]))
        total = counts[ids[0]]
        p = np.maximum(seen - model.pair_discounts[np.minimum(seen, 3)], 0) / total + rest / total * lower
        # All known words and the end, and the unknown word once, make up the distribution.
        assert len(p) == model.words.size + 1
        totals.append(p.sum())
    assert totals == pytest.approx([1, 1, 1])


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(10, "a b"), (None, "c")]).where("doc_id IS NULL")
    got = lm.held_out_scores(docs).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(2, 0, 0)]
    assert got[0]["base_score"] == pytest.approx(0) and got[0]["score"] == pytest.approx(0)
    assert lm.held_out_scores(docs.limit(0)).collect() == []


def test_discounts():
    assert lm.discounts(0, 1, 1, 1).tolist() == [0, 0.5, 0.75, 0.75]
    d = lm.discounts(100, 40, 20, 12)
    y = 100 / 180
    assert d.tolist() == pytest.approx([0, 1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.6])
