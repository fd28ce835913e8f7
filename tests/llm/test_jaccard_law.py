"""The join under laws other than op6's, and the pipeline's stage, against brute force."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import pytest

from nearfield.llm import jaccard


def groups(rows, words, percent):
    sets = {}
    for doc, text in rows:
        found = brute.words((text or "").translate(brute.LOWER))
        width = min(words, len(found))
        sets[doc] = {tuple(found[i : i + width]) for i in range(len(found) - width + 1) if width}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            one, two = sets[a], sets[b]
            if one and two and 100 * len(one & two) >= percent * len(one | two):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [(doc, len(sets[doc]), root(doc)) for doc in ids]


def near_copies(prose, seed):
    """Texts of many sizes, each with copies around 0.8: scattered edits and one changed run."""
    draw = random.Random(seed)
    rows = []
    for k in range(24):
        words = prose(draw.choice([5, 8, 9, 12, 25, 60, 150, 300]), 100 * seed + k).split(" ")
        for share in (0, 0.01, 0.03, 0.1, 0.2):
            out = list(words)
            edits = round(share * len(out))
            if share < 0.1:
                for _ in range(max(1, edits) if share else 0):
                    out[draw.randrange(len(out))] = f"w{draw.randrange(10**6)}"
            else:
                at = draw.randrange(len(out) - edits + 1)
                out[at : at + edits] = [f"w{draw.randrange(10**6)}" for _ in range(edits // 2)]
            rows.append((len(rows), " ".join(out)))
    return rows


@pytest.mark.parametrize("words,percent", [(5, 80), (1, 60), (2, 75), (4, 99)])
def test_any_law_is_exact(make_docs, prose, words, percent):
    rows = near_copies(prose, words)
    found = jaccard.linked_groups(make_docs(rows), law=jaccard.Law(words, percent))
    got = sorted(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect())
    assert got == groups(rows, words, percent)


def test_the_stage_takes_five_words_and_four_fifths(spark, make_docs, prose):
    rows = near_copies(prose, 9)
    expected = [doc for doc, _, least in groups(rows, 5, 80) if doc == least]
    assert len(expected) < len([1 for doc, _, least in groups(rows, 3, 90) if doc == least])
    kept = corpus_pipeline.jaccard_join(spark, make_docs(rows), "/nowhere")
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


def test_laws():
    for percent in (60, 67, 80, 99):
        law = jaccard.Law(5, percent)
        for n in range(law.least, 300):
            assert 2 <= law.least_shared(n) <= n and 100 * law.least_shared(n) >= percent * n
            assert law.prefix_size(n) + 1 <= n
        # One size less, and sets that differ cannot reach it.
        assert 100 * (law.least - 1) < percent * law.least
        assert 100 * law.least >= percent * (law.least + 1)
    for bad in ((0, 80), (5, 100), (5, 50)):
        with pytest.raises(ValueError):
            jaccard.Law(*bad)
