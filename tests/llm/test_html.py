from __future__ import annotations

import itertools
import math
import random
import time

import numpy as np
import pytest

from nearfield.llm import html


@pytest.fixture(scope="module")
def model(spark):
    return html.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def page(body):
    return f"<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body>{body}</body></html>"


TEXT = "This is a sentence of the article, long enough to be one. It goes on, and ends here."


def test_blocks_references_and_space(model):
    got = html.main_text(
        page(
            f"<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav>"
            f"<article><h1>A &amp; B</h1><p>{TEXT}<br>\n  next&#33;</p><p><b>{TEXT}<p>{TEXT}</article>"
            "<footer>&copy; someone</footer>"
        ),
        model,
    )
    assert got == f"A & B\n\n{TEXT} next!\n\n{TEXT}\n\n{TEXT}"


def test_other_layouts(model):
    pages = [f"Paragraph number {i} of it, with some words in it. {TEXT}" for i in range(40)]
    draw = random.Random(31)
    wrong = total = 0
    for _ in range(40):
        made = html.other_layout(pages[: draw.randint(3, 9)], [], pages, draw)
        parsed = html.parse(made)
        label = []
        for i, own in enumerate(parsed.labels):
            label.append(own if own is not None else (label[parsed.parents[i]] if i else 0))
        kept = model.marginals(parsed)
        for element, _, text in parsed.texts:
            total += len(text)
            wrong += len(text) * ((kept[element] >= 0.5) != label[element])
    assert wrong < 0.05 * total


def test_marginals_are_exact():
    """Against the sum over all labelings of a small tree."""
    draw = np.random.default_rng(3)
    parsed = html.parse("<div><p>a<b>b</b></p><ul><li>c</ul></div><p>d")
    n = len(parsed.tags)
    weights = draw.normal(0, 0.4, html.SPACE)
    tree = draw.normal(0, 1, (2, 2, 2))
    got = html.Model(weights, tree).marginals(parsed)
    odds = [weights[f].sum() for f in html.features(parsed)]
    total, mass = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        value = sum(odds[i] for i in range(n) if labels[i])
        for i in range(1, n):
            kind = int(parsed.tags[i] in html.INLINE)
            value += tree[kind, labels[parsed.parents[i]], labels[i]]
        total += math.exp(value)
        mass += math.exp(value) * np.array(labels)
    assert got == pytest.approx((mass / total).tolist())


@pytest.mark.parametrize("source", ["", "<", "<p", "&", "<div>" * 3000, "</p></p>", "<!-- x", "<script>", "\x00<p>\x00", "<table><tr><td><table>"])
def test_broken_pages(model, source):
    assert isinstance(html.main_text(source, model), str)


def test_table(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", page(f"<article><p>{TEXT}</p></article>"))] + [
        (4, "w", page("<article>" + f"<p>{TEXT}</p>" * 3000 + "</article>"))
    ] * 2
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id bigint, url string, html string, text int")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extracted(pages, model).collect())
    whole = "\n\n".join([TEXT] * 3000)
    assert got == [(0, TEXT, len(TEXT)), (1, "", 0), (2, "", 0), (4, whole, len(whole)), (4, whole, len(whole))]
    assert html.extracted(pages.limit(0), model).collect() == []
    empty = html.train(pages.limit(0))
    assert isinstance(html.main_text(page("<p>x"), empty), str)


BODY = f"<h1>A title</h1><p>{TEXT}</p><p>{TEXT}</p>"


@pytest.mark.parametrize(
    "source",
    [
        f"<html><head><title>T</title><article>{BODY}</article></html>",
        f"<head><link><style>x</style><main>{BODY}</main>",
        f"<head><title>T<article>{BODY}</article>",
        f"<html><head><title>T</title></head><body><svg><path><article>{BODY}</article>",
        f"<html><head><meta charset=x><noscript>no</noscript><body><article>{BODY}</article>",
        f"<article>{BODY}</article><body class=x>",
    ],
)
def test_end_tags_left_out(model, source):
    parsed = html.parse(source)
    assert [t for _, _, t in parsed.texts] == ["A title", TEXT, TEXT]
    assert parsed.tags.count("html") == parsed.tags.count("body") == 1
    assert html.main_text(source, model) == f"A title\n\n{TEXT}\n\n{TEXT}"


@pytest.mark.parametrize("one", ["<div></x>", "<p><table>", "<foo></bar>", "<li><b></i>"])
def test_many_open_elements(one):
    """A walk up the open elements per tag would take minutes here."""
    start = time.process_time()
    assert len(html.parse(one * 100_000).tags) > 100_000
    assert time.process_time() - start < 20


def test_training_sample_is_bounded(spark, model):
    pages = spark.createDataFrame(
        [(page(f"<article><p>{TEXT} {i % 30}</p></article>" + "<p>x" * 100 * (i % 5)),) for i in range(60)], "html string"
    )
    few = html.train(pages.repartition(3), rows=10, most=3000)
    again = html.train(pages.repartition(1), rows=10, most=3000)
    assert (few.weights == again.weights).all()
