"""Pages that the standard parser or a label of their own must not stop."""

from __future__ import annotations

import numpy as np
import pytest

from nearfield.llm import html

ALL = html.Model(np.full(html.SPACE, 1.0), np.zeros((2, 2, 2)))  # keeps every text


@pytest.mark.parametrize(
    "source,text",
    [
        ('<table><tr><td data-label="Price">9</td><td data-label>8</table>', "9\n\n8"),
        ('<p data-label="1">a<p data-label="0">b', "a\n\nb"),
        (f'<p {html.LABEL}="x">a<p {html.LABEL}>b', "a\n\nb"),
        ("<p>a<![x y]>b</p>", "ab"),
        ("<p>a<![ foo>b</p>", "ab"),
        ("<p>a<![]>b<!x>c<!>d<![if x]>e<![endif]></p>", "abcde"),
        ("<p>a</p><![ foo", None),
        ("<p>a<![", None),
        ("<p>a&#" + "9" * 5000 + ";b</p>", "a�b"),
        ("<p>a&#" + "0" * 5000 + "65;b</p>", "aAb"),
        ('<p id="&#' + "9" * 5000 + ';">b</p>', "b"),
    ],
)
def test_no_page_ends_the_query(source, text):
    got = html.main_text(source, ALL)
    assert got == text if text is not None else got.startswith("a")
    html.fit([source, "<article><p>some text of it</p></article>"], layouts=1)


def test_a_natural_label_is_no_training_label():
    body = "<article><p{}>some words of the article, in a row</p></article><nav>menu</nav>"
    plain, named = (html.fit([body.format(own)]) for own in ("", ' data-label="0"'))
    assert np.array_equal(plain.weights, named.weights) and np.array_equal(plain.tree, named.tree)
    own = body.format(f' {html.LABEL}="0"')
    assert np.array_equal(html.fit([own]).weights, plain.weights)
