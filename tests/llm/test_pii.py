from __future__ import annotations

import hashlib
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from nearfield.llm import pii

TEXTS = [
    None,
    "",
    "mail a.b@c.de, x@y and é ü me_1%+-@a-b.co.uk. a@b.c_d@e.f @@x@y.z",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.2.3.255 1..2.3.4 00000000000000000000255.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112; 12 3456 7890 1 5555555555554444 4111111111111111 0",
    "+1 (555) 123-4567 +49.30.1234567 +1 2 +123456789 +1234567890123456 + 12 ++44 20 7946 0958)",
    "call +1 555 010 9999 at 10.0.0.1 or a@b.cc",
]


def found(make_docs, texts):
    docs = make_docs(list(enumerate(texts)))
    rows = pii.personal_data(docs).select(
        "doc_id",
        *[F.size(k.name).alias(k.name) for k in pii.BASE],
        pii.listed(F.col("base")).alias("base"),
        pii.listed(F.col("spans")).alias("spans"),
    )
    return [tuple(r) for r in rows.orderBy("doc_id").collect()]


def test_base_spans(make_docs):
    got = found(make_docs, TEXTS)
    assert [r[1:6] for r in got] == [brute.base_spans(t) for t in TEXTS]
    assert all(set(r[5].split(",")) <= set(r[6].split(",")) for r in got if r[5])


def test_random_texts(make_docs):
    draw = random.Random(3)
    parts = ["a@b.c", "@", ".", "1", "12", "+", " ", "-", "(", "4111111111111111", "é", "x_", "255", ",", "\n"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(400)]
    assert [r[1:6] for r in found(make_docs, texts)] == [brute.base_spans(t) for t in texts]


@pytest.mark.parametrize(
    "text",
    ["1 " * 20_000, "a" * 12_000, "a@" * 12_000, "+1" + " " * 50_000, "1." * 6_000, "(1-" * 12_000],
    ids=["digits", "word", "at", "plus", "dots", "marks"],
)
def test_long_texts(make_docs, text):
    assert found(make_docs, [text])[0][1:6] == brute.base_spans(text)


def test_very_long_texts_take_linear_time(make_docs):
    """Sizes at which the plain patterns would take minutes."""
    texts = ["a" * 300_000, "1." * 150_000, "1" * 300_000]
    assert [r[1:5] for r in found(make_docs, texts)] == [(0, 0, 0, 0), (0, 37_500, 0, 0), (0, 0, 0, 0)]


def test_secrets(make_docs):
    value = "7c72db563d7f6e50cec00950f7bab1f2223b6afd"
    texts = [
        f'token = "{value}"',
        f"API_KEY={value}.",
        f"password: '{value}'",
        f"commit {value}",
        f'token = "{"ab" * 20}"',
        'token = "internationalisation"',
        f'token = "{"1a" * 20}"',
        f'token = "{value[:15]}"',
        f'token = "{value * 13}"',
    ]
    starts = [r[6] for r in found(make_docs, texts)]
    assert starts[:3] == ["secret:9:49", "secret:8:48", "secret:11:51"]
    assert starts[3:] == [""] * 6


def test_all_planted_secrets_are_found(spark):
    """Recall over the assignments in the documents of the test tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.personal_data(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    planted = got = 0
    for r in rows:
        for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"] or ""):
            planted += 1
            got += any(s["kind"] == "secret" and (s["start"], s["end"]) == m.span(1) for s in r["spans"])
    assert planted > 10 and got == planted


def test_checks_and_context(make_docs):
    texts = [
        "account GB82 WEST 1234 5698 7654 32.",
        "account GB82 WEST 1234 5698 7654 33.",
        "my ssn is 123-45-6789",
        "part 123-45-6789",
        "phone (555) 123-4567",
        "number 555-123-4567",
    ]
    kinds = [r[6].split(":")[0] for r in found(make_docs, texts)]
    assert kinds == ["iban", "", "ssn", "", "local_phone", ""]


def test_digest_and_empty_table(make_docs):
    docs = make_docs([(1, "no data")])
    row = pii.personal_data(docs).select(F.sha2(pii.listed(F.col("base")), 256)).first()
    assert row[0] == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(docs.limit(0)).collect() == []
