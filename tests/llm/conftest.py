from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    # Names that the operators use inside.
    " mark string, verdict string, kept boolean, copy int, copies int, size int, shard int,"
    " slot int, rec string, node string, key string, tokens string, gone_id int"
)


@pytest.fixture
def make_docs(spark):
    """``make_docs([(doc_id, text), ...])``: a documents table with clashing extra columns."""

    def make(rows, sources=None, parts=2):
        sources = sources or ["src0"]
        full = [
            (i, t, "en", sources[n % len(sources)], None, "m", None, None, n, 1, 2, 3, 4, "r", None, "k", "t", 7)
            for n, (i, t) in enumerate(rows)
        ]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture
def prose():
    """Seeded prose: ``prose(n, seed)`` has n words."""

    def make(n, seed):
        draw = random.Random(seed)
        sounds = ["an", "er", "th", "ion", "es", "lo", "mi", "qua", "vé", "zu", "po", "ra"]
        return " ".join("".join(draw.choices(sounds, k=draw.randint(1, 4))) for _ in range(n))

    return make


def rows_of(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())
