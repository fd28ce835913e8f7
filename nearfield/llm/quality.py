"""Quality rules: counted rules first, then a classifier learned from labelled rows.

The classifier is a logistic regression on hashed character 4-grams, words and word pairs, trained
on a bounded sample of labelled documents, calibrated on labelled documents it has not seen, and
applied to whole texts in Arrow batches. Both thresholds are fixed parameters.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import own_name

# Labelled rows the classifier is fitted on: those with the smallest digests of their ids.
TRAIN_ROWS = 2000
# Hash space of the character and of the word features.
SPACE = 1 << 13
STEPS = 60
# Documents are kept from this calibrated probability of good quality on.
KEEP_FROM = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50

_SPACES = np.zeros(128, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes * _B
    return ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(SPACE - 1)).astype(np.int64)


@dataclass(frozen=True)
class Parsed:
    """A whole text cut once: its code points, and its words as numbers of distinct words."""

    points: np.ndarray
    distinct: list[bytes]
    ids: np.ndarray


def parse(text: bytes) -> Parsed:
    words = text.split()  # bytes split at space and the five control characters only
    distinct = list(dict.fromkeys(words))
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return Parsed(np.frombuffer(text.decode().encode("utf-32-le"), np.uint32), distinct, ids)


def profile(parsed: Parsed) -> np.ndarray:
    """Roots of the relative frequencies of all hashed features of a text."""
    points = parsed.points
    words = np.fromiter(map(zlib.crc32, parsed.distinct), np.uint32, len(parsed.distinct))
    words = words[parsed.ids]
    grams = points[:-3] if len(points) > 3 else points[:0]
    if len(grams):
        for shift in (1, 2, 3):
            grams = grams * _A + points[shift : len(points) - 3 + shift]
    out = np.zeros(3 * SPACE)
    for part, hashes in enumerate((grams, words, words[:-1] * _A + words[1:])):
        if len(hashes):
            counts = np.bincount(_bucket(hashes), minlength=SPACE)
            np.sqrt(counts / len(hashes), out=out[part * SPACE : (part + 1) * SPACE])
    return out


@dataclass(frozen=True)
class Model:
    """Weights, and the line that turns a margin into a calibrated log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, parsed: Parsed) -> float:
        margin = float(self.weights @ profile(parsed)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50))))


def _margins(weights, bias, starts, numbers, values):
    parts = np.concatenate([weights[numbers] * values, [0.0]])
    sums = np.add.reduceat(parts, starts[:-1])
    sums[starts[:-1] == starts[1:]] = 0.0
    return sums + bias


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model | None:
    """Fit on two thirds of the rows and calibrate on the rest; None without both classes."""
    turn = np.arange(len(rows)) % 3
    good = labels > 0
    if any(len(set(good[part])) < 2 for part in (turn != 0, turn == 0)):
        return None

    def packed(chosen):
        picked = [rows[i] for i in np.flatnonzero(chosen)]
        starts = np.cumsum([0] + [len(n) for n, _ in picked])
        return (
            starts,
            np.concatenate([n for n, _ in picked]),
            np.concatenate([v for _, v in picked]),
        )

    starts, numbers, values = packed(turn != 0)
    truth = good[turn != 0].astype(float)
    # Both classes weigh the same, whatever their share among the labels.
    share = np.where(truth > 0, 0.5 / truth.mean(), 0.5 / (1 - truth.mean()))
    owner = np.repeat(np.arange(len(truth)), np.diff(starts))
    weights, bias = np.zeros(3 * SPACE), 0.0
    speed, size = np.zeros(3 * SPACE + 1), np.zeros(3 * SPACE + 1)
    for step in range(1, STEPS + 1):  # Adam over all rows
        gap = (_logistic(_margins(weights, bias, starts, numbers, values)) - truth) * share
        gap /= len(truth)
        slope = np.append(
            np.bincount(numbers, gap[owner] * values, minlength=3 * SPACE) + 1e-5 * weights,
            gap.sum(),
        )
        speed = 0.9 * speed + 0.1 * slope
        size = 0.99 * size + 0.01 * slope**2
        move = speed / (1 - 0.9**step) / (np.sqrt(size / (1 - 0.99**step)) + 1e-9)
        weights -= 0.1 * move[:-1]
        bias -= 0.1 * move[-1]

    # Platt scaling on unseen rows; the targets are smoothed as usual.
    margin = _margins(weights, bias, *packed(turn == 0))
    seen = good[turn == 0]
    yes, no = seen.sum(), (~seen).sum()
    aim = np.where(seen, (yes + 1) / (yes + 2), 1 / (no + 2))
    line = np.array([1.0, 0.0])
    design = np.stack([margin, np.ones_like(margin)])
    for _ in range(60):
        p = _logistic(line @ design)
        slope = design @ (p - aim) + 1e-3 * (line - [1.0, 0.0])
        curve = (design * (p * (1 - p))) @ design.T + 1e-3 * np.eye(2)
        line = line - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return Model(weights, float(bias), float(line[0]), float(line[1]))


# Feature numbers as 16-bit and weights as 32-bit arrays: the sample stays small on its way.
FEATURES = "struct<numbers:binary,weights:binary>"


def _feature_rows(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.cast(pa.binary()).to_pylist():
        values = profile(parse(text or b""))
        found = np.flatnonzero(values)
        rows.append((found.astype("<u2").tobytes(), values[found].astype("<f4").tobytes()))
    return pa.StructArray.from_arrays(
        [
            pa.array([n for n, _ in rows], pa.binary()),
            pa.array([v for _, v in rows], pa.binary()),
        ],
        ["numbers", "weights"],
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = TRAIN_ROWS,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> Model | None:
    """Fit the classifier on at most ``rows`` labelled documents, chosen by digest of their ids.

    Labels or texts that are null are no examples. Without both classes there is no model.
    """
    marked = (
        labels.select(F.col(key).alias("id"), F.col(label).alias("label"))
        .where("id IS NOT NULL AND label IS NOT NULL")
        .withColumn("turn", F.xxhash64("id"))
    )
    # At most ``rows`` labels go to every executor; an id may still meet many documents.
    chosen = F.broadcast(marked.orderBy("turn", "id", "label").limit(rows))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    sample = texts.join(chosen, "id").orderBy("turn", "id", F.xxhash64("text"), "label").limit(rows)
    got = (
        sample.withColumn("f", F.arrow_udf(_feature_rows, FEATURES)("text"))
        .select("turn", "id", "label", "f.numbers", "f.weights")
        .collect()
    )
    got.sort(key=lambda r: (r["turn"], r["id"], r["label"], r["numbers"]))
    pairs = [(np.frombuffer(r["numbers"], "<u2"), np.frombuffer(r["weights"], "<f4")) for r in got]
    return fit(pairs, np.array([r["label"] for r in got])) if got else None


def counts(text: bytes, parsed: Parsed) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, and words in repeated 3-word windows."""
    ascii_points = parsed.points[parsed.points < 128]
    spaces = int(np.count_nonzero(_SPACES[ascii_points]))
    symbols = int(np.count_nonzero(_SYMBOLS[ascii_points]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    ids = parsed.ids
    number, kinds = len(ids), len(parsed.distinct)
    repeated = 0
    if number > 3 and kinds < number:
        pairs = ids[:-1] * kinds + ids[1:]
        # Number the pairs first where three word numbers together would overflow.
        pairs = pairs if kinds < 2_000_000 else np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * kinds + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(number, bool)
        for shift in range(3):
            covered[shift : number - 2 + shift] |= twice
        repeated = int(covered.sum())
    return number, len(parsed.points) - spaces, symbols, len(lines) - len(set(lines)), repeated


VERDICT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,base_failed:boolean,kept:boolean,probability:double>"
)


def verdict(model: Model | None, text: Column, keep_from: float = KEEP_FROM) -> Column:
    """A struct of counts and verdict for a text column; a null text is an empty one.

    Without a model (no labels of both classes) documents are kept unless a counted rule fails.
    """

    def judge(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts.cast(pa.binary()).to_pylist():
            value = value or b""
            parsed = parse(value)
            n, chars, symbols, lines, repeated = counts(value, parsed)
            failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
            p = model.probability(parsed) if model else 1.0
            rows.append((n, chars, symbols, lines, repeated, failed, not failed and p >= keep_from, p))
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
        names = [part.split(":")[0] for part in VERDICT[7:-1].split(",")]
        return pa.StructArray.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names
        )

    return F.arrow_udf(judge, VERDICT)(text)


def judged(
    docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed``, ``kept`` and ``probability``.

    Repeated rows are judged each; null ids stay null; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), verdict(model, F.col(text)).alias("v"))
    return rows.select("doc_id", "v.*")


def keep_good(
    docs: DataFrame, model: Model | None, text: str = "text", keep_from: float = KEEP_FROM
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they are."""
    name = own_name(docs.columns, "verdict")
    whole = docs.withColumn(name, verdict(model, F.col(text), keep_from))
    return whole.where(F.col(f"{name}.kept")).drop(name)
