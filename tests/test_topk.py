"""The in-task selection against a plain full sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.operators.topk import BestK, Cells, Vectors, to_matrix, without_spare_copies


def brute(queries, rows, ids, k, metric, normalize):
    def unit(m):
        m = m.astype(np.float64)
        if not normalize:
            return m
        n = np.sqrt((m**2).sum(1, keepdims=True))
        return m / np.where(n == 0, 1, n)

    q, g = unit(queries), unit(rows)
    out = []
    for i in range(len(q)):
        keys = ((g - q[i]) ** 2).sum(1) if metric == "l2" else -(g @ q[i])
        order = sorted(range(len(g)), key=lambda j: (round(keys[j], 9), ids[j]))[:k]
        out.append([(ids[j], round(float(keys[j]), 9)) for j in order])
    return out


def select(queries, rows, ids, k, metric, normalize, cuts):
    state = BestK(Vectors(queries, metric, normalize), k, metric, pa.string())
    for part in np.split(np.arange(len(rows)), cuts):
        if len(part):
            block = Vectors(rows[part], metric, normalize)
            state.offer(block, pa.array([ids[i] for i in part]))
    table = state.result({"qid": pa.array(range(len(queries)))})
    found = [[] for _ in queries]
    for row in table.to_pylist():
        key = row["score"] if metric == "l2" else -row["score"]
        found[row["qid"]].append((row["id"], round(key, 9)))
    return found


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@settings(max_examples=40, deadline=None)
@given(
    seed=st.integers(0, 10_000),
    n=st.integers(1, 120),
    q=st.integers(1, 6),
    dim=st.integers(1, 9),
    k=st.integers(1, 15),
    grain=st.sampled_from([0, 1, 4]),
)
def test_same_as_full_sort(metric, seed, n, q, dim, k, grain):
    """Coarse values force ties and copies, which go to the smaller id."""
    rng = np.random.default_rng(seed)

    def draw(count):
        m = rng.normal(size=(count, dim))
        return (np.round(m * grain) if grain else m).astype(np.float32)

    rows, queries = draw(n), draw(q)
    ids = [f"{i:03d}" for i in rng.permutation(n)]
    cuts = sorted(rng.integers(0, n + 1, size=3))
    normalize = metric == "cosine"
    expected = brute(queries, rows, ids, k, metric, normalize)
    found = select(queries, rows, ids, k, metric, normalize, cuts)
    if grain:
        # Integer coordinates: l2 and ip keys are exact, so ids must agree too.
        if metric != "cosine":
            assert found == expected
    for got, want in zip(found, expected, strict=True):
        np.testing.assert_allclose([x[1] for x in got], [x[1] for x in want], atol=2e-8)


@pytest.mark.parametrize("scale", [1e-25, 1.0, 1e12, 1e25])
def test_extreme_lengths(scale):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(300, 8)) * scale).astype(np.float32)
    ids = [f"{i:03d}" for i in range(300)]
    for metric in ("l2", "ip", "cosine"):
        with np.errstate(over="ignore"):
            found = select(rows[:5], rows, ids, 4, metric, metric == "cosine", [100, 200])
        q = rows[:5].astype(np.float64)
        g = rows.astype(np.float64)
        if metric == "cosine":
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            g /= np.linalg.norm(g, axis=1, keepdims=True)
        for i in range(5):
            keys = ((g - q[i]) ** 2).sum(1) if metric == "l2" else -(g @ q[i])
            best = [ids[j] for j in np.argsort(keys, kind="stable")[:4]]
            assert [name for name, _ in found[i]] == best


def test_result_does_not_depend_on_batches():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(500, 16)).astype(np.float32)
    rows[100:400] = rows[7]  # most of the rows are copies of one vector
    ids = [f"{i:04d}" for i in rng.permutation(500)]
    runs = [
        select(rows[:40], rows, ids, 7, "cosine", True, cuts)
        for cuts in ([], [1, 2, 3], list(range(50, 500, 50)))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_ragged_and_null_vectors_are_errors():
    with pytest.raises(ValueError, match="one dimension"):
        to_matrix(pa.array([[1.0, 2.0], [1.0]], pa.list_(pa.float32())))
    with pytest.raises(ValueError, match="null vectors"):
        to_matrix(pa.array([[1.0], None], pa.list_(pa.float32())))
    with pytest.raises(ValueError, match="null elements"):
        to_matrix(pa.array([[1.0, None]], pa.list_(pa.float32())))


def test_cells_share_members():
    left = Cells.of_lists(pa.array([[3, 1], [1]], pa.list_(pa.int64())))
    right = Cells.of_lists(pa.array([[1], [2], [3]], pa.list_(pa.int64())))
    mine, theirs = left.shared(right)
    together = list(zip(*left.pairs(mine, right, theirs)))
    assert sorted(together) == [(0, 0), (0, 2), (1, 0)]
    each = {(a, b) for i, j in zip(mine, theirs) for a in left.members(i) for b in right.members(j)}
    assert each == set(together)
    assert list(left.of_key(1)) == [0, 1] and list(left.of_key(99)) == []


def test_spare_copies_are_those_beyond_the_smallest_ids():
    rows = np.zeros((10, 2), np.float32)
    rows[7] = [3, 4]
    rows[8] = [4, 3]  # same length as row 7, another vector
    ids = pa.array(list("jihgfedcba"))
    norms = (rows.astype(float) ** 2).sum(1)
    kept = without_spare_copies(norms, [rows], ids, 3)
    # Copies are rows 0-6 and 9; their three smallest ids are a, d, e.
    assert [ids[i].as_py() for i in kept] == list("edcba")
    assert without_spare_copies(norms, [rows], ids, 8) is None
    cells = np.arange(10)[:, None]  # nobody shares a cell
    assert without_spare_copies(norms, [rows, cells], ids, 3) is None
