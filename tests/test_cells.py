import numpy as np
import pyarrow as pa
import pytest

from gradus.operators import blocks, cells, density, silhouette, similarity, ward


def brute(score, k, tie, first, floor):
    want = []
    for i, row in enumerate(score):
        there = [j for j in range(first[i]) if np.isfinite(row[j]) and row[j] >= floor[i]]
        want += [(i, j) for j in sorted(there, key=lambda j: (-row[j], tie[j]))[:k]]
    return want


@pytest.mark.parametrize("n,m,k", [(40, 37, 3), (300, 5000, 5), (20, 2100, 200), (7, 3, 5), (5, 0, 2)])
def test_best_columns(n, m, k):
    rng = np.random.default_rng(3)
    q, c = rng.integers(-3, 4, (n, 4)).astype(float), rng.integers(-3, 4, (m, 4)).astype(float)  # many equal products
    score = q @ c.T
    score[rng.random((n, m)) < 0.1] = -np.inf
    tie, first = rng.permutation(m), rng.integers(0, m + 1, n)
    floor = np.where(rng.random(n) < 0.5, -np.inf, 4.0)

    def hopes(rows, left, right, out):
        out[...] = score[rows, left:right] + 0.25

    r, at, s = cells.best_columns(n, m, k, hopes, lambda rows, columns: score[rows, columns], tie, first, floor)
    got = sorted(((int(i), int(j)) for i, j, v in zip(r, at, s) if v >= floor[i]), key=lambda p: (p[0], -score[p], tie[p[1]]))
    assert got == brute(score, k, tie, first, floor)


def test_few_pairs_are_worked_out_in_full(monkeypatch):
    rng = np.random.default_rng(4)
    x = blocks.unit_rows(rng.normal(size=(6000, 16)))
    worked, found = [], cells.best_columns

    def counted(n, m, k, hopes, scores, *args):
        return found(n, m, k, hopes, lambda r, c: worked.append(len(r)) or scores(r, c), *args)

    monkeypatch.setattr(cells, "best_columns", counted)
    rows, columns = similarity._best(x, x, 3, 1.0, 9, np.arange(len(x)))
    want = np.argsort(-np.round(x[:100] @ x.T, 9), axis=1, kind="stable")[:, :3]
    assert columns[rows < 100].tolist() == want.ravel().tolist()
    assert sum(worked) < 0.01 * len(x) ** 2


def test_blocks_do_not_grow_with_the_table():
    assert blocks.rows_per_block(8, None, 10_000_000, 12) == blocks.rows_per_block(8, None, 100_000_000, 12) <= 1 << 16


def _counted(monkeypatch):
    worked, found = [], cells.best_columns

    def counted(n, m, k, hopes, scores, *args):
        return found(n, m, k, hopes, lambda r, c: worked.append(len(r)) or scores(r, c), *args)

    monkeypatch.setattr(cells, "best_columns", counted)
    return worked


@pytest.mark.parametrize("offset", [0.0, 50.0])
def test_cheapest_partners(monkeypatch, offset):
    rng = np.random.default_rng(5)
    n, worked = 3000, _counted(monkeypatch)
    x, size, node = rng.normal(size=(n, 8)) + offset, rng.integers(1, 5, n), rng.permutation(n)
    table = pa.table({"node": node, "vec": x.tolist(), "size": size})
    got = ward._nearest(table, table)
    cost = (size[:, None] * size / (size[:, None] + size)) * ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(cost, np.inf)
    assert dict(zip(got["node"].to_pylist(), got["other"].to_pylist())) == dict(zip(node.tolist(), node[cost.argmin(1)].tolist()))
    assert sum(worked) < 0.02 * n * n


def test_shortest_exits(monkeypatch):
    rng = np.random.default_rng(6)
    n, worked = 2500, _counted(monkeypatch)
    monkeypatch.setattr(density, "ROWS_AT_ONCE", 300)
    x, core, comp, key = rng.normal(size=(n, 3)), rng.random(n) / 3, rng.integers(0, 9, n), rng.permutation(n)
    x[:400] = x[0]
    table = pa.table({"key": key, "vec": x.tolist(), "core": core, "comp": comp})
    w = np.maximum(blocks.exact_distances(np.repeat(x, n, 0), np.tile(x, (n, 1))).reshape(n, n), np.maximum(core[:, None], core))
    w[comp[:, None] == comp] = np.inf
    want = set()
    for c in range(9):
        i, j = np.nonzero((w == w[comp == c].min()) & (comp[:, None] == c))
        lo, hi = min((min(key[a], key[b]), max(key[a], key[b])) for a, b in zip(i, j))
        want.add((c, w[comp == c].min(), lo, hi))
    got = density._shortest_exits(table, table).to_pylist()
    assert {(r["comp"], r["w"], r["lo"], r["hi"]) for r in got} == want
    assert sum(worked) < 0.1 * n * n


def test_distances_serve_both_sides():
    rng = np.random.default_rng(7)
    sides = [pa.table({"key": range(a, b), "vec": rng.normal(size=(b - a, 4)).tolist(), "labels": [[i % 3, i % 2] for i in range(a, b)]}) for a, b in ((0, 300), (250, 900))]
    groups = [np.arange(3), np.arange(2)]
    both = silhouette._group_sums(*sides, groups, True)
    for got, (a, b) in zip(both, (sides, sides[::-1])):
        x, y, label = blocks.matrix(a["vec"]), blocks.matrix(b["vec"]), np.array(b["labels"].to_pylist())
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)) * (a["key"].to_numpy()[:, None] != b["key"].to_numpy())
        want = np.hstack([d @ (label[:, [j]] == g) for j, g in enumerate(groups)])
        np.testing.assert_allclose(got, want, rtol=1e-7)


def test_ties_are_not_worked_out_pair_by_pair(monkeypatch):
    rng, worked = np.random.default_rng(8), _counted(monkeypatch)
    n, k = 3000, 3
    x = np.repeat(blocks.unit_rows(rng.normal(size=(5, 4))), n // 5, 0)
    x[::2] = 0.0  # without a direction: all columns tie
    tie, first, hidden = rng.permutation(n), rng.integers(0, n + 1, n), np.where(rng.random(n) < 0.5, rng.integers(0, n, n), -1)
    score = np.round(x @ x.T, 9)
    for upto, without in ((None, None), (first, hidden)):
        rows, columns = similarity._best(x, x, k, 1.0, 9, tie, upto, without)
        got = [columns[rows == i].tolist() for i in range(n)]
        for i in range(0, n, 7):
            there = [j for j in range(n if upto is None else upto[i]) if without is None or j != without[i]]
            assert got[i] == sorted(there, key=lambda j: (-score[i, j], tie[j]))[:k]
    assert sum(worked) < 0.05 * n * n


def test_tasks_of_a_stream_have_rows_enough():
    n = 250_000
    assert blocks.dealt_tasks(n * n, 12, n // blocks.LEAST_ROWS) == n // blocks.LEAST_ROWS < blocks.dealt_tasks(n * n, 12)
    assert blocks.dealt_tasks(1000 * n, 12, 1) == 12
