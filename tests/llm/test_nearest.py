"""Approximate nearest neighbours against brute force, and on odd rows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import nearest

SCHEMA = "vec_id long, embedding array<double>, label int, SCORE string, list int"


def brute(rows):
    """query position in rows to the 20 best (score, vec_id), of usable rows as long as the query's vector."""
    good = [(i, e) for i, e in rows if i is not None and e is not None and None not in e and np.all(np.isfinite(e)) and np.any(np.array(e) != 0)]
    out = defaultdict(list)
    for n, (i, e) in enumerate(good):
        if i % 20 == 0:
            scores = [(-float(np.dot(e, f)), j) for m, (j, f) in enumerate(good) if m != n and len(f) == len(e)]
            out[i].append([(-s, j) for s, j in sorted(scores)[:20]])
    return out


def answers(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    return {q: sorted(v) for q, v in found.items()}


def run(spark, rows):
    return answers(nearest.search(spark.createDataFrame([(i, e, 0, "x", 1) for i, e in rows], SCHEMA)))


@pytest.mark.parametrize("kind", ["unit", "norms", "tiny"])
def test_recall_against_brute_force(spark, kind):
    random = np.random.default_rng(1)
    x = random.standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "norms":
        x *= np.exp(random.normal(0, 1, (1500, 1)))
    if kind == "tiny":
        x *= np.where(random.random((1500, 1)) < 0.3, 1e-160, 1e3)
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    want, got = brute(rows), run(spark, rows)
    assert set(got) == set(want)
    hits = 0
    for q, (best,) in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert [(-s, i) for _, s, i in got[q]] == sorted((-s, i) for _, s, i in got[q])
        assert all(s == pytest.approx(float(np.dot(x[q], x[i])), rel=1e-9, abs=1e-300) for _, s, i in got[q])
        # Where scores are equal or vanish, any row of that score counts.
        hits += sum(s >= best[-1][0] for _, s, _ in got[q])
    assert hits >= 0.9 * 20 * len(want)


def test_few_rows_are_searched_exactly_with_ties_repeats_and_unusable_ones(spark):
    e = [[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], [-1.0, 2.0]]
    rows = [(0, e[0]), (7, e[1]), (3, e[1]), (20, e[2]), (5, e[3]), (20, e[3])]
    odd = [(40, None), (None, e[0]), (60, []), (80, [0.0, 0.0]), (100, [None, 1.0]), (120, [float("nan"), 1.0]), (140, [float("inf"), 1.0]), (160, [1.0, 2.0, 3.0]), (9, [1.0, 1.0, 1.0])]
    got, want = run(spark, rows + odd), brute(rows + odd)
    assert [(s, i) for _, s, i in got[0]] == want[0][0] == [(1.0, 3), (1.0, 7), (0.5, 20), (-1.0, 5), (-1.0, 20)]
    assert sorted((s, i) for _, s, i in got[20]) == sorted(x for part in want[20] for x in part)
    assert [(s, i) for _, s, i in got[160]] == [(6.0, 9)]
    assert set(got) == {0, 20, 160}
    assert run(spark, []) == {} and run(spark, [(1, [1.0]), (2, [2.0])]) == {} and run(spark, [(0, [1.0])]) == {}


def test_a_list_of_copies_is_dealt_to_blocks_and_keeps_the_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 200)
    random = np.random.default_rng(3)
    x = random.standard_normal((1400, 16))
    x[200:1000] = x[200]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    got = run(spark, rows)
    assert [i for _, _, i in got[200]] == list(range(201, 221))
    assert [i for _, _, i in got[400]] == list(range(200, 220))
    places = nearest.Index._blocks([(16, 0, 100), (16, 1, 90), (16, 2, 850), (16, 3, 20), (8, 0, 5)])
    assert places == {(16, 0): (0, 1), (16, 1): (0, 1), (16, 2): (1, 5), (16, 3): (6, 1), (8, 0): (7, 1)}


def test_candidates_are_abandoned_early_and_near_ones_are_kept():
    random = np.random.default_rng(5)
    x = random.standard_normal((2000, 64))
    x[:100] += 3 * random.standard_normal(64)
    turned = x @ nearest.rotation(64)
    unit = (turned / np.linalg.norm(turned, axis=1, keepdims=True)).astype(np.float32)
    size = np.linalg.norm(x, axis=1)
    true = x[:50] @ x.T
    least = np.sort(true, axis=1)[:, -30]
    i, j = nearest.surviving(unit[:50], size[:50], unit, size, least)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    near = set(zip(*(a.tolist() for a in np.nonzero(true >= least[:, None])), strict=True))
    assert len(kept & near) >= 0.99 * len(near) and len(kept) < 0.1 * 50 * 2000
    bounds = nearest.test_bounds(64)
    share = (turned[:, :16] ** 2).sum(axis=1) / size**2
    assert len(bounds) == 3 and bounds[0] < bounds[1] < bounds[2] < 1 and (share > bounds[0]).mean() < 0.02
    assert nearest.test_bounds(8) == () and [s.stop - s.start for s in nearest.column_blocks(20)] == [8, 8, 4]
