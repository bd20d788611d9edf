"""Dense groups of vectors: links are counted by blocks, and as brute force counts them."""

import tracemalloc

import numpy as np
import pytest

from dataplumb.llm import hnsw


def graph(draw, n, dims, near=None, noise=0.1):
    vectors = draw.standard_normal((n, dims))
    if near is not None:
        vectors = near + noise * vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return hnsw.build(np.arange(n) * 10, draw.integers(1, 4, n), vectors)


def brute(left, right, same):
    unit = [g.vectors / g.norms[:, None] for g in (left, right)]
    links = unit[0] @ unit[1].T >= hnsw.LEAST
    if same:
        np.fill_diagonal(links, False)
        return links, links @ right.counts
    return links, np.concatenate([links @ right.counts, links.T @ left.counts])


def tallied(left, right, same):
    tally, n = hnsw.Tally(left, right, same), 0
    for a, b in hnsw.link_blocks(left, right, same):
        n += len(a)
        tally.add(a, b)
    return tally, n


def roots(parent):
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent


@pytest.mark.parametrize("same", [True, False])
def test_a_mix_of_dense_and_sparse_nodes(same):
    draw = np.random.default_rng(1)
    line = np.eye(24)[0]
    vectors = np.concatenate([line + 0.2 * draw.standard_normal((500, 24)) / 5, draw.standard_normal((1500, 24))])
    vectors = np.concatenate([vectors, vectors[600:640] + 1e-3])[draw.permutation(2040)]
    left = hnsw.build(np.arange(2040), draw.integers(1, 4, 2040), vectors)
    right = left if same else graph(draw, 1200, 24, line, 0.3)
    links, sums = brute(left, right, same)
    tally, n = tallied(left, right, same)
    want = int(links.sum()) // (2 if same else 1)
    assert want > 50_000 and abs(n - want) <= 0.001 * want
    assert np.abs(tally.sums - sums).sum() <= 0.002 * sums.sum()
    assert len(tally.tree) <= len(tally.sums) - 1
    parent = roots(tally.parent)
    a, b = np.nonzero(links)
    assert (parent[a] == parent[b + tally.shift]).mean() > 0.999


def test_small_shards_are_exact():
    draw = np.random.default_rng(2)
    g = graph(draw, 150, 8, np.eye(8)[0])
    links, sums = brute(g, g, True)
    tally, n = tallied(g, g, True)
    assert 2 * n == links.sum() and (tally.sums == sums).all()
    a, b = hnsw.linked(g, g, True)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == n and (a != b).all()


def test_what_is_held_does_not_grow_with_the_links():
    """6,000 unlike vectors near one direction have 18 million links."""
    g = graph(np.random.default_rng(3), 6000, 16, np.eye(16)[0], 0.05)
    tracemalloc.start()
    tally, n = tallied(g, g, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6000 * 5999 // 2 and len(tally.tree) == 5999
    assert peak < 120e6, peak


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError):
        hnsw.near_duplicates(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))


def test_a_repeated_vector_is_no_hot_key(spark):
    rows = [(k, [1.0, 0.0, 0.0] if k % 3 else [float(k), 1.0, k * k / 7]) for k in range(3000)] + [(None, [1.0, 0.0, 0.0]), (5000, None)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()
    assert len(got) == len(rows)
    by_id = {r.vec_id: r for r in got}
    v = np.array([x for _, x in rows[:3000]], np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    assert [by_id[k].n_links for k in range(3000)] == links.tolist()
    assert (by_id[None].n_links, by_id[None].component_id, by_id[None].kept) == (0, None, True) and by_id[5000].component_id == 5000
