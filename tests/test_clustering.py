"""Offline clustering: linkage against all pairs at each merge, and the hidden Markov model against all paths."""

import itertools
import time

import numpy as np
import pytest

from turnstream.operators import cluster


def all_pairs(x):
    """Centroid linkage that measures all pairs at each merge."""
    centers, sizes, alive, merges = list(x), [1] * len(x), list(range(len(x))), []
    while len(alive) > 1:
        d, a, b = min((float(np.linalg.norm(centers[a] - centers[b])), a, b) for a, b in itertools.combinations(alive, 2))
        merges.append((a, b, d))
        centers.append((centers[a] * sizes[a] + centers[b] * sizes[b]) / (sizes[a] + sizes[b]))
        sizes.append(sizes[a] + sizes[b])
        alive = [k for k in alive if k not in (a, b)] + [len(centers) - 1]
    return merges


@pytest.mark.parametrize("seed", range(6))
def test_linkage_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((2 + 9 * seed, 5)) + 3 * rng.integers(0, 3, (2 + 9 * seed, 1))
    got, wanted = cluster._linkage(x), all_pairs(x)
    assert [m[:2] for m in got] == [m[:2] for m in wanted]
    assert np.allclose([m[2] for m in got], [m[2] for m in wanted])


def test_equal_points_merge_first_to_last():
    x = np.ones((5, 3))
    assert [m[:2] for m in cluster._linkage(x)] == [m[:2] for m in all_pairs(x)]
    assert cluster.agglomerate(x, 0.5, 1, 5) == [0] * 5


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize(("threshold", "least", "most"), [(0.6, 1, 8), (0.2, 2, 3), (1.5, 3, 3), (0.01, 1, 40)])
def test_flat_clusters(seed, threshold, least, most):
    """Flat clusters are the nodes whose merges all lie at or under the cut, by all pairs."""
    x = np.random.default_rng(seed).standard_normal((30, 4))
    got = cluster.agglomerate(x, threshold, least, most)
    merges = all_pairs(x / np.linalg.norm(x, axis=1, keepdims=True))
    at = lambda k: merges[-k][2] if k < 30 else -np.inf
    cut = at(least) if least == most else min(max(threshold, at(most)), at(least))
    members, top, wanted = [{i} for i in range(30)], [-np.inf] * 30, {frozenset([i]) for i in range(30)}
    for a, b, d in merges:
        members.append(members[a] | members[b])
        top.append(max(d, top[a], top[b]))
        if top[-1] <= cut:
            wanted = {w for w in wanted if not w <= members[-1]} | {frozenset(members[-1])}
    assert {frozenset(np.flatnonzero(np.array(got) == g).tolist()) for g in set(got)} == wanted
    assert list(dict.fromkeys(got)) == list(range(len(wanted)))


def test_thousands_of_points_take_seconds():
    x = np.random.default_rng(0).standard_normal((4000, 16))
    began = time.time()
    assert len(cluster._linkage(x)) == 3999
    assert time.time() - began < 60


# --- hidden Markov models


def all_paths(model, x):
    """(log-likelihood, posterior of each state, likeliest path), over every path."""
    e = model.emissions(x)
    paths = list(itertools.product(range(len(model.means)), repeat=len(x)))
    logs = np.array([model.start[p[0]] + e[0, p[0]] + sum(model.moves[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:]))) for p in paths])
    total = np.logaddexp.reduce(logs)
    own = np.zeros(e.shape)
    for p, v in zip(paths, np.exp(logs - total)):
        own[np.arange(len(x)), p] += v
    return total, own, paths[int(logs.argmax())]


@pytest.mark.parametrize("seed", range(4))
def test_model_equals_all_paths(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((6, 3))
    model = cluster.GaussianStates(x, 3)
    model.start = np.log(rng.dirichlet(np.ones(3)))
    model.moves = np.log(rng.dirichlet(np.ones(3), 3))
    model.variances = rng.uniform(0.2, 2, (3, 3))
    total, own, best = all_paths(model, x)
    e = model.emissions(x)
    a, b = model.forward(e), model.backward(e)
    assert np.isclose(cluster._log_sum(a[-1], 0), total)
    assert np.allclose(np.exp(a + b - total), own)
    assert model.path(x).tolist() == list(best)


@pytest.mark.parametrize("seed", range(6))
def test_objective_never_falls(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((80, 4)) + 2 * rng.integers(0, 2, (80, 1))
    model = cluster.GaussianStates(x, 4).fit(x)
    assert len(model.history) > 1
    assert all(b >= a - 1e-9 for a, b in zip(model.history, model.history[1:]))


@pytest.mark.parametrize("speakers", [2, 3, 4])
def test_planted_speakers_come_back(speakers):
    rng = np.random.default_rng(speakers)
    voices = np.eye(16)[:speakers]
    turns = np.repeat(rng.permutation(np.tile(np.arange(speakers), 5)), 8)
    x = voices[turns] + 0.05 * rng.standard_normal((len(turns), 16))
    got = cluster.markov_labels(x, 1, 8)
    assert len(set(zip(got.tolist(), turns.tolist()))) == speakers == len(set(got.tolist()))


def test_one_voice_and_few_points():
    rng = np.random.default_rng(1)
    assert set(cluster.markov_labels(np.ones(16) + 0.05 * rng.standard_normal((30, 16)), 1, 6).tolist()) == {0}
    assert cluster.markov_labels(np.ones((1, 3)), 1, 6).tolist() == [0]
    assert len(cluster.markov_labels(np.eye(3), 2, 2)) == 3
    with pytest.raises(ValueError):
        cluster.markov_labels(np.eye(3), 3, 2)
