"""Gradients against finite differences, and what training must keep."""

import numpy as np
import pytest

from textanomaly.detectors import net
from textanomaly.detectors import spec as detectors

SMALL = {"hidden_dims": (7, 5), "activation": "tanh", "dropout_rate": 0.0, "batch_size": 64}
CASES = {
    "base": detectors.base(**SMALL),
    "base sigmoid": detectors.base(**{**SMALL, "activation": "Sigmoid"}),
    "base dropout": detectors.base(**{**SMALL, "dropout_rate": 0.3}),
    "base flat": detectors.base(**{**SMALL, "batchnorm": False}),
    "base l1": detectors.base(**SMALL, loss="l1"),
    "base l21": detectors.base(**SMALL, loss="L21"),
    "pruned": detectors.pruned(**SMALL),
    "masked": detectors.masked(**SMALL),
    "rsr": detectors.rsr(**SMALL, latent_dim=3, lambda1=0.4, lambda2=0.7),
    "rsr norms": detectors.rsr(**SMALL, latent_dim=3, norm_type="LAD", loss_norm_type="L1"),
    "rsr normalised": detectors.rsr(**SMALL, latent_dim=3, normalize=True),
    "rsr plain": detectors.rsr(**SMALL, latent_dim=3, robust=False),
    "rsr all alternating": detectors.rsr(**SMALL, latent_dim=3, all_alt=True),
    "lne": detectors.lne(**SMALL, latent_dim=4, n_neighbors=3),
    "lne robust": detectors.lne(**SMALL, latent_dim=4, n_neighbors=3, robust=True, lambda1=0.3),
    "lne outer": detectors.lne(**SMALL, latent_dim=4, n_neighbors=3, locality="outer", robust=True),
    "lne whole batch": detectors.lne(**{**SMALL, "batchnorm": False}, latent_dim=4, n_neighbors=50),
}


@pytest.mark.parametrize("name", CASES)
def test_gradients_match_finite_differences(name):
    spec = CASES[name]
    x = np.random.default_rng(1).standard_normal((11, 6))
    params = net.initial(spec, 6, np.random.default_rng(2), np.float64)
    _, grads, _ = net.loss_and_grads(spec, params, x, np.random.default_rng(3))
    assert set(grads) == set(net.trainable(params))
    pick = np.random.default_rng(4)
    for key, grad in grads.items():
        for _ in range(4):
            at = tuple(pick.integers(0, s) for s in params[key].shape)
            if f"{key}.mask" in params and params[f"{key}.mask"][at] == 0:
                assert grad[at] == 0
                continue
            values = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in params.items()}
                moved[key][at] += step
                values.append(net.loss_and_grads(spec, moved, x, np.random.default_rng(3), False)[0])
            assert grad[at] == pytest.approx((values[0] - values[1]) / 2e-6, rel=2e-4, abs=2e-6), (key, at)


@pytest.mark.parametrize("name", ["base", "pruned", "masked", "rsr", "lne robust"])
def test_training_lowers_the_loss_and_repeats(name):
    x = np.random.default_rng(5).standard_normal((60, 6)).astype(np.float32)
    spec = CASES[name].but(batch_size=20, learning_rate=1e-2)
    first, early = net.fit(spec.but(epochs=1), x, 1)
    params, late = net.fit(spec.but(epochs=40), x, 1)
    again, _ = net.fit(spec.but(epochs=40), x, 1)
    assert late < early
    assert all(np.array_equal(params[k], again[k]) for k in params)
    other, _ = net.fit(spec.but(epochs=40, seed=9), x, 1)
    assert any(not np.array_equal(params[k], other[k]) for k in net.trainable(params))


def test_pruned_share_is_exact_and_stays_zero():
    spec = detectors.pruned(**{**SMALL, "epochs": 5, "weight_decay": 0.1}, prune_ratio=0.4)
    params, _ = net.fit(spec, np.random.default_rng(6).standard_normal((50, 6)), 1)
    masks = {k[: -len(".mask")]: v for k, v in params.items() if k.endswith(".mask")}
    total = sum(m.size for m in masks.values())
    assert sum(int((m == 0).sum()) for m in masks.values()) == round(0.4 * total)
    assert any(k.endswith(".b") for k in masks)
    assert all((params[k][m == 0] == 0).all() for k, m in masks.items())


def test_masked_weights_stay_zero_and_biases_are_free():
    params, _ = net.fit(detectors.masked(**{**SMALL, "epochs": 5}), np.random.default_rng(6).standard_normal((50, 6)), 1)
    masks = {k[: -len(".mask")]: v for k, v in params.items() if k.endswith(".mask")}
    assert masks and all(k.endswith(".W") for k in masks)
    assert all((params[k][m == 0] == 0).all() for k, m in masks.items())


def test_neighbour_lists():
    x = np.array([[0.0], [1.0], [5.0], [6.0]])
    assert net.nearest_others(x, 1).tolist() == [[1], [0], [3], [2]]
    assert [sorted(row) for row in net.nearest_others(x, 3).tolist()] == [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]]
    assert net.gather_sum(x, None).tolist() == [[12.0]] * 4  # a row counts itself once k reaches the batch


@pytest.mark.parametrize("cells", [1, 64, 1 << 23])
def test_neighbour_lists_equal_dense_products(monkeypatch, cells):
    monkeypatch.setattr(net, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(7)
    x, values = rng.standard_normal((40, 5)), rng.standard_normal((40, 3))
    near = net.nearest_others(x, 6)
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2) + np.diag(np.full(40, np.inf))
    dense = np.zeros((40, 40))
    np.put_along_axis(dense, np.argsort(gap, axis=1)[:, :6], 1, axis=1)
    assert np.array_equal(np.sort(near, axis=1), np.sort(np.argsort(gap, axis=1)[:, :6], axis=1))
    assert np.allclose(net.gather_sum(values, near), dense @ values)
    assert np.allclose(net.scatter_add(values, near), dense.T @ values)


@pytest.mark.parametrize("cells", [64, 1 << 17])
def test_neighbours_marked_in_a_matrix_equal_lists(monkeypatch, cells):
    monkeypatch.setattr(net, "CACHE_CELLS", cells)
    rng = np.random.default_rng(12)
    x, values = rng.standard_normal((60, 5)), rng.standard_normal((60, 3))
    x[20:50] = x[5] + 9  # more equal distances than neighbours, far from the other rows
    near, marks = net.nearest_others(x, 16), net.neighbours(x, 16)
    assert marks.shape == (60, 60) and (marks.sum(axis=1) == 16).all() and not marks.diagonal().any()
    far = [i for i in range(60) if not 20 <= i < 50]
    assert all(set(np.flatnonzero(marks[i])) == set(near[i]) for i in far)
    assert np.allclose(net.gather_sum(values, marks)[far], net.gather_sum(values, near)[far])
    assert np.allclose(net.scatter_add(values, marks), marks.T @ values)
    assert net.neighbours(x, 6).shape == (60, 6)  # short lists are gathered


def test_a_large_batch_of_neighbours_stays_below_a_gigabyte():
    import tracemalloc

    spec = detectors.lne(hidden_dims=(16,), latent_dim=4, n_neighbors=10, batch_size=20_000)
    x = np.random.default_rng(8).standard_normal((20_000, 32)).astype(np.float32)
    params = net.initial(spec, 32, np.random.default_rng(9))
    tracemalloc.start()
    net.loss_and_grads(spec, params, x, np.random.default_rng(10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30


def test_scores_are_distances_and_modes_differ():
    x = np.random.default_rng(7).standard_normal((30, 6)).astype(np.float32)
    spec = detectors.rsr(**{**SMALL, "dropout_rate": 0.3, "epochs": 3}, latent_dim=2)
    params, _ = net.fit(spec, x, 1)
    calm = net.scores(spec, params, x, 1)
    assert calm.shape == (30,) and (calm >= 0).all()
    assert np.array_equal(calm, net.scores(spec, params, x, 1))
    assert np.allclose(calm[:5], net.scores(spec, params, x[:5], 1), atol=1e-5)
    noisy = spec.but(score_mode="train")
    assert not np.allclose(calm, net.scores(noisy, params, x, 1))
    assert np.array_equal(net.scores(noisy, params, x, 1), net.scores(noisy, params, x, 1))


def test_standardised_input_with_a_constant_feature():
    x = np.random.default_rng(8).standard_normal((40, 6)) * 5 + 3
    x[:, 2] = 4
    params, _ = net.fit(detectors.base(**{**SMALL, "epochs": 1}, standardize=True), x, 1)
    assert params["in.sigma"][2] == 1
    assert np.allclose(net.standardized(params, x)[:, 0].std(), 1, atol=1e-5)


def test_running_statistics_follow_the_unbiased_batch_variance():
    x = np.random.default_rng(9).standard_normal((10, 6)).astype(np.float32)
    spec = detectors.base(**SMALL)
    params = net.initial(spec, 6, np.random.default_rng(0))
    _, _, stats = net.loss_and_grads(spec, params, x, np.random.default_rng(0))
    active = np.tanh(x @ params["enc0.W"].T + params["enc0.b"])
    net.update_running(params, stats)
    assert np.allclose(params["enc0.mean"], 0.1 * active.mean(axis=0), atol=1e-6)
    assert np.allclose(params["enc0.var"], 0.9 + 0.1 * active.var(axis=0, ddof=1), atol=1e-6)


def test_adam_first_step_moves_by_the_rate():
    params = {"w": np.array([1.0, -1.0])}
    net.Adam(0.01).step(params, {"w": np.array([3.0, -0.2])})
    assert np.allclose(params["w"], [0.99, -0.99], atol=1e-6)


@pytest.mark.parametrize(
    "bad",
    [
        lambda: detectors.base(activation="gelu"),
        lambda: detectors.base(loss="L3"),
        lambda: detectors.rsr(latent_dim=32),
        lambda: detectors.DetectorSpec("x", "other"),
        lambda: detectors.lne(locality="middle"),
    ],
)
def test_wrong_settings_are_refused(bad):
    with pytest.raises(ValueError):
        bad()


def test_settings_survive_json_and_defaults():
    spec = detectors.lne("a", hidden_dims=[9, 4])
    assert detectors.DetectorSpec.from_json(spec.to_json()) == spec
    assert (spec.n_neighbors, spec.latent_dim, spec.robust, spec.dropout_rate) == (5, 16, False, 0.3)
    assert detectors.pruned().prune_ratio == 0.3 and detectors.masked().dropout_rate == 0.0
    assert detectors.rsr().hidden_dims == (64, 32) and detectors.rsr().robust
    with pytest.raises(ValueError):
        net.initial(spec.but(input_dim=5), 6, np.random.default_rng(0))
