"""Registered studies have the settings of full experiments."""

import numpy as np
import pytest

from textanomaly.detectors import net
from textanomaly.detectors.spec import base, lne
from textanomaly.plans import experiments
from textanomaly.queries import detect


class Stop(Exception):
    pass


def specs_of(spark, monkeypatch, name):
    seen = []

    def look(corpus, study, *rest, specs, **options):
        seen.extend(specs)
        raise Stop

    rows = spark.createDataFrame([(0, [0.0], 1, "train")], "doc_id long, embedding array<float>, label int, split string")
    monkeypatch.setattr(detect, "vector_corpus", lambda *_: rows)
    monkeypatch.setattr(experiments, "ablation", look)
    with pytest.raises(Stop):
        detect.QUERIES[name](spark, "")
    return seen


def test_latent_study_has_all_epochs(spark, monkeypatch):
    """Three of a hundred epochs were left of every fit."""
    specs = specs_of(spark, monkeypatch, "ablation_latent")
    assert specs == experiments.ablation_specs("latent")
    assert len(specs) == 32 and {s.epochs for s in specs} == {100}


def test_lambda_study_has_all_epochs(spark, monkeypatch):
    """One of a hundred epochs was left of every fit."""
    specs = specs_of(spark, monkeypatch, "ablation_lambda")
    assert specs == experiments.ablation_specs("lambda")
    assert len(specs) == 1331 and {s.epochs for s in specs} == {100}


@pytest.mark.parametrize("near", [4, 20, 90])
@pytest.mark.parametrize("begin", [False, True])
def test_detectors_trained_together_are_as_trained_alone(near, begin):
    x = np.random.default_rng(3).standard_normal((41, 6)).astype(np.float32)
    own = {"hidden_dims": (5, 4), "latent_dim": 3, "n_neighbors": near, "batch_size": 25, "batches_per_step": 2, "epochs": 6, "robust": True}
    specs = [lne(f"d{i}", lambda1=i / 10, lambda2=1 - i / 10, **own) for i in range(7)]
    specs[3:3] = [base("alone", hidden_dims=(5, 4), epochs=2), lne("other", **{**own, "latent_dim": 2}), lne("twin", **{**own, "latent_dim": 2})]
    start = {s.detector_id: net.initial(s, 6, np.random.default_rng(5), np.float64) for s in specs[:5]} if begin else {}
    numbers = np.arange(41) % 2
    got = list(net.fit_alike(specs, x, 7, "k", batches=lambda _: numbers, name="m", start=start))
    assert [s for s, _ in got] == specs
    for spec, params in got:
        alone, _ = net.fit(spec, x, 7, "k", batches=numbers, name="m", start=start.get(spec.detector_id))
        assert list(params) == list(alone)
        for name, value in alone.items():
            assert params[name].dtype == value.dtype
            np.testing.assert_allclose(params[name], value, rtol=1e-5, atol=1e-6)


def test_alike_detectors_take_their_steps_in_the_same_calls(monkeypatch):
    calls, steps = [], net.loss_and_grads
    monkeypatch.setattr(net, "loss_and_grads", lambda *args: calls.append(1) or steps(*args))
    x = np.random.default_rng(3).standard_normal((9, 6)).astype(np.float32)
    specs = [lne(f"d{i}", hidden_dims=(4, 3), latent_dim=2, lambda1=i / 10, epochs=5, robust=True) for i in range(2 * net.STACK)]
    assert len(list(net.fit_alike(specs, x))) == len(specs) and len(calls) == 2 * 5
