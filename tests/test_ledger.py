"""Grids that are stopped and started again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textanomaly.detectors import spec as detectors
from textanomaly.plans import experiments, ledger

SMALL = {"hidden_dims": (6, 4), "dropout_rate": 0.0, "batch_size": 50, "epochs": 2}
SPECS = [detectors.base("base", **SMALL), detectors.lne("ens-3", **SMALL, latent_dim=2, n_neighbors=3), detectors.lne("ens-4", **SMALL, latent_dim=2, n_neighbors=4)]
OPTIONS = {"runs": 2, "min_size": 10, "classes": 5, "split_size": 30, "seed": 3}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, ("train", "test")[i // 3 % 2], rng.standard_normal(5).tolist()) for i in range(180)]
    return spark.createDataFrame(rows, "doc_id long, label int, split string, embedding array<float>").cache()


def grid(corpus, store, specs=SPECS, **more):
    return experiments.benchmark(corpus, None, "independent", 0.1, "given", specs=specs, store=store, **{**OPTIONS, **more})


def rows(frame):
    return sorted((r["run"], r["inlier"], r["model"], round(r["auc"], 5), round(r["ap"], 5)) for r in frame.collect())


def path_of(corpus, store, **more):
    return experiments.grid_path(corpus, None, "independent", 0.1, None, {**OPTIONS, **more}, store)


def stop_after(corpus, store, commits, cells=3):
    path = path_of(corpus, store)
    experiments.grid_scores(corpus, None, "independent", 0.1, SPECS, None, None, OPTIONS, path, cells, commits)
    return path


def counted_fits(monkeypatch):
    fits = []
    real = ledger.fit_and_score

    def counting(rows, specs, keys, carry, wanted=None, **options):
        fits.extend(tuple(r) for r in wanted.collect())
        return real(rows, specs, keys, carry, wanted=wanted, **options)

    monkeypatch.setattr(ledger, "fit_and_score", counting)
    return fits


def test_a_stopped_grid_fits_only_the_rest(spark, corpus, tmp_path, monkeypatch):
    unbroken = rows(grid(corpus, None))
    fits = counted_fits(monkeypatch)
    path = stop_after(corpus, str(tmp_path), 1)
    early = list(fits)
    assert 0 < len(early) < 18
    assert rows(grid(corpus, str(tmp_path))) == unbroken
    assert len(fits) == len(set(fits)) == 18
    # nothing is fitted a third time, and what is kept is what was returned
    assert rows(grid(corpus, str(tmp_path))) == unbroken and len(fits) == 18
    assert spark.read.parquet(f"{path}/ledger").count() == 18


def test_a_block_cut_short_is_done_again(spark, corpus, tmp_path, monkeypatch):
    real, calls = ledger.write_partitions, []

    def failing(df, path, column):
        if path.endswith("ledger") and not calls:
            calls.append(path)
            raise OSError("lost")
        real(df, path, column)

    monkeypatch.setattr(ledger, "write_partitions", failing)
    with pytest.raises(OSError):
        grid(corpus, str(tmp_path))
    # scores without an entry are there, and aren't read
    assert spark.read.parquet(f"{path_of(corpus, str(tmp_path))}/scores").count() > 0
    assert rows(grid(corpus, str(tmp_path))) == rows(grid(corpus, None))


def test_other_settings_have_other_cells(spark, corpus, tmp_path, monkeypatch):
    fits = counted_fits(monkeypatch)
    store = str(tmp_path)
    grid(corpus, store, SPECS[:1]).count()
    first = len(fits)
    more = rows(grid(corpus, store))  # detectors added to a finished grid
    assert len(fits) == 18 and {r[2] for r in more} == {"base", "ens"}
    grid(corpus, store, [SPECS[0].but(epochs=1)]).count()  # the same name with other settings
    grid(corpus.where("doc_id <> 7"), store, SPECS[:1]).count()
    grid(corpus, store, SPECS[:1], seed=4).count()
    assert len(fits) == 18 + 3 * first


def test_two_writers_count_once(spark, corpus, tmp_path):
    path = stop_after(corpus, str(tmp_path), None)
    once = spark.read.parquet(f"{path}/ledger").withColumn("block", F.lit("0-OTHER"))
    scores = spark.read.parquet(f"{path}/scores").withColumn("block", F.lit("0-OTHER"))
    once = spark.createDataFrame(once.collect(), once.schema)
    scores = spark.createDataFrame(scores.collect(), scores.schema)
    ledger.write_partitions(scores, f"{path}/scores", "block")
    ledger.write_partitions(once, f"{path}/ledger", "block")
    assert rows(grid(corpus, str(tmp_path))) == rows(grid(corpus, None))


def test_studies_are_kept_too(corpus, tmp_path, monkeypatch):
    specs = [s.but(detector_id=f"k-{s.n_neighbors}") for s in SPECS[1:]]
    run = lambda store: experiments.ablation(corpus, "ensemble", None, "independent", 0.1, "given", specs=specs, sizes=[2, 3], store=store, **OPTIONS)
    fits = counted_fits(monkeypatch)
    show = lambda frame: sorted(str(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in frame.collect())
    want = show(run(None))
    assert show(run(str(tmp_path))) == want == show(run(str(tmp_path))) and len(fits) == 12
