"""Detectors with given weights: one step of training, scores and whole grids that SQL can follow."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textanomaly.detectors import net
from textanomaly.detectors import spec as detectors
from textanomaly.operators.fit import fit_detectors, model_rows, model_schema
from textanomaly.operators.metrics import summary
from textanomaly.operators.score import score
from textanomaly.plans import experiments
from textanomaly.queries import detect
from textanomaly.queries.evaluate import metrics_sql
from textanomaly.queries.shared import (
    CORPUS, DIM, HIERARCHY, SEED, bits_sql, order_sql, rounded, scratch, vector_corpus, vector_hierarchy,
)
from textanomaly.queries.splits import MIN_SIZE, NU, split_sql
from textanomaly.session import settle

WIDTH, LATENT = 3, 2
BIAS = (0.05, -0.05, 0.1)
RATE = 0.01
SHAPE = {"hidden_dims": (WIDTH,), "activation": "tanh", "batchnorm": False, "dropout_rate": 0.0}
STEP = {**SHAPE, "epochs": 1, "batch_size": 1 << 20, "learning_rate": RATE}
NEAR = 5  # neighbours of the single detector
MEMBERS = (2, 3, 4)  # neighbours of the ensemble's
BATCH = 30
CODE = np.array([[((q + 2 * p) % 4 - 1) / 4 for p in range(LATENT)] for q in range(WIDTH)])
RUNS, CLASSES, SPLIT_SIZE = 10, 40, 1000


def weights(spec) -> dict:
    """The starting parameters of a detector with one hidden layer; masks leave every other weight out."""
    (width,) = spec.hidden_dims
    inner = LATENT if spec.family in ("rsr", "lne") else width
    encode = np.array([[detect.encoder_weight(i, q) for i in range(DIM)] for q in range(width)])
    decode = np.array([[detect.encoder_weight(j, q) for q in range(inner)] for j in range(DIM)])
    params = {"enc0.W": encode, "enc0.b": np.array(BIAS[:width]), "dec0.W": decode, "dec0.b": np.zeros(DIM)}
    if spec.family in ("rsr", "lne"):
        params["A"] = CODE[:width]
    if spec.family in ("masked", "pruned"):
        for name in ("enc0.W", "dec0.W"):
            rows, columns = np.indices(params[name].shape)
            params[f"{name}.mask"] = ((rows + columns) % 2 == 0).astype(float)
    return params


STEPS = {
    "base": detectors.base("base", **STEP),
    "masked": detectors.masked("masked", **STEP),
    "rsr": detectors.rsr("rsr", latent_dim=LATENT, **STEP),
    "pruned": detectors.pruned("pruned", **STEP),
    "lne": detectors.lne("lne", latent_dim=LATENT, n_neighbors=NEAR, **{**STEP, "robust": True}),
}


def fit_step(family):
    """Every label's weights after one step over all its rows, trained in a task and by all tasks."""
    spec = STEPS[family]

    def query(spark, folder):
        corpus = vector_corpus(spark, folder)
        paths = []
        for path, bound in (("task", None), ("all", 0)):
            fitted = fit_detectors(corpus, [spec], ["label"], max_group_rows=bound, start={spec.detector_id: weights(spec)})
            flat = fitted.select(F.lit(path).alias("path"), "label", "name", F.posexplode("data").alias("at", "value"))
            paths.append(flat.withColumn("value", F.round(F.col("value").cast("double"), 4)))
        return reduce(DataFrame.unionByName, paths)

    return query


def shapes(name):
    """Size, number of finite and of zero weights by model; the zeros of pruned detectors are exact."""

    def query(spark, folder):
        models = detect.QUERIES[name](spark, folder)
        count = lambda test: F.size(F.filter("data", test))
        sized = models.withColumns(
            {
                "shape": F.array_join("shape", "x"),
                "finite": count(lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))),
                "zero": count(lambda v: v == 0),
            }
        )
        if name != "fit_pruned":
            return sized.select("run", "inlier", "name", "shape", "finite")
        linear = F.col("name").endswith(".W") | F.col("name").endswith(".b")
        return sized.where(linear).groupBy("run", "inlier").agg(F.sum("finite").alias("finite"), F.sum("zero").alias("zero"))

    return query


def model_table(spark, spec):
    rows = [(*row[:4], [float(v) for v in row[4]]) for row in model_rows(spec, weights(spec))]
    return spark.createDataFrame(rows, model_schema(spark.range(1), []))


def score_fixed(family, **options):
    """Scores of fixed weights; neighbours are looked for in hash batches of a label."""
    make = {"base": detectors.base, "rsr": detectors.rsr, "lne": detectors.lne}[family]
    layer = {} if family == "base" else {"latent_dim": LATENT}
    near = {"n_neighbors": NEAR} if family == "lne" else {}

    def query(spark, folder):
        spec = make(family, **SHAPE, **layer, **near, batch_size=BATCH)
        found = score(vector_corpus(spark, folder), model_table(spark, spec), [], carry=["label"], within=["label"], **options)
        return found.select("doc_id", "detector_id", F.round("score", 4).alias("score"))

    return query


def grid_specs(members=MEMBERS):
    still = {**SHAPE, "epochs": 0, "batch_size": 1000}
    near = {**still, "latent_dim": LATENT}
    return [
        detectors.base("base", **still),
        detectors.pruned("rae", **still),
        detectors.rsr("rsrae", **near),
        detectors.lne("lleae", n_neighbors=NEAR, **near),
        *[detectors.lne(f"ens-{k}", n_neighbors=k, **near) for k in members],
    ]


GRID = {"runs": RUNS, "classes": CLASSES, "split_size": SPLIT_SIZE, "min_size": MIN_SIZE, "seed": SEED}


def benchmark(spark, folder):
    """The benchmark of detectors that keep their starting weights."""
    corpus, specs = vector_corpus(spark, folder), grid_specs()
    start = {s.detector_id: weights(s) for s in specs}
    results = experiments.benchmark(
        corpus, vector_hierarchy(corpus), "contextual", NU, "given", specs=specs, start=start, **GRID
    )
    return results.withColumns(rounded("auc", "ap"))


def halfway(spark, folder):
    """A store where the benchmark was stopped after some of its blocks of cells, and what it takes to go on."""
    corpus, specs = vector_corpus(spark, folder), grid_specs()
    start = {s.detector_id: weights(s) for s in specs}
    hierarchy = vector_hierarchy(corpus)
    store = scratch(spark, f"grid-{uuid.uuid4().hex}")
    path = experiments.grid_path(corpus, hierarchy, "contextual", NU, start, GRID, store)
    args = (corpus, hierarchy, "contextual", NU, specs, None, start, GRID, path)
    scores, _ = experiments.grid_scores(*args, commit_cells=100, commits=2)
    return store, path, args, scores


def benchmark_restarted(spark, folder):
    """The benchmark stopped after two blocks of cells and started again; results are read from where they are kept."""
    store, _, (corpus, hierarchy, mode, nu, specs, _, start, options, _), _ = halfway(spark, folder)
    results = experiments.benchmark(corpus, hierarchy, mode, nu, "given", specs=specs, start=start, store=store, **options)
    return results.withColumns(rounded("auc", "ap"))


def grid_ledger(spark, folder):
    """Cells with scores when the grid was stopped, at its end, and those fitted more than once."""
    _, path, args, scores = halfway(spark, folder)
    cell = ["run", "inlier", "detector_id"]
    first = settle(scores.select(*cell).distinct())
    whole, _ = experiments.grid_scores(*args)
    held = spark.read.parquet(f"{path}/ledger").groupBy(*cell).agg(F.count(F.lit(1)).alias("times"))
    done = whole.select(*cell).distinct().join(held, cell, "left").join(first.withColumn("early", F.lit(1)), cell, "left")
    return done.groupBy("detector_id").agg(
        F.count(F.lit(1)).alias("cells"), (F.sum("early") < F.count(F.lit(1))).alias("some_missing"),
        F.sum(F.coalesce("times", F.lit(0)) - 1).alias("repeated"),
    )


def fit_many(spark, folder):
    """Weights that differ between a fit in one task and one by all tasks, for detectors of all shapes in the same jobs."""
    corpus = vector_corpus(spark, folder).where("split = 'train'")
    small = {"epochs": 2, "batch_size": 64, "batches_per_step": 2, "activation": "tanh", "batchnorm": False, "dropout_rate": 0.1}
    specs = [make(f"{make.__name__}-{a}-{b}", hidden_dims=(a, b), **small) for make in (detectors.base, detectors.pruned) for a in (16, 12) for b in (8, 6)]
    specs += [
        make(f"{make.__name__}-{a}-{n}", hidden_dims=(a, 6), latent_dim=n, **small)
        for make in (detectors.rsr, detectors.lne) for a in (16, 12, 8) for n in (2, 3, 4)
    ]
    one, many = (
        fit_detectors(corpus, specs, [], max_group_rows=bound).select("detector_id", "name", "data") for bound in (None, 0)
    )
    gaps = F.zip_with("data", F.col("other"), lambda a, b: F.coalesce(F.abs(a - b), F.lit(1.0)))
    apart = F.size(F.filter(gaps, lambda gap: gap > 1e-4))
    both = one.join(many.withColumnRenamed("data", "other"), ["detector_id", "name"], "full")
    return both.groupBy("detector_id").agg(F.sum(F.coalesce(apart, F.lit(1))).alias("differing"))


def benchmark_summary(spark, folder):
    return summary(benchmark(spark, folder)).withColumns(rounded("auc", "ap", digits=5))


STUDY = range(2, 9)


def ablation(spark, folder):
    """A study over the number of neighbours with starting weights kept."""
    corpus = vector_corpus(spark, folder)
    specs = [s.but(detector_id=f"k-{s.n_neighbors}") for s in grid_specs(STUDY)[4:]]
    start = {s.detector_id: weights(s) for s in specs}
    results = experiments.ablation(
        corpus, "latent", vector_hierarchy(corpus), "contextual", NU, "given", specs=specs, start=start, **GRID
    )
    return results.withColumns(rounded("auc", "ap"))


def study(name, specs, **options):
    """A study with starting weights kept, over the grid that ``specs`` gives."""

    def query(spark, folder):
        corpus, grid = vector_corpus(spark, folder), specs()
        start = {s.detector_id: weights(s) for s in grid}
        results = experiments.ablation(
            corpus, name, vector_hierarchy(corpus), "contextual", NU, "given", specs=grid, start=start, **options, **GRID
        )
        return results.withColumns(rounded("auc", "ap"))

    return query


def lambda_specs():
    """All 1,331 combinations of the loss weights."""
    return experiments.ablation_specs("lambda", **{**SHAPE, "epochs": 0, "latent_dim": LATENT, "n_neighbors": NEAR})


def hidden_specs():
    one = grid_specs()[3]
    return [one.but(detector_id=f"hidden-{w}", hidden_dims=(w,)) for w in WIDTHS]


def neighbour_specs():
    return [s.but(detector_id=f"k-{s.n_neighbors}") for s in grid_specs(STUDY)[4:]]


WIDTHS, SIZES = (3, 2), [2, 3, 5, 9]


def weight_sql(i: str, q: str) -> str:
    return f"((({i}) * ({q} + 3) % 7 - 3) / 10.0::double)"


def added(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def each(body: str) -> str:
    return f"list_transform(range(1, {DIM + 1}), lambda i: {body})"


def half(i: str, q: str, masked: bool) -> str:
    return f"{weight_sql(i, q)}" + (f" * (({i} + {q}) % 2 = 0)::int" if masked else "")


def coded_sql(masked: bool = False) -> str:
    """The hidden units of x."""
    units = ", ".join(f"tanh(list_sum({each('x[i] * ' + half('i - 1', str(q), masked))}) + {BIAS[q]})" for q in range(WIDTH))
    return f"([{units}]::double[])"


def code_sql(h: str, width: int = WIDTH) -> str:
    """The latent of hidden units."""
    cells = (added(f"{h}[{q + 1}] * {CODE[q, p]}" for q in range(width)) for p in range(LATENT))
    return f"([{', '.join(cells)}]::double[])"


def decoded_sql(latent: str, width: int, masked: bool = False) -> str:
    return each(f"tanh({added(f'{latent}[{q + 1}] * ' + half('i - 1', str(q), masked) for q in range(width))})")


def distance_sql(latent: str, width: int, masked: bool = False) -> str:
    return f"list_distance({decoded_sql(latent, width, masked)}, x)"


def step_sql(family: str) -> str:
    masked, robust, local = family in ("masked", "pruned"), family in ("rsr", "lne"), family == "lne"
    width = LATENT if robust else WIDTH
    spec = STEPS[family]
    weight = spec.lambda1 + (spec.local_weight if local else 0)
    # neighbours' hidden units are added up; what comes back goes to every row that was a neighbour
    source, returned = ("g", "s") if local else ("h", "dz")
    dy = each(f"2 * (y[i] - x[i]) / (n * {1 if robust else DIM}) * (1 - y[i] * y[i])")
    back = [f"list_sum({each('dy[i] * ' + half('i - 1', str(q), masked))})" for q in range(width)]
    gaps = [f"2 * (h[{q + 1}] - {added(f'z[{p + 1}] * {CODE[q, p]}' for p in range(LATENT))}) / n" for q in range(WIDTH)]
    if robust:
        back = [b + f" - {weight} * {added(f'gap[{q + 1}] * {CODE[q, p]}' for q in range(WIDTH))}" for p, b in enumerate(back)]
        hidden = [f"{weight} * gap[{q + 1}] + {added(f'{returned}[{p + 1}] * {CODE[q, p]}' for p in range(LATENT))}" for q in range(WIDTH)]
    else:
        hidden = [f"dz[{q + 1}]" for q in range(WIDTH)]
    hidden = ", ".join(f"({d}) * (1 - h[{q + 1}] * h[{q + 1}])" for q, d in enumerate(hidden))
    own = f"union all select label, 'A', q * {LATENT} + p, sum({source}[q + 1] * dz[p + 1] - {weight} * gap[q + 1] * z[p + 1]) from rows, qs, ps group by label, q, p"
    grams = 4 * spec.lambda2 / LATENT**2 * (CODE @ (CODE.T @ CODE - np.eye(LATENT)))
    code = " ".join(
        f"union all select 'A', {q * LATENT + p}, {CODE[q, p]}, {grams[q, p]}, 1" for q in range(WIDTH) for p in range(LATENT)
    )
    keep = lambda i, q: f"(({i} + {q}) % 2 = 0)::int" if masked else "1"
    bias = " ".join(f"when {q} then {b}" for q, b in enumerate(BIAS))
    gathered, scattered = "", "pulled"
    if local:
        added_up = ", ".join(f"sum(b.h[{q + 1}])" for q in range(WIDTH))
        sent = ", ".join(f"sum(dz[{p + 1}])" for p in range(LATENT))
        gathered = f"""near as (select a.label, a.doc_id, b.doc_id as other from coded a join coded b on a.label = b.label
  qualify row_number() over (partition by a.label, a.doc_id
    order by case when a.doc_id = b.doc_id then 'infinity'::double else list_distance(a.h, b.h) end, b.doc_id) <= {NEAR}),
sums as (select n.doc_id, [{added_up}]::double[] as g from near n join coded b on n.other = b.doc_id group by n.doc_id),"""
        scattered = f"""(select p.*, coalesce(t.s, [0, 0]::double[]) as s from pulled p left join (
  select n.other, [{sent}]::double[] as s from near n join pulled q on n.doc_id = q.doc_id group by n.other) t on p.doc_id = t.other)"""
    return f"""with coded as (select doc_id, label, count(*) over (partition by label) as n, x, {coded_sql(masked)} as h
  from (select vec_id as doc_id, label, embedding::double[] as x from embeddings)),
{gathered}
latent as (select *, {code_sql(source) if robust else 'h'} as z from {'coded join sums using (doc_id)' if local else 'coded'}),
decoded as (select *, {decoded_sql('z', width, masked)} as y, [{', '.join(gaps) if robust else '0'}]::double[] as gap from latent),
errors as (select *, {dy} as dy from decoded),
pulled as (select *, [{', '.join(back)}]::double[] as dz from errors),
rows as (select *, [{hidden}]::double[] as dh from {scattered}),
qs as (select unnest(range({WIDTH})) as q), ps as (select unnest(range({width})) as p), cells as (select unnest(range({DIM})) as i),
slopes as (
  select label, 'enc0.W' as name, q * {DIM} + i as at, sum(dh[q + 1] * x[i + 1]) as g from rows, qs, cells group by label, q, i
  union all select label, 'enc0.b', q, sum(dh[q + 1]) from rows, qs group by label, q
  union all select label, 'dec0.W', i * {width} + p, sum(dy[i + 1] * z[p + 1]) from rows, ps, cells group by label, p, i
  union all select label, 'dec0.b', i, sum(dy[i + 1]) from rows, cells group by label, i
  {own if robust else ''}),
start as (
  select 'enc0.W' as name, q * {DIM} + i as at, {weight_sql('i', 'q')} as w, 0.0::double as extra, {keep('i', 'q')} as kept from qs, cells
  union all select 'enc0.b', q, case q {bias} end, 0, 1 from qs
  union all select 'dec0.W', i * {width} + p, {weight_sql('i', 'p')}, 0, {keep('i', 'p')} from ps, cells
  union all select 'dec0.b', i, 0, 0, 1 from cells
  {code if robust else ''})
select path, label, s.name, s.at::int as at,
  round(kept * (w - {RATE} * (g + extra) / (abs(g + extra) + 1e-8)), 4)::double as value
from slopes s join start b on s.name = b.name and s.at = b.at, (select unnest(['task', 'all']) as path)"""


def shapes_sql(name: str) -> str:
    """What settings say about the parameters of every group."""
    spec = detect.SPECS[name]
    found = net.initial(spec, DIM, np.random.default_rng(0))
    sizes = [(n, "x".join(map(str, v.shape)), v.size) for n, v in found.items() if not n.endswith(".mask")]
    groups = f"with {CORPUS}, {HIERARCHY}, {split_sql('contextual')}, fitted as (select distinct run, inlier from chosen where split = 'train')"
    if name == "fit_pruned":
        total = sum(size for n, _, size in sizes if n.endswith((".W", ".b")))
        return f"{groups} select run, inlier, {total}::bigint as finite, {round(spec.prune_ratio * total)}::bigint as zero from fitted"
    values = ", ".join(f"('{n}', '{shape}', {size})" for n, shape, size in sizes)
    return f"{groups} select run, inlier, name, shape, finite from fitted, (values {values}) as v(name, shape, finite)"


BATCHED = f"""with {CORPUS},
sized as (select *, ceil(count(*) over (partition by label) / {BATCH}::double)::bigint as batches from corpus),
coded as (select doc_id, label, embedding as x, {bits_sql(order_sql("'0'", "'batch'", 'doc_id::varchar'))} % batches as batch
  from sized), hidden as (select *, {coded_sql()} as h from coded)"""


def gathered_sql(source: str, keys: str, detector: str, near: str) -> str:
    """``near_rows``: rows of ``source(keys, doc_id, x, h)`` with the summed hidden units g of their neighbours."""
    same = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    sums = ", ".join(f"sum(other[{q}])" for q in range(1, WIDTH + 1))
    return f"""pairs as (select {own}, a.doc_id, b.h as other, row_number() over (partition by {own}, a.doc_id
    order by case when a.doc_id = b.doc_id then 'infinity'::double else list_distance(a.h, b.h) end, b.doc_id) as rank
  from {source} a join {source} b on {same}),
sums as (select {keys}, doc_id, {detector}, [{sums}]::double[] as g from pairs, {near} where rank <= k group by {keys}, doc_id, {detector})"""


GRID_SPLIT = split_sql("contextual", size=SPLIT_SIZE, runs=RUNS, classes=CLASSES)
PLACED = f"""with {CORPUS}, {HIERARCHY}, {GRID_SPLIT},
vectors as (select c.run, c.inlier, c.split, c.doc_id, c.y as truth, e.embedding as x from chosen c join corpus e on c.doc_id = e.doc_id),
coded as (select *, {coded_sql()} as h, {coded_sql(True)} as hm from vectors)"""
KEYS = "run, inlier, split"


def near_scores_sql(neighbours) -> str:
    near = ", ".join(f"('{name}', {k})" for name, k in neighbours)
    return f"""{gathered_sql('coded', KEYS, 'detector_id', f'(values {near}) as v(detector_id, k)')},
near_scores as (select c.run, c.inlier, c.split, c.doc_id, truth, detector_id, {distance_sql(code_sql('g'), LATENT)} as score
  from coded c join sums s on c.run = s.run and c.inlier = s.inlier and c.split = s.split and c.doc_id = s.doc_id)"""


def settings_sql(ndetector="1", near=str(NEAR), lambdas=("0.1::double",) * 3, hidden=f"'[{WIDTH}]'") -> str:
    one, two, three = lambdas
    return f"""{TOLD}, run, inlier, {ndetector} as ndetector, {near} as n_neighbors, {one} as lambda1, {two} as lambda2,
  {three} as lambda3, {hidden} as hidden, {LATENT} as latent"""


TOLD = "'given' as embedding, {nu}::double as nu, 'contextual' as generation".format(nu=NU)
BENCHMARK = f"""{PLACED},
{near_scores_sql([('lleae', NEAR), *[(f'ens-{k}', k) for k in MEMBERS]])},
moments as (select run, inlier, detector_id, avg(score) as mu, stddev_pop(score) as sigma from near_scores
  where split = 'train' and detector_id like 'ens-%' group by all),
merged as (select s.run, s.inlier, s.doc_id, s.truth, median((score - mu) / case when sigma = 0 then 1 else sigma end) as score
  from near_scores s join moments m on s.run = m.run and s.inlier = m.inlier and s.detector_id = m.detector_id
  where split = 'test' group by all),
tested as (
  select run, inlier, 'base' as model, truth as y, {distance_sql('h', WIDTH)} as score from coded where split = 'test'
  union all select run, inlier, 'rae', truth, {distance_sql('hm', WIDTH, True)} from coded where split = 'test'
  union all select run, inlier, 'rsrae', truth, {distance_sql(code_sql('h'), LATENT)} from coded where split = 'test'
  union all select run, inlier, 'lleae', truth, score from near_scores where split = 'test' and detector_id = 'lleae'
  union all select run, inlier, 'ens', truth, score from merged),
{metrics_sql('run, inlier, model', 'tested')}"""

QUERIES = {
    **{f"fit_step_{family}": fit_step(family) for family in STEPS},
    **{name.replace("fit_", "fit_shapes_"): shapes(name) for name in detect.SPECS},
    **{f"score_fixed_{family}": score_fixed(family) for family in ("rsr", "lne")},
    **{f"score_joined_{family}": score_fixed(family, max_model_bytes=0) for family in ("base", "rsr", "lne")},
    "benchmark_fixed": benchmark,
    "benchmark_fixed_summary": benchmark_summary,
    "benchmark_restarted": benchmark_restarted,
    "grid_ledger": grid_ledger,
    "fit_many": fit_many,
    "ablation_fixed": ablation,
    "ablation_fixed_lambda": study("lambda", lambda_specs),
    "ablation_fixed_hidden": study("hidden", hidden_specs),
    "ablation_fixed_ensemble": study("ensemble", neighbour_specs, sizes=SIZES),
}

SCORED = {
    "base": f"{BATCHED} select doc_id, 'base' as detector_id, round({distance_sql('h', WIDTH)}, 4) as score from hidden",
    "rsr": f"{BATCHED} select doc_id, 'rsr' as detector_id, round({distance_sql(code_sql('h'), LATENT)}, 4) as score from hidden",
    "lne": f"""{BATCHED}, {gathered_sql('hidden', 'label, batch', 'detector_id', f"(values ('lne', {NEAR})) as v(detector_id, k)")}
select h.doc_id, detector_id, round({distance_sql(code_sql('g'), LATENT)}, 4) as score
from hidden h join sums s on h.doc_id = s.doc_id""",
}
FIXED = f"{BENCHMARK} select model, round(auc, 6) as auc, round(ap, 6) as ap, {TOLD}, run, inlier from ranked"
ORACLES = {
    **{f"fit_step_{family}": step_sql(family) for family in STEPS},
    **{name.replace("fit_", "fit_shapes_"): shapes_sql(name) for name in detect.SPECS},
    **{f"score_fixed_{family}": SCORED[family] for family in ("rsr", "lne")},
    **{f"score_joined_{family}": SCORED[family] for family in ("base", "rsr", "lne")},
    "benchmark_fixed": FIXED,
    "benchmark_restarted": FIXED,
    "grid_ledger": f"""with {CORPUS}, {HIERARCHY}, {GRID_SPLIT}
select unnest({[s.detector_id for s in grid_specs()]}) as detector_id,
  (select count(*) from (select distinct run, inlier from chosen)) as cells, true as some_missing, 0::bigint as repeated""",
    "fit_many": """select f || '-' || a || '-' || b as detector_id, 0::bigint as differing
from (values ('base'), ('pruned')) as x(f), (values (16), (12)) as y(a), (values (8), (6)) as z(b)
union all select f || '-' || a || '-' || b, 0
from (values ('rsr'), ('lne')) as x(f), (values (16), (12), (8)) as y(a), (values (2), (3), (4)) as z(b)""",
    "benchmark_fixed_summary": f"""{BENCHMARK} select model, round(avg(round(auc, 6)), 5) as auc, round(avg(round(ap, 6)), 5) as ap
from ranked group by model""",
    "ablation_fixed": f"""{PLACED}, {near_scores_sql([(f'k-{k}', k) for k in STUDY])},
tested as (select run, inlier, detector_id, truth as y, score from near_scores where split = 'test'),
{metrics_sql('run, inlier, detector_id', 'tested')}
select 'lleae' as model, round(auc, 6) as auc, round(ap, 6) as ap, {TOLD}, run, inlier, 1 as ndetector,
  substr(detector_id, 3)::int as n_neighbors, 0.1::double as lambda1, 0.1::double as lambda2, 0.1::double as lambda3,
  '[{WIDTH}]' as hidden, {LATENT} as latent from ranked""",
    "ablation_fixed_lambda": f"""{PLACED}, {near_scores_sql([('lleae', NEAR)])},
tested as (select run, inlier, truth as y, score from near_scores where split = 'test'),
{metrics_sql('run, inlier', 'tested')},
a as (select unnest(range(11)) / 10.0::double as a), b as (select a as b from a), c as (select a as c from a)
select 'lleae' as model, round(auc, 6) as auc, round(ap, 6) as ap, {settings_sql(lambdas=('a', 'b', 'c'))} from ranked, a, b, c""",
    "ablation_fixed_hidden": f"""{PLACED}, narrow as (select * exclude (h), h[1:2] as h from coded),
{near_scores_sql([('3', NEAR)])},
{gathered_sql('narrow', KEYS, 'detector_id', f"(values ('2', {NEAR})) as v(detector_id, k)").replace('pairs', 'narrow_pairs').replace('sums as', 'narrow_sums as')},
tested as (select run, inlier, detector_id, truth as y, score from near_scores where split = 'test' union all
  select c.run, c.inlier, detector_id, truth, {distance_sql(code_sql('g', 2), LATENT)} from narrow c join narrow_sums s
  on c.run = s.run and c.inlier = s.inlier and c.split = s.split and c.doc_id = s.doc_id where c.split = 'test'),
{metrics_sql('run, inlier, detector_id', 'tested')}
select 'lleae' as model, round(auc, 6) as auc, round(ap, 6) as ap, {settings_sql(hidden="'[' || detector_id || ']'")} from ranked""",
    "ablation_fixed_ensemble": f"""{PLACED}, {near_scores_sql([(f'k-{k}', k) for k in STUDY])},
moments as (select run, inlier, detector_id, avg(score) as mu, stddev_pop(score) as sigma from near_scores where split = 'train' group by all),
z as (select s.run, s.inlier, s.doc_id, s.truth as y, s.detector_id, (score - mu) / case when sigma = 0 then 1 else sigma end as z
  from near_scores s join moments m on s.run = m.run and s.inlier = m.inlier and s.detector_id = m.detector_id where split = 'test'),
draws as (select n as draw, 'k-' || ({STUDY.start} + {bits_sql(order_sql(f"'{SEED}'", "'draw'", 'n::varchar', 'slot::varchar'))} % {len(STUDY)}) as d
  from (select n, unnest(range(n))::int as slot from (select unnest({SIZES})::int as n))),
mixed as (select run, inlier, draw, doc_id, y, median(z) as score from z join draws on z.detector_id = draws.d group by all),
tested as (
  select run, inlier, 0 as draw, detector_id, truth as y, score from near_scores where split = 'test'
  union all select run, inlier, draw, 'ens', y, score from mixed),
{metrics_sql('run, inlier, draw, detector_id', 'tested')}
select case when draw = 0 then 'lleae' else 'ens' end as model, round(auc, 6) as auc, round(ap, 6) as ap,
  {settings_sql('case when draw = 0 then 1 else draw end', "case when draw = 0 then substr(detector_id, 3)::int else -1 end")} from ranked""",
}
