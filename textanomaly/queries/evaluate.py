"""Score scaling, ensembles, decisions and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textanomaly.detectors.spec import base
from textanomaly.operators import ensemble, metrics
from textanomaly.queries.shared import CORPUS, DIM, HIERARCHY, SEED, bits_sql, order_sql, rounded, scratch, table, vector_corpus, vector_hierarchy
from textanomaly.queries.splits import contaminated, split_sql
from textanomaly.session import small_side
from textanomaly.sources.corpus import save_results

DETECTORS = DIM + 1  # the coordinates of the vector and a constant


def coordinate_scores(spark, folder):
    """Stand-in detector scores that need no training."""
    corpus = vector_corpus(spark, folder)
    values = F.concat(
        F.transform(F.slice("embedding", 1, DETECTORS - 1), lambda v: F.abs(v.cast("double"))), F.array(F.lit(1.0))
    )
    return corpus.select("doc_id", "label", "split", F.posexplode(values).alias("detector_id", "score"))


def scaled_scores(spark, folder):
    scores = coordinate_scores(spark, folder)
    scaler = ensemble.fit_score_scaler(scores.where("split = 'train'"), [])
    return ensemble.apply_score_scaler(scores, scaler, [])


def matrix(spark, folder):
    scores = coordinate_scores(spark, folder)
    wide = ensemble.score_matrix(scores, list(range(DETECTORS)), ["doc_id"])
    return wide.select("doc_id", *[F.round(F.col(str(d)), 6).alias(f"d{d}") for d in range(DETECTORS)])


def zscale(spark, folder):
    return scaled_scores(spark, folder).select("doc_id", "detector_id", F.round("z", 6).alias("z"))


def combined(how):
    def query(spark, folder):
        return ensemble.combine(scaled_scores(spark, folder), ["doc_id"], how).withColumns(rounded("score"))

    return query


def sub(spark, folder):
    scores = scaled_scores(spark, folder)
    draws = ensemble.draw_detectors(scores, [2, 3, 5, 8], SEED)
    return ensemble.sub_ensemble(scores, ["doc_id"], draws).withColumns(rounded("score"))


def event_scores(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "event_type", F.col("value").alias("score")
    )


def thresholds(spark, folder):
    return ensemble.threshold(event_scores(spark, folder), ["event_type"], 0.1).withColumns(rounded("threshold"))


def threshold_all(spark, folder):
    return ensemble.threshold(event_scores(spark, folder), [], 0.05, ranges=64).withColumns(rounded("threshold"))


def predicted(spark, folder):
    scores = event_scores(spark, folder)
    limits = ensemble.threshold(scores, ["event_type"], 0.1, ranges=16)
    return ensemble.predict(scores, limits, ["event_type"]).select("event_id", "label")


def predicted_by_detector(spark, folder):
    """Labels of every stand-in detector, half of them with another contamination."""
    scores = coordinate_scores(spark, folder).withColumn("detector_id", F.col("detector_id").cast("string"))
    specs = [base(str(d), contamination=0.1 if d < 4 else 0.3) for d in range(DETECTORS)]
    limits = ensemble.detector_thresholds(scores.where("split = 'train'"), specs, ["label"], ranges=1)
    labelled = ensemble.predict(scores.withColumnRenamed("label", "class"), limits.withColumnRenamed("label", "class"), ["class", "detector_id"])
    return labelled.select("doc_id", "detector_id", "label")


def ensemble_labels(spark, folder):
    """Labels of the ensemble of all stand-in detectors within each class."""
    scores = coordinate_scores(spark, folder).withColumnRenamed("label", "class")
    return ensemble.decide(scores, ["class"], "median", 0.1).select("doc_id", F.round("score", 6).alias("score"), "label")


def proba(how):
    def query(spark, folder):
        scores = event_scores(spark, folder)
        fitted = ensemble.fit_proba(scores, ["event_type"])
        result = ensemble.predict_proba(scores, fitted, ["event_type"], how)
        return result.select("event_id", F.round("proba", 6).alias("proba"))

    return query


def truths(spark, folder, score):
    return table(spark, folder, "events").select(
        (F.col("user_id") % 5).alias("g"), (F.col("event_type") == "error").cast("int").alias("y"), score.alias("score")
    )


def auc(spark, folder):
    return metrics.roc_auc(truths(spark, folder, F.floor("value")), ["g"]).withColumns(rounded("auc", digits=8))


def ap(spark, folder):
    scored = truths(spark, folder, F.floor("value"))
    return metrics.average_precision(scored, ["g"]).withColumns(rounded("ap", digits=8))


def continuous(spark, folder):
    scored = truths(spark, folder, F.col("value"))
    return metrics.ranking_metrics(scored, ["g"], ranges=64).withColumns(rounded("auc", "ap", digits=8))


def overall(spark, folder):
    """One group holding every row, ranked in 256 pieces."""
    return metrics.ranking_metrics(truths(spark, folder, F.col("value")), [], ranges=256).withColumns(rounded("auc", "ap", digits=8))


def split_scores(spark, folder):
    corpus = vector_corpus(spark, folder)
    split = contaminated(corpus, "contextual", vector_hierarchy(corpus)).select("run", "inlier", "split", "doc_id", "y")
    return coordinate_scores(spark, folder).drop("split", "label").join(small_side(split), "doc_id")


def by_detector(spark, folder):
    tested = split_scores(spark, folder).where("split = 'test'")
    return metrics.ranking_metrics(tested, ["run", "inlier", "detector_id"], ranges=1)


def summary(spark, folder):
    named = by_detector(spark, folder).withColumnRenamed("detector_id", "model")
    return metrics.summary(named).withColumns(rounded("auc", "ap"))


def saved(spark, folder):
    path = scratch(spark, "results")
    results = by_detector(spark, folder).withColumns(rounded("auc", "ap"))
    save_results(results, path)
    save_results(spark.read.parquet(path).where("run = 0"), path + "-again")
    save_results(results.where("run > 0"), path + "-again")
    stored = spark.read.parquet(path + "-again")
    return stored.select("run", "inlier", "detector_id", "auc", "ap")


def curve(spark, folder):
    keys = ["run", "inlier"]
    scores = split_scores(spark, folder)
    scaler = ensemble.fit_score_scaler(scores.where("split = 'train'"), keys)
    scaled = ensemble.apply_score_scaler(scores.where("split = 'test'"), scaler, keys)
    draws = ensemble.draw_detectors(scores, list(range(2, DETECTORS)), SEED)
    drawn = ensemble.sub_ensemble(scaled, [*keys, "doc_id", "y"], draws)
    rounded_scores = drawn.withColumns(rounded("score", digits=9))
    return metrics.ranking_metrics(rounded_scores, [*keys, "draw"], ranges=1).withColumns(rounded("auc", "ap"))


SCORES = f"""{CORPUS},
scores as (select doc_id, label, split, unnest(range({DETECTORS}))::int as detector_id,
  unnest(list_append(list_transform(embedding[1:{DETECTORS - 1}], lambda v: abs(v)), 1.0::double)) as score from corpus)"""
SCALED = f"""{SCORES},
fitted as (select detector_id, avg(score) as mu, stddev_pop(score) as sigma from scores where split = 'train' group by all),
scaled as (select s.doc_id, s.detector_id, (score - mu) / case when sigma = 0 then 1 else sigma end as z
  from scores s join fitted f on s.detector_id = f.detector_id)"""
DRAWS = f"""draws as (select n as draw, {bits_sql(order_sql(f"'{SEED}'", "'draw'", 'n::varchar', 'slot::varchar'))} % {DETECTORS} as d
  from (select n, unnest(range(n))::int as slot from (select unnest({{sizes}})::int as n)))"""
EVENTS = """e as (select event_id, event_type, value as score from events)"""
FITTED = """fitted as (select event_type, min(score) lo, max(score) hi, avg(score) mu, stddev_pop(score) sigma
  from e group by event_type)"""
# erf by its all-positive series: 2/sqrt(pi) exp(-x²) sum 2^n x^(2n+1) / (2n+1)!!
ERF = """case when x <= 0 then 0 when x > 5.9 then 1 else least(1, 2 / sqrt(pi()) * exp(-x * x) *
  list_sum(list_transform(range(0, 140), lambda n: exp(2 * n * ln(2) + lgamma(n + 1.0::double) - lgamma(2 * n + 2.0::double)
    + (2 * n + 1) * ln(x))))) end"""


def metrics_sql(keys: str, source: str) -> str:
    """Ranking metrics of ``source(keys, y, score)`` by cumulative sums over distinct scores."""
    group = f"partition by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    tail = f"group by {keys}" if keys else ""
    return f"""t as (select {lead}score, sum(y)::double as p, count(*)::double as n from {source} group by {lead}score),
u as (select *, sum(p) over ({group} order by score desc) as cp, sum(n) over ({group} order by score desc) as cn,
  sum(n - p) over ({group} order by score) - (n - p) as below,
  sum(p) over ({group}) as tp, sum(n) over ({group}) as tn from t),
ranked as (select {lead}sum(p * (below + 0.5::double * (n - p))) / nullif(max(tp) * (max(tn) - max(tp)), 0) as auc,
  sum(p / nullif(tp, 0) * cp / cn) as ap from u {tail})"""


TRUTHS = "truths as (select user_id % 5 as g, (event_type = 'error')::int as y, {} as score from events)"
SPLIT_SCORES = f"""{SCORES}, {HIERARCHY}, {split_sql('contextual')},
joined as (select c.run, c.inlier, c.split, c.doc_id, c.y, s.detector_id, s.score
  from chosen c join scores s on c.doc_id = s.doc_id),
tested as (select * from joined where split = 'test')"""
RUN_KEYS = "run, inlier, detector_id"
CURVE = f"""fitted as (select {RUN_KEYS}, avg(score) as mu, stddev_pop(score) as sigma from joined where split = 'train' group by all),
z as (select t.run, t.inlier, t.doc_id, t.y, t.detector_id, (score - mu) / case when sigma = 0 then 1 else sigma end as z
  from tested t join fitted f on t.run = f.run and t.inlier = f.inlier and t.detector_id = f.detector_id),
{DRAWS.format(sizes=f'range(2, {DETECTORS})')},
curve as (select run, inlier, draw, doc_id, y, round(median(z), 9) as score from z join draws on z.detector_id = draws.d
  group by all)"""


def combine_sql(call: str) -> str:
    return f"with {SCALED} select doc_id, round({call}(z), 6) as score from scaled group by doc_id"


def proba_sql(raw: str) -> str:
    return f"""with {EVENTS}, {FITTED},
p as (select event_id, (score - lo) / (hi - lo) as linear, (score - mu) / (sigma * sqrt(2)) as x
  from e join fitted f on e.event_type = f.event_type)
select event_id, round({raw}, 6) as proba from p"""


QUERIES = {
    "score_matrix": matrix,
    "score_zscale": zscale,
    "combine_avg": combined("average"),
    "combine_max": combined("maximisation"),
    "combine_median": combined("median"),
    "sub_ensemble": sub,
    "threshold": thresholds,
    "threshold_all": threshold_all,
    "predict": predicted,
    "predict_detectors": predicted_by_detector,
    "ensemble_labels": ensemble_labels,
    "proba_linear": proba("linear"),
    "proba_unify": proba("unify"),
    "roc_auc": auc,
    "average_precision": ap,
    "ranking_continuous": continuous,
    "ranking_overall": overall,
    "results_summary": summary,
    "save_results": saved,
    "ensemble_curve": curve,
}

ORACLES = {
    "score_matrix": f"""with {SCORES} select doc_id,
{', '.join(f'round(max(score) filter (detector_id = {d}), 6) as d{d}' for d in range(DETECTORS))} from scores group by doc_id""",
    "score_zscale": f"with {SCALED} select doc_id, detector_id, round(z, 6) as z from scaled",
    "combine_avg": combine_sql("avg"),
    "combine_max": combine_sql("max"),
    "combine_median": combine_sql("median"),
    "sub_ensemble": f"""with {SCALED}, {DRAWS.format(sizes='[2, 3, 5, 8]')}
select doc_id, draw, round(median(z), 6) as score from scaled s join draws on s.detector_id = draws.d group by doc_id, draw""",
    "threshold": f"""with {EVENTS} select event_type, round(quantile_cont(score, 0.9), 6) as threshold
from e group by event_type""",
    "threshold_all": f"with {EVENTS} select round(quantile_cont(score, 0.95), 6) as threshold from e",
    "predict": f"""with {EVENTS}, t as (select event_type, quantile_cont(score, 0.9) as threshold from e group by all)
select event_id, (score > threshold)::int as label from e join t on e.event_type = t.event_type""",
    "predict_detectors": f"""with {SCORES}, limits as (select label, detector_id,
    case when detector_id < 4 then quantile_cont(score, 0.9) else quantile_cont(score, 0.7) end as threshold
  from scores where split = 'train' group by label, detector_id)
select s.doc_id, s.detector_id::varchar as detector_id, (s.score > t.threshold)::int as label
from scores s join limits t on s.label = t.label and s.detector_id = t.detector_id""",
    "ensemble_labels": f"""with {SCORES}, moments as (select label, detector_id, avg(score) as mu, stddev_pop(score) as sigma
  from scores where split = 'train' group by label, detector_id),
merged as (select s.label, s.split, s.doc_id, median((score - mu) / case when sigma = 0 then 1 else sigma end) as score
  from scores s join moments m on s.label = m.label and s.detector_id = m.detector_id group by all),
limits as (select label, quantile_cont(score, 0.9) as threshold from merged where split = 'train' group by label)
select doc_id, round(score, 6) as score, (score > threshold)::int as label from merged m join limits l on m.label = l.label""",
    "proba_linear": proba_sql("greatest(0, least(1, linear))"),
    "proba_unify": proba_sql(ERF),
    "roc_auc": f"""with {TRUTHS.format('floor(value)')}, {metrics_sql('g', 'truths')}
select g, round(auc, 8) as auc from ranked""",
    "average_precision": f"""with {TRUTHS.format('floor(value)')}, {metrics_sql('g', 'truths')}
select g, round(ap, 8) as ap from ranked""",
    "ranking_continuous": f"""with {TRUTHS.format('value')}, {metrics_sql('g', 'truths')}
select g, round(auc, 8) as auc, round(ap, 8) as ap from ranked""",
    "ranking_overall": f"""with {TRUTHS.format('value')}, {metrics_sql('', 'truths')}
select round(auc, 8) as auc, round(ap, 8) as ap from ranked""",
    "results_summary": f"""with {SPLIT_SCORES}, {metrics_sql(RUN_KEYS, 'tested')}
select detector_id as model, round(avg(auc), 6) as auc, round(avg(ap), 6) as ap from ranked group by detector_id""",
    "save_results": f"""with {SPLIT_SCORES}, {metrics_sql(RUN_KEYS, 'tested')}
select {RUN_KEYS}, round(auc, 6) as auc, round(ap, 6) as ap from ranked""",
    "ensemble_curve": f"""with {SPLIT_SCORES}, {CURVE}, {metrics_sql('run, inlier, draw', 'curve')}
select run, inlier, draw, round(auc, 6) as auc, round(ap, 6) as ap from ranked""",
}
