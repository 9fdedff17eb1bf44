"""Scaling, neighbours and loss measures on the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textanomaly.functions.vectors import as_double, matrix, times_rows
from textanomaly.operators import losses, neighbours, scale
from textanomaly.queries.shared import CORPUS, DIM, bits_sql, order_sql, rounded, table, vector_corpus

BATCH = 30


def standardize(spark, folder):
    corpus = vector_corpus(spark, folder)
    scaler = scale.fit_scaler(corpus.where("split = 'train'"), ["label"])
    scaled = scale.apply_scaler(corpus, scaler, ["label"])
    long = scaled.select("doc_id", "label", F.posexplode("embedding").alias("dim", "value"))
    return long.withColumns(rounded("value", digits=5))


def minmax(spark, folder):
    return scale.minmax(table(spark, folder, "events").select("event_id", "value"), "value").withColumns(rounded("value"))


def minmax_by_type(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    return scale.minmax(events, "value", ["event_type"]).withColumns(rounded("value"))


def knn(spark, folder):
    near = neighbours.knn(vector_corpus(spark, folder), ["label"], 5, BATCH)
    return near.withColumns(rounded("dist"))


def weights(outputs):
    return [[(i * (q + 3) % 7 - 3) / 10 for q in range(outputs)] for i in range(DIM)]


def neighbour_sum(spark, folder):
    corpus = vector_corpus(spark, folder)
    near = neighbours.knn(corpus, ["label"], 5, BATCH)
    sums = neighbours.neighbour_sum(corpus, near, weights(2))
    return sums.select("id", *[F.round(F.col("local_sum")[q], 6).alias(f"s{q}") for q in range(2)])


def reversed_rows(spark, folder):
    corpus = vector_corpus(spark, folder).select("doc_id", "label", as_double(F.col("embedding")).alias("x"))
    return corpus.withColumn("xhat", F.reverse("x"))


def recon(kind):
    def query(spark, folder):
        return losses.recon_error(reversed_rows(spark, folder), "x", "xhat", kind, ["label"]).withColumns(rounded("error"))

    return query


def latent_rows(spark, folder):
    """Rows with their latent: the whole vector times the weights."""
    columns = matrix([list(column) for column in zip(*weights(3))])
    return reversed_rows(spark, folder).withColumn("z", times_rows(F.col("x"), columns))


def subspace(spark, folder):
    rows = latent_rows(spark, folder)
    return losses.subspace_error(rows, "x", "z", weights(3), "MSE", ["label"]).withColumns(rounded("error"))


def ortho(spark, folder):
    long = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    cells = long.groupBy("i", F.col("label").alias("j")).agg((F.avg(F.col("v").cast("double")) * 10).alias("v"))
    return losses.ortho_error(cells).withColumns(rounded("error"))


def lambda_grid(spark, folder):
    """The robust loss of every label under the 11 x 11 x 11 weight combinations."""
    rows = latent_rows(spark, folder)
    recon_part = losses.recon_error(rows, "x", "xhat", "MSE", ["label"])
    near = losses.subspace_error(rows, "x", "z", weights(3), "MSE", ["label"]).withColumnRenamed("error", "pca")
    cells = rows.select(F.posexplode("z").alias("i", "v"), "doc_id").select(F.col("doc_id").alias("i"), F.col("i").alias("j"), "v")
    gram = losses.ortho_error(cells)
    steps = F.sequence(F.lit(0), F.lit(10))
    grid = recon_part.join(near, "label")
    for axis in ("lambda1", "lambda2", "lambda3"):
        grid = grid.withColumn(axis, F.explode(steps)).withColumn(axis, F.col(axis) / F.lit(10.0).cast("double"))
    loss = F.col("error") + (F.col("lambda1") + 0.1) * F.col("pca") + F.col("lambda2") * gram.scalar()
    return grid.select("label", "lambda1", "lambda2", "lambda3", F.round(loss, 5).alias("loss"))


def recon_sql(row: str) -> str:
    return f"select label, round(avg(err), 6) as error from (select label, {row} as err from rows) group by label"


WEIGHT = "((({i} - 1) * ({q} + 2) % 7 - 3) / 10.0::double)"
LATENT = ", ".join(
    f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: x[i] * {WEIGHT.format(i='i', q=q)}))" for q in (1, 2, 3)
)
ROWS = f"""rows as (select doc_id, label, x, list_reverse(x) as xhat, [{LATENT}] as z
  from (select vec_id as doc_id, label, embedding::double[] as x from embeddings))"""
BACK = " + ".join(f"z[{q}] * {WEIGHT.format(i='i', q=q)}" for q in (1, 2, 3))
PCA = f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: power(x[i] - ({BACK}), 2)))"
KNN = f"""with {CORPUS},
sized as (select *, ceil(count(*) over (partition by label) / {BATCH}::double)::bigint as batches from corpus),
batched as (select doc_id, label, embedding,
  {bits_sql(order_sql("'0'", "'batch'", 'doc_id::varchar'))} % batches as batch from sized),
pairs as (select a.label, a.batch, a.doc_id as id, b.doc_id as nbr,
  case when a.doc_id = b.doc_id then 'infinity'::double else list_distance(a.embedding, b.embedding) end as dist
  from batched a join batched b on a.label = b.label and a.batch = b.batch),
near as (select *, row_number() over (partition by label, batch, id order by dist, nbr)::int as rank from pairs qualify rank <= 5)"""
SUMS = ", ".join(
    f"round(sum(list_sum(list_transform(range(1, {DIM + 1}), lambda i: embedding[i] * "
    f"(((i - 1) * ({q} + 3) % 7 - 3) / 10.0::double)))), 6) as s{q}"
    for q in (0, 1)
)
GRAM = """(select sum(power(g - case when a = b then 1 else 0 end, 2)) / count(*) from (
  select a.j as a, b.j as b, sum(a.v * b.v) as g from {cells} a join {cells} b on a.i = b.i group by a.j, b.j))"""

QUERIES = {
    "standardize_features": standardize,
    "minmax": minmax,
    "minmax_by_key": minmax_by_type,
    "knn": knn,
    "neighbour_sum": neighbour_sum,
    "recon_mse": recon("MSE"),
    "recon_l1": recon("L1"),
    "recon_l21": recon("L21"),
    "subspace_error": subspace,
    "ortho_error": ortho,
    "lambda_grid": lambda_grid,
}

ORACLES = {
    "standardize_features": f"""with {CORPUS},
long as (select doc_id, label, split, unnest(range({DIM}))::int as dim, unnest(embedding) as v from corpus),
stats as (select label, dim, avg(v) as mu, stddev_pop(v) as sigma from long where split = 'train' group by label, dim)
select doc_id, l.label, l.dim, round((v - mu) / case when sigma = 0 then 1 else sigma end, 5) as value
from long l join stats s on l.label = s.label and l.dim = s.dim""",
    "minmax": """select event_id, round((value - (select min(value) from events)) /
((select max(value) from events) - (select min(value) from events)), 6) as value from events""",
    "minmax_by_key": """select event_id, event_type, round((value - min(value) over w) /
(max(value) over w - min(value) over w), 6) as value from events window w as (partition by event_type)""",
    "knn": f"{KNN} select label, batch, id, nbr, rank, round(dist, 6) as dist from near",
    "neighbour_sum": f"{KNN} select n.id, {SUMS} from near n join corpus c on n.nbr = c.doc_id group by n.id",
    "recon_mse": f"with {ROWS} " + recon_sql("power(list_distance(x, xhat), 2)"),
    "recon_l1": f"with {ROWS} " + recon_sql(f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: abs(x[i] - xhat[i])))"),
    "recon_l21": f"with {ROWS} " + recon_sql("list_distance(x, xhat)"),
    "subspace_error": f"with {ROWS} " + recon_sql(PCA),
    "ortho_error": f"""with long as (select label, unnest(range({DIM})) as i, unnest(embedding::double[]) as v from embeddings),
cells as (select i, label as j, avg(v) * 10 as v from long group by i, label)
select round({GRAM.format(cells='cells')}, 6) as error""",
    "lambda_grid": f"""with {ROWS},
base as (select label, avg(power(list_distance(x, xhat), 2)) as error, avg({PCA}) as pca from rows group by label),
cells as (select doc_id as i, unnest(range(3)) as j, unnest(z) as v from rows),
steps as (select unnest(range(11)) / 10.0::double as s)
select label, a.s as lambda1, b.s as lambda2, c.s as lambda3,
  round(error + (a.s + 0.1::double) * pca + b.s * {GRAM.format(cells='cells')}, 5) as loss
from base, steps a, steps b, steps c""",
}
