"""Parents, inlier classes and contaminated splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textanomaly.operators import contaminate as tac
from textanomaly.operators import corpus as ops
from textanomaly.queries.shared import CORPUS, HIERARCHY, SEED, labelled_documents, order_sql, vector_corpus, vector_hierarchy

RUNS, CLASSES, NU, SIZE, MIN_SIZE = 10, 40, 0.1, 1000, 15


def document_hierarchy(docs):
    """Language over source; sources of one language are left out."""
    pairs = docs.select("label").distinct().withColumn("parent", F.substring_index("label", "/", 1))
    return pairs.where("parent <> 'de'")


def attach_parent(spark, folder):
    docs = labelled_documents(spark, folder)
    return ops.attach_parent(docs, document_hierarchy(docs)).select("doc_id", "label", "parent")


def unmapped(spark, folder):
    docs = labelled_documents(spark, folder)
    return ops.unmapped_labels(docs, document_hierarchy(docs))


def eligible(mode):
    def query(spark, folder):
        corpus = vector_corpus(spark, folder)
        return ops.eligible_inliers(corpus, mode, 50, vector_hierarchy(corpus))

    return query


def drawn(corpus, hierarchy=None, mode="independent"):
    train = corpus.where("split = 'train'")
    return tac.draw_inliers(ops.eligible_inliers(train, mode, MIN_SIZE, hierarchy), RUNS, CLASSES, SEED)


def draw(spark, folder):
    return drawn(vector_corpus(spark, folder))


def contaminated(corpus, mode, hierarchy=None, size=SIZE, nu=NU):
    inliers = drawn(corpus, hierarchy, mode)
    return tac.contaminate(corpus, inliers, mode, nu, size, SEED, hierarchy)


def contaminate(mode, size=SIZE, nu=NU, nested=True):
    def query(spark, folder):
        corpus = vector_corpus(spark, folder)
        return contaminated(corpus, mode, vector_hierarchy(corpus) if nested else None, size, nu)

    return query


def paired(spark, folder):
    """A corpus without a test split: train rows stand in for it."""
    corpus = vector_corpus(spark, folder).withColumn("split", F.lit("train"))
    hierarchy = vector_hierarchy(corpus)
    inliers = drawn(corpus, hierarchy, "contextual")
    pair = tac.paired_splits(corpus)
    return tac.contaminate(pair, inliers, "contextual", NU, SIZE, SEED, hierarchy)


def no_outliers(spark, folder):
    """Groups whose inlier class has no sibling, drawn as if they were eligible."""
    corpus = vector_corpus(spark, folder)
    hierarchy = vector_hierarchy(corpus)
    split = tac.contaminate(corpus, drawn(corpus), "contextual", NU, SIZE, SEED, hierarchy)
    return tac.without_outliers(split)


def inliers_sql(mode: str, runs: int = RUNS, classes: int = CLASSES) -> str:
    keep = "" if mode == "independent" else """and label in (select h.label from hierarchy h join
    (select parent from hierarchy group by parent having count(*) >= 2) s on h.parent = s.parent)"""
    return f"""eligible as (select label from corpus where split = 'train' group by label having count(*) >= {MIN_SIZE} {keep}),
drawn as (select r.run, label as inlier, row_number() over (partition by r.run
    order by {order_sql(f"'{SEED}'", "'inlier'", 'r.run::varchar', 'label::varchar')}, label) as k
  from eligible, (select unnest(range({runs}))::int as run) r qualify k <= {classes})"""


def split_sql(mode: str, size: int = SIZE, nu: float = NU, drawn_mode: str | None = None, **grid) -> str:
    """Common table expressions ending in ``chosen``: every class looks through all rows."""
    sibling = "<>" if mode == "independent" else "="
    return f"""{inliers_sql(drawn_mode or mode, **grid)},
placed as (select c.doc_id, c.label, c.split, h.parent from corpus c join hierarchy h on c.label = h.label),
groups as (select d.run, d.inlier, s.split, h.parent as p,
    least(coalesce(n.n, 0), {size})::int as m, trunc(least(coalesce(n.n, 0), {size}) * {nu}::double)::int as c
  from drawn d join (select distinct split from corpus) s on true join hierarchy h on d.inlier = h.label
  left join (select split, label, count(*) as n from corpus group by all) n on n.split = s.split and n.label = d.inlier),
ordered as (select g.run, g.inlier, g.split, g.m, g.c, x.doc_id, x.label, x.parent, (x.label <> g.inlier)::int as y,
    row_number() over (partition by g.run, g.inlier, g.split, x.label <> g.inlier
      order by {order_sql(f"'{SEED}'", 'g.run::varchar', 'x.split', 'x.doc_id::varchar')}, x.doc_id) as k
  from groups g join placed x on x.split = g.split
   and (x.label = g.inlier or (x.label <> g.inlier and x.parent {sibling} g.p))),
chosen as (select run, inlier, split, doc_id, label, parent, y from ordered
  where k <= case when y = 0 then m - c else greatest(c, 1) end)"""


FLAT = "hierarchy as (select distinct label, label as parent from corpus)"


def full_sql(mode: str, corpus: str = CORPUS, hierarchy: str = HIERARCHY, **options) -> str:
    return f"with {corpus}, {hierarchy}, {split_sql(mode, **options)} select * from chosen"


TRAIN_ONLY = CORPUS.replace("case when vec_id % 2 = 0 then 'train' else 'test' end as split", "unnest(['train', 'test']) as split")

QUERIES = {
    "attach_parent": attach_parent,
    "unmapped_labels": unmapped,
    "eligible_independent": eligible("independent"),
    "eligible_contextual": eligible("contextual"),
    "draw_inliers": draw,
    "contaminate_independent": contaminate("independent"),
    "contaminate_contextual": contaminate("contextual"),
    "contaminate_flat": contaminate("independent", nested=False),
    "contaminate_cut": contaminate("contextual", size=20),
    "contaminate_heavy": contaminate("contextual", size=350, nu=1.0),
    "contaminate_none": contaminate("independent", size=350, nu=0.0),
    "contaminate_paired": paired,
    "no_outliers": no_outliers,
}

ORACLES = {
    "attach_parent": """select doc_id, lang || '/' || source as label, case when lang <> 'de' then lang end as parent
from documents""",
    "unmapped_labels": "select lang || '/' || source as label, count(*) as n from documents where lang = 'de' group by all",
    "eligible_independent": "select label, count(*) as n from embeddings group by label having count(*) >= 50",
    "eligible_contextual": f"""with {HIERARCHY} select label, count(*) as n from embeddings where label in (
  select label from hierarchy where parent in (select parent from hierarchy group by parent having count(*) >= 2))
group by label having count(*) >= 50""",
    "draw_inliers": f"with {CORPUS}, {HIERARCHY}, {inliers_sql('independent')} select run, inlier from drawn",
    "contaminate_independent": full_sql("independent"),
    "contaminate_contextual": full_sql("contextual"),
    "contaminate_flat": full_sql("independent", hierarchy=FLAT),
    "contaminate_cut": full_sql("contextual", size=20),
    "contaminate_heavy": full_sql("contextual", size=350, nu=1.0),
    "contaminate_none": full_sql("independent", size=350, nu=0.0),
    "contaminate_paired": full_sql("contextual", corpus=TRAIN_ONLY),
    "no_outliers": f"""with {CORPUS}, {HIERARCHY}, {split_sql('contextual', drawn_mode='independent')}
select run, inlier, split, sum(y)::bigint as outliers from chosen group by all having sum(y) = 0""",
}
