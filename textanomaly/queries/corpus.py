"""Corpus preparation and embedding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textanomaly.functions.text import ALPHANUMERIC, BASIC_ENGLISH_RULES, TREEBANK_RULES, WHITESPACE, basic_english_tokens
from textanomaly.operators import corpus as ops
from textanomaly.operators import embed
from textanomaly.operators.embed import PUNCTUATION
from textanomaly.plans.prepare import prepare, prepare_files
from textanomaly.queries.shared import SEED, labelled_documents, order_sql, scratch, table
from textanomaly.session import settle, shuffles_removed, widen
from textanomaly.sources.corpus import cached, load_corpus


def texts(spark, folder):
    return widen(table(spark, folder, "documents").select("doc_id", "text"))


def harmonize(spark, folder):
    raw = load_corpus(spark, f"{folder}/documents.parquet", "train", dataset="Newsgroups")
    shaped = raw.select("doc_id", F.col("text").alias("sentence"), F.col("source").alias("label"), F.col("lang").alias("text"), "split")
    return ops.harmonize(shaped, keep=["doc_id", "split"])


def topics(spark, folder):
    docs = table(spark, folder, "documents")
    listed = (
        F.when(F.col("n_chars") < 200, F.array().cast("array<string>"))
        .when(F.col("n_chars") > 5000, F.array("lang", "source"))
        .otherwise(F.array("lang"))
    )
    tagged = docs.select("doc_id", listed.alias("topics"), "lang", "text")
    # one language is left without a number
    ranked = docs.groupBy("lang").agg(F.min("doc_id").alias("label")).where("lang <> 'fr'")
    categories = ranked.select(F.col("lang").alias("topic"), F.col("label").cast("string").alias("label"))
    return ops.single_topic(tagged, categories, "topics").select("doc_id", "label", "text")


def non_empty(spark, folder):
    text = F.when(F.col("lang") == "es", None).when(F.col("n_chars") < 200, "").otherwise(F.col("text"))
    return ops.non_empty(table(spark, folder, "documents").select("doc_id", text.alias("text")))


def cap(spark, folder):
    return ops.cap_per_label(labelled_documents(spark, folder), 10, SEED).select("doc_id", "label")


def cap_by_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("label"))
    return ops.cap_per_label(docs, 100, SEED)


def cleaned(**flags):
    return lambda spark, folder: ops.clean(texts(spark, folder), **flags)


def word_vectors(docs):
    """Four numbers for every distinct token but those of three letters."""
    words = docs.select(F.explode(basic_english_tokens(F.col("text"))).alias("token")).distinct()
    size, first, last = F.length("token"), F.ascii("token"), F.ascii(F.reverse("token"))
    values = [size % 7 / F.lit(7.0), first % 11 / F.lit(11.0), last % 13 / F.lit(13.0), size * first % 17 / F.lit(17.0) - 0.5]
    return words.where(size != 3).select("token", F.array(*[v.cast("float") for v in values]).alias("vector"))


def pooled(how, oov="zero", joined=False, tokenizer="basic_english", **options):
    def query(spark, folder):
        docs = texts(spark, folder)
        pool = embed.pool_by_join if joined else embed.pool_word_vectors
        with shuffles_removed(spark):
            vectors = settle(word_vectors(docs))
        result = pool(docs, vectors, 4, how, oov, tokenizer, **options)
        return result.select("doc_id", *[F.round(F.col("embedding")[i].cast("double"), 5).alias(f"v{i}") for i in range(4)])

    return query


def letter_counts():
    """A stand-in encoder: length, and counts of three characters."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count(" "), t.count("e"), t.count("a")] for t in texts])

    return encode


def embed_with(spark, folder):
    vectors = embed.embed_with(texts(spark, folder), letter_counts, 4)
    return vectors.select("doc_id", *[F.col("embedding")[i].cast("long").alias(f"v{i}") for i in range(4)])


def dimensions(spark, folder):
    return embed.check_dim(table(spark, folder, "embeddings"), 64)


def stage(spark, folder):
    def build():
        return ops.cap_per_label(labelled_documents(spark, folder), 10, SEED)

    settings = {"folder": folder, "cap": 10, "seed": SEED}
    return cached(spark, build, scratch(spark, "stages"), settings).select("doc_id", "label", F.length("text").alias("n"))


def prepared(spark, folder):
    raw = widen(labelled_documents(spark, folder)).withColumn("split", F.lit("train"))
    result = prepare(raw, lambda df: embed.embed_with(df, letter_counts, 4), lowercase=True, alnum=True, cap=10, seed=SEED)
    return result.select("doc_id", "label", *[F.col("embedding")[i].cast("long").alias(f"v{i}") for i in range(4)])


def prepared_files(spark, folder):
    """Every text of the table, prepared by files; the second call finds all of them done."""

    def shape(raw):
        return raw.select("doc_id", F.concat_ws("/", "lang", "source").alias("label"), "text", F.lit("train").alias("split"))

    def call():
        embed_letters = lambda df: embed.embed_with(df, letter_counts, 4)
        return prepare_files(spark, f"{folder}/documents.parquet", embed_letters, scratch(spark, "files"), shape=shape, lowercase=True, alnum=True)

    call()
    return call().select("doc_id", "label", *[F.col("embedding")[i].cast("long").alias(f"v{i}") for i in range(4)])


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rules_sql(column: str, rules) -> str:
    for pattern, replacement in rules:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return column


def words_sql(column: str) -> str:
    return f"list_filter(string_split_regex({column}, {quoted(WHITESPACE)}), lambda w: w <> '')"


def clean_sql(column: str, alnum: bool = False) -> str:
    words = words_sql(rules_sql(column, TREEBANK_RULES))
    if alnum:
        words = f"list_filter({words}, lambda w: regexp_matches(w, {quoted(ALPHANUMERIC)}))"
    return f"array_to_string({words}, ' ')"


POOL = f"""with tokens as (
  select doc_id, unnest({words_sql(rules_sql('lower(text)', BASIC_ENGLISH_RULES))}) as token from documents),
vectors as (
  select token, (length(token) % 7 / 7.0::double)::float as x0, (ord(token) % 11 / 11.0::double)::float as x1,
         (ord(reverse(token)) % 13 / 13.0::double)::float as x2,
         (length(token) * ord(token) % 17 / 17.0::double - 0.5::double)::float as x3
  from (select distinct token from tokens) where length(token) <> 3),
found as (select doc_id, t.token, x0::double x0, x1::double x1, x2::double x2, x3::double x3, v.token is not null as known
          from tokens t left join vectors v on t.token = v.token)"""


def pool_sql(how: str, oov: str = "zero") -> str:
    value = "coalesce(x{0}, 0)" if oov == "zero" else "x{0}"
    call = {"mean": "avg", "max": "max", "sum": "sum"}[how]
    keep = "" if oov == "zero" else "and f.known"
    columns = ", ".join(f"round(coalesce({call}({value.format(i)}), 0), 5) as v{i}" for i in range(4))
    # with every token known or zero, a text without rows gets zeros
    return f"{POOL} select d.doc_id, {columns} from documents d left join found f on d.doc_id = f.doc_id {keep} group by d.doc_id"


def forms_sql(fallbacks: int) -> str:
    """The mean of the known tokens cut at white space, each looked up in ``fallbacks`` further forms."""
    forms = ["t.token", "lower(t.token)", f"regexp_replace(lower(t.token), {quoted(f'^{PUNCTUATION}|{PUNCTUATION}$')}, '', 'g')"]
    joins = " ".join(f"left join vectors f{i} on f{i}.token = {form}" for i, form in enumerate(forms[: fallbacks + 1]))
    value = "coalesce(" + ", ".join(f"f{i}.x{{0}}" for i in range(fallbacks + 1)) + ")::double"
    columns = ", ".join(f"round(coalesce(avg({value.format(i)}), 0), 5) as v{i}" for i in range(4))
    return f"""{POOL}, cut as (select doc_id, unnest({words_sql('text')}) as token from documents)
select d.doc_id, {columns} from documents d left join cut t on d.doc_id = t.doc_id {joins} group by d.doc_id"""


LETTERS = ", ".join(f"length(t) - length(replace(t, '{c}', '')) as v{i}" for i, c in ((1, " "), (2, "e"), (3, "a")))
CAPPED = f"""(select *, row_number() over (partition by label
     order by {order_sql(f"'{SEED}'", 'doc_id::varchar')}, doc_id) as k
   from (select doc_id, lang || '/' || source as label, text from documents))"""

QUERIES = {
    "corpus_harmonize": harmonize,
    "single_topic": topics,
    "non_empty": non_empty,
    "cap_per_label": cap,
    "cap_per_language": cap_by_language,
    "clean_text": cleaned(),
    "clean_text_lower": cleaned(lowercase=True),
    "clean_text_alnum": cleaned(alnum=True),
    "pool_mean": pooled("mean"),
    "pool_max": pooled("max"),
    "pool_sum": pooled("sum"),
    "pool_skip_oov": pooled("mean", "skip"),
    "pool_mean_joined": pooled("mean", joined=True),
    "pool_max_joined": pooled("max", "skip", joined=True),
    "pool_sum_few_heavy": pooled("sum", joined=True, heavy_bytes=32 * 50),
    "pool_skip_few_heavy": pooled("mean", "skip", joined=True, heavy_bytes=32 * 50),
    "pool_sentence": pooled("mean", "skip", tokenizer="sentence"),
    "pool_sentence_joined": pooled("mean", "skip", joined=True, tokenizer="sentence"),
    "pool_lowercase": pooled("mean", "skip", tokenizer="whitespace"),
    "pool_lowercase_joined": pooled("mean", "skip", joined=True, tokenizer="whitespace"),
    "embed_with": embed_with,
    "check_dim": dimensions,
    "stage_roundtrip": stage,
    "prepare_corpus": prepared,
    "prepare_files": prepared_files,
}

ORACLES = {
    "corpus_harmonize": "select doc_id, 'train' as split, source as label, text from documents",
    "single_topic": """select d.doc_id, c.label, d.text from documents d
join (select lang, min(doc_id)::varchar as label from documents where lang <> 'fr' group by lang) c on d.lang = c.lang
where d.n_chars between 200 and 5000""",
    "non_empty": "select doc_id, text from documents where lang <> 'es' and n_chars >= 200 and length(text) > 0",
    "cap_per_label": f"select doc_id, label from {CAPPED} where k <= 10",
    "cap_per_language": f"""select doc_id, label from (select doc_id, lang as label, row_number() over (partition by lang
order by {order_sql(f"'{SEED}'", 'doc_id::varchar')}, doc_id) as k from documents) where k <= 100""",
    "clean_text": f"select doc_id, {clean_sql('text')} as text from documents",
    "clean_text_lower": f"select doc_id, {clean_sql('lower(text)')} as text from documents",
    "clean_text_alnum": f"select doc_id, {clean_sql('text', True)} as text from documents",
    "pool_mean": pool_sql("mean"),
    "pool_max": pool_sql("max"),
    "pool_sum": pool_sql("sum"),
    "pool_skip_oov": pool_sql("mean", "skip"),
    "pool_mean_joined": pool_sql("mean"),
    "pool_max_joined": pool_sql("max", "skip"),
    "pool_sum_few_heavy": pool_sql("sum"),
    "pool_skip_few_heavy": pool_sql("mean", "skip"),
    "pool_sentence": forms_sql(2),
    "pool_sentence_joined": forms_sql(2),
    "pool_lowercase": forms_sql(1),
    "pool_lowercase_joined": forms_sql(1),
    "embed_with": f"select doc_id, length(t) as v0, {LETTERS} from (select doc_id, text as t from documents)",
    "check_dim": "select len(embedding)::int as dim, count(*) as n, len(embedding) = 64 as ok from embeddings group by all",
    "stage_roundtrip": f"select doc_id, label, length(text)::int as n from {CAPPED} where k <= 10",
    "prepare_corpus": f"""select doc_id, label, length(t) as v0, {LETTERS} from (
  select doc_id, label, t, row_number() over (partition by label
     order by {order_sql(f"'{SEED}'", 'doc_id::varchar')}, doc_id) as k
  from (select doc_id, lang || '/' || source as label, {clean_sql('lower(text)', True)} as t from documents)
  where length(t) > 0) where k <= 10""",
    "prepare_files": f"""select doc_id, label, length(t) as v0, {LETTERS} from (
  select doc_id, lang || '/' || source as label, {clean_sql('lower(text)', True)} as t from documents) where length(t) > 0""",
}
