"""Corpus preparation, text cleaning, pooling and sources on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textanomaly.functions import text as text_functions
from textanomaly.functions.text import basic_english_tokens, clean_text
from textanomaly.operators import corpus as ops
from textanomaly.operators import embed
from textanomaly.plans.prepare import prepare
from textanomaly.sources import corpus as sources


def cleaned(spark, text, **flags):
    return spark.createDataFrame([(text,)], "t string").select(clean_text(F.col("t"), **flags)).first()[0]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Don't stop.", "Do n't stop ."),
        ("He said: \"it's 3,000 miles\"", "He said : `` it 's 3,000 miles ''"),
        ("Hello, world! (Really?)", "Hello , world ! ( Really ? )"),
        ("Mr. Smith left. Then we'll go.", "Mr. Smith left . Then we 'll go ."),
        ("version 2.5 of x.y", "version 2.5 of x.y"),
        ("wait... what--now", "wait ... what -- now"),
        ("I cannot, gimme it", "I can not , gim me it"),
        ("the dogs' bones, they've", "the dogs ' bones , they 've"),
        ("a\tb\n\n c d", "a b c d"),
        ("50% & #1 @home; ok:", "50 % & # 1 @ home ; ok :"),
        ("«Été» “oui”", "« Été » “ oui ”"),
        ("'Tis more'n d'ye", "'T is more 'n d 'ye"),
        ("   ", ""),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, text, tokens):
    assert cleaned(spark, text) == tokens


def test_clean_text_keeps_whole_words(spark):
    assert cleaned(spark, "Don't go, élan no.5 naïve!", alnum=True) == "Do go élan naïve"
    assert cleaned(spark, "Don't", lowercase=True, alnum=True) == "do"
    assert cleaned(spark, None, alnum=True) is None
    assert cleaned(spark, "?!", alnum=True) == ""


def test_basic_english(spark):
    df = spark.createDataFrame([("It's \"A\" (test); a.b<br />c:d",)], "t string")
    assert df.select(basic_english_tokens(F.col("t"))).first()[0] == "it ' s a ( test ) a . b c d".split()


def test_harmonize_takes_the_first_column_that_exists(spark):
    df = spark.createDataFrame([(1, "l", "s", "x")], "doc_id int, label string, sms string, text string")
    assert ops.harmonize(df).first().asDict() == {"label": "l", "text": "s"}
    assert ops.harmonize(df, ["text"], keep=["doc_id"]).columns == ["doc_id", "label", "text"]
    with pytest.raises(ValueError):
        ops.harmonize(df.drop("sms", "text"))
    with pytest.raises(ValueError):
        ops.harmonize(df, label_col="topics")


def test_single_topic(spark):
    df = spark.createDataFrame(
        [(1, ["a"]), (2, ["a", "b"]), (3, []), (4, ["c"]), (5, None), (6, ["b"])], "doc_id int, label array<string>"
    )
    names = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], "topic string, label string")
    assert sorted(tuple(r) for r in ops.single_topic(df, names).collect()) == [(1, "1"), (6, "3")]


def test_non_empty(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), (" ",)], "text string")
    assert ops.non_empty(df).count() == 2


@pytest.mark.parametrize("cap", [1, 7, 1500])
def test_cap_per_label_equals_a_ranking(spark, cap):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") < 30, None).otherwise("b").alias("label")
    )
    got = ops.cap_per_label(df, cap, 3)
    ranked = df.selectExpr(
        "*", "row_number() over (partition by label order by md5(concat_ws('|', '3', doc_id)), doc_id) as k"
    )
    want = ranked.where(f"k <= {cap}").select("doc_id", "label")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert ops.cap_per_label(df.repartition(7), cap, 3).exceptAll(got).count() == 0
    assert ops.cap_per_label(df, cap, 4).exceptAll(got).count() > 0


def test_parents(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), ("z",)], "label string")
    tree = spark.createDataFrame([("a", "p"), ("b", "q")], "label string, parent string")
    assert {(r["label"], r["parent"]) for r in ops.attach_parent(df, tree).collect()} == {("a", "p"), ("b", "q"), ("z", None)}
    assert {(r["label"], r["parent"]) for r in ops.attach_parent(df).collect()} == {("a", "a"), ("b", "b"), ("z", "z")}
    assert [tuple(r) for r in ops.unmapped_labels(df, tree).collect()] == [("z", 2)]


def test_eligible(spark):
    df = spark.createDataFrame([(x,) for x in "aaaabbbbccccd"], "label string")
    # e is a sibling of c in the hierarchy only; b is alone
    tree = spark.createDataFrame([("a", 1), ("d", 1), ("b", 2), ("c", 3), ("e", 3)], "label string, parent int")
    assert {r["label"] for r in ops.eligible_inliers(df, "independent", 4).collect()} == {"a", "b", "c"}
    assert {r["label"] for r in ops.eligible_inliers(df, "Contextual", 4, tree).collect()} == {"a", "c"}
    for bad in ({"mode": "other"}, {"mode": "contextual"}):
        with pytest.raises(ValueError):
            ops.eligible_inliers(df, **bad)


VECTORS = [("cat", [1.0, 2.0]), ("dog", [3.0, -4.0]), ("Rex", [9.0, 9.0])]


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize(
    "how, oov, expected",
    [
        ("mean", "zero", {1: [5 / 3, 0], 2: [0, 0], 3: [12, 5], 4: [0, 0]}),
        ("mean", "skip", {1: [5 / 2, 0], 2: [0, 0], 3: [12, 5], 4: [0, 0]}),
        ("sum", "zero", {1: [5, 0], 2: [0, 0], 3: [12, 5], 4: [0, 0]}),
        ("max", "zero", {1: [3, 2], 2: [0, 0], 3: [9, 9], 4: [0, 0]}),
    ],
)
def test_pooling(spark, limit, how, oov, expected):
    docs = spark.createDataFrame(
        [(1, "cat Cat bird dog"), (2, "bird"), (3, "Rex dog"), (4, ""), (5, None)], "doc_id int, text string"
    )
    if how == "mean" and oov == "zero":
        expected = {**expected, 1: [5 / 4, 0], 3: [6, 2.5]}
    elif how == "mean":
        expected = {**expected, 1: [5 / 3, 0], 3: [6, 2.5]}
    vectors = spark.createDataFrame(VECTORS, "token string, vector array<float>")
    pooled = embed.pool_word_vectors(docs, vectors, 2, how, oov, "whitespace", max_vocabulary_bytes=limit)
    got = {r["doc_id"]: list(r["embedding"]) for r in pooled.collect()}
    assert got.keys() == expected.keys()
    assert all(np.allclose(got[k], expected[k]) for k in got), got


def test_encoder_is_checked_and_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "x", "ab"), (2, "y", "abc"), (3, "z", None)], "doc_id int, label string, text string")
    good = embed.embed_with(docs, lambda: lambda texts: np.array([[len(t), 1] for t in texts]), 2, batch_size=1)
    assert {tuple(r[:3]) + tuple(r[3]) for r in good.collect()} == {(1, "x", "ab", 2, 1), (2, "y", "abc", 3, 1)}
    with pytest.raises(Exception, match="expected"):
        embed.embed_with(docs, lambda: lambda texts: np.ones((len(texts), 3)), 2).collect()
    assert embed.expected_dim("distill-roberta") == 768 and embed.expected_dim("glove") == 300
    report = embed.check_dim(good.withColumn("embedding", F.slice("embedding", 1, F.col("doc_id"))), 2)
    assert {tuple(r) for r in report.collect()} == {(1, 1, False), (2, 1, True)}


def test_embedding_by_name(spark):
    docs = spark.createDataFrame([(1, "l", "Cat. dog")], "doc_id int, label string, text string")
    vectors = spark.createDataFrame(VECTORS, "token string, vector array<float>")
    by_words = embed.encode_corpus(docs, "GloVe", vectors, dim=2)
    assert by_words.columns == ["doc_id", "label", "text", "embedding"]
    assert np.allclose(by_words.first()["embedding"], [4 / 3, -2 / 3])  # cat, period, dog
    assert np.allclose(embed.encode_corpus(docs, vectors=vectors, dim=2).first()["embedding"], [2, -1])
    encoded = embed.encode_corpus(docs, "roberta", encoder_factory=lambda: lambda t: np.ones((len(t), 768)))
    assert len(encoded.first()["embedding"]) == 768
    for bad in ({"embedding": "elmo"}, {"embedding": "roberta"}, {"embedding": "glove"}):
        with pytest.raises(ValueError):
            embed.encode_corpus(docs, **bad)


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x, \"y\"\nz")], "label string, text string")
    for kind in ("parquet", "json", "csv"):
        path = str(tmp_path / f"corpus.{kind}")
        writer = rows.write.option("header", True) if kind == "csv" else rows.write
        (writer.option("escape", '"') if kind == "csv" else writer).format(kind).save(path)
        assert sources.load_corpus(spark, path, "test").select("label", "text", "split").first() == ("a", "x, \"y\"\nz", "test")
    rows.createOrReplaceTempView("corpus_view")
    assert sources.load_corpus(spark, "corpus_view", dataset="IMDB").first()["split"] == "train"
    assert sources.load_corpus(spark, rows, "dev").first()["split"] == "dev"
    with pytest.raises(ValueError):
        sources.load_corpus(spark, rows, dataset="unknown")
    assert sources.label_column("Reuters") == "topics" and sources.test_split("sst2") == "validation"


def test_stages_are_reused_by_settings(spark, tmp_path):
    built = []

    def build(n):
        def run():
            built.append(n)
            return spark.range(n)

        return run

    path = str(tmp_path)
    assert sources.cached(spark, build(3), path, {"n": 1}).count() == 3
    assert sources.cached(spark, build(4), path, {"n": 1}).count() == 3
    assert sources.cached(spark, build(4), path, {"n": 2}).count() == 4
    (tmp_path / sources.fingerprint({"n": 2}) / "_SUCCESS").unlink()
    assert sources.cached(spark, build(5), path, {"n": 2}).count() == 5
    assert built == [3, 4, 5]


def test_results_are_replaced_by_run(spark, tmp_path):
    path = str(tmp_path / "results")
    frame = spark.createDataFrame([(0, 1.0), (1, 2.0)], "run int, auc double")
    sources.save_results(frame, path)
    sources.save_results(spark.createDataFrame([(1, 5.0)], "run int, auc double"), path)
    assert {(r["run"], r["auc"]) for r in spark.read.parquet(path).collect()} == {(0, 1.0), (1, 5.0)}


def test_prepare_with_and_without_cache(spark, tmp_path):
    raw = spark.createDataFrame(
        [(i, "train" if i % 2 else "test", "a", f"Text no.{i}") for i in range(20)] + [(99, "test", "a", "")],
        "doc_id int, split string, label string, text string",
    )

    def encode(df):
        return embed.embed_with(df, lambda: lambda texts: np.array([[len(t)] for t in texts]), 1)

    plain = prepare(raw, encode, cap=4, lowercase=True)
    stored = prepare(raw, encode, cap=4, lowercase=True, cache=str(tmp_path))
    assert {r["split"]: r["count"] for r in plain.groupBy("split").count().collect()} == {"train": 4, "test": 4}
    assert plain.select("doc_id", "embedding").exceptAll(stored.select("doc_id", "embedding")).count() == 0
    assert plain.where("text like 'Text%'").count() == 0
    # another corpus with the same settings has stages of its own
    other = raw.withColumn("label", F.lit("b"))
    assert {r["label"] for r in prepare(other, encode, cap=4, lowercase=True, cache=str(tmp_path)).collect()} == {"b"}
    assert prepare(raw, encode).count() == 20


def test_pooling_paths_agree_on_repeated_tokens_doubles_and_capitals(spark):
    vectors = spark.createDataFrame(
        [("a", [0.15, 2.0]), ("a", [0.1, 9.0]), ("éa", [1.0, -1.0]), ("dog", [3.0, 0.3]), (None, [7.0, 7.0])],
        "token string, vector array<double>",
    )
    docs = spark.createDataFrame([(1, "a ÉA (Dog)!"), (2, "!!! zebra"), (3, "  "), (4, "dog " * 40000)], "doc_id int, text string")
    for how, first in (("mean", [4.1 / 3, 8.3 / 3]), ("sum", [4.1, 8.3]), ("max", [3.0, 9.0])):
        got = [
            {r[0]: list(r[1]) for r in embed.pool_word_vectors(docs, vectors, 2, how, "skip", "sentence", max_vocabulary_bytes=limit).collect()}
            for limit in (1 << 20, 0)
        ]
        for result in got:
            assert np.allclose(result[1], first) and result[2] == result[3] == [0, 0]
            assert np.allclose(result[4], [120000, 12000] if how == "sum" else [3.0, 0.3])


def test_the_sketch_keeps_what_most_texts_hold(spark):
    texts = spark.createDataFrame([(["the", "a", "the", f"w{i}", f"x{i % 50}"],) for i in range(400)] + [(None,), ([],)], "tokens array<string>")
    whole = {r["token"]: r["texts"] for r in embed.frequent_tokens(texts.repartition(3), "tokens").collect()}
    assert whole["the"] == whole["a"] == 400 and whole["x3"] == 8 and len(whole) == 452
    few = {r["token"]: r["texts"] for r in embed.frequent_tokens(texts.repartition(3), "tokens", 8).collect()}
    assert len(few) <= 24 and all(whole[t] >= n for t, n in few.items()) and min(few["the"], few["a"]) > 100


@pytest.mark.parametrize("how", ["mean", "max", "sum"])
@pytest.mark.parametrize("oov", ["zero", "skip"])
def test_heavy_tokens_do_not_change_a_join(spark, how, oov):
    vectors = spark.createDataFrame([("the", [1.0, 2.0]), ("cat", [3.0, -4.0]), ("sat", [-1.0, -1.0])], "token string, vector array<float>")
    docs = spark.createDataFrame(
        [(1, "the The cat xx the"), (2, "xx yy"), (3, ""), (4, None), (5, "sat sat cat"), (6, "the the")], "doc_id long, text string"
    )
    show = lambda **o: {r["doc_id"]: np.round(r["embedding"], 9).tolist() for r in embed.pool_by_join(docs, vectors, 2, how, oov, "whitespace", **o).collect()}
    want = {r["doc_id"]: np.round(r["embedding"], 9).tolist() for r in embed.pool_word_vectors(docs, vectors, 2, how, oov, "whitespace").collect()}
    assert show() == want and show(heavy_bytes=16) == want and show(heavy_bytes=32) == want


def test_rules_are_left_out_only_where_they_change_nothing(spark):
    """A rule whose parts a text lacks leaves it alone, so guarded rules give what all rules give."""
    odd = ["", " ", "plain words", "He said \"yes\" . Mr. X can't. Cannot", "'tis gimme d'ye more'n 'Twas", "a\u0001b", "« “ ‘ „ `q` ''x'' ''", "3:4 a:b a,b",
           "gonna  wanna gotta lemme", "the end.", "x..y -- z [1] (2)", "dogs' tails' ", "ab\u0085 c\u0085d e_f 12 é", "\"start", "St. Paul. Next\n(One). 5.5"]
    docs = spark.createDataFrame([(t,) for t in [*odd, None]], "t string")
    t = F.col("t")
    guarded = docs.select(text_functions._treebank(t).alias("a"), text_functions.apply_rules(t, text_functions.TREEBANK_RULES).alias("b"))
    assert all(r["a"] == r["b"] for r in guarded.collect())
    for (pattern, replacement), parts in zip(text_functions.TREEBANK_RULES, text_functions.TREEBANK_PARTS, strict=True):
        if parts:
            lacks = docs
            for part in parts:
                lacks = lacks.where(~t.contains(part))
            assert lacks.where(F.regexp_replace(t, pattern, "\u0002") != t).isEmpty()
    words = F.filter(text_functions.word_tokens(t), lambda w: w.rlike(text_functions.ALPHANUMERIC))
    kept = docs.select(text_functions.clean_text(t, alnum=True).alias("a"), F.array_join(words, " ").alias("b"))
    assert all(r["a"] == r["b"] for r in kept.collect())


def test_a_vocabulary_of_a_million_tokens_is_joined(spark, monkeypatch):
    """A Python worker's copy takes several times the bytes measured, and an executor has a worker a core."""
    vectors = spark.range(1_000_000).select(F.format_string("%012d", "id").alias("token"), F.array_repeat(F.lit(0.5).cast("float"), 4).alias("vector"))
    monkeypatch.setattr(embed, "_pool_in_place", lambda *given: "broadcast")
    joined = []
    monkeypatch.setattr(embed, "pool_by_join", lambda df, *given: joined.append(1) or df.withColumn("embedding", F.lit(None)))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    embed.pool_word_vectors(docs, vectors, 4)
    assert joined == [1]
    assert embed.pool_word_vectors(docs, vectors.limit(1000), 4) == "broadcast"


@pytest.mark.parametrize("how", ["mean", "max", "sum"])
def test_rows_with_one_id_are_pooled_apart_by_both_paths(spark, how):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (1, "b", "y"), (None, "a", "z"), (2, None, "z")], "doc_id long, text string, label string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -1.0])], "token string, vector array<float>")
    show = lambda limit: sorted(map(repr, embed.pool_word_vectors(docs, vectors, 2, how, max_vocabulary_bytes=limit, carry=["label"]).collect()))
    assert show(0) == show(1 << 20) and len(show(0)) == 4
