"""From texts to one dense vector a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textanomaly.functions import text as text_functions
from textanomaly.session import dropped, measured_bytes, settle, shuffles_removed, small_batches, stored_rows

# Every Python worker keeps its own copy of a broadcast vocabulary, in some six times the bytes measured.
MAX_VOCABULARY_BYTES = 64 << 20

# Vectors of the tokens that most texts hold, in a join; counters of a task's sketch.
HEAVY_BYTES, HEAVY_SLOTS = 4 << 20, 1 << 12

# so many tokens are added up at a time
BLOCK_TOKENS = 1 << 14
# a task works on the texts of so many tokens at a time, or on one longer text
PIECE_TOKENS = 1 << 18

PUNCTUATION = r"[!-/:-@\[-`{-~]+"


def _bare(token: Column) -> Column:
    """A token in lower case without the punctuation around it."""
    return F.regexp_replace(F.lower(token), f"^{PUNCTUATION}|{PUNCTUATION}$", "")


TOKENIZERS = {
    "basic_english": text_functions.basic_english_tokens,
    "whitespace": text_functions.split_words,
    "sentence": text_functions.split_words,
}
# what is looked up when a token itself is unknown, in this order
FALLBACKS: dict[str, list[Callable[[Column], Column]]] = {
    "basic_english": [],  # in lower case already
    "whitespace": [F.lower],
    "sentence": [F.lower, _bare],
}


def one_vector_a_token(vectors: DataFrame) -> DataFrame:
    """Vectors in doubles, one row a token: of several the smallest, compared number by number."""
    doubles = vectors.where(F.col("token").isNotNull()).select("token", F.col("vector").cast("array<double>").alias("vector"))
    return doubles.groupBy("token").agg(F.min("vector").alias("vector"))


def pool_word_vectors(
    df: DataFrame,
    vectors: DataFrame,
    dim: int,
    how: str = "mean",
    oov: str = "zero",
    tokenizer: str = "basic_english",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_vocabulary_bytes: int = MAX_VOCABULARY_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Reduce the word vectors of a text by ``mean``, ``max`` or ``sum``.

    Returns ``id_col``, the columns to ``carry`` and ``embedding``.

    A token is looked up in ``vectors(token, vector)`` as it is, then in lower
    case, then (``tokenizer='sentence'``) also without punctuation around it. A
    token found in no form counts as the zero vector (``oov='zero'``) or is left
    out (``oov='skip'``). A text without any token gets the zero vector. If a
    token has several vectors, the smallest counts.

    A vocabulary measured below ``max_vocabulary_bytes`` is broadcast, and texts
    are pooled where they are read, without a shuffle. A larger one is joined.
    """
    if how not in ("mean", "max", "sum"):
        raise ValueError("reduction should be mean, max or sum")
    if oov not in ("zero", "skip"):
        raise ValueError("oov should be zero or skip")
    if measured_bytes(vectors) <= max_vocabulary_bytes:
        return _pool_in_place(df, one_vector_a_token(vectors), dim, how, oov, tokenizer, id_col, text_col, carry or [])
    # ids may repeat or be null: a row is pooled by a number of its own, as in place
    columns = [id_col, *(carry or [])]
    rows = df.where(F.col(text_col).isNotNull()).select(*columns, F.col(text_col).alias("__text"))
    numbered = settle(rows.withColumn("__row", F.monotonically_increasing_id()))
    pooled = pool_by_join(numbered, vectors, dim, how, oov, tokenizer, "__row", "__text", columns)
    return pooled.select(*columns, "embedding")


def in_pieces(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by the tokens in the column numbered ``lists``: a batch is bounded in rows only, however long."""
    for batch in batches:
        ends = np.cumsum(batch.column(lists).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_TOKENS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _pool_in_place(df, vectors, dim, how, oov, tokenizer, id_col, text_col, carry) -> DataFrame:
    table = vectors.toArrow()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    shared = df.sparkSession.sparkContext.broadcast(
        (table.column("token").to_pylist(), np.vstack([flat.reshape(-1, dim), np.zeros((1, dim))]))
    )
    forms = [f"__form{i}" for i in range(1 + len(FALLBACKS[tokenizer]))]
    texts = df.where(F.col(text_col).isNotNull()).select(
        id_col, *carry, TOKENIZERS[tokenizer](F.col(text_col)).alias(forms[0])
    )
    for name, form in zip(forms[1:], FALLBACKS[tokenizer]):
        texts = texts.withColumn(name, F.transform(forms[0], form))
    add = np.maximum if how == "max" else np.add

    def looked_up(lists: pa.Array, index: dict[str, int]) -> np.ndarray:
        """Row of every token's vector; each distinct token of a batch is looked up once."""
        coded = lists.flatten().dictionary_encode()
        places = np.array([index.get(token, -1) for token in coded.dictionary.to_pylist()], np.int64)
        return places[coded.indices.to_numpy(zero_copy_only=False)] if len(places) else places

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = shared.value
        index = {word: i for i, word in enumerate(words)}
        for batch in in_pieces(batches, 1 + len(carry)):
            lengths = batch.column(forms[0]).value_lengths().to_numpy(zero_copy_only=False)
            found = looked_up(batch.column(forms[0]), index)
            for form in forms[1:]:
                if (found < 0).any():
                    found = np.where(found < 0, looked_up(batch.column(form), index), found)
            text = np.repeat(np.arange(batch.num_rows), lengths)
            if oov == "skip":
                text, found = text[found >= 0], found[found >= 0]
            pooled = np.full((batch.num_rows, dim), -np.inf if how == "max" else 0.0)
            for at in range(0, len(found), BLOCK_TOKENS):
                own = text[at : at + BLOCK_TOKENS]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                part = add.reduceat(values[found[at : at + BLOCK_TOKENS]], starts)  # -1 is the zero row at the end
                pooled[own[starts]] = add(pooled[own[starts]], part)
            counts = np.bincount(text, minlength=batch.num_rows)
            pooled[counts == 0] = 0
            if how == "mean":
                pooled /= np.maximum(counts, 1)[:, None]
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
            vector = pa.ListArray.from_arrays(offsets, pa.array(pooled.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(forms)], vector], names=schema.names)

    schema = T.StructType(
        [*texts.schema.fields[: -len(forms)], T.StructField("embedding", T.ArrayType(T.DoubleType()))]
    )
    return texts.mapInArrow(pool, schema)


def frequent_tokens(texts: DataFrame, tokens: str, slots: int = HEAVY_SLOTS, once: bool = False) -> DataFrame:
    """(token, texts): candidates for the tokens that most texts hold, with a lower bound of how many do.

    Every task keeps at most ``slots`` counters: when there are more, the largest count that does not fit is taken from
    all of them. A token that more than one in ``slots`` of the texts holds is never lost, and sketches add up.
    ``once`` says that a text's list names a token once.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in in_pieces(batches, 0):
            words, _, codes = _token_codes(batch.column(0)) if once else _counted_tokens(batch.column(0))[:3]
            for word, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                held[word] = held.get(word, 0) + n
            if len(held) > slots:
                least = sorted(held.values(), reverse=True)[slots]
                held = {word: n - least for word, n in held.items() if n > least}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "texts"])

    return texts.select(tokens).mapInArrow(sketch, "token string, texts long").groupBy("token").agg(F.sum("texts").alias("texts"))


def _token_codes(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of a batch; and row and token's number of every token."""
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), rows, coded.indices.to_numpy(zero_copy_only=False)


def _counted_tokens(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of a batch; and row, token's number and count of every token that a row holds."""
    words, rows, codes = _token_codes(lists)
    pairs, counts = np.unique(rows * max(len(words), 1) + codes, return_counts=True)
    return words, pairs // max(len(words), 1), pairs % max(len(words), 1), counts


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of every row's list in the second column, and their counts."""
    for batch in in_pieces(batches, 1):
        words, rows, codes, counts = _counted_tokens(batch.column(1))
        offsets = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32())
        tokens = pa.array(words, pa.string()).take(pa.array(codes))
        lists = [pa.ListArray.from_arrays(offsets, values) for values in (tokens, pa.array(counts))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[batch.schema.names[0], "tokens", "counts"])


def _looked_up(tokens: DataFrame, vectors: DataFrame, tokenizer: str) -> DataFrame:
    """(token, vector) of the distinct tokens that are known in some form, the first that is."""
    forms = F.array(F.col("token"), *[form(F.col("token")) for form in FALLBACKS[tokenizer]])
    tried = tokens.select("token", F.posexplode(forms).alias("place", "form"))
    by_form = one_vector_a_token(vectors).withColumnRenamed("token", "form")
    return tried.join(by_form, "form").groupBy("token").agg(F.min_by("vector", "place").alias("vector"))


def pool_by_join(
    df: DataFrame,
    vectors: DataFrame,
    dim: int,
    how: str = "mean",
    oov: str = "zero",
    tokenizer: str = "basic_english",
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    heavy_bytes: int = HEAVY_BYTES,
) -> DataFrame:
    """The same pooling as a join on the token, for vocabularies of any size.

    Texts are cut into tokens once: each one's distinct tokens and their counts are
    stored. The tokens that most texts hold are found by a sketch, and as many of their
    vectors as ``heavy_bytes`` take are broadcast: they are added up where texts
    are read, so no frequent word crosses a shuffle or makes a skewed key. The
    other tokens are counted per text, joined with their vectors, and both parts
    of a text's sum are added. Other forms are tried on distinct tokens only.
    """
    texts = df.where(F.col(text_col).isNotNull()).select(id_col, TOKENIZERS[tokenizer](F.col(text_col)).alias("tokens"))
    most = max(1, min(HEAVY_SLOTS // 2, heavy_bytes // (8 * dim)))
    kind = texts.schema[id_col].dataType.simpleString()
    with small_batches(df.sparkSession), shuffles_removed(df.sparkSession):  # a worker holds a batch's tokens, so memory doesn't grow with the rows a task has
        listed, path = stored_rows(texts.mapInArrow(_token_counts, f"`{id_col}` {kind}, tokens array<string>, counts array<long>"), "tokens")
        heavy = settle(frequent_tokens(listed, "tokens", once=True).orderBy(F.desc("texts"), "token").limit(most))
    known = {r["token"]: r["vector"] for r in _looked_up(heavy.select("token"), vectors, tokenizer).collect()}  # heavy_bytes
    names = [r["token"] for r in heavy.select("token").toLocalIterator()]
    table = np.array([known.get(name) or [0.0] * dim for name in names], np.float64).reshape(len(names), dim)
    shared = df.sparkSession.sparkContext.broadcast((names, np.array([name in known for name in names], bool), table))
    skip, add = oov == "skip", np.maximum if how == "max" else np.add

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, has_vector, values = shared.value
        index = {name: i for i, name in enumerate(listed)}
        for batch in in_pieces(batches, 1):
            words, rows, codes = _token_codes(batch.column(1))
            counts = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            place = np.array([index.get(word, -1) for word in words], np.int64)[codes] if words else codes
            own, n = batch.num_rows, np.where(place >= 0, counts, 0)
            inside = place >= 0
            if skip:
                inside &= has_vector[np.maximum(place, 0)] if len(listed) else False
            pooled = np.full((own, dim), -np.inf if how == "max" else 0.0)
            at, found = rows[inside], place[inside]
            for start in range(0, len(at), BLOCK_TOKENS):
                stop = start + BLOCK_TOKENS
                block = values[found[start:stop]] * (1 if how == "max" else counts[inside][start:stop, None])
                starts = np.flatnonzero(np.diff(at[start:stop], prepend=-1))
                pooled[at[start:stop][starts]] = add(pooled[at[start:stop][starts]], add.reduceat(block, starts))
            n = np.bincount(at, counts[inside], own).astype(np.int64)
            rest = place < 0
            offsets = pa.array(np.searchsorted(rows[rest], np.arange(own + 1)), pa.int32())
            left = pa.array(words, pa.string()).take(pa.array(codes[rest]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(own + 1) * dim, pa.int32()), pa.array(pooled.ravel())),
                    pa.array(n), pa.ListArray.from_arrays(offsets, left), pa.ListArray.from_arrays(offsets, pa.array(counts[rest])),
                ],
                names=[id_col, "vector", "n", "tokens", "counts"],
            )

    schema = f"`{id_col}` {kind}, vector array<double>, n long, tokens array<string>, counts array<long>"
    with small_batches(df.sparkSession):
        parts = settle(listed.mapInArrow(part, schema))
    dropped(df.sparkSession, path)
    tail = parts.select(id_col, F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
    tail = tail.select(id_col, F.col("t.tokens").alias("token"), F.col("t.counts").alias("n"))
    # without other forms every vector is its token's, and the distinct tokens are not needed
    forms = FALLBACKS[tokenizer]
    words = _looked_up(tail.select("token").distinct(), vectors, tokenizer) if forms else one_vector_a_token(vectors)
    found = tail.join(words, "token", "left")
    if skip:
        found = found.where(F.col("vector").isNotNull())
    zero = F.array_repeat(F.lit(0.0), dim)
    fits = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} numbers")))
    known = F.when(F.col("vector").isNull(), zero).otherwise(fits)
    found = found.select(id_col, known.alias("vector"), F.col("n").cast("double").alias("weight"), "n")
    # a text's heavy part is one vector, added up already
    both = found.unionByName(parts.where("n > 0").select(id_col, "vector", F.lit(1.0).alias("weight"), "n"))
    numbers = [F.col("vector")[i] for i in range(dim)]
    pooled = [F.max(v) if how == "max" else F.sum(v * F.col("weight")) for v in numbers]
    result = both.groupBy(id_col).agg(F.array(*pooled).alias("embedding"), F.sum("n").alias("n"))
    if how == "mean":
        result = result.withColumn("embedding", F.transform("embedding", lambda v: v / F.col("n")))
    every = df.where(F.col(text_col).isNotNull()).select(id_col, *(carry or []))
    return every.join(result.drop("n"), id_col, "left").withColumn("embedding", F.coalesce("embedding", zero))


def embed_with(
    df: DataFrame,
    encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]],
    dim: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_size: int = 64,
) -> DataFrame:
    """Vectors from a user's batch encoder, built once in every task's worker.

    ``encoder_factory()`` returns a function from a list of texts to an array of
    shape (texts, dim). Other columns are kept; null texts are left out.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for batch in batches:
            if encoder is None:
                encoder = encoder_factory()
            texts = batch[text_col].tolist()
            parts = [np.asarray(encoder(texts[i : i + batch_size])) for i in range(0, len(texts), batch_size)]
            if not parts:
                continue
            vectors = np.concatenate(parts).astype(np.float32)
            if vectors.shape != (len(texts), dim):
                raise ValueError(f"encoder returned shape {vectors.shape}, expected {(len(texts), dim)}")
            yield batch.assign(embedding=list(vectors))

    fields = [f for f in df.schema.fields if f.name != "embedding"]
    schema = T.StructType([*fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return df.drop("embedding").where(F.col(text_col).isNotNull()).mapInPandas(encode, schema)


# Embeddings by name, and what each is made from.
EMBEDDINGS = {
    "glove": "words",
    "fasttext": "words",
    "sentence-glove": "known words",
    "roberta": "encoder",
    "distill-roberta": "encoder",
}


def encode_corpus(
    df: DataFrame,
    embedding: str = "sentence-glove",
    vectors: DataFrame | None = None,
    encoder_factory: Callable | None = None,
    reduction: str = "mean",
    dim: int | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """Add ``embedding`` to every row by the name of the embedding.

    Word embeddings need ``vectors(token, vector)``; encoders need an
    ``encoder_factory`` (see ``embed_with``), as no pretrained weights come along.
    """
    kind = EMBEDDINGS.get(embedding.lower())
    if kind is None:
        raise ValueError(f"{embedding} is not an available embedding: {', '.join(EMBEDDINGS)}")
    dim = dim or expected_dim(embedding.lower())
    if kind == "encoder":
        if encoder_factory is None:
            raise ValueError(f"{embedding} needs an encoder_factory")
        return embed_with(df, encoder_factory, dim, id_col)
    if vectors is None:
        raise ValueError(f"{embedding} needs a table of word vectors")
    # the sentence embedding averages the known words only, cut at white space
    how, oov, tokenizer = (
        ("mean", "skip", "sentence") if kind == "known words" else (reduction, "zero", "basic_english")
    )
    carry = [c for c in df.columns if c not in (id_col, "embedding")]
    return pool_word_vectors(df, vectors, dim, how, oov, tokenizer, id_col, carry=carry)


def expected_dim(embedding: str) -> int:
    """768 for encoders of the roberta family, 300 for word vectors."""
    return 768 if "roberta" in embedding else 300


def check_dim(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Vector lengths present, their row counts, and whether each is the expected one."""
    return (
        df.groupBy(F.size(vector).alias("dim"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ok", F.col("dim") == dim)
    )
