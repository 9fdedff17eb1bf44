"""Bottom-k sketches of word shingles: fingerprints that merge and tell resemblance, containment and distinct shingles.

A sketch holds the ``SIZE`` least hashes of a text's shingles of five words, sorted, as hexadecimal digits; of fewer
shingles it holds all. The least hashes of a union follow from the least hashes of its parts, so sketches of parts merge
into that of the whole. Everything is array functions on a row; nothing leaves the JVM.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textanomaly.llm.common import Scratch, ranked
from textanomaly.operators.topk import first_k
from textanomaly.session import attach, broadcast_if_small

SIZE, WORDS = 128, 5
DIGITS = 16  # of a hash: 64 bits
STRETCH = 64  # documents that follow each other and look for their next one together


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null and empty texts have none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(found: str) -> Column:
    """Hashes of all shingles of the column of words; fewer words than ``WORDS`` are one shingle, none give none."""
    size, column = F.size(found), F.col(found)

    def hashed(shingle: Column) -> Column:
        return F.substring(F.md5(shingle.cast("binary")), 1, DIGITS)

    def at(i: Column) -> Column:
        return hashed(F.concat_ws(" ", *(F.get(column, i + j) for j in range(WORDS))))

    short = F.when(size > 0, F.array(hashed(F.array_join(column, " ")))).otherwise(F.array().cast("array<string>"))
    return F.when(size >= WORDS, F.transform(F.sequence(F.lit(0), F.greatest(size - WORDS, F.lit(0))), at)).otherwise(short)


def least(hashes: Column, k: int = SIZE) -> Column:
    """The sketch of hashes in any order, repeats included."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def _seen(a: Column, b: Column, k: int) -> Column:
    """Hashes by which two sketches compare: the least of the union, all of it where both hold all of theirs."""
    union = F.array_sort(F.array_union(a, b))
    return F.when((F.size(a) < k) & (F.size(b) < k), union).otherwise(F.slice(union, 1, k))


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Share of both texts' distinct shingles that they have in common, 0 to 1; two without shingles: 1.

    Exact where both sketches hold all of their shingles, else an estimate with a deviation of at most
    1 / (2 sqrt(k)).
    """
    seen = _seen(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(seen, a), b))
    return F.when(F.size(seen) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(seen), F.lit(1)))


def distinct_shingles(a: Column, k: int = SIZE) -> Column:
    """Number of distinct shingles: exact below ``k``, else estimated from the largest hash held."""
    largest = F.conv(F.get(a, F.lit(k - 1)), 16, 10).cast("decimal(20,0)").cast("double") + 1
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**64) / largest)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Share of the distinct shingles of ``a`` that ``b`` has too, 0 to 1; 1 if ``a`` has none."""
    union = _seen(a, b, k)
    whole = (F.size(a) < k) & (F.size(b) < k)
    together = F.when(whole, F.size(union).cast("double")).otherwise(distinct_shingles(union, k))
    share = resemblance(a, b, k) * together / F.greatest(distinct_shingles(a, k), F.lit(1.0))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def sketched(df: DataFrame, text: str = "text", name: str = "sketch", k: int = SIZE) -> DataFrame:
    """Add the sketch of each row's whole text; a column of that name is replaced."""
    own = "__words"
    return df.withColumn(own, words(F.col(text))).withColumn(name, least(shingle_hashes(own), k)).drop(own)


def merged(parts: DataFrame, keys: list[str], name: str = "sketch", k: int = SIZE) -> DataFrame:
    """A sketch for each key from the sketches of its parts; null keys are a group, keys of empty sketches only have an
    empty one. No task holds all of a group's hashes, whatever its size."""
    hashes = parts.select(*keys, F.explode(name).alias("__hash")).distinct()
    kept = first_k(hashes, keys, "__hash", k, [])
    sketches = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(name))  # k a group
    return attach(parts.select(*keys).distinct(), sketches, keys, "left").withColumn(
        name, F.coalesce(F.col(name), F.array().cast("array<string>"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text of every row, with ``__stretch`` and ``__at``, by which rows are dealt and sorted.

    Rows follow each other by doc_id (null first), then by a hash of the text; repeated rows count as one in that order
    and are returned as often as they come. The first row follows the last. Rows with ``__at`` beyond their stretch only
    carry a stretch's end and are marked ``__end``.
    """
    scratch = Scratch(docs, "following")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("__md5", F.md5(F.col("text").cast("binary")))
    keys = rows.groupBy("doc_id", "__md5").agg(F.count(F.lit(1)).alias("__copies"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("__md5")]
    keys = scratch.store(ranked(keys, order, "__at"), "keys")
    total = keys.count()
    last = max(0, total - 1) // STRETCH
    distinct = rows.dropDuplicates(["doc_id", "__md5"]) if keys.where("__copies > 1").limit(1).count() else rows
    side = broadcast_if_small(keys.select(F.col("doc_id").alias("__id"), F.col("__md5").alias("__hash"), "__at", "__copies"))
    placed = distinct.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__hash")))
    own = F.struct(F.floor(F.col("__at") / STRETCH).alias("stretch"), F.col("__at").alias("at"), F.lit(False).alias("end"))
    first = F.col("__at") == 0
    before = F.struct(
        F.when(first, F.lit(last)).otherwise(F.floor(F.col("__at") / STRETCH) - 1).cast("long").alias("stretch"),
        F.when(first, F.lit(total)).otherwise(F.col("__at")).cast("long").alias("at"), F.lit(True).alias("end"),
    )
    places = F.explode(F.when(F.col("__at") % STRETCH == 0, F.array(own, before)).otherwise(F.array(own))).alias("__p")
    dealt = placed.select("doc_id", "text", "__copies", places).select(
        "doc_id", "text", "__copies", F.col("__p.stretch").alias("__stretch"), F.col("__p.at").alias("__at"), F.col("__p.end").alias("__end")
    )
    return dealt.withColumn("next_text", F.lead("text").over(Window.partitionBy("__stretch").orderBy("__at")))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text's last quarter of code points (rounded down) is the beginning of the next document's text
    (``with_next``; all of it if that is shorter). A fingerprint is a sketch's hashes one after the other; null, empty
    and blank texts have none and an empty fingerprint, and are alike among themselves. Very long texts are taken whole.
    """
    # both windows deal and sort alike, so the second needs no shuffle
    follows = Window.partitionBy("__stretch").orderBy("__at")
    rows = sketched(with_next(docs)).withColumn("next_sketch", F.lead("sketch").over(follows)).where(~F.col("__end"))
    length = F.length("text")
    quarter = F.floor(length / 4).cast("int")
    changed = F.concat(F.expr("substring(text, 1, n_chars - quarter)"), F.expr("substring(next_text, 1, quarter)"))
    rows = rows.withColumns({"n_chars": length, "quarter": quarter}).withColumn("edited", changed)
    rows = sketched(rows, "edited", "edited_sketch")
    rows = rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"), F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "__copies",
    )
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy")


_SKETCH = r"""
    list_sort(list_distinct(list_transform(
        case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
             when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end,
        lambda g: substr(md5(g), 1, 16))))[1:128]"""
_WORDS = r"""
    list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
_LIKE = """
    case when len(a) = 0 and len(b) = 0 then 1.0::double
         else len(list_intersect(list_intersect(u, a), b))::double / len(u) end"""
ORACLE = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
followed as (
    select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text from docs
), changed as (
    select *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) as edited from followed
), worded as (
    select 1 as kind, doc_id, {_WORDS.format(text="text")} as w from changed
    union all select 2, doc_id, {_WORDS.format(text="next_text")} from changed
    union all select 3, doc_id, {_WORDS.format(text="edited")} from changed
), sketches as (select kind, doc_id, {_SKETCH} as s from worded),
pairs as (
    select x.doc_id, y.kind, x.s as a, y.s as b, list_sort(list_distinct(list_concat(x.s, y.s))) as whole,
           case when len(x.s) < 128 and len(y.s) < 128 then whole else whole[1:128] end as u
    from sketches x join sketches y using (doc_id) where x.kind = 1 and y.kind > 1
), alike as (select doc_id, kind, a, b, {_LIKE} as alike from pairs)
select c.doc_id, length(c.text)::bigint as n_chars, sha256(c.edited) as edited_sha256,
       array_to_string(e.a, '') as fingerprint, array_to_string(e.b, '') as edited_fingerprint,
       e.alike as near_edited, n.alike as near_next
from changed c join alike e on c.doc_id = e.doc_id and e.kind = 3 join alike n on c.doc_id = n.doc_id and n.kind = 2
"""
