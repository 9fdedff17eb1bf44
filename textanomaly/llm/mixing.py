"""Mixing sources to target weights: certain whole copies, the rest by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textanomaly.llm.common import ranked, stored, word_count
from textanomaly.session import broadcast_if_small

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
# Rows of a source are cut at one of so many levels of their order key; only that level is sorted.
LEVELS = 1 << 12


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row a source with its target in words.

    ``sizes`` has a row a source (source, source_size, source_rows). Sources in code-point order, null last,
    weigh 1, 2, 3 and so on again, and share the sum of all sizes; targets stop at three times the source's
    size, and what is over goes to the others by weight until none is above. Each round is a sum over the
    table of sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    table = stored(
        ranked(sizes, order, "rank").withColumn("weight", weight).withColumn("cap", MAX_COPIES * F.col("source_size"))
        .withColumn("capped", F.lit(False)),
        "mix-weights",
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        used, weights = table.agg(
            F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0.0)),
        ).first()
        free = float(total - used) * F.col("weight") / (weights or 1.0)
        target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free)
        above = ~F.col("capped") & (free > F.col("cap"))
        table = table.withColumn("target", target)
        if not weights or table.where(above).isEmpty():
            return table.select("source", "source_size", "target")
        table = stored(table.withColumn("capped", F.col("capped") | above).drop("target"), "mix-sources")


def random_number(*parts: Column) -> Column:
    """A number between 0 and 1 that the row's own values give; 48 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def order_key(size: Column, rest: Column, roots: Column, number: Column) -> Column:
    """Pareto's ranking variable: the random odds over the inclusion odds.

    Inclusion is proportional to the root of the size and adds up to the words wanted; documents larger than
    those have no chance (null).
    """
    wanted = F.least(F.lit(0.999999), rest * F.sqrt(size.cast("double")) / roots)
    key = (number / (1 - number)) / (wanted / (1 - wanted))
    return F.when((size > 0) & (size <= rest), key)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with __size, __u (the row's random number), __id and __tie (its place among equal keys)."""
    number = random_number(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    tie = F.md5(F.coalesce("text", F.lit("")))
    return docs.withColumns({"__size": word_count(F.col("text")), "__u": number, "__id": last, "__tie": tie})


def _attach(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    side = by_source.withColumnRenamed("source", "__source")
    return rows.join(broadcast_if_small(side), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _keyed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    key = order_key(F.col("__size"), F.col("__rest"), F.col("__roots"), F.col("__u"))
    return _attach(rows, sources).withColumn("__key", key)


def _cuts(sized: DataFrame) -> DataFrame:
    """One row a source: __target, __certain copies, __rest, __roots, and the place (__last) its sample ends at."""
    sizes = sized.groupBy("source").agg(F.sum("__size").alias("source_size"))
    targets = source_targets(stored(sizes, "mix-sums")).withColumnsRenamed(
        {"source_size": "__source_size", "target": "__target"}
    )
    share = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    targets = targets.withColumn("__certain", share.cast("long"))
    rest = F.col("__target") - F.col("__certain") * F.col("__source_size")
    targets = stored(targets.withColumn("__rest", rest), "mix-targets")
    fits = (F.col("__size") > 0) & (F.col("__size") <= F.col("__rest"))
    # whole numbers, so that the sum is the same in any order
    root = F.floor(F.sqrt(F.col("__size").cast("double")) * F.col("__size") * 1000).cast("decimal(38,0)")
    roots = _attach(sized, targets).where(fits).groupBy("source").agg((F.sum(root).cast("double") / 1000).alias("__roots"))
    sources = stored(_attach(targets, stored(roots, "mix-roots")), "mix-sources")
    keyed = _keyed(sized, sources).where("__key is not null")
    # keys lie anywhere above 0: their place in (0, 1) makes the levels
    keyed = keyed.withColumn("__level", F.floor(F.col("__key") / (1 + F.col("__key")) * LEVELS).cast("long"))
    keyed = stored(keyed.select("source", "__size", "__rest", "__key", "__id", "__tie", "__level"), "mix-keys")
    place = F.struct("__key", "__id", "__tie")
    levels = keyed.groupBy("source", "__level").agg(
        F.sum("__size").alias("words"), F.first("__rest").alias("__rest"), F.max(place).alias("end")
    )
    before = Window.partitionBy("source").orderBy("__level").rowsBetween(Window.unboundedPreceding, -1)
    levels = stored(levels.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))), "mix-levels")
    whole = levels.where(F.col("before") + F.col("words") <= F.col("__rest"))
    # at most one level a source is cut
    cut = levels.where((F.col("before") < F.col("__rest")) & (F.col("before") + F.col("words") > F.col("__rest")))
    cut = stored(cut.select("source", F.col("__level").alias("__cut"), "before"), "mix-cuts")
    inside = _attach(keyed, cut).where(F.col("__level") == F.col("__cut"))
    earlier = Window.partitionBy("source").orderBy("__key", "__id", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    half = F.col("before") + F.coalesce(F.sum("__size").over(earlier), F.lit(0)) + F.col("__size") / 2
    inside = inside.withColumn("half", half).where("half <= __rest").select("source", place.alias("end"))
    last = whole.select("source", "end").unionByName(inside).groupBy("source").agg(F.max("end").alias("__last"))
    return stored(_attach(sources, last), "mix-ends")


def _copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    drawn = F.coalesce(F.struct("__key", "__id", "__tie") <= F.col("__last"), F.lit(False)) & F.col("__key").isNotNull()
    copies = F.when(F.col("__size") > 0, F.col("__certain") + drawn.cast("long")).otherwise(0)
    return _keyed(rows, sources).withColumn("__copies", copies.cast("long"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words, repeats counted) of every document.

    Every document has as many certain copies as its source's target holds its size in whole; the rest of the
    target is drawn in the order of Pareto's key: a document belongs to the sample if the words before it and
    half of its own fit into the rest. The order depends on seed, doc_id and text alone, so reruns agree, and
    rows that are equal are drawn together. Null texts have size 0 and are never taken; a null doc_id comes last
    among equal keys.

    Cumulated words come from sums by level of the key; only the level that the cut falls into is ranked
    row by row, so a source of any size is never sorted in one task. Texts are read once and not moved.
    """
    rows = _sized(docs.select("doc_id", "source", "text"), seed).drop("text")
    sized = stored(rows, "mix-sizes")
    return _copies(sized, _cuts(sized)).select(
        "doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").cast("double").alias("target"), F.col("__copies").alias("copies"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it; rows are repeated where they lie."""
    sized = stored(_sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-sizes")
    counted = _copies(_sized(docs, seed), _cuts(sized)).where("__copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return counted.withColumn("__copy", copies).select(*docs.columns)


ORACLE_PARTS = r"""
sized as (
  select row_number() over () as r, doc_id, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as size,
         (('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '')), 1, 12))::bigint::double + 0.5)
           / 281474976710656.0 as u, md5(coalesce(text, '')) as tie
  from {docs}),
sums as (
  select source, sum(size)::bigint as source_size,
         [1.0, 2.0, 3.0][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as w
  from sized group by source),
total as (select sum(source_size)::bigint as total from sums),
steps as (
  select *, 3 * source_size / w as ratio,
         coalesce(sum(3 * source_size) over (order by 3 * source_size / w range between unbounded preceding and current row), 0) as caps,
         sum(w) over () - sum(w) over (order by 3 * source_size / w range between unbounded preceding and current row) as freew
  from sums),
water as (
  select coalesce(max(caps) filter (where ratio * freew + caps < total), 0)::bigint as caps,
         coalesce(min(freew) filter (where ratio * freew + caps < total), (select sum(w) from sums)) as freew
  from steps, total),
targets as (
  select source, source_size,
         least(3.0 * source_size, (total - water.caps)::double * w / (case when water.freew = 0 then 1 else water.freew end)) as target
  from sums, total, water),
parts as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as certain,
         target - (case when source_size > 0 then floor(target / source_size)::bigint else 0 end) * source_size as rest
  from targets),
rooted as (
  select s.*, p.source_size, p.target, p.certain, p.rest,
         sum(case when size > 0 and size <= rest then floor(sqrt(size::double) * size * 1000)::decimal(38,0) end)
           over (partition by s.source)::double / 1000 as roots
  from sized s join parts p on s.source is not distinct from p.source),
keyed as (
  select *, case when size > 0 and size <= rest then
      (u / (1 - u)) / (least(0.999999, rest * sqrt(size::double) / roots)
        / (1 - least(0.999999, rest * sqrt(size::double) / roots))) end as k
  from rooted),
drawn as (
  select *, k is not null and
      coalesce(sum(size) over (partition by source, k is null order by k, doc_id, tie
                               rows between unbounded preceding and 1 preceding), 0) + size / 2 <= rest as hit
  from keyed),
mixed as (
  select r, doc_id, size, source_size, target,
         case when size > 0 then certain + hit::int else 0 end::bigint as copies from drawn)
"""
ORACLE = "with " + ORACLE_PARTS.format(docs="documents") + (
    "select doc_id, size, source_size, target, (copies * size)::bigint as taken from mixed"
)
