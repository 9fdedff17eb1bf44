"""Quality rules by document, and rates of their failures by host, shrunk towards an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textanomaly.llm.common import SPACE_CHARS, stored
from textanomaly.session import attach, broadcast_if_small

SYMBOLS = "#*$%&|<>"
SPACES_SQL = r"[\\x20\\x09-\\x0D]+"

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows
MAX_SYMBOLS = 0.1  # symbols for each word
MAX_DUP_LINES = 0.3  # share of the lines with a word
MAX_CAPITALS = 0.5  # share of the code points in words
MAX_HOST_RATE = 0.5  # shrunken rate of failures above which a host is refused

# Words lie in an array bound to a lambda variable, so that it is split once a text. A window is kept with
# its position; after sorting, equal windows are neighbours. The positions found cover at most three words
# each, fewer where the next one begins earlier.
REPEATED_WORDS = rf"""
element_at(
  transform(array(filter(split(text, '{SPACES_SQL}'), w -> w <> '')), ws ->
    element_at(
      transform(
        array(sort_array(if(size(ws) < 3, array(),
          transform(sequence(2, size(ws) - 1),
                    i -> struct(concat_ws(' ', ws[i - 2], ws[i - 1], ws[i]) as g, i as i))))), s ->
        element_at(
          transform(
            array(sort_array(transform(
              filter(s, (x, k) -> get(s, k - 1).g = x.g or get(s, k + 1).g = x.g), x -> x.i))), p ->
            aggregate(transform(p, (v, k) -> coalesce(least(3, get(p, k + 1) - v), 3)), 0L, (a, b) -> a + b)),
          1)),
      1)),
  1)"""


def _removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def document_counts(docs: DataFrame) -> DataFrame:
    """Add the counts the rules look at to every document (null text: no words).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) and n_capitals; all
    in one pass over the text, without a shuffle. Columns with these names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: _removed(x, SPACE_CHARS) != "")
    line_counts = F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    counted = docs.withColumn("text", text).withColumns(
        {
            "n_words": F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
            "word_chars": F.length(_removed(F.col("text"), SPACE_CHARS)).cast("long"),
            "n_symbols": (F.length("text") - F.length(_removed(F.col("text"), SYMBOLS))).cast("long"),
            "n_repeat_words": F.expr(REPEATED_WORDS).cast("long"),
            "n_capitals": (F.length("text") - F.length(_removed(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long"),
            "__lines": line_counts[0],
        }
    )
    return counted.withColumns(
        {
            "n_lines": F.col("__lines.n").cast("long"),
            "n_dup_lines": (F.col("__lines.n") - F.col("__lines.d")).cast("long"),
        }
    ).drop("__lines")


def rule_failures(counts: DataFrame) -> DataFrame:
    """Add base_failed, and failed: the base rules or one of symbols, repeated lines and capitals."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    other = (
        (F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"))
        | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
        | (F.col("n_capitals") > MAX_CAPITALS * F.col("word_chars"))
    )
    return counts.withColumns({"base_failed": base, "failed": base | other})


def host_rates(failures: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: n, rate and the rate shrunk with the beta prior that the hosts' rates themselves give.

    The prior's mean is the mean of the hosts' rates and its strength follows from their variance (moments);
    hosts that don't differ, or a single host, are shrunk wholly to the mean. A null host is one host.
    Counts are added up before the shuffle, so a host may hold any share of the rows.
    """
    hosts = failures.groupBy(host).agg(
        F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k")
    ).withColumn("rate", F.col("k") / F.col("n"))
    hosts = stored(hosts, "host-rates")
    prior = hosts.agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("variance")).select(
        "mean",
        F.when(F.col("variance") > 0, F.greatest(F.lit(0.0), F.col("mean") * (1 - F.col("mean")) / F.col("variance") - 1))
        .alias("strength"),
    )
    shrunk = F.when(F.col("strength").isNull(), F.col("mean")).otherwise(
        (F.col("k") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))
    )
    return attach(hosts, prior, []).select(host, "n", "rate", shrunk.alias("shrunken_rate"))


def host_verdicts(failures: DataFrame, host: str = "source") -> DataFrame:
    """Add host_rate (shrunken) and kept: no rule failed, and the host's rate is at most ``MAX_HOST_RATE``."""
    rates = host_rates(failures, host).select(F.col(host).alias("__host"), F.col("shrunken_rate").alias("host_rate"))
    joined = failures.join(broadcast_if_small(rates), F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("kept", ~F.col("failed") & (F.col("host_rate") <= MAX_HOST_RATE))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts, failures and verdict of every document; texts are read once and not carried along.

    Needs text, doc_id and the host's column. Empty and null texts fail; repeated rows are judged each.
    """
    counts = document_counts(docs.select("doc_id", "text", host)).drop("text")
    return host_verdicts(stored(rule_failures(counts), "rule-failures"), host)


ORACLE = r"""
with docs as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
words as (
  select r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from docs),
places as (select r, unnest(range(3, len(ws) + 1)) as i, ws from words),
windows as (select r, i, concat_ws(' ', ws[i - 2], ws[i - 1], ws[i]) as g from places),
found as (select r, i from windows qualify count(*) over (partition by r, g) > 1),
covered as (
  select r, sum(coalesce(least(3, nxt - i), 3)) as n
  from (select r, i, lead(i) over (partition by r order by i) as nxt from found) group by r),
lines as (
  select r, count(*) as n, count(distinct l) as d
  from (select r, unnest(string_split(text, chr(10))) as l from docs)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
counts as (
  select d.r, d.doc_id, d.source, len(w.ws)::bigint as n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(l.n - l.d, 0)::bigint as n_dup_lines, coalesce(l.n, 0) as n_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words,
         length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g')) as n_capitals
  from docs d join words w using (r) left join lines l using (r) left join covered c using (r)),
failures as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         n_symbols > 0.1 * n_words or n_dup_lines > 0.3 * n_lines or n_capitals > 0.5 * word_chars as soft_failed
  from counts),
hosts as (
  select source, count(*) as n, sum((base_failed or soft_failed)::int) as k,
         sum((base_failed or soft_failed)::int) / count(*) as rate
  from failures group by source),
prior as (select avg(rate) as m, var_pop(rate) as v from hosts),
rates as (
  select source, case when v > 0 then (k + greatest(0, m * (1 - m) / v - 1) * m) / (n + greatest(0, m * (1 - m) / v - 1))
                      else m end as shrunk
  from hosts, prior)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not soft_failed and shrunk <= 0.5 as kept
from failures f join rates h on f.source is not distinct from h.source
"""
