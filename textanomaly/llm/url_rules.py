"""URL filters: host and path rules, and association rules mined from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textanomaly.llm.common import stored
from textanomaly.session import broadcast_if_small

# the fixed rules, (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BAD = "label:bad"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path begins the URL's; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, the domains it lies in, path parts and query keys; numbers are one token."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.concat(F.lit("path:"), F.regexp_replace(p, r"[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.split(query, "&"), lambda k: k != "")
    keys = F.transform(keys, lambda k: F.concat(F.lit("key:"), F.substring_index(k, "=", 1)))
    both = F.concat(F.array(F.concat(F.lit("scheme:"), scheme)), domains, parts, keys)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, confidence, support): token combinations that go with bad labels.

    ``labelled`` has tokens (array of strings) and bad (boolean). Itemsets are mined by FP-growth over all
    rows; rules are those whose consequent is the bad label, pruned by support and confidence. Combinations that
    hold a smaller rule of at least their confidence are left out. Without labels there are no rules.
    """
    items = F.when(F.col("bad"), F.array_append(F.col("tokens"), BAD)).otherwise(F.col("tokens"))
    baskets = labelled.where("bad is not null and size(tokens) > 0").select(items.alias("items"))
    baskets = stored(baskets, "url-baskets")
    empty = baskets.select(
        F.lit(0).cast("long").alias("rule_id"), F.col("items").alias("tokens"),
        F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"),
    ).limit(0)
    if baskets.isEmpty():
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    rules = rules.select(
        F.array_sort("antecedent").alias("tokens"), F.round("confidence", 9).alias("confidence"), "support"
    )
    rules = stored(rules.withColumn("rule_id", F.xxhash64("tokens")), "url-rules")
    # a rule is redundant if one of its parts is as good: parts are found through one of their tokens
    parts = rules.select(
        F.col("rule_id").alias("part"), F.col("tokens").alias("part_tokens"), F.col("confidence").alias("part_confidence"),
        F.element_at("tokens", 1).alias("token"),
    )
    redundant = (
        rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
        .join(parts, "token")
        .where("rule_id <> part and part_confidence >= confidence and size(array_except(part_tokens, tokens)) = 0")
        .select("rule_id")
        .distinct()
    )
    return rules.join(redundant, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support")


def matching_rules(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, confidence): the most confident rule of each URL that has one.

    The inverted index has each rule once, under the token that fewest rules hold, so frequent tokens meet
    few rules; the other tokens are checked on the row.
    """
    posted = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    held = posted.groupBy("token").agg(F.count("*").alias("held"))
    rarest = F.min_by("token", F.struct("held", "token"))
    index = posted.join(held, "token").groupBy("rule_id").agg(
        rarest.alias("token"), F.first("tokens").alias("rule_tokens"), F.first("confidence").alias("confidence")
    )
    index = broadcast_if_small(stored(index.select("token", "rule_tokens", "confidence"), "url-index"))
    return (
        pages.select(key, "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where("size(array_except(rule_tokens, tokens)) = 0")
        .groupBy(key)
        .agg(F.max("confidence").alias("mined_confidence"))
    )


def judge(pages: DataFrame, labels: DataFrame, fixed=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, url, host, path, rule, mined_confidence and verdict of every page.

    A page is labelled through the document its URL is numbered after (its path's first number, else none);
    bad is a label of low quality or of toxic text. Null URLs have no tokens and are allowed unless a rule
    blocks them; the mined rules judge a distinct URL once.
    """
    columns = pages.select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = columns.withColumns({"host": host, "path": path})
    judged = judged.withColumns(
        {"rule": fixed_rule(F.col("host"), F.col("path"), fixed), "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))}
    )
    judged = stored(judged, "url-parts")
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)")
    marks = labels.groupBy("doc_id").agg(((F.min("quality") < 1) | (F.max("toxic") > 0)).alias("bad"))
    labelled = judged.withColumn("doc", number).join(marks, F.col("doc") == F.col("doc_id"))
    rules = stored(mine_rules(labelled.select("tokens", "bad"), min_support, min_confidence), "url-rules")
    urls = judged.where("url is not null and size(tokens) > 0").groupBy("url").agg(F.first("tokens").alias("tokens"))
    matched = matching_rules(urls, rules, "url")
    result = judged.join(matched, "url", "left")
    listed = F.create_map(*[F.lit(x) for rule in fixed for x in rule])
    verdict = F.coalesce(listed[F.col("rule")], F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow"))
    return result.select("page_id", "url", "host", "path", "rule", "mined_confidence", verdict.alias("verdict"))
