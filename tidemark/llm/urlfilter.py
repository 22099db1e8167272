"""URL filters, in DataFrame functions only: given host and path rules first, mined rules else.

Mining: each labelled URL is a set of tokens plus its label; Spark's FP-growth finds frequent sets,
and association rules "tokens => block" pruned by confidence, support and lift are kept. Matching:
an inverted index lists each rule under its rarest token; a URL's tokens look up the rules that may
fit, and those whose tokens it holds all are hits.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

#: (verdict, host, path): the given rules; host without leading dot, path with its slash.
GIVEN_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Labelled rows mined at most: those with the smallest hashed ids.
TRAIN_ROWS = 100_000
MIN_SUPPORT = 0.002
#: A frequent set occurs in so many labelled rows at least, beside MIN_SUPPORT as a share of them.
MIN_COUNT = 25
#: A rule's URLs are bad more often than not, MIN_LIFT times as often as any, and by MIN_DEVIATIONS
#: standard deviations more often than chance would have it for so many rows.
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
MIN_DEVIATIONS = 5.0
BAD = "label=block"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null or without `://`."""
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, at, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(u, at, 2)


def given_rule(host: Column, path: Column, rules=GIVEN_RULES) -> tuple[Column, Column]:
    """The longest given rule that fits (host + path, else null) and its verdict. Rules are few and
    constant, so they are one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the host and its suffixes, words of hyphenated labels, path segments with their depth, names of query parameters, scheme, file extension."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            suffixes,
            # words of hyphenated labels
            F.flatten(F.transform(F.filter(labels, lambda x: x.rlike("[-_]")), lambda x: F.transform(F.filter(F.split(x, "[-_]"), lambda w: w != ""), lambda w: F.concat(F.lit("word:"), w)))),
            F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x)),
            F.transform(names, lambda x: F.concat(F.lit("query:"), x)),
            F.array(F.concat(F.lit("depth:"), F.size(segments).cast("string"))),
            F.filter(F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]+)://", 1)), lambda x: x != ""),
        )
    )


def mine_rules(labelled: DataFrame, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, min_lift=MIN_LIFT) -> DataFrame:
    """labelled: (id, tokens, bad boolean). Rules (items array, confidence, support), none implied by a shorter one."""
    h = F.xxhash64("id", F.lit(3))
    bound = labelled.select(h.alias("h")).orderBy("h").limit(TRAIN_ROWS).agg(F.max("h")).first()[0]
    sample = labelled.limit(0) if bound is None else labelled.filter(h <= bound)
    items = sample.select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items")).filter(F.size("items") > 0).cache()
    try:
        n = items.count()
        if n < MIN_COUNT:
            return labelled.sparkSession.createDataFrame([], "items array<string>, confidence double, support double")
        model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_COUNT / n), minConfidence=min_confidence).fit(items)
        rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
        base = F.col("confidence") / F.col("lift")
        rows = F.col("support") * n / F.col("confidence")
        rules = rules.filter((F.col("confidence") - base) * F.sqrt(rows) >= MIN_DEVIATIONS * F.sqrt(base * (1 - base)))
        passing = materialize(rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "rules")
    finally:
        items.unpersist()
    # a rule that a shorter rule implies adds nothing
    shorter = rule_index(passing).withColumnRenamed("items", "_less")
    implied = passing.select("items", F.explode("items").alias("token")).join(shorter, "token")
    implied = implied.filter((F.size("_less") < F.size("items")) & (F.size(F.array_except("_less", "items")) == 0)).select("items").distinct()
    least = materialize(passing.join(implied, "items", "left_anti"), "rules")
    forget(passing)
    return least


def rule_index(rules: DataFrame) -> DataFrame:
    """(token, items): each rule under its rarest token."""
    freq = rules.select(F.explode("items").alias("token")).groupBy("token").count()
    return rules.select("items", F.explode("items").alias("token")).join(freq, "token").groupBy("items").agg(F.min_by("token", F.struct("count", "token")).alias("token")).select("token", "items")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: (url, tokens). The distinct urls that hold all items of some rule, by the inverted index,
    which Spark broadcasts if it is small."""
    probe = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    hits = probe.join(rule_index(rules), "token").filter(F.size(F.array_except("items", "tokens")) == 0)
    return hits.select("url").distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, rules=GIVEN_RULES, id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row. Where no given rule fits, a URL is blocked if
    a mined rule hits it. A labelled page is one whose id has a label row; bad means low quality or
    toxic. Null urls have no tokens but depth, empty host and path, and are allowed unless mined
    rules say otherwise; without labels nothing is mined. Repeated rows are judged alike."""
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col("url"), host.alias("host"), path.alias("path"))
    bad = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    mined = mine_rules(urls.join(bad, "id").select("id", tokens.alias("tokens"), "bad"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    judged = urls.withColumn("rule", rule).withColumn("_given", verdict)
    if mined.isEmpty():
        hit = F.lit(False)
    else:
        open_urls = judged.filter("rule IS NULL").select("url", "host", "path").distinct()
        hits = match_rules(open_urls.select("url", tokens.alias("tokens")), mined).withColumnRenamed("url", "_hit")
        judged = judged.join(hits, judged["url"].eqNullSafe(hits["_hit"]), "left")
        hit = F.col("_hit").isNotNull()
    out = F.coalesce("_given", F.when(hit, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", out.alias("verdict"))
