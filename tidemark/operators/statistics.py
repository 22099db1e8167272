"""Percentiles, drift statistics and latency summaries as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import materialize

PSI_BINS = 10
PSI_FLOOR = 1e-6
PSI_LEAST = 20


def running(counts: DataFrame, keys: list[str], value: str, totals: list[str]) -> DataFrame:
    """counts: one row for each (keys, value). Adds for each column of `totals` its sum up to and with the
    row in the order of value (`<name>_upto`) and over all rows of the keys (`<name>_all`). Rows lie in
    ranges of (keys, value): sums within a range, plus those of the ranges before, so no task holds a whole
    key. Null keys are a group; at most one row for each key and range is exchanged besides."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(counts.repartitionByRange(n, *keys, value).withColumn("_part", F.spark_partition_id()), "running")
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    parts = dealt.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in totals])
    ranges = [F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}_ahead") for c in totals] + [F.sum(c).over(whole).alias(f"{c}_all") for c in totals]
    parts = parts.select(F.struct(*keys, "_part").alias("_range"), *ranges)
    here = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumns({f"_{c}_here": F.sum(c).over(here) for c in totals})
    out = rows.join(parts, F.struct(*keys, "_part").eqNullSafe(F.col("_range")))
    return out.select(*counts.columns, *[(F.col(f"_{c}_ahead") + F.col(f"_{c}_here")).alias(f"{c}_upto") for c in totals], *[f"{c}_all" for c in totals])


def _ranked(samples: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, n, n_upto, n_all): the distinct values and how many rows are not above them."""
    return running(samples.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), keys, value, ["n"])


def percentiles(samples: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: exact percentiles by linear interpolation, a column for each share; null without values."""
    ranked = _ranked(samples, value, [])
    at = lambda k: F.min(F.when(F.col("n_upto") > k, F.col(value)))
    rank = {name: F.lit(q) * (F.col("n_all") - 1) for name, q in shares.items()}
    ends = [e for name, r in rank.items() for e in (at(F.floor(r)).alias(f"_{name}_lo"), at(F.ceil(r)).alias(f"_{name}_hi"), F.max(r - F.floor(r)).alias(f"_{name}_part"))]
    found = ranked.agg(*ends)
    between = lambda c: F.col(f"_{c}_lo") + (F.col(f"_{c}_hi") - F.col(f"_{c}_lo")) * F.col(f"_{c}_part")
    return found.select(*[between(c).alias(c) for c in shares])


def latency_summary(samples: DataFrame, value: str) -> DataFrame:
    """One row: count, min, max, mean, median, p90, p99 (linear interpolation) and the median absolute
    deviation, which takes a second pass."""
    x = F.col(value)
    first = samples.agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))
    ranks = percentiles(samples, value, {"median": 0.5, "p90": 0.9, "p99": 0.99}).first()
    mad = None
    if ranks["median"] is not None:
        mad = percentiles(samples.select(F.abs(x - F.lit(ranks["median"])).alias("_apart")), "_apart", {"mad": 0.5}).first()["mad"]
    return first.withColumns({c: F.lit(ranks[c]).cast("double") for c in ("median", "p90", "p99")} | {"mad": F.lit(mad).cast("double")})


def nearest_rank(samples: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Quantiles that are values: x[n div 2], x[min(n - 1, int(0.99 n))], the greatest. Counts of equal
    values are summed in order, so a group is ranked by its distinct values."""
    keys = [by] if by else []
    ranked = _ranked(samples, value, keys)
    at = lambda k: F.min(F.when(F.col("n_upto") > k, F.col(value)))
    n = F.col("n_all")
    return ranked.groupBy(*keys).agg(at(F.floor(n / 2)).alias("p50"), at(F.least(n - 1, F.floor(n * 0.99))).alias("p99"), F.max(value).alias("max"))


def sides(left: DataFrame, right: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, v, a, b and their running sums): counts of each value on either side, in order; all that
    PSI, KS and AUC need."""
    a = left.select(*keys, F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = right.select(*keys, F.col(value).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    counts = a.unionByName(b).filter(F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return running(counts, keys, "v", ["a", "b"])


def ks_of(both: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ks) of what `sides` returns."""
    share = lambda c: F.col(f"{c}_upto") / F.nullif(F.col(f"{c}_all"), F.lit(0))
    return both.groupBy(*keys).agg(F.max(F.abs(share("a") - share("b"))).alias("ks"))


def ks_statistic(left: DataFrame, right: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, ks): greatest distance of the two distribution functions; null if a side is empty."""
    return ks_of(sides(left, right, value, keys), keys)


def psi_of(both: DataFrame, keys: list[str], bins: int = PSI_BINS) -> DataFrame:
    """(keys, psi) of what `sides` returns. A key has fewer edges than bins, which come as an array."""
    c = both.withColumn("upto", F.col("a_upto") + F.col("b_upto")).withColumn("n", F.col("a_all") + F.col("b_all"))
    before = F.col("upto") - F.col("a") - F.col("b")
    rank = lambda i: F.floor(F.lit(i / bins) * (F.col("n") - 1))
    is_edge = F.lit(False)
    for i in range(1, bins):
        is_edge = is_edge | ((before <= rank(i)) & (rank(i) < F.col("upto")))
    edges = c.filter(is_edge).groupBy(*keys).agg(F.collect_set("v").alias("_edges")).select(F.struct(F.lit(0), *keys).alias("_of"), "_edges")
    c = c.join(edges, F.struct(F.lit(0), *keys).eqNullSafe(F.col("_of")))
    binned = c.withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col("v"))))
    binned = binned.groupBy(*keys, "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.first("n").alias("n"), F.first("a_all").alias("na"), F.first("b_all").alias("nb"))
    share = lambda x, n: F.greatest(F.col(x) / F.nullif(F.col(n), F.lit(0)), F.lit(PSI_FLOOR))
    term = (share("b", "nb") - share("a", "na")) * F.ln(share("b", "nb") / share("a", "na"))
    total = binned.groupBy(*keys).agg(F.sum(term).alias("psi"), F.first("n").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.select(*keys, F.when((F.col("n") >= PSI_LEAST) & (F.col("na") > 0) & (F.col("nb") > 0), F.col("psi")).alias("psi"))


def population_stability_index(left: DataFrame, right: DataFrame, value: str, keys: list[str], bins: int = PSI_BINS) -> DataFrame:
    """(keys, psi): edges are pooled values at ranks int(i / bins * (n - 1)), a value's bin the number of
    distinct edges below it, shares at least PSI_FLOOR; null with fewer than PSI_LEAST pooled values
    or an empty side."""
    return psi_of(sides(left, right, value, keys), keys, bins)


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row, auc: the share of (positive, negative) pairs in which the positive scores higher, ties
    half; exact, from ranks of the distinct scores. Null without positives or negatives."""
    is_positive = F.col(label) == 1
    both = sides(scored.filter(~is_positive), scored.filter(is_positive), score, [])
    below = F.col("a_upto") - F.col("a") / 2
    pairs = F.max("a_all").cast("double") * F.max("b_all")
    return both.agg((F.sum(F.col("b") * below) / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def close(a: Column, b: Column, rel: float, abs_: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))
