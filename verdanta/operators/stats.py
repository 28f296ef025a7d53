"""Whole-column statistics and normalisation.

Exact ranks come from counts of distinct values, which are range-partitioned and counted within each partition;
what earlier partitions hold is carried over as one number per partition. So no task gathers a whole column,
however few groups there are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


#: parts of one that ``steady_mean`` counts in
PARTS = 1e9


def steady_mean(value: str) -> Column:
    """The mean of a column as an aggregate, the same in every order of the rows, so that thresholds and ranks may hang on it.

    Values are counted in billionths. These are whole numbers, whose sum is exact below 2^53, as of nine million
    values of 1; so means that are equal are equal doubles, and one that is a decimal is the double nearest to it.
    """
    return F.avg(F.round(F.col(value) * F.lit(PARTS))) / F.lit(PARTS)


def in_order(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """``df`` range-partitioned by its groups and ``key``, with the number of the partition as ``part``; equal keys share one."""
    return stored(df.repartitionByRange(*by, key).withColumn("part", F.spark_partition_id()))


def beside(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join by equal columns, of which NULLs are equal too."""
    named = right.withColumnsRenamed({c: f"{c}__right" for c in on})
    match = [left[c].eqNullSafe(named[f"{c}__right"]) for c in on] or F.lit(True)  # without columns both are one row
    return left.join(named, match, how).drop(*[f"{c}__right" for c in on])


def carried(ordered: DataFrame, by: list[str], **totals: tuple[Column, str]) -> DataFrame:
    """Per partition and group, what the partitions before it (or "after") hold of each total: one row each.

    A total is an aggregate of a partition and how to combine it: "sum", or "max" of those before, or "min" of those after.
    """
    parts = ordered.groupBy("part", *by).agg(*[column.alias(name) for name, (column, _) in totals.items()])
    order = Window.partitionBy(*by).orderBy("part")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    combine = {"sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "min": lambda c: F.min(c).over(after)}
    return parts.select("part", *by, *[combine[how](F.col(name)).alias(name) for name, (_, how) in totals.items()])


def ranked(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values v of each group with how often they occur (n) and how many rows are at or below them (upto)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ordered = in_order(counts, by, "v")
    before = carried(ordered, by, before=(F.sum("n"), "sum"))
    running = Window.partitionBy("part", *by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return beside(ordered.withColumn("own", F.sum("n").over(running)), before, ["part", *by]).select(*by, "v", "n", (F.col("own") + F.coalesce("before", F.lit(0))).alias("upto"))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles, linear between the two nearest values; a group without values has none."""
    by = by or []
    keyed = df if by else df.withColumn("all", F.lit(0))
    groups = by or ["all"]
    ranks = stored(ranked(keyed, value, groups))
    sizes = ranks.groupBy(*groups).agg(F.max("upto").alias("size"))
    at = {name: F.lit(share) * (F.col("size") - 1) for name, share in shares.items()}
    found = beside(ranks, sizes, groups).groupBy(*groups, "size").agg(*[F.min(F.when(F.col("upto") > edge(h), F.col("v"))).alias(f"{name}_{k}") for name, h in at.items() for k, edge in (("lo", F.floor), ("hi", F.ceil))])
    return found.select(*by, *[(F.col(f"{name}_lo") + (h - F.floor(h)) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))).alias(name) for name, h in at.items()])


def column_stats(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """min, max, mean, population std, median and count; NULLs don't count, and an empty input gives NULLs."""
    x = F.col(value)
    stats = df.groupBy(*(by or [])).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("count"))
    medians = percentiles(df, value, {"median": 0.5}, by)
    return beside(stats, medians, by or [], "left").select(*(by or []), "min", "max", "mean", "std", "median", "count")


def clip_to_percentile(df: DataFrame, value: str, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """``value`` clipped to its percentiles and stretched to [0, 1], as ``scaled``."""
    limits = percentiles(df, value, {"lo": low / 100, "hi": high / 100})  # one row
    x = F.col(value)
    clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.col("lo")), F.col("hi")))
    out = beside(df, F.broadcast(limits), [], "left")
    return out.withColumn("scaled", (clipped - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(1e-9))).drop("lo", "hi")


def quantiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    ranks = ranked(df, value, by)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    return beside(ranks, sizes, by).select(*by, "v", (F.col("upto") / F.col("size")).alias("q"))


def histogram_match(source: DataFrame, reference: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct source values (v) and the reference value at the same quantile (matched), linear in between and clamped at the ends."""
    src = quantiles(source, value, by).select(*by, "q", F.col("v").alias("sv"), F.lit(None).cast("double").alias("rv"))
    ref = quantiles(reference, value, by).select(*by, "q", F.lit(None).cast("double").alias("sv"), F.col("v").alias("rv"))
    at = F.when(F.col("rv").isNotNull(), F.struct("q", "rv"))
    ordered = in_order(src.unionByName(ref), by, "q")
    others = carried(ordered, by, below=(F.max(at), "max"), above=(F.min(at), "min"))
    # both frames grow from one end, so each row is added once
    own = Window.partitionBy("part", *by)
    grown = lambda order: own.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = ordered.withColumns({"lo": F.max(at).over(grown(F.col("q").asc())), "hi": F.min(at).over(grown(F.col("q").desc()))}).where("sv IS NOT NULL")
    both = beside(both, others, ["part", *by]).withColumns({"lo": F.coalesce("lo", "below"), "hi": F.coalesce("hi", "above")})

    def between() -> Column:
        lo, hi = F.col("lo"), F.col("hi")
        share = F.when(hi["q"] != lo["q"], (F.col("q") - lo["q"]) / (hi["q"] - lo["q"])).otherwise(F.lit(0.0))
        return F.when(lo.isNull(), hi["rv"]).when(hi.isNull(), lo["rv"]).otherwise(lo["rv"] + share * (hi["rv"] - lo["rv"]))

    return both.select(*by, F.col("sv").alias("v"), between().alias("matched"))
