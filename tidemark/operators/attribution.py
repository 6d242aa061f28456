"""Why a score moved, how it reads, and whether suggestions were right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import zscore


def group_statistics(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean and population deviation of each group, for z-scores of other values too."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def decompose(prior: DataFrame, current: DataFrame, keys: list[str], key_id: str, value: str = "x") -> DataFrame:
    """Change of each z: the own part, and that of the peers' distribution.

    own = z now - z of the prior value among the current peers; distribution = the
    rest. reason says why there is no split: no prior, no current value or no spread.
    """
    now, then = group_statistics(current, value, keys), group_statistics(prior, value, keys)
    p = prior.select(key_id, *keys, F.col(value).alias("x0")).join(then.select(*keys, F.col("mean").alias("m0"), F.col("std").alias("s0")), keys)
    c = current.select(key_id, *keys, F.col(value).alias("x1"))
    x = c.join(p, [key_id, *keys], "full_outer").join(now.select(*keys, F.col("mean").alias("m1"), F.col("std").alias("s1")), keys, "left")
    z0, z1 = zscore(F.col("x0"), F.col("m0"), F.col("s0")), zscore(F.col("x1"), F.col("m1"), F.col("s1"))
    counter = zscore(F.col("x0"), F.col("m1"), F.col("s1"))
    reason = F.when(F.col("x1").isNull(), "no_current").when(F.col("x0").isNull(), "no_prior").when(z0.isNull() | z1.isNull(), "no_spread")
    own = F.when(reason.isNull(), F.bround(z1 - counter, 12))
    delta = F.when(reason.isNull(), z1 - z0)
    return x.select(key_id, *keys, delta.alias("delta"), own.alias("own"), (delta - own).alias("distribution"), reason.alias("reason"))


def hit_rates(outcomes: DataFrame, keys: list[str], ret: str, peer: str, sign: Column) -> DataFrame:
    """Share of suggestions whose return was above the peers' median; sales count turned round."""
    hit = sign * F.col(ret) > sign * F.col(peer)
    return outcomes.filter(F.col(ret).isNotNull() & F.col(peer).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("hit_rate")
    )


def merged_ranges(ranges: DataFrame, key: str, lookback: int) -> DataFrame:
    """One window of each key: from the earliest start less a look-back to the latest end."""
    return ranges.groupBy(key).agg(
        F.date_sub(F.min("start"), lookback).alias("start"),
        F.max("end").alias("end"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )


def effect(contribution: Column, available: Column, applicable: Column) -> Column:
    return (
        F.when(~applicable, "not_applicable").when(~available, "unavailable")
        .when(contribution > 0, "supports").when(contribution < 0, "weighs").otherwise("neutral")
    )


def position(percentile: Column) -> Column:
    return (
        F.when(percentile >= 75, "leading").when(percentile >= 60, "above average").when(percentile >= 40, "average")
        .when(percentile >= 25, "below average").when(percentile.isNotNull(), "trailing").otherwise("not ranked")
    )


def strongest(legs: DataFrame, key: str, each: int = 2) -> DataFrame:
    """The legs that support a score most, and those that weigh on it most."""
    up = Window.partitionBy(key).orderBy(F.desc("contribution"), "leg")
    down = Window.partitionBy(key).orderBy("contribution", "leg")
    x = legs.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    a = x.filter((F.col("contribution") > 0) & (F.col("_u") <= each)).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_u", "leg"))), lambda s: s["leg"]), ", ").alias("supports"))
    b = x.filter((F.col("contribution") < 0) & (F.col("_d") <= each)).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_d", "leg"))), lambda s: s["leg"]), ", ").alias("weighs"))
    return legs.select(key).distinct().join(a, key, "left").join(b, key, "left")
