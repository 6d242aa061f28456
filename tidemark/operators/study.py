"""Comparing signals with one another: matched populations, benchmarks, variants, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpointed
from tidemark.functions.scalar import effective_size, two_sided_p
from tidemark.operators import perf


def matched_ic(rows: DataFrame, value: str, ret: str, keys: list[str]) -> DataFrame:
    """Rank correlation over the rows that have both values, and how many had the first."""
    had = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"))
    out = had.join(perf.spearman(rows, value, ret, keys), keys, "left")
    population = F.coalesce("population", F.lit(0))
    return out.select(*keys, population.alias("population"), "candidates", (population / F.col("candidates")).alias("coverage"), "ic")


def paired(rows: DataFrame, champion: str, benchmark: str, keys: list[str]) -> DataFrame:
    """Differences of two series by date: mean, sample deviation, share of wins."""
    diff = F.col(champion) - F.col(benchmark)
    x = rows.withColumn("_d", diff).filter("_d IS NOT NULL")
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_difference"), F.stddev_samp("_d").alias("std"), F.avg((F.col("_d") > 0).cast("double")).alias("wins")
    )


def trimmed_mean(rows: DataFrame, value: str, keys: list[str], sigma: float = 3.0) -> DataFrame:
    """Mean without what is more than ``sigma`` sample deviations off, and how many that are."""
    g = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n"))
    x = rows.filter(F.col(value).isNotNull()).join(g, keys)
    near = ~F.coalesce(F.col("_s") > 0, F.lit(False)) | (F.abs(F.col(value) - F.col("_m")) <= sigma * F.col("_s"))
    out = x.groupBy(*keys).agg(F.avg(F.when(near, F.col(value))).alias("_t"), F.count(F.when(near, 1)).alias("_k"), F.max("_m").alias("_m"), F.max("_n").alias("_n"))
    return out.select(*keys, F.coalesce("_t", "_m").alias("trimmed"), F.when(F.col("_k") > 0, F.col("_n") - F.col("_k")).otherwise(0).alias("dropped"))


def net_of_costs(gross: Column, turnover: Column, cost: float) -> Column:
    return gross - turnover * cost


def autocorrelations(series: DataFrame, value: str, keys: list[str], order: str, lags: int) -> DataFrame:
    """rho_1 to rho_lags of each series, n, and the sample size that they leave.

    Lags of n or more have none; a series without variance has zeros.
    """
    part = Window.partitionBy(*keys)
    w = part.orderBy(order)
    x = series.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(part))
    x = x.select(*keys, "_d", *[(F.col("_d") * F.lag("_d", k).over(w)).alias(f"_g{k}") for k in range(1, lags + 1)])
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(f"_g{k}").alias(f"_g{k}") for k in range(1, lags + 1)]
    )
    rho = [F.when(F.col("n") > k, F.when(F.col("_v") > 0, F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) / F.col("_v")).otherwise(0.0)).alias(f"rho_{k}") for k in range(1, lags + 1)]
    g = g.select(*keys, "n", *rho)
    top = F.least(F.lit(lags), F.col("n") - 1)
    total = sum((F.coalesce((1 - F.lit(k) / (top + 1)) * F.col(f"rho_{k}"), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    return g.withColumn("effective", F.col("n") / F.greatest(F.lit(1.0), 1 + 2 * total))


def overlap_inflation(horizon: Column, n: Column) -> Column:
    """How far overlapping windows inflate a variance."""
    return F.when(horizon > 1, F.least(horizon, n)).otherwise(1)


def excludes_zero(low: Column, high: Column) -> Column:
    return (low < high) & ((low > 0) | (high < 0))


def against(ics: DataFrame, champion: str, z: float, horizons: tuple[int, ...]) -> DataFrame:
    """Each variant against the champion, by horizon: paired differences with an interval and a test.

    ``ics`` has variant, horizon, session_date and ic: one row for each date. It is
    computed once and written, as are the comparisons. Tests are adjusted together.
    """
    base = ics.filter(F.col("variant") == champion).select("horizon", "session_date", F.col("ic").alias("_base"))
    x = ics.filter(F.col("variant") != champion).join(base, ["horizon", "session_date"])
    x = checkpointed(x.withColumn("diff", F.col("ic") - F.col("_base")).filter("diff IS NOT NULL"))  # read once for each horizon
    parts = [perf.newey_west(x.filter(F.col("horizon") == h), "diff", ["variant", "horizon"], "session_date", h, z) for h in horizons]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumnRenamed("mean", "mean_difference").withColumn("excludes_zero", F.coalesce(excludes_zero(F.col("low"), F.col("high")), F.lit(False)))
    out = out.withColumn("p", F.round(two_sided_p(F.col("mean_difference") / F.col("se")), 9))
    out = checkpointed(out).withColumn("family", F.lit("variants")).withColumn("name", F.concat_ws(":", "variant", "horizon"))
    tested = perf.benjamini_hochberg(out, "p", ["family"], "name").select("name", "q", "significant")
    return out.join(tested, "name", "left").drop("name", "family")


def verdict(primary: int, least_effective: float) -> Column:
    """What a registered study says of a variant; too little evidence never promotes."""
    enough = (effective_size(F.col("n"), F.col("horizon")) >= least_effective) & F.col("mean_difference").isNotNull()
    return (
        F.when(F.col("horizon") != primary, "not_primary").when(~enough, "insufficient_evidence")
        .when(F.col("mean_difference") <= 0, "no_improvement")
        .when(~F.col("excludes_zero") | ~F.coalesce("significant", F.lit(False)), "insufficient_evidence").otherwise("promote")
    )


def plain_decimal(x: Column, places: int = 10) -> Column:
    """A number at fixed precision without trailing zeros; halves go to the even digit."""
    text = F.bround(x, places).cast(f"decimal(38,{places})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def detail(**items: Column) -> Column:
    """Name=value pairs of what isn't null, as a map."""
    pairs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in items.items()]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def latest(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """The last row of each key."""
    best = F.max_by(F.struct(*rows.columns), F.col(date)).alias("b")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best).select("b.*")
