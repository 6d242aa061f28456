"""Cross-sections: three-tier statistics, blended z-scores and percentiles, composite.

Group statistics are aggregated (combined before the shuffle) and joined back, rather
than taken by a window over the whole universe: no task holds a whole tier's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpointed
from tidemark.functions.scalar import confidence, half_up, scope, tier_weights, winsorise, zscore

#: Weight of each leg by filer profile.
WEIGHTS = {
    "DOMESTIC": {"thesis_linkage": 0.20, "attention": 0.15, "narrative": 0.10, "health": 0.20, "smart_money": 0.20, "valuation": 0.15},
    "FPI": {"thesis_linkage": 0.25, "attention": 0.1875, "narrative": 0.125, "health": 0.25, "valuation": 0.1875},
}
TIERS = ("cohort", "parent", "universe")


def scopes(members: DataFrame) -> DataFrame:
    """Members of each tier, and the tier that a security is compared in."""
    c = members.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_n"))
    p = members.groupBy("parent").agg(F.count(F.lit(1)).alias("parent_n"))
    out = members.join(c, "cohort").join(p, "parent")
    return out.withColumns(
        {"scope": scope(F.col("cohort_n"), F.col("parent_n")), "confidence": confidence(F.col("cohort_n"), F.col("parent_n"))}
    )


def tier_statistics(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, mean and population deviation of the non-null values of all three tiers.

    One scan and one aggregation, by cohort; the wider tiers' sums are windows over the
    cohorts' sums, one row for each cohort and key. A row for each key and cohort.
    """
    x = F.col(value)
    base = rows.groupBy(*keys, "cohort", "parent").agg(
        F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")
    )
    over = {"cohort": [*keys, "cohort"], "parent": [*keys, "parent"], "universe": [*keys, F.lit(0)]}
    out = base
    for tier in TIERS:
        w = Window.partitionBy(*over[tier])
        n, s, q = (F.sum(c).over(w) for c in ("n", "s", "q"))
        out = out.withColumns({f"_{tier}_n": n, f"_{tier}_s": s, f"_{tier}_q": q})
    picked = []
    for tier in TIERS:
        n, s, q = (F.col(f"_{tier}_{c}") for c in ("n", "s", "q"))
        mean = F.when(n > 0, s / n)
        var = F.when(n > 0, F.greatest(F.lit(0.0), q / n - mean * mean))
        # a deviation that is rounding noise of equal values is none
        std = F.when(var > 1e-13 * mean * mean, F.sqrt(var)).otherwise(F.when(n > 0, F.lit(0.0)))
        picked += [n.alias(f"{tier}_vn"), mean.alias(f"{tier}_mean"), std.alias(f"{tier}_std")]
    return out.select(*keys, "cohort", "parent", *picked)


def blended_zscores(rows: DataFrame, value: str = "x", keys: tuple[str, ...] = ("leg",)) -> DataFrame:
    """``rows`` with z: the blend of the z-scores in each tier.

    A tier counts with its shrinkage weight if it has two values and a deviation;
    weights are made to sum to one over the tiers that count. Needs cohort_n, parent_n.
    """
    out = rows.join(tier_statistics(rows, value, list(keys)), [*keys, "cohort", "parent"], "left")
    top, bottom = F.lit(0.0), F.lit(0.0)
    for tier, w in zip(TIERS, tier_weights(F.col("cohort_n"), F.col("parent_n")), strict=True):
        ok = F.col(value).isNotNull() & (w > 0) & (F.col(f"{tier}_vn") >= 2) & (F.col(f"{tier}_std") > 0)
        top += F.when(ok, w * zscore(F.col(value), F.col(f"{tier}_mean"), F.col(f"{tier}_std"))).otherwise(0.0)
        bottom += F.when(ok, w).otherwise(0.0)
    drop = [f"{t}_{c}" for t in TIERS for c in ("vn", "mean", "std")]
    return out.withColumn("z", F.when(bottom > 0, top / bottom)).drop(*drop)


def percentile_fraction(value: str, keys: list[str]):
    """(below + ties / 2) / n among the non-null values of ``keys``; null for null."""
    part = Window.partitionBy(*keys, F.col(value).isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, F.col(value)))
    below = F.rank().over(part.orderBy(F.col(value))) - 1
    return F.when(F.col(value).isNotNull(), (below + ties / 2) / F.count(F.lit(1)).over(part))


#: Parts that the values of a wide group are cut into before they are ranked.
CUTS = 64


def wide_fraction(rows: DataFrame, value: str, keys: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` with ``percentile_fraction`` as ``name``, for groups of any size.

    Equal values are counted first; the distinct ones are cut into about CUTS parts at
    approximate quantiles, and ranked within each part. The parts' totals, CUTS rows a
    group, give what lies below. So no task sorts a whole group. Rows are written first:
    sums of doubles may differ in their last bits if they are computed twice, and the
    ranks are joined back by value.
    """
    keys, rows = list(keys), checkpointed(rows)
    some = rows.filter(F.col(value).isNotNull())
    counts = some.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    at = F.percentile_approx(value, F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), F.lit(10_000))
    cuts = counts.groupBy(*keys).agg(at.alias("_cuts"))
    counts = counts.join(cuts, keys) if keys else counts.crossJoin(F.broadcast(cuts))
    counts = counts.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    upto = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_here", F.sum("_k").over(upto))
    parts = counts.groupBy(*keys, "_part").agg(F.sum("_k").alias("_t"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    parts = parts.withColumn("_all", F.sum("_t").over(group))
    parts = parts.withColumn("_below", F.sum("_t").over(group.orderBy("_part")) - F.col("_t"))
    f = (F.col("_below") + F.col("_here") - F.col("_k") / 2) / F.col("_all")
    out = counts.join(parts.drop("_t"), [*keys, "_part"]).select(*keys, value, f.alias(name))
    return rows.join(out, [*keys, value], "left")


def blended_percentiles(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with percentile: 0 to 100, blended over the tiers, halves up."""
    out = wide_fraction(rows, value, keys, "_universe")
    top = bottom = F.lit(0.0)
    for tier, w in zip(TIERS, tier_weights(F.col("cohort_n"), F.col("parent_n")), strict=True):
        if tier != "universe":
            out = out.withColumn(f"_{tier}", percentile_fraction(value, [*keys, tier]))
        ok = F.col(f"_{tier}").isNotNull() & (w > 0)
        top += F.when(ok, w * F.col(f"_{tier}")).otherwise(0.0)
        bottom += F.when(ok, w).otherwise(0.0)
    out = out.withColumn("percentile", F.when(bottom > 0, half_up(F.round(100 * top / bottom, 9))))
    return out.drop(*[f"_{t}" for t in TIERS])


def weighted(legs: DataFrame) -> DataFrame:
    """Legs with the weight that the filer's profile gives them; null if not applicable."""
    w = F.lit(None).cast("double")
    for profile, by_leg in WEIGHTS.items():
        for leg, x in by_leg.items():
            w = F.when((F.col("profile") == profile) & (F.col("leg") == leg), x).otherwise(w)
    return legs.withColumn("weight", w)


def composite(legs: DataFrame, keys: tuple[str, ...] = ("security_id", "cohort", "parent")) -> DataFrame:
    """Composite of each security: winsorised z by weight over all applicable weight.

    An applicable leg without z counts with 0 and its weight; composite is null if no
    leg has one. coverage: computable legs among the applicable.
    """
    w, z = F.col("weight"), winsorise(F.col("z"))
    extra = [c for c in ("cohort_n", "parent_n", "scope", "confidence") if c in legs.columns]
    g = legs.filter(w.isNotNull()).groupBy(*keys, *extra).agg(
        F.sum(F.when(z.isNotNull(), w * z).otherwise(0.0)).alias("top"),
        F.sum(w).alias("bottom"),
        F.count(z).alias("computable"),
        F.count(F.lit(1)).alias("applicable"),
    )
    return g.select(
        *keys,
        *extra,
        F.when(F.col("computable") > 0, F.col("top") / F.col("bottom")).alias("composite"),
        (F.col("computable") / F.col("applicable")).alias("coverage"),
    )


def score_universe(legs: DataFrame, members: DataFrame) -> DataFrame:
    """From raw legs to composite, percentile and coverage of each security."""
    sized = scopes(members).select("security_id", "cohort_n", "parent_n", "scope", "confidence")
    z = blended_zscores(legs.join(sized, "security_id"))
    return blended_percentiles(composite(weighted(z)), "composite")
