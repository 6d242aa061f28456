"""Repair of price series: conventions, quarantine, rewritten fields, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.integrity import ADJUSTED_TOLERANCE, MAX_RETURN, adjustment_factors, bar_findings, forward_anomalies, series_anomalies

#: Fixed values of the integrity policy.
CONVENTION_TOLERANCE, FACTOR_TOLERANCE = 0.01, 0.002
MAX_FORWARD_RETURN = 10.0
HORIZONS = (21, 63, 126)
#: Series findings that make a bar unusable; the others are warnings.
ERRORS = {"SPLIT_FACTOR_DISCONTINUITY": "SPLIT_FACTOR_DISCONTINUITY", "IMPLAUSIBLE_JUMP_ERROR": "IMPLAUSIBLE_JUMP"}


def unquarantined(bars: DataFrame, flag: str = "quarantined") -> DataFrame:
    """Bars that may be read; a missing flag means that they may."""
    return bars.filter(~F.coalesce(F.col(flag), F.lit(False)))


def quarantined_only(bars: DataFrame, flag: str = "quarantined") -> DataFrame:
    return bars.filter(F.coalesce(F.col(flag), F.lit(False)))


def off(value: Column, expected: Column) -> Column:
    """Relative deviation; null if there is nothing to compare with."""
    return F.when(expected != 0, F.abs(value - expected) / F.abs(expected))


def conventions(bars: DataFrame) -> DataFrame:
    """Which adjustment each security's stored series follows, by the median deviation.

    Both candidates' factors are running products; TOTAL_RETURN wins ties and stands in
    where neither fits. verified: the chosen one is within CONVENTION_TOLERANCE.
    """
    keys = ["security_id", "session_date"]
    both = adjustment_factors(bars).withColumnRenamed("factor", "total_factor").drop("event")
    split = adjustment_factors(bars.withColumn("dividend", F.lit(0.0))).select(*keys, F.col("factor").alias("split_only"))
    x = both.join(split, keys)
    ok = F.col("close") > 0
    x = x.withColumn("_t", F.when(ok, off(F.col("close_adjusted"), F.col("close") * F.col("total_factor"))))
    x = x.withColumn("_s", F.when(ok, off(F.col("close_adjusted"), F.col("close") * F.col("split_only"))))
    g = x.groupBy("security_id").agg(F.median("_t").alias("total_off"), F.median("_s").alias("split_off"))
    split_fits = (F.col("split_off") < F.col("total_off")) & (F.col("split_off") <= CONVENTION_TOLERANCE)
    deviation = F.when(split_fits, F.col("split_off")).otherwise(F.col("total_off"))
    g = g.select(
        "security_id",
        F.when(F.coalesce(split_fits, F.lit(False)), "SPLIT_ONLY").otherwise("TOTAL_RETURN").alias("convention"),
        deviation.alias("deviation"),
        F.coalesce(deviation <= CONVENTION_TOLERANCE, F.lit(False)).alias("verified"),
    )
    return x.drop("_t", "_s").join(g, "security_id")


def plan(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Every bar with what a repair would do to it; nothing is written.

    Of the bars of a session the last by id stays, the others are quarantined as
    duplicates. Structural faults, series errors and impossible forward returns (put on
    the session at fault, if its own move is implausible) quarantine bars. Where the
    convention is verified, adjusted closes and factors out of tolerance are rebuilt.
    Columns codes (sorted), action (quarantine, release or null), new_adjusted,
    new_factor (null: unchanged), convention, verified, changed. Windows by security;
    findings are few rows, joined back.
    """
    keys = ["security_id", "session_date"]
    w = Window.partitionBy(*keys).orderBy(F.desc("bar_id"))
    x = bars.withColumn("_r", F.row_number().over(w))
    kept = x.filter("_r = 1").drop("_r")
    faults = bar_findings(kept).select(*keys, "code").distinct()
    sound = kept.join(faults.select(*keys).distinct(), keys, "left_anti")
    series = series_anomalies(sound).filter(F.col("code").isin(*ERRORS))
    series = series.select(*keys, F.when(F.col("code") == "IMPLAUSIBLE_JUMP_ERROR", "IMPLAUSIBLE_JUMP").otherwise(F.col("code")).alias("code"))
    adjusted = sound.withColumn("close", F.col("close_adjusted"))
    found = faults.unionByName(series)
    for h in horizons:
        worst = forward_anomalies(adjusted, h, MAX_FORWARD_RETURN).filter(F.col("worst_move") > MAX_RETURN)
        found = found.unionByName(worst.select("security_id", F.col("culprit").alias("session_date"), F.lit("FORWARD_RETURN_ANOMALY").alias("code")))
    found = found.groupBy(*keys).agg(F.array_sort(F.collect_set("code")).alias("found"))
    known = conventions(sound)
    factor = F.when(F.col("convention") == "SPLIT_ONLY", F.col("split_only")).otherwise(F.col("total_factor"))
    known = known.select(*keys, "convention", "verified", F.when(F.col("verified"), factor).alias("_f"))
    x = x.join(found, keys, "left").join(known, keys, "left")
    none = F.array().cast("array<string>")
    codes = F.when(F.col("_r") > 1, F.array(F.lit("DUPLICATE_BAR"))).otherwise(F.coalesce("found", none))
    x = x.withColumn("codes_now", codes)
    bad, was = F.size("codes_now") > 0, F.coalesce(F.col("quarantined"), F.lit(False))
    held = F.coalesce(F.col("codes"), none)
    action = F.when(bad & (~was | (F.array_sort(held) != F.col("codes_now"))), "quarantine").when(~bad & (was | (F.size(held) > 0)), "release")
    f = F.when((F.col("_r") == 1) & (F.col("close") > 0), F.col("_f"))
    want = F.round(F.col("close") * f, 6)
    adjusted_off = F.col("close_adjusted").isNull() | (off(F.col("close_adjusted"), want) > ADJUSTED_TOLERANCE)
    factor_off = F.col("factor").isNull() | (off(F.col("factor"), F.round(f, 10)) > FACTOR_TOLERANCE)
    x = x.withColumn("action", action)
    x = x.withColumn("new_adjusted", F.when(adjusted_off, want)).withColumn("new_factor", F.when(factor_off, F.round(f, 10)))
    changed = F.col("action").isNotNull() | F.col("new_adjusted").isNotNull() | F.col("new_factor").isNotNull()
    return x.withColumn("changed", changed).drop("_r", "found", "_f")


def manifest(planned: DataFrame) -> DataFrame:
    """One report for each security: what was examined and would change, and where."""
    when = lambda c: F.when(c, F.col("session_date"))
    repairs = F.col("new_adjusted").isNotNull().cast("long") + F.col("new_factor").isNotNull().cast("long")
    return planned.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("bars"),
        F.max("convention").alias("convention"),
        F.sum(repairs).alias("repairs"),
        F.sum((F.col("action") == "quarantine").cast("long")).alias("quarantined"),
        F.sum((F.col("action") == "release").cast("long")).alias("released"),
        F.min(when(F.col("changed"))).alias("first_date"),
        F.max(when(F.col("changed"))).alias("last_date"),
    )


def affected(planned: DataFrame) -> DataFrame:
    """The span of dates of each security and reason."""
    repaired = F.col("new_adjusted").isNotNull() | F.col("new_factor").isNotNull()
    reasons = F.array_compact(F.array(F.when(repaired, F.lit("adjusted_repair")), F.col("action")))
    x = planned.select("security_id", "session_date", F.explode(reasons).alias("reason"))
    return x.groupBy("security_id", "reason").agg(F.min("session_date").alias("start"), F.max("session_date").alias("end"))


def applied(planned: DataFrame, revision: int) -> DataFrame:
    """The bars after the repair; source fields keep what was there first.

    Applying twice is applying once: a plan over the result changes nothing.
    """
    none = F.array().cast("array<string>")
    columns = {
        "close_adjusted": F.coalesce("new_adjusted", "close_adjusted"),
        "factor": F.coalesce("new_factor", "factor"),
        "quarantined": F.when(F.col("action") == "quarantine", True).when(F.col("action") == "release", False).otherwise(F.coalesce(F.col("quarantined"), F.lit(False))),
        "codes": F.when(F.col("action") == "quarantine", F.col("codes_now")).when(F.col("action") == "release", none).otherwise(F.coalesce("codes", none)),
        "revision": F.when(F.col("changed"), F.lit(revision)).otherwise(F.col("revision")),
    }
    return planned.withColumns(columns).drop("codes_now", "action", "new_adjusted", "new_factor", "convention", "verified", "changed")
