"""Price series: structural checks, anomalies, adjustment factors, dedupe, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the integrity policy.
MAX_RETURN, EXTREME_RETURN = 0.45, 5.0
ADJUSTED_TOLERANCE = 0.002
MIN_SPLIT, SPLIT_TOLERANCE = 1.9, 0.05
SPLITS = (2, 3, 4, 5, 6, 7, 8, 10, 15, 20, 25, 30, 40, 50, 100)


def bar_findings(bars: DataFrame) -> DataFrame:
    """One row for each structural fault of a bar (security_id, session_date, code, detail)."""
    prices = ("open", "high", "low", "close")
    sound = F.lit(True)
    checks = []
    for p in prices:
        good = F.col(p).isNotNull() & (F.col(p) > 0)
        sound &= good
        checks.append((~good, "NON_POSITIVE_PRICE", f"{p} must be > 0"))
    o, h, low, c = (F.col(p) for p in prices)
    checks += [
        (sound & (h < low), "IMPOSSIBLE_OHLC", "high < low"),
        (sound & (h < F.greatest(o, c)), "IMPOSSIBLE_OHLC", "high < max(open, close)"),
        (sound & (low > F.least(o, c)), "IMPOSSIBLE_OHLC", "low > min(open, close)"),
        (F.col("volume") < 0, "IMPOSSIBLE_VOLUME", "volume must be >= 0"),
        (~F.coalesce(F.col("split_factor") > 0, F.lit(False)), "IMPOSSIBLE_SPLIT_FACTOR", "split_factor must be > 0"),
        (~F.coalesce(F.col("dividend") >= 0, F.lit(False)), "IMPOSSIBLE_DIVIDEND", "dividend must be >= 0"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail"))) for bad, code, detail in checks]))
    return bars.select("security_id", "session_date", F.explode(found).alias("f")).select("security_id", "session_date", "f.*")


def round_split(previous: Column, close: Column) -> Column:
    """The usual split ratio that a price move is near to, if any."""
    ratio = F.greatest(previous / close, close / previous)
    fits = F.filter(F.array(*[F.lit(float(s)) for s in SPLITS]), lambda s: F.abs((ratio - s) / s) <= SPLIT_TOLERANCE)
    return F.when(ratio >= MIN_SPLIT, F.try_element_at(fits, F.lit(1)))


def series_anomalies(bars: DataFrame) -> DataFrame:
    """Moves between successive bars that no recorded event explains."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    sound = bars.filter("open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND split_factor > 0 AND dividend >= 0 AND volume >= 0")
    x = sound.withColumn("previous", F.lag("close").over(w)).filter("previous > 0")
    x = x.withColumn("move", F.abs((F.col("close") * F.col("split_factor") + F.col("dividend")) / F.col("previous") - 1))
    plain = (F.col("split_factor") == 1) & (F.col("dividend") == 0)
    matched = F.when(plain, round_split(F.col("previous"), F.col("close")))
    code = (
        F.when((F.col("split_factor") != 1) & (F.col("move") > MAX_RETURN), "SPLIT_FACTOR_DISCONTINUITY")
        .when(F.col("move") > EXTREME_RETURN, "IMPLAUSIBLE_JUMP_ERROR")
        .when((F.col("move") > MAX_RETURN) & matched.isNotNull(), "UNEXPLAINED_SCALE_BREAK")
        .when(F.col("move") > MAX_RETURN, "IMPLAUSIBLE_JUMP_WARNING")
    )
    return x.select("security_id", "session_date", code.alias("code"), "move", matched.alias("ratio")).filter("code IS NOT NULL")


def dedupe_bars(bars: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(the last bar of each key, the others with their rank)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    x = bars.withColumn("_r", F.row_number().over(w))
    return x.filter("_r = 1").drop("_r"), x.filter("_r > 1")


def adjustment_factors(bars: DataFrame) -> DataFrame:
    """Back-adjustment: each event scales all earlier bars; the latest factor is 1.

    A dividend that is not under the close before it can't be right and is left out.
    """
    w = Window.partitionBy("security_id").orderBy("session_date")
    event = (1 / F.col("split_factor")) * F.when(F.lag("close").over(w) > F.col("dividend"), (F.lag("close").over(w) - F.col("dividend")) / F.lag("close").over(w)).otherwise(1.0)
    x = bars.withColumn("event", F.when(F.lag("close").over(w).isNull(), 1.0).otherwise(event))
    later = Window.partitionBy("security_id").orderBy(F.desc("session_date")).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("factor", F.exp(F.coalesce(F.sum(F.ln("event")).over(later), F.lit(0.0))))


def repaired(bars: DataFrame) -> DataFrame:
    """Adjusted closes rebuilt from events where they are out of tolerance."""
    x = adjustment_factors(bars).withColumn("expected", F.col("close") * F.col("factor"))
    off = F.abs((F.col("close_adjusted") - F.col("expected")) / F.col("expected")) > ADJUSTED_TOLERANCE
    return x.withColumn("inconsistent", off).withColumn("close_repaired", F.when(off, F.round("expected", 6)).otherwise(F.col("close_adjusted")))


def forward_anomalies(bars: DataFrame, horizon: int, limit: float) -> DataFrame:
    """Impossible forward returns, put down to the largest single move inside; first among equals."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    x = bars.withColumn("step", F.abs(F.col("close") / F.lag("close").over(w) - 1))
    span = w.rowsBetween(1, horizon)
    worst = F.max(F.struct("step", (-F.unix_date("session_date")).alias("neg"))).over(span)
    x = x.withColumn("fwd", F.lead("close", horizon).over(w) / F.col("close") - 1).withColumn("worst", worst)
    x = x.filter((F.col("close") > 0) & (F.abs("fwd") > limit))
    return x.select("security_id", "session_date", "fwd", F.date_from_unix_date(-F.col("worst.neg")).alias("culprit"), F.col("worst.step").alias("worst_move"))
