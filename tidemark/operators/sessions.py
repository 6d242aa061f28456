"""Observed sessions: numbering, staleness, streaks, as-of joins and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(bars: DataFrame, date: str = "session_date") -> DataFrame:
    """Distinct sessions with their number. One row for each date: a small window."""
    days = bars.select(date).distinct()
    return days.withColumn("session_no", F.row_number().over(Window.orderBy(date)).cast("long"))


def latest_as_of(bars: DataFrame, as_of, key: str, date: str, *values: str) -> DataFrame:
    """Each key's last row on or before ``as_of``: an aggregation, not a sort."""
    best = F.max_by(F.struct(date, *values), F.col(date)).alias("b")
    return bars.filter(F.col(date) <= as_of).groupBy(key).agg(best).select(key, "b.*")


def with_returns(bars: DataFrame, horizons: tuple[int, ...], key: str = "security_id", date: str = "session_date", price: str = "close") -> DataFrame:
    """Forward returns over each horizon, and the last one back, in observed sessions."""
    w = Window.partitionBy(key).orderBy(date)
    p = F.col(price)
    out = bars.withColumn("ret", F.when(F.lag(p).over(w) > 0, p / F.lag(p).over(w) - 1))
    for h in horizons:
        out = out.withColumn(f"fwd_{h}", F.when(p > 0, F.lead(p, h).over(w) / p - 1))
        out = out.withColumn(f"back_{h}", F.when(F.lag(p, h).over(w) > 0, p / F.lag(p, h).over(w) - 1))
    return out


def streaks(rows: DataFrame, state, key: str, date: str) -> DataFrame:
    """Length of the run of rows in ``state`` that ends at each row (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(date)
    n = F.row_number().over(w)
    out = rows.withColumn("_n", n).withColumn("_on", F.coalesce(state, F.lit(False)))
    broken = F.max(F.when(~F.col("_on"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("streak", F.when(F.col("_on"), F.col("_n") - F.coalesce(broken, F.lit(0))).otherwise(0).cast("long")).drop("_n", "_on")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, max_age: int | None = None) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` on or before ``at``, by key.

    Both sides are laid on one time line and the value is carried forward by a window
    per key and nothing else: linear, no pairs. Columns as_of_value and as_of_date.
    """
    cols = left.columns
    l = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("date").alias("_d"), F.lit(1).alias("_side"))
    r = right.select(
        *[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols],
        F.col(value).alias("_v"), F.col(at).alias("_d"), F.lit(0).alias("_side"),
    )
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_v").alias("v"), F.col("_d").alias("d"))), ignorenulls=True).over(w)
    out = l.unionByName(r).withColumn("_last", last).filter("_side = 1")
    fresh = F.lit(True) if max_age is None else F.datediff(at, F.col("_last.d")) <= max_age
    return out.select(*cols, F.when(fresh, F.col("_last.v")).alias("as_of_value"), F.when(fresh, F.col("_last.d")).alias("as_of_date"))


def numbered_days(calendar_: DataFrame, date: str = "session_date") -> DataFrame:
    """Every day from the first session to the last, with the number of the last session by then.

    One row for each day, however many securities there are: a table to look dates up in.
    """
    ends = calendar_.agg(F.min(date).alias("a"), F.max(date).alias("z"))
    days = ends.select(F.explode(F.sequence("a", "z")).alias(date)).join(calendar_, date, "left")
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return days.select(date, F.last("session_no", ignorenulls=True).over(w).alias("session_no"))


def strictly_between(calendar_: DataFrame, rows: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions strictly inside (start, end): by the numbers of the last sessions up to both."""
    days = numbered_days(calendar_)
    top = F.broadcast(calendar_.agg(F.max("session_date").alias("_z")))
    out = rows.crossJoin(top)
    for at, name in ((F.col(start), "_from"), (F.date_sub(end, 1), "_to")):
        look = days.select(F.col("session_date").alias("_day"), F.col("session_no").alias(name))
        out = out.withColumn("_day", F.least(at, F.col("_z"))).join(look, "_day", "left").drop("_day")
    n = F.greatest(F.lit(0), F.coalesce("_to", F.lit(0)) - F.coalesce("_from", F.lit(0)))
    return out.withColumn("between", n.cast("long")).drop("_from", "_to", "_z")
