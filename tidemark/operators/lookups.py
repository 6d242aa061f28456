"""Small rules: sessions back, point-in-time visibility, caches, limits, displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ahead
from tidemark.operators.sessions import numbered_days

#: The position and cohort caps (percent) of each objective; None: the policy's own.
POSITION_CAPS = {"CAPITAL_PRESERVATION": 8.0, "INCOME": 10.0, "BALANCED_GROWTH": 12.5, "CAPITAL_GROWTH": None}


def sessions_back(calendar_: DataFrame, rows: DataFrame, at: str, n: int, name: str = "prior") -> DataFrame:
    """``rows`` with the session that lies ``n`` before the last one up to ``at``; null if there is none.

    Looked up by number: one row for each session and day, however many rows ask.
    """
    top = F.broadcast(calendar_.agg(F.max("session_date").alias("_z")))
    days = numbered_days(calendar_).select(F.col("session_date").alias("_day"), (F.col("session_no") - n).alias("_no"))
    there = calendar_.select(F.col("session_no").alias("_no"), F.col("session_date").alias(name))
    x = rows.crossJoin(top).withColumn("_day", F.least(F.col(at), F.col("_z"))).join(days, "_day", "left")
    return x.join(there, "_no", "left").drop("_z", "_day", "_no")


def visible(rows: DataFrame, key: str, ident: str, as_of: Column, *dates: str) -> DataFrame:
    """Rows that were known, filed and published by ``as_of``; of each id the last written."""
    seen = F.lit(True)
    for d in dates:
        seen &= F.col(d).isNull() | (F.col(d) <= as_of)
    best = F.max_by(F.struct(*rows.columns), F.struct(*[F.col(d) for d in dates])).alias("b")
    return rows.filter(seen).groupBy(F.col(key).alias("_k"), F.col(ident).alias("_i")).agg(best).select("b.*")


def newest(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, with their place."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def same_statement(quarter: Column, known_quarter: Column, *amounts: tuple[Column, Column]) -> Column:
    """Whether a statement is the one that was verified before: its quarter and all amounts."""
    out = quarter.eqNullSafe(known_quarter) & quarter.isNotNull()
    for now, known in amounts:
        out &= now.eqNullSafe(known)
    return out


def position_cap(objective: Column, policy: Column) -> Column:
    """The smaller of the objective's cap and the policy's."""
    out = F.lit(None).cast("double")
    for name, cap in POSITION_CAPS.items():
        out = F.when(objective == name, F.least(policy, F.lit(cap)) if cap is not None else policy).otherwise(out)
    return out


def contribution_delta(delta: Column, weight: Column) -> Column:
    """Weighted change; the change itself without a weight, nothing without a change."""
    return F.coalesce(weight * delta, delta, F.lit(0.0))


def availability(cached: Column, now: Column, asked: Column) -> Column:
    """Whether a cached overview may be shown for a day: missing, future, later than asked, stale or fresh.

    Future is what rounds to a later second (see ``ahead``); ages count whole seconds of ``cached``.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp(cached)
    return (
        F.when(cached.isNull(), "missing").when(ahead(cached, now), "future").when(F.to_date(cached) > asked, "after_date")
        .when(age > 48 * 3600, "stale").otherwise("fresh")
    )


def sign_text(name: str, z: Column) -> Column:
    word = F.when(z > 0, "above").when(z < 0, "below").otherwise("in line with")
    return F.when(z.isNull(), F.concat(F.lit(name), F.lit(" is missing"))).otherwise(F.concat(F.lit(name), F.lit(" is "), word, F.lit(" peers")))


def sane_plan(raw: Column) -> Column:
    """A retrieval plan from JSON; null if it is broken or its dates are reversed."""
    p = F.from_json(raw, "tickers array<string>, date_from date, date_to date, classes array<string>")
    ok = p["tickers"].isNotNull() & (p["date_from"].isNull() | p["date_to"].isNull() | (p["date_from"] <= p["date_to"]))
    return F.when(ok, p)


def within_budget(rows: DataFrame, key: str, size: str, budget: int, *order: Column) -> DataFrame:
    """The rows of each key that fit a budget together, the last ones dropped first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(w)).filter(F.col("_sum") <= budget).drop("_sum")
