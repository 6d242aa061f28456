"""Collectors: what of a batch is new, by marks, sets of what was done, contents and age.

Each takes what is stored and what a source offers, and returns the rows to add; marks
only move forward, so a batch that is offered again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ahead, micros


def mark_key(collector: str, security: Column) -> Column:
    return F.concat_ws(":", F.lit(collector), security)


def after_marks(offered: DataFrame, marks: DataFrame, key: str, value: str, inclusive: bool = False) -> DataFrame:
    """Rows beyond their key's mark; those of keys without one are all new."""
    x = offered.join(marks.select(key, F.col("mark").alias("_m")), key, "left")
    beyond = (F.col(value) >= F.col("_m")) if inclusive else (F.col(value) > F.col("_m"))
    return x.filter(F.col("_m").isNull() | beyond).drop("_m")


def new_contents(rows: DataFrame, stored: DataFrame, key: str, digest: str, *order: str) -> DataFrame:
    """The first row of each contents that the key does not have yet."""
    w = Window.partitionBy(key, digest).orderBy(*order)
    first = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return first.join(stored.select(key, digest).distinct(), [key, digest], "left_anti")


def enriched(stored: DataFrame, offered: DataFrame, key: str, digest: str, field: str) -> DataFrame:
    """Stored rows that lack ``field`` take it from an offered row of the same contents."""
    have = offered.filter(F.col(field).isNotNull()).groupBy(key, digest).agg(F.min(field).alias("_f"))
    return stored.join(have, [key, digest], "left").withColumn(field, F.coalesce(field, "_f")).drop("_f")


def unprocessed(offered: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not in the set of what was processed."""
    return offered.join(done.select(*keys).distinct(), list(keys), "left_anti")


def stale(cached: Column, now: Column, hours: int = 24) -> Column:
    """Whether a cached row is to be fetched again: never fetched, too old, or from the future.

    Ages count to the microsecond; ahead is what rounds to a later second.
    """
    old = micros(cached) <= micros(now) - hours * 3_600_000_000
    return cached.isNull() | old | ahead(cached, now)


def token_bucket(requests: DataFrame, key: str, time: str, order: list[str], capacity: float, per_second: float) -> DataFrame:
    """Requests with ``allowed``: each takes a token of its key's bucket, which fills steadily.

    A bucket's level rests on all requests before, so a key is one group, in order.
    """
    fields = requests.select(key, time, *order).schema

    def run(pdf):
        level, before, allowed = capacity, None, []
        pdf = pdf.sort_values([time, *order])
        for t in pdf[time]:
            if before is not None:
                level = min(capacity, level + (t - before).total_seconds() * per_second)
            before = t
            allowed.append(level >= 1)
            level -= 1 if allowed[-1] else 0
        return pdf.assign(allowed=allowed)

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return requests.select(key, time, *order).groupBy(key).applyInPandas(run, f"{names}, allowed boolean")


def resume_at(steps: DataFrame, run: str, order: str, status: str) -> DataFrame:
    """The first step of each run that has neither succeeded nor been skipped; null if none is left."""
    todo = F.when(~F.coalesce(F.col(status).isin("SUCCESS", "SKIPPED"), F.lit(False)), F.col(order))
    return steps.groupBy(run).agg(F.min(todo).alias("resume_at"))


def kept_state(rows: DataFrame, key: str, date: str, cutoff: Column, days: int = 7) -> DataFrame:
    """State of a replay: rows older than ``days`` before the day in hand go."""
    return rows.filter(F.col(date) >= F.date_sub(cutoff, days))


def expected_weekdays(spark, last: str, n: int) -> DataFrame:
    """The last ``n`` days from Monday to Friday up to ``last``."""
    end = F.to_date(F.lit(last))
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, 2 * n), end)).alias("day")).filter("weekday(day) < 5")
    return days.orderBy(F.desc("day")).limit(n)
