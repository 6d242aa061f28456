"""Raw signals from point-in-time evidence: claims, activity, trades, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, decay, safe_div

#: Strength of a claim, authority and materiality of a document, weight of a trader.
STRENGTH = {"purchase": 1.0, "signup": 0.75, "click": 0.5, "view": 0.25}
ROLE = {"1-URGENT": 1.0, "2-HIGH": 1.0, "3-MEDIUM": 0.5}


def lookup(c: Column, values: dict[str, float], default: float | None = None) -> Column:
    """A small fixed table as an expression: nothing to join, nothing to broadcast."""
    out = F.lit(default).cast("double")
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def in_window(rows: DataFrame, date: str, as_of, days: int) -> DataFrame:
    """Rows known by ``as_of`` and at most ``days`` old, with their age."""
    return rows.withColumn("age", F.datediff(as_of, date)).filter(F.col("age").between(0, days))


def thesis_linkage(claims: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """Decayed sum of strength times authority, in [0, 1]; 0 if only reviewed, null if neither."""
    s = claims.groupBy(key).agg(F.sum(F.col("strength") * F.col("authority") * decay(F.col("age"))).alias("s"), F.count(F.lit(1)).alias("n"))
    out = reviewed.join(s, key, "full_outer")
    leg = F.when(F.col("n") > 0, clip(F.col("s"), 0.0, 1.0)).when(F.col("reviewed") > 0, 0.0)
    return out.select(key, leg.alias("thesis_linkage"))


def attention(events: DataFrame, key: str, recent: int, prior: int) -> DataFrame:
    """ln((weight of the recent days + 1) / (weight of the days before + 1)), within 1.5."""
    w = F.col("weight")
    new = F.sum(F.when(F.col("age") < recent, w).otherwise(0.0))
    old = F.sum(F.when((F.col("age") >= recent) & (F.col("age") < prior), w).otherwise(0.0))
    return events.filter(F.col("age") < prior).groupBy(key).agg(clip(F.ln((new + 1) / (old + 1)), -1.5, 1.5).alias("attention"))


def narrative_premium(claims: DataFrame, growth: DataFrame, key: str) -> DataFrame:
    """Decayed claims in [0, 1] less the growth percentile, within 1; null without the latter."""
    s = claims.groupBy(key).agg(F.sum(F.col("strength") * decay(F.col("age"))).alias("s"))
    x = growth.join(s, key, "left")
    total = F.coalesce(clip(F.col("s"), 0.0, 1.0), F.lit(0.0))
    return x.select(key, clip(total - F.col("percentile") / 100, -1.0, 1.0).alias("narrative"))


def smart_money(trades: DataFrame, caps: DataFrame, key: str) -> DataFrame:
    """Signed, weighted value of purchases and sales over the market's value; null without that."""
    sign = F.when(F.col("code") == "P", 1.0).when(F.col("code") == "S", -1.0).otherwise(0.0)
    s = trades.groupBy(key).agg(F.sum(sign * F.col("amount") * F.col("weight")).alias("s"))
    out = caps.join(s, key, "left")
    return out.select(key, F.when(F.col("cap") > 0, F.coalesce("s", F.lit(0.0)) / F.col("cap")).alias("smart_money"))


def last_facts(facts: DataFrame, key: str, period: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` periods of each key; of several facts of a period the last by ``order``."""
    w = Window.partitionBy(key, period).orderBy(*[F.desc(c) for c in order])
    one = facts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(period)))
    return one.withColumn("back", back).filter(F.col("back") <= n)


def fundamentals(last: DataFrame, key: str, need: int) -> DataFrame:
    """Growth of the last period over the first, the trend of margins, and the last margins."""
    i = F.lit(need) - F.col("back")
    margin = safe_div(F.col("profit"), F.col("revenue"))
    pick = lambda c, b: F.max(F.when(F.col("back") == b, F.col(c)))
    g = last.withColumn("_i", i.cast("double")).withColumn("margin", margin).groupBy(key).agg(
        F.count(F.lit(1)).alias("periods"), pick("revenue", 1).alias("now"), pick("revenue", need).alias("then"),
        pick("margin", 1).alias("margin"), F.regr_slope("margin", "_i").alias("slope"),
    )
    return g.select(
        key, "periods",
        F.when(F.col("periods") >= need, safe_div(F.col("now") - F.col("then"), F.col("then"))).alias("growth"),
        F.when(F.col("periods") >= 2, F.col("slope")).alias("margin_trend"), "margin",
    )
