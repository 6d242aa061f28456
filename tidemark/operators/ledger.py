"""Append-only ledger: corrections, lots, cash and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpointed
from tidemark.functions.scalar import money


def effective(events: DataFrame, ident: str = "id", corrects: str = "corrects") -> DataFrame:
    """Events that no later event corrects."""
    gone = events.filter(F.col(corrects).isNotNull()).select(F.col(corrects).alias(ident)).distinct()
    return events.join(gone, ident, "left_anti")


def inherited(events: DataFrame, value: str, ident: str = "id", corrects: str = "corrects") -> DataFrame:
    """``events`` with ``value`` taken from the nearest corrected event that has it.

    Pointer doubling: each round the rows that still lack a value look at the row they
    point to, and take its value or its pointer. A chain among n such rows has at most
    n steps, so after log2(n) + 1 rounds only rows that lead into a cycle are left:
    there is nothing to find in it, and they stay null. Rows that have a value, or
    nowhere to look, take no part in the joins.
    """
    kind = events.schema[value].dataType
    state = events.select(F.col(ident).alias("_id"), F.col(value).alias("_v"), F.col(corrects).alias("_to"))
    state = checkpointed(state)
    lacks = F.col("_v").isNull() & F.col("_to").isNotNull()
    for _ in range(state.filter(lacks).count().bit_length() + 1):
        todo, done = state.filter(lacks), state.filter(~lacks)
        far = state.select(F.col("_id").alias("_at"), F.col("_v").alias("_w"), F.col("_to").alias("_next"))
        moved = todo.join(far, F.col("_to") == F.col("_at"), "left").select("_id", F.col("_w").cast(kind).alias("_v"), F.col("_next").alias("_to"))
        state = checkpointed(done.unionByName(moved))
        if not state.filter(lacks).limit(1).count():
            break
    return events.drop(value).join(state.select(F.col("_id").alias(ident), F.col("_v").alias(value)), ident)


def open_lots(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What is left of each bought lot, first in first out.

    Within a key, sales use up the oldest lots bought before them; what exceeds them
    is lost. With running sums over the events in order: the stock after each is a
    walk held at zero, so the oversold amount so far is the running maximum of sold
    less bought. A lot's rest is its part of the final stock, newest lots first. All
    of it is windows by key: no state, no loop.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sold = F.when(F.col("side") == "SELL", F.col("quantity")).otherwise(0.0)
    bought = F.when(F.col("side") == "SELL", 0.0).otherwise(F.col("quantity"))
    x = events.withColumn("_bought", bought).withColumn("_sold", sold)
    x = x.withColumn("_b", F.sum("_bought").over(upto)).withColumn("_s", F.sum("_sold").over(upto))
    all_ = Window.partitionBy(*keys)
    x = x.withColumn("_over", F.greatest(F.lit(0.0), F.max(F.col("_s") - F.col("_b")).over(all_)))
    stock = F.sum("_bought").over(all_) - F.sum("_sold").over(all_) + F.col("_over")
    newer = F.sum("_bought").over(all_) - F.col("_b")
    rest = F.greatest(F.lit(0.0), F.least(F.col("_bought"), stock - newer))
    x = x.withColumn("rest", F.round(rest, 6)).filter((F.col("side") != "SELL") & (F.col("rest") > 0))
    return x.drop("_bought", "_sold", "_b", "_s", "_over")


def cash(events: DataFrame, keys: list[str]) -> DataFrame:
    """Cash by currency: proceeds and payments less fees, to the cent."""
    signed = F.when(F.col("side") == "SELL", F.col("amount")).otherwise(-F.col("amount")) - F.col("fees")
    return events.groupBy(*keys).agg(money(F.sum(signed.cast("decimal(28,6)"))).alias("cash"))


def project(lots: DataFrame, prices: DataFrame, key: str, owner: str) -> DataFrame:
    """Positions valued at the last price, with their share of the owner's total."""
    p = lots.groupBy(owner, key).agg(
        F.sum("rest").alias("quantity"),
        F.sum(F.col("rest") * F.col("price")).alias("cost"),
        F.floor(F.sum(F.col("days") * F.col("rest")) / F.sum("rest")).cast("long").alias("holding_days"),
    )
    x = p.join(prices, key, "left").withColumn("value", F.col("quantity") * F.col("last_price"))
    total = F.sum("value").over(Window.partitionBy(owner))
    return x.withColumn("weight", F.when(total > 0, 100 * F.col("value") / total)).withColumn("gain", F.col("value") - F.col("cost"))
