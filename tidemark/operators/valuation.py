"""Ratios of statements and valuation against peers, in one currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import safe_div
from tidemark.operators.sessions import as_of_join
from tidemark.operators.xsec import blended_zscores

METRICS = ("ev_sales", "ev_ebitda", "fcf_yield")


def roic(operating_income: Column, tax_rate: Column, equity: Column, debt: Column, cash: Column) -> Column:
    """Income after tax over invested capital."""
    return safe_div(operating_income * (1 - tax_rate), equity + debt - cash)


def net_cash_ratio(cash: Column, short_term: Column, debt: Column, assets: Column) -> Column:
    return safe_div(cash + short_term - debt, assets)


def fcf_margin(cfo: Column, capex: Column, revenue: Column) -> Column:
    return safe_div(cfo - capex, revenue)


def enterprise_value(market_cap: Column, debt: Column, cash: Column) -> Column:
    return market_cap + debt - cash


def converted(statements: DataFrame, rates: DataFrame, amounts: tuple[str, ...]) -> DataFrame:
    """Amounts in the common currency, at the last rate on or before each period's end.

    ``statements`` has currency and period_end, ``rates`` currency, period_end (the
    rate's day) and rate; USD needs none. Without a rate all amounts are null and
    reason says so.
    """
    x = as_of_join(statements, rates, "currency", "period_end", "rate").withColumnRenamed("as_of_value", "rate")
    x = x.withColumn("rate", F.when(F.col("currency") == "USD", 1.0).otherwise(F.col("rate"))).drop("as_of_date")
    x = x.withColumns({c: F.col(c) * F.col("rate") for c in amounts})
    return x.withColumn("reason", F.when(F.col("rate").isNull(), "no_rate"))


def multiples(x: DataFrame) -> DataFrame:
    """``x`` with the three multiples; market_cap, debt, cash, revenue, ebitda, cfo, capex in one currency."""
    ev = enterprise_value(F.col("market_cap"), F.col("debt"), F.col("cash"))
    return x.withColumns({
        "ev_sales": safe_div(ev, F.col("revenue")),
        "ev_ebitda": safe_div(ev, F.col("ebitda")),
        "fcf_yield": safe_div(F.col("cfo") - F.col("capex"), F.col("market_cap")),
    })


def signals(x: DataFrame) -> DataFrame:
    """One row for each security and multiple: its blended z, turned so that cheap is high.

    Only values above zero take part, a security's own as well as its peers'.
    """
    long = x.unpivot(["security_id", "cohort", "parent", "cohort_n", "parent_n"], list(METRICS), "leg", "x")
    z = blended_zscores(long.withColumn("x", F.when(F.col("x") > 0, F.col("x"))))
    return z.withColumn("signal", F.when(F.col("leg") == "fcf_yield", F.col("z")).otherwise(-F.col("z")))


def brake(signal_rows: DataFrame) -> DataFrame:
    """Mean of the signals that there are."""
    return signal_rows.groupBy("security_id").agg(F.count("signal").alias("signals"), F.avg("signal").alias("brake"))


def health(x: DataFrame, parts: tuple[str, ...], least: int = 3) -> DataFrame:
    """Mean of blended sub-scores, missing ones as zero; null under ``least``."""
    long = x.unpivot(["security_id", "cohort", "parent", "cohort_n", "parent_n"], list(parts), "leg", "x")
    g = blended_zscores(long).groupBy("security_id").agg(F.sum(F.coalesce("z", F.lit(0.0))).alias("s"), F.count("z").alias("available"))
    return g.select("security_id", "available", F.when(F.col("available") >= least, F.col("s") / len(parts)).alias("health"))


def reporting_currency(facts: DataFrame, key: str) -> DataFrame:
    """Unit of each key's last revenue fact, by (filed, end, unit), among units that are currencies."""
    ok = facts.filter(F.col("unit").rlike("^[A-Za-z]{3}$"))
    return ok.groupBy(key).agg(F.max(F.struct("filed", "end", "unit"))["unit"].alias("currency"))
