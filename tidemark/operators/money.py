"""Money: conversions, ledger totals, costs and previews, exact to the cent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import safe_div

#: The usual wide and narrow decimals.
AMOUNT, RATE = "decimal(24,6)", "decimal(14,8)"


def to_decimal(x: Column) -> Column:
    """A number or a text as a decimal; what is none becomes null."""
    return F.trim(x.cast("string")).try_cast(AMOUNT)


def cents(x: Column) -> Column:
    """Halves away from zero, at two places."""
    return F.round(x, 2)


def usd_to_chf(amount: Column, rate: Column) -> Column:
    return cents(amount.cast(AMOUNT) * rate.cast(RATE))


def fx_effect(quantity: Column, price: Column, then: Column, now: Column) -> Column:
    """What a position's value in francs changed by because of the rate alone."""
    return cents((quantity * price).cast(AMOUNT) * (now.cast(RATE) - then.cast(RATE)))


def basis_points(bps: Column) -> Column:
    return bps * 0.0001


def rate_of(currency: Column, rates: dict[str, float]) -> Column:
    """The rate to francs of each currency; null if there is none."""
    out = F.when(currency == "CHF", F.lit(1).cast(RATE))
    for name, rate in rates.items():
        out = out.when(currency == name, F.lit(rate).cast(RATE))
    return out


def cash_in_francs(cash: DataFrame, owner: str, rates: dict[str, float]) -> DataFrame:
    """One balance for each owner; a balance without a rate is an error, as it can't be left out."""
    amount, rate = F.col("cash").cast(AMOUNT), rate_of(F.col("currency"), rates)
    known = F.when(amount == 0, F.lit(0).cast(RATE)).otherwise(F.coalesce(rate, F.raise_error(F.concat(F.lit("no rate for "), "currency")).cast(RATE)))
    return cash.groupBy(owner).agg(cents(F.sum(amount * known)).cast("double").alias("cash_chf"))


def cost_category(category: Column, kind: Column) -> Column:
    """The names under which taxes are booked."""
    upper = F.upper(category)
    tax = F.when(kind == "DIVIDEND", "WITHHOLDING_TAX").otherwise("TRANSACTION_TAX")
    return F.when(upper == "STAMP_DUTY", "TRANSACTION_TAX").when(upper == "TAX", tax).otherwise(upper)


def financials(events: DataFrame, owner: str, rates: dict[str, float]) -> DataFrame:
    """Capital paid in, dividends, expenses and withdrawals of each owner, in francs.

    Events in a currency without a rate are left out. Fees count as expenses unless
    the event is itself a fee or a tax, whose amount counts then.
    """
    rate = F.coalesce(F.col("fx_rate").cast(RATE), rate_of(F.col("currency"), rates))
    amount, fees = F.col("amount").cast(AMOUNT), F.col("fees").cast(AMOUNT)
    kind = F.col("kind")
    x = events.withColumn("_r", F.when(F.col("currency") == "CHF", F.lit(1).cast(RATE)).otherwise(rate)).filter("_r IS NOT NULL")
    zero = F.lit(0).cast(AMOUNT)
    total = lambda cond, value: cents(F.sum(F.when(cond, value * F.col("_r")).otherwise(zero * F.col("_r")))).cast("double")
    paid = F.when(kind == "WITHDRAWAL", -F.abs(amount)).otherwise(F.greatest(amount, zero))
    spent = F.when(kind.isin("FEE", "TAX"), F.abs(amount)).otherwise(fees)
    return x.groupBy(owner).agg(
        total(kind.isin("OPENING_CASH", "DEPOSIT", "WITHDRAWAL"), paid).alias("contributed"),
        total(kind == "DIVIDEND", F.greatest(amount, zero)).alias("dividends"),
        total(F.lit(True), spent).alias("expenses"),
        total(kind == "WITHDRAWAL", F.abs(amount)).alias("withdrawals"),
    )


def suggested_quantity(action: Column, notional: Column, price: Column, rate: Column, held: Column) -> Column:
    """Whole shares that a suggestion comes to; sales are of all that is held."""
    shares = F.floor(safe_div(notional, price * rate))
    bought = F.when((action == "TRIM") & held.isNotNull(), F.least(shares.cast("double"), held)).otherwise(shares.cast("double"))
    quantity = F.when(action == "SELL", held).otherwise(bought)
    valid = action.isin("BUY", "ADD", "TRIM", "SELL") & (notional > 0) & (price > 0) & (rate > 0)
    return F.when(valid & (quantity > 0), quantity)


def preview(side: Column, quantity: Column, price: Column, rate: Column, costs: Column, held: Column, total: Column) -> dict[str, Column]:
    """What a trade would leave: quantity, change of cash, position's value and weight."""
    sold = side == "SELL"
    after = F.when(sold, held - quantity).otherwise(held + quantity)
    gross = quantity * price * rate
    value = F.greatest(F.lit(0.0), after) * price * rate
    return {
        "after": after, "cash_change": F.when(sold, gross - costs).otherwise(-gross - costs),
        "value": value, "weight": F.when(total > 0, 100 * value / total),
    }


def listed(events: DataFrame, ident: str, corrects: str, kind: str, owner: str, *order: Column) -> DataFrame:
    """Events with their status, and their place in their owner's list, newest first."""
    later = events.filter(F.col(corrects).isNotNull()).groupBy(F.col(corrects).alias(ident)).agg(F.max((F.col(kind) == "VOID").cast("int")).alias("_void"))
    status = F.when(F.col("_void") == 1, "VOIDED").when(F.col("_void") == 0, "CORRECTED").otherwise("EFFECTIVE")
    x = events.join(later, ident, "left").withColumn("status", status).drop("_void")
    return x.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(*order)).cast("long"))
