"""Queries over money: francs, ledger totals, costs, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.formula import compile_formula
from tidemark.operators import ledger as L
from tidemark.operators import money as M
from tidemark.operators import policy as P
from tidemark.sources import frames as fr

from .portfolio import _CTX, _LED, _LOTS, _ORDER, _context, _decide_sql, _effective, _ledger

RATES = {"USD": 0.9, "EUR": 0.95}
KINDS = ("DEPOSIT", "DIVIDEND", "FEE", "WITHDRAWAL", "TAX", "BUY", "OPENING_CASH")


def cash_in_francs(spark, d):
    return M.cash_in_francs(L.cash(_effective(spark, d), ["owner", "currency"]), "owner", RATES)


def _typed(spark, d):
    """Events in force, of a kind by their ticker."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("ticker", F.lit(len(KINDS))) + 1).cast("int"))
    rate = F.when(F.pmod("ticker", F.lit(3)) == 0, 0.88)
    return _effective(spark, d).withColumn("kind", kind).withColumn("fx_rate", rate)


def ledger_summary(spark, d):
    return M.financials(_typed(spark, d), "owner", RATES)


def currency_effects(spark, d):
    """Francs of each trade, and what the rate alone changed since."""
    e = _effective(spark, d).filter("currency = 'USD'")
    return e.select(
        "id", M.usd_to_chf(F.col("amount"), F.lit(0.91)).cast("double").alias("chf"), M.fx_effect(F.col("quantity"), F.col("price"), F.lit(0.95), F.lit(0.91)).cast("double").alias("effect"),
        F.round(M.basis_points(F.lit(15.0)) * F.col("amount"), 6).alias("spread"),
    )


def cost_rows(spark, d):
    """Trades in force and their costs as rows of one table."""
    e = _typed(spark, d)
    costs = e.select("id", F.explode(F.create_map(F.lit("commission"), F.col("fees"), F.lit("tax"), F.round(F.col("fees") / 4, 4))).alias("category", "amount"), "kind")
    costs = costs.select("id", M.cost_category(F.col("category"), F.col("kind")).alias("category"), "amount")
    return e.select("id", F.lit("TRADE").alias("category"), "amount").unionByName(costs)


def transaction_list(spark, d):
    """The newest five events of each owner, with what became of them."""
    e = _ledger(spark, d).withColumn("kind", F.when(F.pmod("ticker", F.lit(5)) == 0, "VOID").otherwise("TRADE"))
    out = M.listed(e, "id", "corrects", "kind", "owner", F.desc("day"), F.desc("id")).filter("place <= 5")
    return out.select("owner", "place", "id", "day", "status")


def suggested_quantities(spark, d):
    x = P.decide(_context(spark, d)).filter("action IN ('BUY', 'ADD', 'TRIM', 'SELL')")
    q = M.suggested_quantity(F.col("action"), F.col("notional"), F.lit(123.0), F.lit(0.9), F.when(F.col("held"), F.col("weight") * 10))
    return x.select("security_id", "action", q.alias("quantity"))


def trade_previews(spark, d):
    """What each suggested trade would leave of the position and the cash."""
    x = _context(spark, d)
    side = F.when(F.col("held"), "SELL").otherwise("BUY")
    out = M.preview(side, F.floor(F.col("notional") / 100).cast("double"), F.lit(100.0), F.lit(0.9), F.col("cost") * 0.9, F.col("weight") * 5, F.lit(100_000.0))
    return x.select("security_id", side.alias("side"), *[F.round(c, 8).alias(k) for k, c in out.items()])


def unknown_tickers(spark, d):
    """Tickers that are held but not in the universe."""
    lots = L.open_lots(_effective(spark, d), ["owner", "ticker"], _ORDER).select("ticker").distinct()
    known = fr.read(spark, d, "supplier", "s_suppkey").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("ticker"))
    return lots.join(known, "ticker", "left_anti")


def ledger_snapshot(spark, d):
    """Each owner's open lots, cash and paid-in capital; degraded if no capital is known."""
    lots = L.open_lots(_effective(spark, d), ["owner", "ticker"], _ORDER)
    held = lots.groupBy("owner").agg(F.count(F.lit(1)).alias("lots"), F.count_distinct("ticker").alias("tickers"))
    out = cash_in_francs(spark, d).join(held, "owner", "left").join(ledger_summary(spark, d), "owner", "left")
    degraded = F.coalesce(F.col("contributed") == 0, F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("owner", "cash_chf", zero("lots"), zero("tickers"), "contributed", degraded.alias("degraded"))


def parsed_events(spark, d):
    """Ledger events from JSON: numbers may be texts, and currencies fall back."""
    c = fr.read(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    amount = F.when(F.pmod("c_custkey", F.lit(7)) == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    doc = F.to_json(F.struct(
        amount.alias("cash_amount"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, "EUR").alias("cash_currency"),
        F.when(F.pmod("c_custkey", F.lit(3)) == 0, "USD").alias("currency"), F.lower("c_mktsegment").alias("type"),
    ))
    x = c.select("c_custkey", F.from_json(doc, "cash_amount string, cash_currency string, currency string, type string, fees string").alias("j"))
    zero = F.lit(0).cast(M.AMOUNT)
    return x.select(
        "c_custkey", F.upper("j.type").alias("kind"), F.coalesce(M.to_decimal(F.col("j.cash_amount")), zero).cast("double").alias("amount"),
        F.coalesce("j.cash_currency", "j.currency", F.lit("CHF")).alias("cash_currency"), F.coalesce("j.currency", F.lit("CHF")).alias("currency"),
        F.coalesce(M.to_decimal(F.col("j.fees")), zero).cast("double").alias("fees"),
    )


def exact_costs(spark, d):
    """Costs of trades of each customer's balance, by the formulas in decimals, to the cent."""
    c = fr.read(spark, d, "customer", "c_custkey", "c_acctbal")
    notional = {"notional": F.abs("c_acctbal").cast("decimal(18,2)")}
    fee, spread = (compile_formula(f, notional, exact=True) for f in (P.FEE, P.FX_SPREAD))
    return c.select("c_custkey", fee.cast("double").alias("fee"), spread.cast("double").alias("spread"), M.cents(fee + spread).cast("double").alias("cost"))


_R = "CASE currency WHEN 'CHF' THEN 1 WHEN 'USD' THEN 0.9 WHEN 'EUR' THEN 0.95 END"
_TYPED = _LED + f""",
ty AS (SELECT *, [{', '.join(repr(k) for k in KINDS)}][ticker % {len(KINDS)} + 1] AS kind, CASE WHEN ticker % 3 = 0 THEN 0.88 END AS fx_rate FROM eff)"""
_CASH = f"""cb AS (SELECT owner, currency, round(sum(CAST(CASE WHEN side = 'SELL' THEN amount ELSE -amount END - fees AS DECIMAL(24, 6))), 2) AS cash FROM eff GROUP BY 1, 2),
cf AS (SELECT owner, CAST(round(sum(cash * CAST({_R} AS DECIMAL(10, 4))), 2) AS DOUBLE) AS cash_chf FROM cb GROUP BY 1)"""
_SUM = f"""su AS (SELECT owner, CAST(round(sum(CASE WHEN kind IN ('OPENING_CASH', 'DEPOSIT') THEN greatest(a, 0) * r WHEN kind = 'WITHDRAWAL' THEN -abs(a) * r ELSE 0 END), 2) AS DOUBLE) AS contributed,
  CAST(round(sum(CASE WHEN kind = 'DIVIDEND' THEN greatest(a, 0) * r ELSE 0 END), 2) AS DOUBLE) AS dividends, CAST(round(sum(CASE WHEN kind IN ('FEE', 'TAX') THEN abs(a) ELSE f END * r), 2) AS DOUBLE) AS expenses,
  CAST(round(sum(CASE WHEN kind = 'WITHDRAWAL' THEN abs(a) * r ELSE 0 END), 2) AS DOUBLE) AS withdrawals
  FROM (SELECT *, CAST(amount AS DECIMAL(18, 6)) AS a, CAST(fees AS DECIMAL(18, 6)) AS f, CAST(CASE WHEN currency = 'CHF' THEN 1 ELSE coalesce(fx_rate, {_R}) END AS DECIMAL(10, 4)) AS r FROM ty) GROUP BY 1)"""
QUERIES = {
    "exact_costs": (exact_costs, """WITH n AS (SELECT c_custkey, CAST(abs(c_acctbal) AS DECIMAL(18, 2)) AS n FROM customer), f AS (SELECT c_custkey, least(greatest(n * 0.0010, 10), 100) AS fee, n * 0.0015 AS spread FROM n)
SELECT c_custkey, CAST(fee AS DOUBLE) AS fee, CAST(spread AS DOUBLE) AS spread, CAST(round(fee + spread, 2) AS DOUBLE) AS cost FROM f"""),
    "cash_in_francs": (cash_in_francs, f"WITH {_LED}, {_CASH} SELECT * FROM cf"),
    "ledger_summary": (ledger_summary, f"WITH {_TYPED}, {_SUM} SELECT * FROM su"),
    "currency_effects": (currency_effects, f"WITH {_LED} SELECT id, CAST(round(CAST(amount AS DECIMAL(18, 6)) * 0.91, 2) AS DOUBLE) AS chf, CAST(round(CAST(quantity * price AS DECIMAL(18, 6)) * -0.04, 2) AS DOUBLE) AS effect, round(0.0015::DOUBLE * amount, 6) AS spread FROM eff WHERE currency = 'USD'"),
    "cost_rows": (cost_rows, f"""WITH {_TYPED} SELECT id, 'TRADE' AS category, amount FROM ty UNION ALL SELECT id, 'COMMISSION', fees FROM ty
UNION ALL SELECT id, CASE WHEN kind = 'DIVIDEND' THEN 'WITHHOLDING_TAX' ELSE 'TRANSACTION_TAX' END, round(fees / 4, 4) FROM ty"""),
    "transaction_list": (transaction_list, f"""WITH {_LED}, s AS (SELECT a.owner, a.id, a.day, CASE WHEN a.version = a.newest THEN 'EFFECTIVE' WHEN b.ticker % 5 = 0 THEN 'VOIDED' ELSE 'CORRECTED' END AS status
  FROM led a LEFT JOIN led b ON split_part(a.id, ':', 1) = split_part(b.id, ':', 1) AND split_part(a.id, ':', 2) = split_part(b.id, ':', 2) AND b.version = a.version + 1)
SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY day DESC, id DESC) AS place, id, day, status FROM s QUALIFY place <= 5"""),
    "suggested_quantities": (suggested_quantities, f"""WITH a AS ({_decide_sql()}), b AS (WITH {_CTX} SELECT * FROM x), q AS (SELECT security_id, action, CASE WHEN held THEN weight * 10 END AS h, floor(notional / (123 * 0.9::DOUBLE)) AS s, notional FROM a JOIN b USING (security_id) WHERE action IN ('BUY', 'ADD', 'TRIM', 'SELL')),
r AS (SELECT security_id, action, notional, CASE WHEN action = 'SELL' THEN h WHEN action = 'TRIM' AND h IS NOT NULL THEN least(s, h) ELSE s END AS q FROM q)
SELECT security_id, action, CASE WHEN notional > 0 AND q > 0 THEN q END AS quantity FROM r"""),
    "trade_previews": (trade_previews, f"""WITH {_CTX}, t AS (SELECT security_id, CASE WHEN held THEN 'SELL' ELSE 'BUY' END AS side, floor(notional / 100) AS q, weight * 5 AS h, cost * 0.9::DOUBLE AS c FROM x),
v AS (SELECT *, CASE side WHEN 'SELL' THEN h - q ELSE h + q END AS after FROM t)
SELECT security_id, side, round(after, 8) AS after, round(CASE side WHEN 'SELL' THEN q * 90 ELSE -q * 90 END - c, 8) AS cash_change, round(greatest(0, after) * 90, 8) AS value, round(100 * greatest(0, after) * 90 / 100000, 8) AS weight FROM v"""),
    "unknown_tickers": (unknown_tickers, f"WITH {_LOTS} SELECT DISTINCT ticker FROM lots WHERE ticker NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)"),
    "ledger_snapshot": (ledger_snapshot, f"""WITH {_LOTS}, {_CASH}, {_TYPED.removeprefix(_LED).lstrip(',').strip()}, {_SUM}, hd AS (SELECT owner, count(*) AS lots, count(DISTINCT ticker) AS tickers FROM lots GROUP BY 1)
SELECT owner, cash_chf, coalesce(lots, 0) AS lots, coalesce(tickers, 0) AS tickers, contributed, coalesce(contributed = 0, true) AS degraded FROM cf LEFT JOIN hd USING (owner) LEFT JOIN su USING (owner)"""),
    "parsed_events": (parsed_events, """SELECT c_custkey, c_mktsegment AS kind, CASE WHEN c_custkey % 7 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS amount, CASE WHEN c_custkey % 2 = 0 THEN 'EUR' WHEN c_custkey % 3 = 0 THEN 'USD' ELSE 'CHF' END AS cash_currency,
  CASE WHEN c_custkey % 3 = 0 THEN 'USD' ELSE 'CHF' END AS currency, 0.0::DOUBLE AS fees FROM customer"""),
}
