"""Queries over statements: ratios, valuation against peers, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import legs as G
from tidemark.operators import valuation as V
from tidemark.operators import xsec
from tidemark.sources import frames as fr

AMOUNTS = ("revenue", "ebitda", "cfo", "capex", "debt", "cash", "equity")
PARTS = ("margin_trend", "roic", "net_cash_ratio", "fcf_margin", "growth")
TAX = 0.21


def _yearly(spark, d):
    """Figures of each supplier and year; an amended figure replaces the first."""
    x = fr.read(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    e = F.col("l_extendedprice")
    return x.groupBy(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("period"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("filed")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(e * (0.5 - F.col("l_discount"))).alias("profit"),
        F.sum(e * F.col("l_tax")).alias("debt"), F.sum(e * F.col("l_discount")).alias("capex"),
    )


def _statements(spark, d):
    """The last year's statement of each security, in its own currency, with growth and trend."""
    last = G.last_facts(_yearly(spark, d), "id", "period", ["filed"], 5)
    trend = G.fundamentals(last, "id", 5).select("id", "growth", "margin_trend")
    now = last.filter("back = 1").join(trend, "id").withColumnRenamed("id", "security_id")
    sec = xsec.scopes(fr.securities(spark, d).select("security_id", "cohort", "parent", "balance"))
    bal, region = F.col("balance"), F.col("parent")
    return sec.join(now, "security_id").select(
        "security_id", "cohort", "parent", "cohort_n", "parent_n", "growth", "margin_trend", "revenue", "profit", "debt", "capex",
        F.make_date(F.col("period"), F.lit(12), F.lit(31)).alias("period_end"),
        F.when(region == "EUROPE", "EUR").when(region == "ASIA", "JPY").when(region == "AFRICA", "XAF").otherwise("USD").alias("currency"),
        F.when(bal > 0, bal).otherwise(0.0).alias("cash"), (bal * 10).alias("equity"),
        (F.col("profit") * 1.2).alias("ebitda"), (F.col("profit") * 0.9).alias("cfo"),
    )


def _ratios(spark, d):
    c = F.col
    return _statements(spark, d).withColumns({
        "roic": V.roic(c("profit"), F.lit(TAX), c("equity"), c("debt"), c("cash")),
        "net_cash_ratio": V.net_cash_ratio(c("cash"), c("cash") * 0.5, c("debt"), c("equity") + c("debt")),
        "fcf_margin": V.fcf_margin(c("cfo"), c("capex"), c("revenue")),
    })


def statement_ratios(spark, d):
    return _ratios(spark, d).select("security_id", *[F.round(p, 7).alias(p) for p in PARTS])


def fundamental_health(spark, d):
    """Mean of five blended sub-scores, missing ones as zero; null under three."""
    out = V.health(_ratios(spark, d), PARTS)
    return out.select("security_id", "available", F.round("health", 6).alias("health"))


def _rates(spark, d):
    """Daily rates by currency: means over the orders of a priority."""
    o = fr.read(spark, d, "orders", "o_orderpriority", "o_orderdate", "o_totalprice")
    unit = F.when(F.col("o_orderpriority") == "1-URGENT", "EUR").when(F.col("o_orderpriority") == "2-HIGH", "JPY")
    o = o.select(unit.alias("currency"), F.to_date("o_orderdate").alias("period_end"), "o_totalprice").filter("currency IS NOT NULL")
    return o.groupBy("currency", "period_end").agg((F.avg("o_totalprice") / 100_000).alias("rate"))


def _multiples(spark, d):
    x = V.converted(_statements(spark, d).drop("growth", "margin_trend", "profit"), _rates(spark, d), AMOUNTS)
    close = fr.month_bars(spark, d).groupBy("security_id").agg((F.max_by("close", "session_date") * 1000).alias("market_cap"))
    return V.multiples(x.join(close, "security_id", "left"))


def valuation_metrics(spark, d):
    return _multiples(spark, d).select("security_id", "currency", "reason", F.round("rate", 8).alias("rate"), *[F.round(c, 7).alias(c) for c in V.METRICS])


def valuation_signals(spark, d):
    return V.signals(_multiples(spark, d)).select("security_id", "leg", F.round("signal", 6).alias("signal"))


def valuation_brake(spark, d):
    out = V.brake(V.signals(_multiples(spark, d)))
    return out.select("security_id", "signals", F.round("brake", 6).alias("brake"))


def reporting_currencies(spark, d):
    x = fr.read(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_shipdate")
    unit = F.when(F.col("l_returnflag") == "A", "USD").when(F.col("l_returnflag") == "N", "EUR").otherwise("USD/shares")
    x = x.select("l_suppkey", unit.alias("unit"), F.to_date("l_shipdate").alias("end"), F.trunc(F.to_date("l_shipdate"), "month").alias("filed"))
    return V.reporting_currency(x, "l_suppkey")


_ST = fr.SECURITIES + f""",
yf AS (SELECT l_suppkey AS id, year(l_shipdate) AS period, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS filed, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (0.5 - l_discount)) AS profit,
  sum(l_extendedprice * l_tax) AS debt, sum(l_extendedprice * l_discount) AS capex FROM lineitem GROUP BY ALL),
y1 AS (SELECT * FROM yf QUALIFY row_number() OVER (PARTITION BY id, period ORDER BY filed DESC) = 1),
y5 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY period DESC) AS back FROM y1 QUALIFY back <= 5),
tr AS (SELECT id, CASE WHEN count(*) >= 5 THEN (max(revenue) FILTER (back = 1) - max(revenue) FILTER (back = 5)) / max(revenue) FILTER (back = 5) END AS growth, CASE WHEN count(*) >= 2 THEN regr_slope(profit / revenue, 5 - back) END AS margin_trend FROM y5 GROUP BY 1),
n AS (SELECT security_id, cohort, parent, balance, count(*) OVER (PARTITION BY cohort) AS cn, count(*) OVER (PARTITION BY parent) AS pn FROM sec),
sm AS (SELECT security_id, cohort, parent, cn, pn, growth, margin_trend, revenue, profit, debt, capex, make_date(period, 12, 31) AS period_end,
  CASE parent WHEN 'EUROPE' THEN 'EUR' WHEN 'ASIA' THEN 'JPY' WHEN 'AFRICA' THEN 'XAF' ELSE 'USD' END AS currency, greatest(balance, 0) AS cash, balance * 10 AS equity, profit * 1.2 AS ebitda, profit * 0.9 AS cfo
  FROM n JOIN y5 ON y5.id = security_id AND back = 1 JOIN tr ON tr.id = security_id),
ra AS (SELECT *, profit * (1 - {TAX}) / (equity + debt - cash) AS roic, (cash + cash * 0.5 - debt) / (equity + debt) AS net_cash_ratio, (cfo - capex) / revenue AS fcf_margin FROM sm)"""


def blended_sql(name: str, source: str) -> str:
    """SQL: ``name`` holds the blended z of the rows of ``source`` (security_id, cohort, parent, cn, pn, leg, x)."""
    return f"""{name}s AS (SELECT *, avg(x) OVER c AS cm, stddev_pop(x) OVER c AS cs, count(x) OVER c AS cc, avg(x) OVER p AS pm, stddev_pop(x) OVER p AS ps, count(x) OVER p AS pc, avg(x) OVER u AS um, stddev_pop(x) OVER u AS us, count(x) OVER u AS uc
  FROM {source} WINDOW c AS (PARTITION BY leg, cohort), p AS (PARTITION BY leg, parent), u AS (PARTITION BY leg)),
{name}k AS (SELECT *, CASE WHEN x IS NOT NULL AND cc >= 2 AND cs > 0 THEN cn / (cn + 12.0) ELSE 0 END AS kc, CASE WHEN x IS NOT NULL AND pc >= 2 AND ps > 0 THEN (1 - cn / (cn + 12.0)) * (pn / (pn + 12.0)) ELSE 0 END AS kp,
  CASE WHEN x IS NOT NULL AND uc >= 2 AND us > 0 THEN (1 - cn / (cn + 12.0)) * (1 - pn / (pn + 12.0)) ELSE 0 END AS ku FROM {name}s),
{name} AS (SELECT security_id, leg, CASE WHEN kc + kp + ku > 0 THEN (CASE WHEN kc > 0 THEN kc * (x - cm) / cs ELSE 0 END + CASE WHEN kp > 0 THEN kp * (x - pm) / ps ELSE 0 END + CASE WHEN ku > 0 THEN ku * (x - um) / us ELSE 0 END) / (kc + kp + ku) END AS z FROM {name}k)"""


_MU = f"""{_ST}, fx AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'EUR' WHEN '2-HIGH' THEN 'JPY' END AS currency, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 100000 AS rate FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2),
{fr.BARS}, mc AS (SELECT security_id, arg_max(close, session_date) * 1000 AS cap FROM bars GROUP BY 1),
cv AS (SELECT sm.*, CASE WHEN sm.currency = 'USD' THEN 1.0 ELSE fx.rate END AS rate FROM sm ASOF LEFT JOIN fx ON sm.currency = fx.currency AND sm.period_end >= fx.day),
mu AS (SELECT *, (cap + (debt - cash) * rate) / nullif(revenue * rate, 0) AS ev_sales, (cap + (debt - cash) * rate) / nullif(ebitda * rate, 0) AS ev_ebitda, (cfo - capex) * rate / nullif(cap, 0) AS fcf_yield FROM cv LEFT JOIN mc USING (security_id)),
vl AS (SELECT security_id, cohort, parent, cn, pn, leg, CASE WHEN x > 0 THEN x END AS x FROM (SELECT security_id, cohort, parent, cn, pn, unnest(['ev_sales', 'ev_ebitda', 'fcf_yield']) AS leg, unnest([ev_sales, ev_ebitda, fcf_yield]) AS x FROM mu)),
{blended_sql('vz', 'vl')},
sg AS (SELECT security_id, leg, CASE WHEN leg = 'fcf_yield' THEN z ELSE -z END AS signal FROM vz)"""
QUERIES = {
    "statement_ratios": (statement_ratios, f"WITH {_ST} SELECT security_id, " + ", ".join(f"round({p}, 7) AS {p}" for p in PARTS) + " FROM ra"),
    "fundamental_health": (fundamental_health, f"WITH {_ST}, hl AS (SELECT security_id, cohort, parent, cn, pn, unnest([{', '.join(repr(p) for p in PARTS)}]) AS leg, unnest([{', '.join(PARTS)}]) AS x FROM ra), {blended_sql('hz', 'hl')} SELECT security_id, count(z) AS available, round(CASE WHEN count(z) >= 3 THEN sum(coalesce(z, 0)) / 5 END, 6) AS health FROM hz GROUP BY 1"),
    "valuation_metrics": (valuation_metrics, f"WITH {_MU} SELECT security_id, currency, CASE WHEN rate IS NULL THEN 'no_rate' END AS reason, round(rate, 8) AS rate, round(ev_sales, 7) AS ev_sales, round(ev_ebitda, 7) AS ev_ebitda, round(fcf_yield, 7) AS fcf_yield FROM mu"),
    "valuation_signals": (valuation_signals, f"WITH {_MU} SELECT security_id, leg, round(signal, 6) AS signal FROM sg"),
    "valuation_brake": (valuation_brake, f"WITH {_MU} SELECT security_id, count(signal) AS signals, round(avg(signal), 6) AS brake FROM sg GROUP BY 1"),
    "reporting_currencies": (reporting_currencies, "WITH f AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'N' THEN 'EUR' END AS unit, CAST(l_shipdate AS DATE) AS e FROM lineitem WHERE l_returnflag IN ('A', 'N')) SELECT l_suppkey, arg_max(unit, struct_pack(f := date_trunc('month', e), e, unit)) AS currency FROM f GROUP BY 1"),
}
