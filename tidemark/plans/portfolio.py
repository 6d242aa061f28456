"""Queries of evidence legs, policy and ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.formula import compile_formula
from tidemark.operators import ledger as L
from tidemark.operators import legs as G
from tidemark.operators import policy as P
from tidemark.operators import xsec
from tidemark.sources import frames as fr

AS_OF = "2024-01-28"


def _events(spark, d):
    e = fr.read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    e = e.select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return G.in_window(e, "day", F.lit(AS_OF).cast("date"), 180)


_EV = f"""ev AS (SELECT *, DATE '{AS_OF}' - CAST(ts AS DATE) AS age, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
  WHERE DATE '{AS_OF}' - CAST(ts AS DATE) BETWEEN 0 AND 180)"""
_ST = "CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.75 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 END::DOUBLE"


def thesis_linkage(spark, d):
    e = _events(spark, d)
    claims = e.withColumn("strength", G.lookup(F.col("event_type"), G.STRENGTH)).filter("strength IS NOT NULL AND k < 20")
    claims = claims.withColumn("authority", F.when(F.col("k") < 5, 1.0).when(F.col("k") < 10, 0.7).otherwise(0.4) / 10)
    reviewed = e.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).alias("reviewed"))
    out = G.thesis_linkage(claims, reviewed, "user_id")
    return out.select("user_id", F.round("thesis_linkage", 8).alias("thesis_linkage"))


def attention(spark, d):
    e = _events(spark, d).withColumn("weight", F.greatest(F.col("value") / 100, F.when(F.col("event_type") == "view", 0.0).otherwise(0.25))).filter("weight > 0")
    out = G.attention(e, "user_id", 10, 20)
    return out.select("user_id", F.round("attention", 8).alias("attention"))


def narrative(spark, d):
    e = _events(spark, d)
    claims = e.filter("event_type IN ('click', 'view')").withColumn("strength", F.col("k") / 1000.0)
    g = e.groupBy("user_id").agg(F.sum("value").alias("v")).withColumn("v", F.round("v", 4))
    g = xsec.wide_fraction(g, "v", (), "f").withColumn("percentile", S.half_up(F.round(100 * F.col("f"), 9))).drop("f")
    out = G.narrative_premium(claims, g.select("user_id", "percentile"), "user_id")
    return out.select("user_id", F.round("narrative", 8).alias("narrative"))


def smart_money(spark, d):
    o = fr.read(spark, d, "orders", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    o = G.in_window(o.withColumn("day", F.to_date("o_orderdate")), "day", F.lit("2001-06-30").cast("date"), 700)
    trades = o.select(
        F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "P").when(F.col("o_orderstatus") == "O", "S").otherwise("X").alias("code"),
        F.col("o_totalprice").alias("amount"), G.lookup(F.col("o_orderpriority"), G.ROLE, 0.0).alias("weight"),
    )
    caps = fr.read(spark, d, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 1000).alias("cap"))
    out = G.smart_money(trades, caps, "id")
    return out.select("id", F.round("smart_money", 8).alias("smart_money"))


def _facts(spark, d):
    """Yearly figures of each supplier; an amended figure replaces the first."""
    x = fr.read(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_shipdate")
    g = x.groupBy(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("period"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("filed")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * (0.5 - F.col("l_discount"))).alias("profit")
    )
    return g


def fundamentals(spark, d):
    last = G.last_facts(_facts(spark, d), "id", "period", ["filed"], 5)
    out = G.fundamentals(last, "id", 5)
    return out.select("id", "periods", *[F.round(c, 8).alias(c) for c in ("growth", "margin_trend", "margin")])


_FACTS = """facts AS (SELECT l_suppkey AS id, year(l_shipdate) AS period, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS filed,
  sum(l_extendedprice) AS revenue, sum(l_extendedprice * (0.5 - l_discount)) AS profit FROM lineitem GROUP BY ALL),
one AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY id, period ORDER BY filed DESC) = 1),
lastn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY period DESC) AS back FROM one QUALIFY back <= 5),
fund AS (SELECT id, count(*) AS periods, CASE WHEN count(*) >= 5 THEN (max(revenue) FILTER (back = 1) - max(revenue) FILTER (back = 5)) / max(revenue) FILTER (back = 5) END AS growth,
  CASE WHEN count(*) >= 2 THEN regr_slope(profit / revenue, 5 - back) END AS margin_trend, max(profit / revenue) FILTER (back = 1) AS margin FROM lastn GROUP BY 1)"""


def _context(spark, d):
    """A policy context for each customer, from balances and orders."""
    o = fr.read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderstatus")
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    c = fr.read(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").join(g, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.coalesce("n", F.lit(0))
    pct = F.when(n > 0, F.pmod(F.col("c_custkey") * 37, F.lit(101)))
    notional = F.round(F.abs("c_acctbal"), 2)
    x = c.select(
        F.col("c_custkey").alias("security_id"), F.col("c_nationkey").alias("portfolio"),
        (F.pmod("c_custkey", F.lit(3)) == 0).alias("held"), pct.cast("int").alias("percentile"),
        F.when(n >= 8, 1.0).when(n >= 4, 0.83).otherwise(0.5).alias("coverage"),
        F.when(n >= 12, "HIGH").when(n >= 3, "MEDIUM").otherwise("LOW").alias("confidence"),
        (F.pmod(F.col("c_custkey") * 7, F.lit(50)) / 10.0 - 2.5).alias("valuation_z"),
        (F.pmod(F.col("c_custkey") * 11, F.lit(40)) / 10.0 - 2.0).alias("thesis_z"),
        F.when(F.pmod("c_custkey", F.lit(5)) < 3, "WEAKENING").when(F.pmod("c_custkey", F.lit(5)) == 3, "STABLE").otherwise("STRENGTHENING").alias("direction"),
        F.pmod(F.col("c_custkey") * 3, F.lit(17)).alias("streak"),
        (F.pmod(F.col("c_custkey") * 13, F.lit(200)) / 10.0).alias("weight"), notional.alias("notional"),
    )
    fee = compile_formula(P.FEE, {"notional": F.col("notional")}) + compile_formula(P.FX_SPREAD, {"notional": F.col("notional")})
    t = P.THRESHOLDS["MODERATE"]
    x = x.withColumn("cost", fee).withColumn("target_weight", S.target_weight(F.col("percentile"), t["top"], t["floor"]))
    return x.withColumn("resulting_weight", F.col("weight") + F.col("notional") / 1000).withColumn("cash_after", 12000 - F.col("notional"))


_CTX = """g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS security_id, c_nationkey AS portfolio, c_custkey % 3 = 0 AS held, CASE WHEN coalesce(n, 0) > 0 THEN CAST((c_custkey * 37) % 101 AS INT) END AS percentile,
  CASE WHEN coalesce(n, 0) >= 8 THEN 1.0 WHEN coalesce(n, 0) >= 4 THEN 0.83 ELSE 0.5 END::DOUBLE AS coverage,
  CASE WHEN coalesce(n, 0) >= 12 THEN 'HIGH' WHEN coalesce(n, 0) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  (c_custkey * 7) % 50 / 10.0::DOUBLE - 2.5::DOUBLE AS valuation_z, (c_custkey * 11) % 40 / 10.0::DOUBLE - 2.0::DOUBLE AS thesis_z,
  CASE WHEN c_custkey % 5 < 3 THEN 'WEAKENING' WHEN c_custkey % 5 = 3 THEN 'STABLE' ELSE 'STRENGTHENING' END AS direction, (c_custkey * 3) % 17 AS streak,
  (c_custkey * 13) % 200 / 10.0::DOUBLE AS weight, round(abs(c_acctbal), 2) AS notional FROM customer LEFT JOIN g ON c_custkey = o_custkey),
x AS (SELECT *, least(greatest(notional * 0.0010::DOUBLE, 10), 100) + notional * 0.0015::DOUBLE AS cost, CASE WHEN percentile IS NULL THEN 4.0 ELSE greatest(15.0 * percentile / 100, 4.0) END AS target_weight,
  weight + notional / 1000 AS resulting_weight, 12000 - notional AS cash_after FROM c)"""
_G = {
    "coverage_min": "coverage >= 0.8", "confidence_not_low": "confidence <> 'LOW'", "not_held": "NOT held", "held": "held", "buy_percentile": "percentile >= 75",
    "confidence_min": "confidence <> 'LOW'", "valuation_min": "valuation_z >= -1.0", "resulting_weight": "resulting_weight <= 15", "cash_after": "cash_after >= 3000",
    "cost_pct": "(notional <> 0 AND cost / notional <= 0.01)", "trade_min": "notional >= 2000", "add_percentile": "percentile >= 70", "weight_gap": "target_weight - weight >= 3",
    "overweight": "weight > 15", "sell_percentile": "percentile < 25", "sell_streak": "(direction = 'WEAKENING' AND streak >= 10)", "thesis_broken": "thesis_z < -1.0",
    "trim_percentile": "percentile < 40", "weakening": "direction = 'WEAKENING'",
}


def _all_sql(names):
    return " AND ".join(f"coalesce({_G[n]}, false)" for n in names)


def _told_sql(names):
    return " || ',' || ".join(f"'{n}=' || CAST(coalesce({_G[n]}, false) AS INT)" for n in names)


def _decide_sql() -> str:
    rules = P.HELD_RULES
    action = " ".join(f"WHEN {_all_sql(n)} THEN '{a}'" for a, n in rules)
    so_far, trace = _told_sql(P.FIRST), ""
    for _, n in rules:
        so_far += " || ',' || " + _told_sql(n)
        trace += f" WHEN {_all_sql(n)} THEN {so_far}"
    first, buy = _all_sql(P.FIRST), _all_sql(P.BUY)
    return f"""WITH {_CTX} SELECT security_id,
  CASE WHEN NOT ({first}) THEN 'HOLD_INSUFFICIENT_DATA' WHEN NOT held THEN CASE WHEN {buy} THEN 'BUY' ELSE 'HOLD_NO_ACTION' END {action} ELSE 'HOLD_NO_ACTION' END AS action,
  CASE WHEN NOT ({first}) THEN {_told_sql(P.FIRST)} WHEN NOT held THEN {_told_sql(P.FIRST)} || ',' || {_told_sql(P.BUY)} {trace} ELSE {so_far} END AS trace FROM x"""


def policy_actions(spark, d):
    return P.decide(_context(spark, d)).select("security_id", "action", "trace")


def trade_costs(spark, d):
    x = _context(spark, d)
    return x.select("security_id", F.round("cost", 6).alias("cost"), F.round("target_weight", 6).alias("target_weight"), S.quantity_band(F.floor("notional")).cast("long").alias("band"))


def post_run_assertions(spark, d):
    """Counts of actions against the limits that a run must hold."""
    x = P.decide(_context(spark, d))
    g = x.agg(F.count(F.lit(1)).alias("scored"), F.sum((F.col("action") == "HOLD_INSUFFICIENT_DATA").cast("int")).alias("poor"), F.sum((F.col("action") == "BUY").cast("int")).alias("buys"))
    return g.select(
        "scored", F.col("buys").cast("long").alias("buys"), F.round(F.col("poor") / F.col("scored"), 8).alias("insufficient"),
        (F.col("scored") >= 85).alias("enough_scored"), (F.col("poor") / F.col("scored") < 0.30).alias("enough_data"),
    )


def joint_allocation(spark, d):
    """What each suggestion gets of its portfolio's budgets, given what is held of its cohort and group."""
    group = F.pmod("security_id", F.lit(3))
    x = P.decide(_context(spark, d), "AGGRESSIVE").withColumns({
        "cohort": F.concat(F.lit("c"), F.pmod("security_id", F.lit(4)).cast("string")),
        "grp": F.when(group > 0, F.concat(F.lit("g"), group.cast("string"))),
    })
    held = lambda by, name: x.filter("held").groupBy("portfolio", by).agg((F.sum("weight") / 20).alias(name))
    x = x.filter("action IN ('BUY', 'ADD', 'TRIM', 'SELL')")
    x = x.join(held("cohort", "cohort_weight"), ["portfolio", "cohort"], "left").join(held("grp", "group_weight"), ["portfolio", "grp"], "left")
    x = x.select(
        "portfolio", "security_id", "action", "percentile", "direction", F.col("notional").alias("requested"), "cost", "weight", "cohort", "grp", "cohort_weight", "group_weight",
        (F.pmod("security_id", F.lit(7)) / 10.0).alias("volatility"), (F.col("notional") * 40).alias("daily_value"),
    )
    return P.allocate(x, "portfolio").select("portfolio", "security_id", "action", F.round("allocated", 4).alias("allocated"), "bound")


def decision_signatures(spark, d):
    x = P.decide(_context(spark, d))
    return x.select("security_id", P.signature("action", "security_id", S.quantity_band(F.floor("notional")).cast("long"), F.col("direction"), F.col("confidence"), F.col("trace")).alias("signature"))


def _ledger(spark, d):
    """Lines as ledger events; a later line of the same order and part corrects the first."""
    x = fr.read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate")
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey")
    x = x.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    at = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    x = x.withColumn("version", F.row_number().over(at))
    ident = F.concat_ws(":", "l_orderkey", "l_linenumber", "version")
    before = F.concat_ws(":", F.col("l_orderkey"), F.col("l_linenumber"), F.col("version") - 1)
    return x.select(
        ident.alias("id"), F.when(F.col("version") > 1, before).alias("corrects"), F.col("o_custkey").alias("owner"), F.pmod("l_partkey", F.lit(50)).alias("ticker"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("amount"), F.round(F.col("l_tax") * 10, 2).alias("fees"),
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "USD").otherwise("CHF").alias("currency"),
    )


_LED = """led0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS version FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
led AS (SELECT l_orderkey || ':' || l_linenumber || ':' || version AS id, o_custkey AS owner, l_partkey % 50 AS ticker, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  CAST(l_shipdate AS DATE) AS day, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS amount, round(l_tax * 10, 2) AS fees, CASE WHEN l_suppkey % 2 = 0 THEN 'USD' ELSE 'CHF' END AS currency,
  version, max(version) OVER (PARTITION BY l_orderkey, l_linenumber) AS newest FROM led0),
eff AS (SELECT * FROM led WHERE version = newest)"""
_ORDER = ["day", "last", "id"]


def _effective(spark, d):
    return L.effective(_ledger(spark, d)).withColumn("last", F.col("side") == "SELL")


def effective_transactions(spark, d):
    return _effective(spark, d).select("id", "owner", "ticker", "side", "day", "quantity")


def inherited_costs(spark, d):
    """Fees of events in force; a correction without any has those of the nearest event that it goes back to."""
    e = _ledger(spark, d).withColumn("fees", F.when(F.substring_index("id", ":", -1).cast("int") % 3 == 1, F.col("fees")))
    return L.effective(L.inherited(e, "fees")).select("id", "fees")


def holdings(spark, d):
    """Open lots by owner and ticker, first in first out."""
    return L.open_lots(_effective(spark, d), ["owner", "ticker"], _ORDER).select("id", "owner", "ticker", "day", F.round("rest", 4).alias("rest"))


def cash_by_currency(spark, d):
    return L.cash(_effective(spark, d), ["owner", "currency"])


def portfolio_projection(spark, d):
    """Positions of each owner at the last price of each ticker."""
    e = _effective(spark, d)
    lots = L.open_lots(e, ["owner", "ticker"], _ORDER).withColumn("days", F.datediff(F.lit("2002-01-01"), "day"))
    last = e.groupBy("ticker").agg(F.max_by("price", F.struct("day", "id")).alias("last_price"))
    out = L.project(lots, last, "ticker", "owner")
    return out.select("owner", "ticker", "holding_days", *[F.round(c, 6).alias(c) for c in ("quantity", "cost", "value", "weight")])


# The oracle walks the events one by one, as the definition says.
_LOTS = _LED + """,
seq AS (SELECT *, row_number() OVER (PARTITION BY owner, ticker ORDER BY day, side = 'SELL', id) AS i FROM eff),
walk AS (SELECT owner, ticker, list(struct_pack(i, q := CASE WHEN side = 'SELL' THEN -quantity ELSE quantity END) ORDER BY i) AS es FROM seq GROUP BY 1, 2),
stock AS (SELECT owner, ticker, list_reduce(list_prepend(0.0::DOUBLE, list_transform(es, lambda e: e.q)), lambda a, q: greatest(0.0, a + q)) AS stock FROM walk),
lots0 AS (SELECT seq.*, stock, sum(quantity) OVER (PARTITION BY seq.owner, seq.ticker ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer
  FROM seq JOIN stock USING (owner, ticker) WHERE side = 'BUY'),
lots AS (SELECT *, greatest(0.0, least(quantity, stock - coalesce(newer, 0))) AS rest FROM lots0 WHERE greatest(0.0, least(quantity, stock - coalesce(newer, 0))) > 1e-6)"""

QUERIES = {
    "thesis_linkage": (thesis_linkage, f"""WITH {_EV}, c AS (SELECT user_id, sum({_ST} * (CASE WHEN k < 5 THEN 1.0 WHEN k < 10 THEN 0.7 ELSE 0.4 END / 10)::DOUBLE * exp(-age / 90.0)) AS s, count(*) AS n FROM ev WHERE event_type <> 'error' AND k < 20 GROUP BY 1),
r AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS reviewed FROM ev GROUP BY 1)
SELECT user_id, round(CASE WHEN n > 0 THEN least(1.0, greatest(0.0, s)) WHEN reviewed > 0 THEN 0.0 END, 8) AS thesis_linkage FROM r FULL JOIN c USING (user_id)"""),
    "attention_acceleration": (attention, f"""WITH {_EV}, w AS (SELECT *, greatest(value / 100, CASE WHEN event_type = 'view' THEN 0.0 ELSE 0.25 END) AS w FROM ev)
SELECT user_id, round(least(1.5, greatest(-1.5, ln((coalesce(sum(w) FILTER (age < 10), 0) + 1) / (coalesce(sum(w) FILTER (age >= 10), 0) + 1)))), 8) AS attention FROM w WHERE w > 0 AND age < 20 GROUP BY 1"""),
    "narrative_premium": (narrative, f"""WITH {_EV}, g AS (SELECT user_id, round(sum(value), 4) AS v FROM ev GROUP BY 1),
p AS (SELECT user_id, floor(round(100 * (rank() OVER (ORDER BY v) - 1 + count(*) OVER (PARTITION BY v) / 2.0) / count(*) OVER (), 9) + 0.5) AS p FROM g),
c AS (SELECT user_id, sum(k / 1000.0 * exp(-age / 90.0)) AS s FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT user_id, round(least(1.0, greatest(-1.0, coalesce(least(1.0, greatest(0.0, s)), 0.0) - p / 100)), 8) AS narrative FROM p LEFT JOIN c USING (user_id)"""),
    "smart_money": (smart_money, """WITH t AS (SELECT o_custkey AS id, sum(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END * o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 1.0 WHEN '3-MEDIUM' THEN 0.5 ELSE 0.0 END) AS s
  FROM orders WHERE DATE '2001-06-30' - CAST(o_orderdate AS DATE) BETWEEN 0 AND 700 GROUP BY 1)
SELECT c_custkey AS id, round(CASE WHEN c_acctbal > 0 THEN coalesce(s, 0) / (c_acctbal * 1000) END, 8) AS smart_money FROM customer LEFT JOIN t ON c_custkey = id"""),
    "fundamental_facts": (fundamentals, f"WITH {_FACTS} SELECT id, periods, round(growth, 8) AS growth, round(margin_trend, 8) AS margin_trend, round(margin, 8) AS margin FROM fund"),
    "policy_actions": (policy_actions, _decide_sql()),
    "trade_costs": (trade_costs, f"""WITH {_CTX} SELECT security_id, round(cost, 6) AS cost, round(target_weight, 6) AS target_weight,
  CAST(CASE WHEN floor(notional) < 10 THEN floor(notional) ELSE floor(floor(notional) / pow(10.0, floor(log10(floor(notional))) - 1) + 0.5) * pow(10.0, floor(log10(floor(notional))) - 1) END AS BIGINT) AS band FROM x"""),
    "post_run_assertions": (post_run_assertions, f"""WITH a AS ({_decide_sql()}) SELECT count(*) AS scored, count(*) FILTER (action = 'BUY') AS buys, round(count(*) FILTER (action = 'HOLD_INSUFFICIENT_DATA') / count(*), 8) AS insufficient,
  count(*) >= 85 AS enough_scored, count(*) FILTER (action = 'HOLD_INSUFFICIENT_DATA') / count(*) < 0.30 AS enough_data FROM a"""),
    "joint_allocation": (joint_allocation, None),
    "decision_signatures": (decision_signatures, f"""WITH a AS ({_decide_sql()}), b AS (WITH {_CTX} SELECT *, CASE WHEN floor(notional) < 10 THEN floor(notional) ELSE floor(floor(notional) / pow(10.0, floor(log10(floor(notional))) - 1) + 0.5) * pow(10.0, floor(log10(floor(notional))) - 1) END AS band FROM x)
SELECT security_id, 'v1:' || sha256(action || chr(10) || security_id || chr(10) || CAST(band AS BIGINT) || chr(10) || direction || chr(10) || confidence || chr(10) || trace) AS signature FROM a JOIN b USING (security_id)"""),
    "effective_transactions": (effective_transactions, f"WITH {_LED} SELECT id, owner, ticker, side, day, quantity FROM eff"),
    "inherited_costs": (inherited_costs, f"""WITH {_LED}, f AS (SELECT id, version, newest, last_value(CASE WHEN version % 3 = 1 THEN fees END IGNORE NULLS) OVER (PARTITION BY split_part(id, ':', 1), split_part(id, ':', 2) ORDER BY version) AS fees FROM led)
SELECT id, fees FROM f WHERE version = newest"""),
    "fifo_holdings": (holdings, f"WITH {_LOTS} SELECT id, owner, ticker, day, round(rest, 4) AS rest FROM lots"),
    "cash_by_currency": (cash_by_currency, f"""WITH {_LED} SELECT owner, currency, CAST(round(sum(CAST(CASE WHEN side = 'SELL' THEN amount ELSE -amount END - fees AS DECIMAL(28, 6))), 2) AS DOUBLE) AS cash FROM eff GROUP BY 1, 2"""),
    "portfolio_projection": (portfolio_projection, f"""WITH {_LOTS}, lp AS (SELECT ticker, last(price ORDER BY day, id) AS last_price FROM eff GROUP BY 1),
p AS (SELECT owner, ticker, sum(rest) AS quantity, sum(rest * price) AS cost, CAST(floor(sum((DATE '2002-01-01' - day) * rest) / sum(rest)) AS BIGINT) AS holding_days FROM lots GROUP BY 1, 2)
SELECT owner, ticker, holding_days, round(quantity, 6) AS quantity, round(cost, 6) AS cost, round(quantity * last_price, 6) AS value, round(100 * quantity * last_price / sum(quantity * last_price) OVER (PARTITION BY owner), 6) AS weight FROM p JOIN lp USING (ticker)"""),
}
