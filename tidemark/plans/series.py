"""Queries over price series: sessions, returns, integrity, signal measurement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import integrity as I
from tidemark.operators import perf as P
from tidemark.operators import sessions as N
from tidemark.sources import frames as fr

HORIZONS = (1, 3, 6)


def _bars(spark, d):
    return fr.month_bars(spark, d)


def price_bars(spark, d):
    return _bars(spark, d)


def latest_price_bars(spark, d):
    return N.latest_as_of(_bars(spark, d), F.lit("1998-06-15").cast("date"), "security_id", "session_date", "close", "volume")


def price_history(spark, d):
    """The twelve latest bars of each security up to a date."""
    w = Window.partitionBy("security_id").orderBy(F.desc("session_date"))
    b = _bars(spark, d).filter("session_date <= DATE '1999-03-31'")
    return b.withColumn("back", F.row_number().over(w)).filter("back <= 12").select("security_id", "session_date", "close", F.col("back").cast("long"))


def returns(spark, d):
    out = N.with_returns(_bars(spark, d), HORIZONS)
    return out.select("security_id", "session_date", F.round("ret", 8).alias("ret"), *[F.round(f"{k}_{h}", 8).alias(f"{k}_{h}") for k in ("fwd", "back") for h in HORIZONS])


def observed_sessions(spark, d):
    return N.calendar(_bars(spark, d))


def staleness(spark, d):
    """Sessions between each security's last bar and a date; stale beyond two."""
    b = _bars(spark, d).filter("session_date <= DATE '2001-10-01'")
    last = b.groupBy("security_id").agg(F.max("session_date").alias("last_date")).withColumn("as_of", F.lit("2001-10-15").cast("date"))
    out = N.strictly_between(N.calendar(b), last, "last_date", "as_of")
    return out.select("security_id", "last_date", "between", (F.col("between") > 2).alias("stale"))


def weakening_streaks(spark, d):
    out = N.with_returns(_bars(spark, d), (1,))
    return N.streaks(out, F.col("ret") < 0, "security_id", "session_date").select("security_id", "session_date", "streak")


def fx_as_of(spark, d):
    """Error events with the last purchase value of their user, at most seven days old."""
    e = fr.read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("day", F.to_date("ts"))
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "day")
    rates = e.filter("event_type = 'purchase'").groupBy("user_id", "day").agg(F.max("value").alias("rate"))
    out = N.as_of_join(left, rates, "user_id", "day", "rate", max_age=7)
    return out.select("event_id", "user_id", "day", F.col("as_of_value").alias("rate"), F.col("as_of_date").alias("rate_day"))


def day_bars(spark, d):
    e = fr.read(spark, d, "events", "event_id", "ts", "user_id", "value").withColumn("day", F.to_date("ts"))
    at = F.struct("ts", "event_id")
    return e.groupBy("user_id", "day").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")
    )


def _events_bars(spark, d):
    """Bars with the events that checks look at: splits and dividends by rule."""
    m = F.month("session_date")
    return _bars(spark, d).select(
        "*",
        F.when(m == 7, 2.0).otherwise(1.0).alias("split_factor"),
        F.when(m == 3, F.col("close") * 0.01).otherwise(0.0).alias("dividend"),
    )


_EB = fr.BARS + """,
eb AS (SELECT *, CASE WHEN month(session_date) = 7 THEN 2.0 ELSE 1.0 END::DOUBLE AS split_factor,
  CASE WHEN month(session_date) = 3 THEN close * 0.01 ELSE 0.0 END AS dividend FROM bars)"""


def series_anomalies(spark, d):
    out = I.series_anomalies(_events_bars(spark, d))
    return out.select("security_id", "session_date", "code", F.round("move", 8).alias("move"), "ratio")


def bar_findings(spark, d):
    """Structural faults of bars that were made faulty by rule."""
    b = _events_bars(spark, d)
    bad = b.withColumns({
        "high": F.when(F.col("volume") % 97 == 0, F.col("low") - 1).otherwise(F.col("high")),
        "close": F.when(F.col("volume") % 89 == 0, F.lit(0.0)).otherwise(F.col("close")),
        "dividend": F.when(F.col("volume") % 83 == 0, F.lit(-1.0)).otherwise(F.col("dividend")),
    })
    return I.bar_findings(bad)


def adjustment_factors(spark, d):
    out = I.adjustment_factors(_events_bars(spark, d))
    return out.select("security_id", "session_date", F.round("factor", 8).alias("factor"))


def repaired_series(spark, d):
    """Adjusted closes that forget dividends are found inconsistent and rebuilt."""
    b = _events_bars(spark, d)
    later = Window.partitionBy("security_id").orderBy(F.desc("session_date")).rowsBetween(Window.unboundedPreceding, -1)
    splits = F.exp(-F.coalesce(F.sum(F.ln("split_factor")).over(later), F.lit(0.0)))
    out = I.repaired(b.withColumn("close_adjusted", F.round(F.col("close") * splits, 6)))
    return out.select("security_id", "session_date", "inconsistent", F.round("close_repaired", 6).alias("close_repaired"))


def forward_anomalies(spark, d):
    out = I.forward_anomalies(_bars(spark, d), 3, 0.45)
    return out.select("security_id", "session_date", F.round("fwd", 8).alias("fwd"), "culprit")


def dedupe(spark, d):
    """Lines that share an order and a line number: the last one stays."""
    x = fr.read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    kept, _ = I.dedupe_bars(x, ("l_orderkey", "l_linenumber"), ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _cross(spark, d):
    """Date, security, score (trailing return) and forward returns."""
    return N.with_returns(_bars(spark, d), HORIZONS).withColumn("score", F.round(-F.col("back_3"), 10))


def _long(spark, d):
    x = _cross(spark, d).select("security_id", "session_date", "score", *[F.round(f"fwd_{h}", 10).alias(str(h)) for h in HORIZONS])
    x = x.unpivot(["security_id", "session_date", "score"], [str(h) for h in HORIZONS], "horizon", "fwd")
    return x.withColumn("horizon", F.col("horizon").cast("int"))


def _ics(spark, d):
    return P.spearman(_long(spark, d), "score", "fwd", ["horizon", "session_date"])


def rank_ic(spark, d):
    return _ics(spark, d).select("horizon", "session_date", "population", F.round("ic", 8).alias("ic"))


def ic_distribution(spark, d):
    out = P.distribution(_ics(spark, d), "ic", ["horizon"], F.col("horizon"))
    return out.select("horizon", "n", *[F.round(c, 7).alias(c) for c in ("mean", "std", "low", "high", "q10", "q25", "median", "q75", "q90", "positive", "information_ratio", "ess", "t", "p")])


def top_bottom_spread(spark, d):
    s = P.spread(_long(spark, d), "score", "fwd", ["horizon", "session_date"], "security_id")
    s = P.turnover(s, "top_ids", ["horizon"], "session_date")
    return s.select("horizon", "session_date", "population", *[F.round(c, 8).alias(c) for c in ("top_return", "bottom_return", "spread", "turnover")])


def max_drawdown(spark, d):
    x = N.with_returns(_bars(spark, d), (1,)).filter("ret IS NOT NULL")
    return P.drawdown(x, "ret", ["security_id"], "session_date").select("security_id", F.round("max_drawdown", 8).alias("max_drawdown"))


def multiple_testing(spark, d):
    """One test for each security's mean return, adjusted over all securities."""
    x = N.with_returns(_bars(spark, d), (1,)).filter("ret IS NOT NULL")
    g = x.groupBy("security_id").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    g = g.withColumn("p", F.round(S.two_sided_p(F.col("m") / F.col("s") * F.sqrt("n")), 9)).withColumn("family", F.lit("returns"))
    out = P.benjamini_hochberg(g, "p", ["family"], "security_id")
    return out.select("security_id", "p", F.col("rank").cast("long"), F.round("q", 7).alias("q"), "significant")


def newey_west(spark, d):
    x = _ics(spark, d).filter("horizon = 3 AND ic IS NOT NULL")
    out = P.newey_west(x, "ic", ["horizon"], "session_date", 3, S.Z_BY_CONFIDENCE[0.95])
    return out.select("horizon", "n", *[F.round(c, 8).alias(c) for c in ("mean", "se", "low", "high")])


def block_bootstrap(spark, d):
    return P.bootstrap(_ics(spark, d), "ic", "horizon", "session_date", 3)


def random_null_band(spark, d):
    return P.random_band(_cross(spark, d).filter("fwd_1 IS NOT NULL").withColumn("day", F.col("session_date").cast("string")), "fwd_1", "day", "security_id")


def non_overlapping_sessions(spark, d):
    cal = N.calendar(_bars(spark, d)).withColumn("grp", F.lit("all"))
    return P.non_overlapping(cal, "grp", "session_no", 6).select("session_date", "session_no")


def coverage_bias(spark, d):
    """Whether thinly traded securities score and return differently: by date."""
    x = _cross(spark, d).filter("score IS NOT NULL AND fwd_1 IS NOT NULL").withColumn("fwd_1", F.round("fwd_1", 10))
    a = P.spearman(x, "volume", "score", ["session_date"], "coverage_score")
    b = P.spearman(x, "volume", "fwd_1", ["session_date"], "coverage_return").drop("population")
    med = x.groupBy("session_date").agg(F.median("volume").alias("mid"))
    half = x.join(med, "session_date").withColumn("half", F.when(F.col("volume") >= F.col("mid"), "high").otherwise("low"))
    c = P.spearman(half, "score", "fwd_1", ["session_date", "half"])
    high = c.filter("half = 'high'").select("session_date", F.col("ic").alias("high_ic"))
    low = c.filter("half = 'low'").select("session_date", F.col("ic").alias("low_ic"))
    out = a.join(b, "session_date").join(high, "session_date", "left").join(low, "session_date", "left")
    return out.select("session_date", "population", *[F.round(k, 8).alias(k) for k in ("coverage_score", "coverage_return", "high_ic", "low_ic")])


def leg_correlations(spark, d):
    """Pearson of every pair of legs over the securities that have both."""
    x = fr.legs_long(spark, d).filter("x IS NOT NULL").select("security_id", "leg", "x")
    both = x.alias("a").join(x.alias("b"), (F.col("a.security_id") == F.col("b.security_id")) & (F.col("a.leg") < F.col("b.leg")))
    both = both.select(F.col("a.leg").alias("leg_a"), F.col("b.leg").alias("leg_b"), F.col("a.x").alias("xa"), F.col("b.x").alias("xb"))
    return P.pearson(both, "xa", "xb", ["leg_a", "leg_b"], "r").select("leg_a", "leg_b", "population", F.round("r", 6).alias("r"))


def market_risk(spark, d):
    """Annualised volatility of the last 60 returns, and mean daily value."""
    w = Window.partitionBy("security_id").orderBy(F.desc("session_date"))
    last = _bars(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 61")
    r = N.with_returns(last, (1,))
    g = r.groupBy("security_id").agg(F.stddev_pop("ret").alias("s"), F.avg(F.col("close") * F.col("volume")).alias("v"), F.count("ret").alias("n"))
    return g.select("security_id", "n", F.round(F.col("s") * F.sqrt(F.lit(252.0)), 8).alias("volatility"), F.round("v", 4).alias("daily_value"))


_RET = fr.BARS + """,
r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, """ + ", ".join(
    f"lead(close, {h}) OVER w / close - 1 AS fwd_{h}, close / lag(close, {h}) OVER w - 1 AS back_{h}" for h in HORIZONS
) + " FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY session_date))"
_LONG = _RET + """,
x AS (SELECT security_id, session_date, round(-back_3, 10) AS score, volume, unnest([1, 3, 6]) AS horizon,
  unnest([round(fwd_1, 10), round(fwd_3, 10), round(fwd_6, 10)]) AS fwd FROM r),
ok AS (SELECT * FROM x WHERE score IS NOT NULL AND fwd IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY horizon, session_date ORDER BY score) + (count(*) OVER (PARTITION BY horizon, session_date, score) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY horizon, session_date ORDER BY fwd) + (count(*) OVER (PARTITION BY horizon, session_date, fwd) - 1) / 2.0 AS ry FROM ok),
ic AS (SELECT horizon, session_date, count(*) AS population,
  CASE WHEN count(*) >= 2 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END AS ic
  FROM rk GROUP BY 1, 2)"""


def _erf_sql(x: str) -> str:
    t = f"(1 / (1 + {S.ERF_P} * abs({x})))"
    poly = "0.0"
    for a in reversed(S.ERF_A):
        poly = f"(({poly}) + ({a})) * {t}"
    return f"(sign({x}) * (1 - ({poly}) * exp(-({x}) * ({x}))))"


def _p_sql(t: str) -> str:
    return f"2 * (1 - least(1, greatest(0, 0.5 * (1 + {_erf_sql(f'(abs({t}) / sqrt(2.0))')}))))"


def _spear_sql(name: str, x: str, y: str, source: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, count(*) AS n,
  CASE WHEN count(*) >= 2 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END AS v
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2.0 AS ry FROM {source})
  GROUP BY {keys})"""


QUERIES = {
    "price_bars": (price_bars, f"WITH {fr.BARS} SELECT * FROM bars"),
    "latest_price_bars": (latest_price_bars, f"WITH {fr.BARS} SELECT security_id, session_date, close, volume FROM bars WHERE session_date <= DATE '1998-06-15' QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY session_date DESC) = 1"),
    "price_history": (price_history, f"WITH {fr.BARS} SELECT security_id, session_date, close, row_number() OVER (PARTITION BY security_id ORDER BY session_date DESC) AS back FROM bars WHERE session_date <= DATE '1999-03-31' QUALIFY back <= 12"),
    "returns": (returns, f"WITH {_RET} SELECT security_id, session_date, round(ret, 8) AS ret, " + ", ".join(f"round({k}_{h}, 8) AS {k}_{h}" for k in ("fwd", "back") for h in HORIZONS) + " FROM r"),
    "observed_sessions": (observed_sessions, f"WITH {fr.BARS} SELECT session_date, row_number() OVER (ORDER BY session_date) AS session_no FROM (SELECT DISTINCT session_date FROM bars)"),
    "staleness": (staleness, f"""WITH {fr.BARS}, b AS (SELECT * FROM bars WHERE session_date <= DATE '2001-10-01'),
  l AS (SELECT security_id, max(session_date) AS last_date FROM b GROUP BY 1)
SELECT security_id, last_date, (SELECT count(DISTINCT session_date) FROM b WHERE session_date > last_date AND session_date < DATE '2001-10-15') AS between,
  (SELECT count(DISTINCT session_date) FROM b WHERE session_date > last_date AND session_date < DATE '2001-10-15') > 2 AS stale FROM l"""),
    "weakening_streaks": (weakening_streaks, f"""WITH {_RET}, s AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY session_date) AS n, coalesce(ret < 0, false) AS on_ FROM r)
SELECT security_id, session_date, CASE WHEN on_ THEN n - coalesce(max(CASE WHEN NOT on_ THEN n END) OVER (PARTITION BY security_id ORDER BY session_date), 0) ELSE 0 END AS streak FROM s"""),
    "fx_as_of": (fx_as_of, """WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
p AS (SELECT user_id, day, max(value) AS rate FROM e WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, e.day, CASE WHEN e.day - p.day <= 7 THEN p.rate END AS rate, CASE WHEN e.day - p.day <= 7 THEN p.day END AS rate_day
FROM (SELECT * FROM e WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.day >= p.day"""),
    "day_bars": (day_bars, """SELECT user_id, CAST(ts AS DATE) AS day, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2"""),
    "series_anomalies": (series_anomalies, f"""WITH {_EB}, p AS (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY session_date) AS prev FROM eb),
m AS (SELECT *, abs((close * split_factor + dividend) / prev - 1) AS move, greatest(prev / close, close / prev) AS q FROM p WHERE prev > 0),
c AS (SELECT *, CASE WHEN split_factor = 1 AND dividend = 0 AND q >= 1.9 THEN list_filter([2.0, 3, 4, 5, 6, 7, 8, 10, 15, 20, 25, 30, 40, 50, 100]::DOUBLE[], lambda s: abs((q - s) / s) <= 0.05)[1] END AS ratio FROM m)
SELECT security_id, session_date, code, round(move, 8) AS move, ratio FROM (SELECT *, CASE WHEN split_factor <> 1 AND move > 0.45 THEN 'SPLIT_FACTOR_DISCONTINUITY' WHEN move > 5 THEN 'IMPLAUSIBLE_JUMP_ERROR'
  WHEN move > 0.45 AND ratio IS NOT NULL THEN 'UNEXPLAINED_SCALE_BREAK' WHEN move > 0.45 THEN 'IMPLAUSIBLE_JUMP_WARNING' END AS code FROM c) WHERE code IS NOT NULL"""),
    "bar_findings": (bar_findings, f"""WITH {_EB}, b AS (SELECT security_id, session_date, open, CASE WHEN volume % 97 = 0 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN volume % 89 = 0 THEN 0.0 ELSE close END AS close, volume, split_factor, CASE WHEN volume % 83 = 0 THEN -1.0 ELSE dividend END AS dividend FROM eb),
s AS (SELECT *, open > 0 AND high > 0 AND low > 0 AND close > 0 AS sound FROM b)
SELECT security_id, session_date, 'NON_POSITIVE_PRICE' AS code, 'open must be > 0' AS detail FROM s WHERE open <= 0
UNION ALL SELECT security_id, session_date, 'NON_POSITIVE_PRICE', 'high must be > 0' FROM s WHERE high <= 0
UNION ALL SELECT security_id, session_date, 'NON_POSITIVE_PRICE', 'low must be > 0' FROM s WHERE low <= 0
UNION ALL SELECT security_id, session_date, 'NON_POSITIVE_PRICE', 'close must be > 0' FROM s WHERE close <= 0
UNION ALL SELECT security_id, session_date, 'IMPOSSIBLE_OHLC', 'high < low' FROM s WHERE sound AND high < low
UNION ALL SELECT security_id, session_date, 'IMPOSSIBLE_OHLC', 'high < max(open, close)' FROM s WHERE sound AND high < greatest(open, close)
UNION ALL SELECT security_id, session_date, 'IMPOSSIBLE_OHLC', 'low > min(open, close)' FROM s WHERE sound AND low > least(open, close)
UNION ALL SELECT security_id, session_date, 'IMPOSSIBLE_VOLUME', 'volume must be >= 0' FROM s WHERE volume < 0
UNION ALL SELECT security_id, session_date, 'IMPOSSIBLE_SPLIT_FACTOR', 'split_factor must be > 0' FROM s WHERE split_factor <= 0
UNION ALL SELECT security_id, session_date, 'IMPOSSIBLE_DIVIDEND', 'dividend must be >= 0' FROM s WHERE dividend < 0"""),
    "adjustment_factors": (adjustment_factors, f"""WITH {_EB}, e AS (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY session_date) AS prev FROM eb),
f AS (SELECT *, CASE WHEN prev IS NULL THEN 1.0 WHEN prev > dividend THEN (1 / split_factor) * ((prev - dividend) / prev) ELSE 1 / split_factor END AS event FROM e)
SELECT security_id, session_date, round(exp(coalesce(sum(ln(event)) OVER (PARTITION BY security_id ORDER BY session_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 8) AS factor FROM f"""),
    "repaired_series": (repaired_series, f"""WITH {_EB}, e AS (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY session_date) AS prev FROM eb),
f AS (SELECT *, CASE WHEN prev IS NULL THEN 1.0 WHEN prev > dividend THEN (1 / split_factor) * ((prev - dividend) / prev) ELSE 1 / split_factor END AS event FROM e),
g AS (SELECT *, close * exp(coalesce(sum(ln(event)) OVER w, 0)) AS expected, round(close * exp(-coalesce(sum(ln(split_factor)) OVER w, 0)), 6) AS adj FROM f
  WINDOW w AS (PARTITION BY security_id ORDER BY session_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT security_id, session_date, abs((adj - expected) / expected) > 0.002 AS inconsistent,
  CASE WHEN abs((adj - expected) / expected) > 0.002 THEN round(expected, 6) ELSE adj END AS close_repaired FROM g"""),
    "forward_anomalies": (forward_anomalies, f"""WITH {fr.BARS}, s AS (SELECT *, abs(close / lag(close) OVER w - 1) AS step, lead(close, 3) OVER w / close - 1 AS fwd,
  row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY session_date))
SELECT a.security_id, a.session_date, round(a.fwd, 8) AS fwd, first(b.session_date ORDER BY b.step DESC, b.session_date) AS culprit
FROM s a JOIN s b ON a.security_id = b.security_id AND b.n BETWEEN a.n + 1 AND a.n + 3 WHERE abs(a.fwd) > 0.45 GROUP BY ALL"""),
    "dedupe_bars": (dedupe, """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1"""),
    "rank_ic": (rank_ic, f"WITH {_LONG} SELECT horizon, session_date, population, round(ic, 8) + 0.0 AS ic FROM ic"),
    "ic_distribution": (ic_distribution, f"""WITH {_LONG}, g AS (SELECT horizon, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, min(ic) AS low, max(ic) AS high,
  quantile_cont(ic, 0.1) AS q10, quantile_cont(ic, 0.25) AS q25, median(ic) AS median, quantile_cont(ic, 0.75) AS q75, quantile_cont(ic, 0.9) AS q90,
  avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM ic WHERE ic IS NOT NULL GROUP BY 1),
h AS (SELECT *, mean / std AS information_ratio, CASE WHEN horizon <= 1 THEN n ELSE n / least(horizon, n) END AS ess FROM g),
k AS (SELECT *, CASE WHEN ess >= 10 THEN information_ratio * sqrt(ess) END AS t FROM h)
SELECT horizon, n, """ + ", ".join(f"round({c}, 7) AS {c}" for c in ("mean", "std", "low", "high", "q10", "q25", "median", "q75", "q90", "positive", "information_ratio", "ess", "t")) + f", round({_p_sql('t')}, 7) AS p FROM k"),
    "top_bottom_spread": (top_bottom_spread, f"""WITH {_LONG}, k AS (SELECT *, row_number() OVER (PARTITION BY horizon, session_date ORDER BY score, security_id) AS k, count(*) OVER (PARTITION BY horizon, session_date) AS n FROM ok),
s AS (SELECT *, greatest(1, least(floor(n * 0.2 + 1e-9), floor(n / 2))) AS size FROM k WHERE n >= 2),
g AS (SELECT horizon, session_date, max(n) AS population, avg(fwd) FILTER (k > n - size) AS top_return, avg(fwd) FILTER (k <= size) AS bottom_return,
  list(security_id) FILTER (k > n - size) AS ids FROM s GROUP BY 1, 2),
t AS (SELECT *, lag(ids) OVER (PARTITION BY horizon ORDER BY session_date) AS before FROM g)
SELECT horizon, session_date, population, round(top_return, 8) AS top_return, round(bottom_return, 8) AS bottom_return, round(top_return - bottom_return, 8) AS spread,
  round(CASE WHEN before IS NOT NULL THEN len(list_filter(ids, lambda i: NOT list_contains(before, i))) / len(ids) END, 8) AS turnover FROM t"""),
    "max_drawdown": (max_drawdown, f"""WITH {_RET}, v AS (SELECT security_id, session_date, exp(sum(ln(1 + ret)) OVER (PARTITION BY security_id ORDER BY session_date)) AS v FROM r WHERE ret IS NOT NULL),
p AS (SELECT *, greatest(1.0, max(v) OVER (PARTITION BY security_id ORDER BY session_date)) AS p FROM v)
SELECT security_id, round(CASE WHEN count(*) >= 2 THEN least(0.0, min(v / p - 1)) END, 8) AS max_drawdown FROM p GROUP BY 1"""),
    "multiple_testing": (multiple_testing, f"""WITH {_RET}, g AS (SELECT security_id, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM r WHERE ret IS NOT NULL GROUP BY 1),
t AS (SELECT security_id, round({_p_sql('(m / s * sqrt(n))')}, 9) AS p FROM g),
k AS (SELECT *, row_number() OVER (ORDER BY p, security_id) AS rank, count(*) OVER () AS m FROM t)
SELECT security_id, p, rank, round(least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC)), 7) AS q,
  rank <= coalesce((SELECT max(rank) FROM k WHERE p <= rank / m * 0.05), 0) AS significant FROM k"""),
    "newey_west": (newey_west, f"""WITH {_LONG}, s AS (SELECT session_date, ic - (SELECT avg(ic) FROM ic WHERE horizon = 3) AS d, ic, row_number() OVER (ORDER BY session_date) AS i FROM ic WHERE horizon = 3 AND ic IS NOT NULL),
c AS (SELECT count(*) AS n, avg(ic) AS mean, (SELECT sum(d * d) FROM s) AS g0,
  (SELECT sum(a.d * b.d) FROM s a JOIN s b ON a.i = b.i + 1) AS g1, (SELECT sum(a.d * b.d) FROM s a JOIN s b ON a.i = b.i + 2) AS g2 FROM s),
v AS (SELECT n, mean, sqrt((g0 / n + 2 * (2.0 / 3) * g1 / n + 2 * (1.0 / 3) * g2 / n) / n) AS se FROM c)
SELECT 3 AS horizon, n, round(mean, 8) AS mean, round(se, 8) AS se, round(mean - 1.9599639845 * se, 8) AS low, round(mean + 1.9599639845 * se, 8) AS high FROM v"""),
    "block_bootstrap": (block_bootstrap, None),
    "random_null_band": (random_null_band, None),
    "non_overlapping_sessions": (non_overlapping_sessions, f"""WITH RECURSIVE {fr.BARS}, c AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS session_no FROM (SELECT DISTINCT session_date FROM bars)),
k AS (SELECT min(session_no) AS session_no FROM c UNION ALL SELECT (SELECT min(session_no) FROM c WHERE c.session_no >= k.session_no + 6) FROM k WHERE (SELECT min(session_no) FROM c WHERE c.session_no >= k.session_no + 6) IS NOT NULL)
SELECT session_date, session_no FROM c JOIN k USING (session_no)"""),
    "coverage_bias": (coverage_bias, f"""WITH {_LONG}, o AS (SELECT * FROM ok WHERE horizon = 1), h AS (SELECT *, volume >= median(volume) OVER (PARTITION BY session_date) AS hi FROM o),
{_spear_sql('a', 'volume', 'score', 'o', 'session_date')}, {_spear_sql('b', 'volume', 'fwd', 'o', 'session_date')}, {_spear_sql('c', 'score', 'fwd', 'h', 'session_date, hi')}
SELECT a.session_date, a.n AS population, round(a.v, 8) + 0.0 AS coverage_score, round(b.v, 8) + 0.0 AS coverage_return, round(h1.v, 8) + 0.0 AS high_ic, round(h0.v, 8) + 0.0 AS low_ic
FROM a JOIN b USING (session_date) LEFT JOIN c h1 ON h1.session_date = a.session_date AND h1.hi LEFT JOIN c h0 ON h0.session_date = a.session_date AND NOT h0.hi"""),
    "leg_correlations": (leg_correlations, f"""WITH {fr.RAW} SELECT a.leg AS leg_a, b.leg AS leg_b, count(*) AS population, round(corr(a.x, b.x), 6) AS r
FROM long a JOIN long b ON a.security_id = b.security_id AND a.leg < b.leg AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2"""),
    "market_risk": (market_risk, f"""WITH {fr.BARS}, l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY session_date DESC) <= 61),
r AS (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY session_date) - 1 AS ret FROM l)
SELECT security_id, count(ret) AS n, round(stddev_pop(ret) * sqrt(252.0), 8) AS volatility, round(avg(close * volume), 4) AS daily_value FROM r GROUP BY 1"""),
}
