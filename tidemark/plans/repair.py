"""Queries that diagnose and repair price series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import attribution as A
from tidemark.operators import repair as R
from tidemark.sources import frames as fr

from .explain import LOOKBACK

#: Sessions ahead that are looked at: bars are monthly here.
HORIZONS = (3, 6)


def _stored(spark, d):
    """Monthly bars as they may lie in a store: adjusted by security in one of three ways, with
    duplicates, broken bars, and flags of an earlier run; splits each third July."""
    m, k = F.month("session_date"), F.pmod("security_id", F.lit(3))
    b = fr.month_bars(spark, d).withColumns({
        "split_factor": F.when((m == 7) & (F.year("session_date") % 3 == 0), 2.0).otherwise(1.0),
        "dividend": F.when(m == 3, F.col("close") * 0.01).otherwise(0.0),
    })
    x = R.conventions(b.withColumn("close_adjusted", F.col("close"))).drop("convention", "deviation", "verified")
    factor = F.when(k == 0, F.col("total_factor")).when(k == 1, F.col("split_only")).otherwise(F.col("total_factor") * (F.lit(1) + F.pmod("volume", F.lit(7)) / 10))
    x = x.withColumn("factor", F.round(factor, 10)).drop("total_factor", "split_only")
    x = x.withColumn("close_adjusted", F.round(F.col("close") * F.col("factor") * F.when(F.col("volume") % 29 == 0, 1.1).otherwise(1.0), 6))
    x = x.withColumns({
        "high": F.when(F.col("volume") % 97 == 0, F.col("low") - 1).otherwise(F.col("high")),
        "quarantined": F.when(F.col("volume") % 31 == 0, True).when(F.col("volume") % 2 == 0, False),
        "codes": F.when(F.col("volume") % 31 == 0, F.array(F.lit("OLD"))).otherwise(F.array().cast("array<string>")),
        "revision": F.lit(0),
    })
    copies = F.when(F.col("volume") % 41 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return x.withColumn("bar_id", F.explode(copies))


def _plan(spark, d):
    return R.plan(_stored(spark, d), HORIZONS)


def repair_plan(spark, d):
    """Every bar that a repair would change, and how."""
    out = _plan(spark, d).filter("changed")
    return out.select("security_id", "session_date", "bar_id", F.array_join("codes_now", ",").alias("codes"), "action", F.round("new_adjusted", 4).alias("new_adjusted"), F.round("new_factor", 7).alias("new_factor"))


def repair_manifest(spark, d):
    """Reports of a dry run, one for each security; empty ones where there are no bars."""
    out = R.manifest(_plan(spark, d))
    x = fr.securities(spark, d).select("security_id").join(out, "security_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.select("security_id", *[count(c) for c in ("bars", "repairs", "quarantined", "released")], "convention", "first_date", "last_date")


def repair_totals(spark, d):
    """The manifest's totals, as a revision after the last."""
    x = repair_manifest(spark, d)
    sums = [F.sum(c).alias(c) for c in ("bars", "repairs", "quarantined", "released")]
    return x.agg(F.lit(1).cast("long").alias("revision"), F.count(F.lit(1)).alias("securities"), *sums, F.count("first_date").alias("changed"))


def repair_targets(spark, d):
    """Windows to be computed again after a repair, one for each security."""
    return A.merged_ranges(R.affected(_plan(spark, d)), "security_id", LOOKBACK)


def repaired_twice(spark, d):
    """What a second repair still finds to change: readers see the state of the first."""
    once = R.applied(_plan(spark, d), 1)
    out = R.unquarantined(once).groupBy("security_id").agg(F.count(F.lit(1)).alias("readable"), F.round(F.sum("close_adjusted"), 3).alias("total"))
    held = R.quarantined_only(once).groupBy("security_id").agg(F.count(F.lit(1)).alias("held"))
    return out.join(held, "security_id", "left").select("security_id", "readable", "total", F.coalesce("held", F.lit(0)).alias("held"))


def adjustment_conventions(spark, d):
    """How each security's stored series was adjusted, as far as it can be told."""
    b = R.unquarantined(_stored(spark, d)).filter("bar_id = 'a' AND high >= low")
    return R.conventions(b).select("security_id", "convention", F.round("deviation", 6).alias("deviation"), "verified").distinct()


def duplicate_bars(spark, d):
    """Bars that lose to a later one of their session, as findings."""
    x = _plan(spark, d).filter(F.array_contains("codes_now", "DUPLICATE_BAR"))
    return x.select("security_id", "session_date", F.col("bar_id").alias("observed"), F.lit("b").alias("expected"))


def _factor(name: str, source: str, dividend: str) -> str:
    """SQL: back-adjustment factors of the bars in ``source``."""
    e = f"(1 / split_factor) * CASE WHEN prev > {dividend} THEN (prev - {dividend}) / prev ELSE 1.0 END"
    return f"""{name} AS (SELECT *, exp(coalesce(sum(ln(CASE WHEN prev IS NULL THEN 1.0 ELSE {e} END)) OVER (PARTITION BY security_id ORDER BY session_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS {name}_f
  FROM (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY session_date) AS prev FROM {source}))"""


_STORED = fr.BARS + f""",
b0 AS (SELECT *, CASE WHEN month(session_date) = 7 AND year(session_date) % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS split_factor, CASE WHEN month(session_date) = 3 THEN close * 0.01 ELSE 0.0 END::DOUBLE AS dividend FROM bars),
{_factor('t', 'b0', 'dividend')}, {_factor('s', '(SELECT * EXCLUDE (prev) FROM t)', '0.0')},
b1 AS (SELECT * EXCLUDE (prev, t_f, s_f), round(CASE security_id % 3 WHEN 0 THEN t_f WHEN 1 THEN s_f ELSE t_f * (1 + (volume % 7) / 10.0) END, 10) AS factor FROM s),
st AS (SELECT security_id, session_date, open, CASE WHEN volume % 97 = 0 THEN low - 1 ELSE high END AS high, low, close, volume, split_factor, dividend, factor,
  round(close * factor * CASE WHEN volume % 29 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS close_adjusted, volume % 31 = 0 AS quarantined, CASE WHEN volume % 31 = 0 THEN ['OLD'] ELSE [] END AS codes,
  unnest(CASE WHEN volume % 41 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS bar_id FROM b1)"""


def _convention(source: str) -> str:
    """SQL: cv holds the convention of each security of ``source``."""
    return f"""{_factor('ct', source, 'dividend')}, {_factor('cs', '(SELECT * EXCLUDE (prev) FROM ct)', '0.0')},
cd AS (SELECT security_id, median(abs(close_adjusted - close * ct_f) / abs(close * ct_f)) AS td, median(abs(close_adjusted - close * cs_f) / abs(close * cs_f)) AS sd FROM cs GROUP BY 1),
cv AS (SELECT security_id, CASE WHEN sd < td AND sd <= 0.01 THEN 'SPLIT_ONLY' ELSE 'TOTAL_RETURN' END AS convention, CASE WHEN sd < td AND sd <= 0.01 THEN sd ELSE td END AS deviation FROM cd)"""


_FWD = "\nUNION ALL ".join(
    f"""SELECT security_id, culprit, 'FORWARD_RETURN_ANOMALY' FROM (
  SELECT security_id, lead(close_adjusted, {h}) OVER w / close_adjusted - 1 AS fwd, max(step) OVER n AS worst, arg_max(session_date, struct_pack(a := step, b := -epoch(session_date))) OVER n AS culprit FROM stp
  WINDOW w AS (PARTITION BY security_id ORDER BY session_date), n AS (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING))
  WHERE abs(fwd) > 10 AND worst > 0.45"""
    for h in HORIZONS
)
_PLAN = f"""{_STORED},
kp AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY security_id, session_date ORDER BY bar_id DESC) = 1),
so AS (SELECT * FROM kp WHERE high >= low AND high >= greatest(open, close) AND low <= least(open, close)),
stp AS (SELECT *, abs(close_adjusted / lag(close_adjusted) OVER (PARTITION BY security_id ORDER BY session_date) - 1) AS step FROM so),
mv AS (SELECT *, abs((close * split_factor + dividend) / lag(close) OVER (PARTITION BY security_id ORDER BY session_date) - 1) AS move FROM so),
{_convention('so')},
fd AS (SELECT security_id, session_date, 'IMPOSSIBLE_OHLC' AS code FROM kp ANTI JOIN so USING (security_id, session_date)
UNION ALL SELECT security_id, session_date, CASE WHEN split_factor <> 1 AND move > 0.45 THEN 'SPLIT_FACTOR_DISCONTINUITY' ELSE 'IMPLAUSIBLE_JUMP' END FROM mv WHERE split_factor <> 1 AND move > 0.45 OR move > 5
UNION ALL {_FWD}),
fc AS (SELECT security_id, session_date, list_sort(list_distinct(list(code))) AS found FROM fd GROUP BY 1, 2),
cf AS (SELECT security_id, session_date, convention, CASE WHEN deviation <= 0.01 THEN CASE convention WHEN 'SPLIT_ONLY' THEN cs_f ELSE ct_f END END AS f FROM cs JOIN cv USING (security_id)),
j AS (SELECT st.*, convention, CASE WHEN kp.bar_id = st.bar_id THEN f END AS f, CASE WHEN kp.bar_id <> st.bar_id THEN ['DUPLICATE_BAR'] ELSE coalesce(found, []) END AS now
  FROM st JOIN (SELECT security_id, session_date, bar_id FROM kp) kp USING (security_id, session_date) LEFT JOIN fc USING (security_id, session_date) LEFT JOIN cf USING (security_id, session_date)),
pl AS (SELECT *, CASE WHEN len(now) > 0 AND (NOT quarantined OR codes <> now) THEN 'quarantine' WHEN len(now) = 0 AND quarantined THEN 'release' END AS action,
  CASE WHEN abs(close_adjusted - round(close * f, 6)) / round(close * f, 6) > 0.002 THEN round(close * f, 6) END AS new_adjusted,
  CASE WHEN abs(factor - round(f, 10)) / round(f, 10) > 0.002 THEN round(f, 10) END AS new_factor FROM j),
ch AS (SELECT *, action IS NOT NULL OR new_adjusted IS NOT NULL OR new_factor IS NOT NULL AS changed FROM pl)"""
_MANIFEST = f"""{_PLAN},
mf AS (SELECT s_suppkey AS security_id, count(bar_id) AS bars, coalesce(CAST(sum((new_adjusted IS NOT NULL)::INT + (new_factor IS NOT NULL)::INT) AS BIGINT), 0) AS repairs,
  count(*) FILTER (action = 'quarantine') AS quarantined, count(*) FILTER (action = 'release') AS released, max(convention) AS convention, min(session_date) FILTER (changed) AS first_date, max(session_date) FILTER (changed) AS last_date
  FROM supplier LEFT JOIN ch ON security_id = s_suppkey GROUP BY 1)"""

QUERIES = {
    "repair_plan": (repair_plan, f"WITH {_PLAN} SELECT security_id, session_date, bar_id, array_to_string(now, ',') AS codes, action, round(new_adjusted, 4) AS new_adjusted, round(new_factor, 7) AS new_factor FROM ch WHERE changed"),
    "repair_manifest": (repair_manifest, f"WITH {_MANIFEST} SELECT * FROM mf"),
    "repair_totals": (repair_totals, f"WITH {_MANIFEST} SELECT CAST(1 AS BIGINT) AS revision, count(*) AS securities, CAST(sum(bars) AS BIGINT) AS bars, CAST(sum(repairs) AS BIGINT) AS repairs, CAST(sum(quarantined) AS BIGINT) AS quarantined, CAST(sum(released) AS BIGINT) AS released, count(first_date) AS changed FROM mf"),
    "repair_targets": (repair_targets, f"""WITH {_PLAN}, r AS (SELECT security_id, session_date, unnest([CASE WHEN new_adjusted IS NOT NULL OR new_factor IS NOT NULL THEN 'adjusted_repair' END, action]) AS reason FROM ch)
SELECT security_id, min(session_date) - {LOOKBACK} AS start, max(session_date) AS end, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r WHERE reason IS NOT NULL GROUP BY 1"""),
    "repaired_twice": (repaired_twice, f"""WITH {_PLAN}, a AS (SELECT security_id, coalesce(new_adjusted, close_adjusted) AS c, CASE action WHEN 'quarantine' THEN true WHEN 'release' THEN false ELSE quarantined END AS q FROM ch)
SELECT security_id, count(*) FILTER (NOT q) AS readable, round(sum(c) FILTER (NOT q), 3) AS total, count(*) FILTER (q) AS held FROM a GROUP BY 1 HAVING count(*) FILTER (NOT q) > 0"""),
    "adjustment_conventions": (adjustment_conventions, f"WITH {_STORED}, u AS (SELECT * FROM st WHERE NOT quarantined AND bar_id = 'a' AND high >= low), {_convention('u')} SELECT security_id, convention, round(deviation, 6) AS deviation, deviation <= 0.01 AS verified FROM cv"),
    "duplicate_bars": (duplicate_bars, f"WITH {_STORED} SELECT security_id, session_date, 'a' AS observed, 'b' AS expected FROM st WHERE bar_id = 'a' AND volume % 41 = 0"),
}
