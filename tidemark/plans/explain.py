"""Queries that explain scores and check outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import attribution as A
from tidemark.operators import sessions as N
from tidemark.operators import texts as X
from tidemark.operators import xsec
from tidemark.sources import frames as fr

from .groups import _z
from .scoring import _W, _Z, SCORE_SQL, score_universe
from .series import _RET

#: Calendar days that hold 126 sessions, and a week more.
LOOKBACK = -(-126 * 7 // 5) + 7


def _month(spark, d, day):
    """Two signals of each security in a month: its price level and its volume."""
    b = fr.month_bars(spark, d).filter(F.col("session_date") == F.lit(day).cast("date"))
    x = b.select("security_id", F.ln("close").alias("level"), F.ln(F.col("volume") + 1).alias("flow"))
    return x.unpivot("security_id", ["level", "flow"], "leg", "x")


def leg_changes(spark, d):
    """Own and distribution parts of each signal's change between two months."""
    out = A.decompose(_month(spark, d, "2001-09-01"), _month(spark, d, "2001-10-01"), ["leg"], "security_id")
    return out.select("security_id", "leg", *[F.round(c, 7).alias(c) for c in ("delta", "own", "distribution")], "reason")


def _outcomes(spark, d):
    """Suggestions at each session: buys of what fell, sales of what rose; and their cohort's median."""
    x = N.with_returns(fr.month_bars(spark, d), (3,)).join(fr.securities(spark, d).select("security_id", "cohort", "parent"), "security_id")
    x = x.withColumn("fwd", F.round("fwd_3", 10)).filter("fwd IS NOT NULL")
    med = x.groupBy("session_date", "parent").agg(F.median("fwd").alias("peer"))
    x = x.join(med, ["session_date", "parent"])
    return x.withColumn("action", F.when(F.col("back_3") < -0.3, "BUY").when(F.col("back_3") > 0.5, "SELL")).filter("action IS NOT NULL")


def suggestion_hit_rate(spark, d):
    out = A.hit_rates(_outcomes(spark, d), ["action"], "fwd", "peer", F.when(F.col("action") == "SELL", -1.0).otherwise(1.0))
    return out.select("action", "n", F.round("hit_rate", 8).alias("hit_rate"))


def cohort_dispersion(spark, d):
    x = N.with_returns(fr.month_bars(spark, d), (1,)).filter("ret IS NOT NULL")
    x = x.join(fr.securities(spark, d).select("security_id", "cohort"), "security_id")
    return x.groupBy("cohort", "session_date").agg(F.count("ret").alias("n"), F.round(F.stddev_pop("ret"), 7).alias("dispersion"))


def score_explanations(spark, d):
    """Effect of every leg on a score."""
    x = xsec.weighted(_z(spark, d)).withColumn("contribution", F.round(F.coalesce(F.col("weight") * S.winsorise(F.col("z")), F.lit(0.0)), 7))
    return x.select("security_id", "leg", "contribution", A.effect(F.col("contribution"), F.col("z").isNotNull(), F.col("weight").isNotNull()).alias("effect"))


def selected_explanations(spark, d):
    x = xsec.weighted(_z(spark, d)).filter("weight IS NOT NULL AND z IS NOT NULL")
    x = x.withColumn("contribution", F.round(F.col("weight") * S.winsorise(F.col("z")), 7))
    return A.strongest(x.select("security_id", "leg", "contribution"), "security_id")


def score_reasoning(spark, d):
    x = score_universe(spark, d)
    text = F.concat(F.lit("Ranked "), F.coalesce(F.col("percentile").cast("string"), F.lit("-")), F.lit(" of 100: "), A.position(F.col("percentile")), F.lit(" within its "), F.col("scope"))
    return x.select("security_id", text.alias("reasoning"))


def recompute_windows(spark, d):
    """Windows to be computed again after large moves, one for each security."""
    x = N.with_returns(fr.month_bars(spark, d), (1,)).filter(F.abs("ret") > 5)
    x = x.select("security_id", F.col("session_date").alias("start"), F.add_months("session_date", 1).alias("end"), F.when(F.col("ret") > 0, "rise").otherwise("fall").alias("reason"))
    return A.merged_ranges(x, "security_id", LOOKBACK)


def replay_coverage(spark, d):
    """Expected sessions, and how many securities each has; under 85 is too few."""
    b = fr.month_bars(spark, d)
    months = F.sequence(F.lit("1994-10-01").cast("date"), F.lit("2002-02-01").cast("date"), F.expr("interval 1 month"))
    cal = spark.range(1).select(F.explode(months).alias("session_date"))
    n = b.groupBy("session_date").agg(F.count_distinct("security_id").alias("n"))
    out = cal.join(n, "session_date", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("session_date", "n", (F.col("n") >= 85).alias("enough"))


def incomplete_securities(spark, d):
    """Securities with fewer bars than sessions, and their first one."""
    b = fr.month_bars(spark, d)
    total = b.select("session_date").distinct().agg(F.count(F.lit(1)).alias("total"))
    g = b.groupBy("security_id").agg(F.count(F.lit(1)).alias("n"), F.min("session_date").alias("first_date"))
    out = fr.securities(spark, d).select("security_id").join(g, "security_id", "left").crossJoin(F.broadcast(total))
    return out.filter(F.coalesce("n", F.lit(0)) < F.col("total")).select("security_id", F.coalesce("n", F.lit(0)).alias("n"), "first_date")


def value_changes(spark, d):
    """Change of each user's daily total against the last earlier day."""
    e = fr.read(spark, d, "events", "ts", "user_id", "value").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("day")
    return e.select("user_id", "day", F.round(F.col("v") - F.lag("v").over(w), 6).alias("change"), F.datediff("day", F.lag("day").over(w)).alias("days"))


def relevant_titles(spark, d):
    """First lines of documents that name a word, or a ticker after its exchange."""
    x = fr.read(spark, d, "documents", "doc_id", "text").withColumn("title", F.substring_index("text", "\n", 1))
    return x.filter(X.relevant(F.col("title"), "ther in", "Onthe", False)).select("doc_id")


def profile_check(spark, d):
    """Customers whose kinds of orders do not fit the profile that they are given."""
    o = fr.read(spark, d, "orders", "o_custkey", "o_orderpriority")
    g = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("forms"))
    domestic = F.arrays_overlap("forms", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))
    foreign = F.arrays_overlap("forms", F.array(F.lit("5-LOW")))
    got = F.when(foreign & ~domestic, "FPI").otherwise("DOMESTIC")
    c = fr.read(spark, d, "customer", "c_custkey", "c_mktsegment").join(g, F.col("c_custkey") == F.col("o_custkey"))
    given = F.when(F.col("c_mktsegment") == "BUILDING", "FPI").otherwise("DOMESTIC")
    return c.filter(got != given).select("c_custkey", got.alias("found"), given.alias("given"))


_CON = f"{_Z}, w AS (SELECT *, {_W} AS w FROM z), k AS (SELECT security_id, leg, w, z, round(CASE WHEN w IS NULL OR z IS NULL THEN 0 ELSE w * greatest(-2.5, least(2.5, z)) END, 7) AS c FROM w)"
QUERIES = {
    "leg_changes": (leg_changes, f"""WITH {fr.BARS}, l AS (SELECT security_id, session_date, unnest(['level', 'flow']) AS leg, unnest([ln(close), ln(volume + 1)]) AS x FROM bars),
a AS (SELECT security_id, leg, x AS x0, avg(x) OVER (PARTITION BY leg) AS m0, stddev_pop(x) OVER (PARTITION BY leg) AS s0 FROM l WHERE session_date = DATE '2001-09-01'),
b AS (SELECT security_id, leg, x AS x1 FROM l WHERE session_date = DATE '2001-10-01'), s AS (SELECT leg, avg(x1) AS m1, stddev_pop(x1) AS s1 FROM b GROUP BY 1),
j AS (SELECT * FROM a FULL JOIN b USING (security_id, leg) LEFT JOIN s USING (leg))
SELECT security_id, leg, CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN round((x1 - m1) / s1 - (x0 - m0) / s0, 7) END AS delta, CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN round((x1 - x0) / s1, 7) END AS own,
  CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN round((x0 - m1) / s1 - (x0 - m0) / s0, 7) END AS distribution, CASE WHEN x1 IS NULL THEN 'no_current' WHEN x0 IS NULL THEN 'no_prior' END AS reason FROM j"""),
    "suggestion_hit_rate": (suggestion_hit_rate, f"""WITH {fr.SECURITIES}, {_RET}, x AS (SELECT r.*, parent, round(fwd_3, 10) AS fwd FROM r JOIN sec USING (security_id) WHERE fwd_3 IS NOT NULL),
m AS (SELECT *, median(fwd) OVER (PARTITION BY session_date, parent) AS peer, CASE WHEN back_3 < -0.3 THEN 'BUY' WHEN back_3 > 0.5 THEN 'SELL' END AS action FROM x)
SELECT action, count(*) AS n, round(avg(CASE WHEN action = 'SELL' AND fwd < peer OR action = 'BUY' AND fwd > peer THEN 1.0 ELSE 0.0 END), 8) AS hit_rate FROM m WHERE action IS NOT NULL GROUP BY 1"""),
    "cohort_dispersion": (cohort_dispersion, f"WITH {fr.SECURITIES}, {_RET} SELECT cohort, session_date, count(ret) AS n, round(stddev_pop(ret), 7) AS dispersion FROM r JOIN sec USING (security_id) WHERE ret IS NOT NULL GROUP BY 1, 2"),
    "score_explanations": (score_explanations, f"WITH {_CON} SELECT security_id, leg, c AS contribution, CASE WHEN w IS NULL THEN 'not_applicable' WHEN z IS NULL THEN 'unavailable' WHEN c > 0 THEN 'supports' WHEN c < 0 THEN 'weighs' ELSE 'neutral' END AS effect FROM k"),
    "selected_explanations": (selected_explanations, f"""WITH {_CON}, o AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY c DESC, leg) AS u, row_number() OVER (PARTITION BY security_id ORDER BY c, leg) AS d FROM k WHERE w IS NOT NULL AND z IS NOT NULL)
SELECT security_id, string_agg(leg, ', ' ORDER BY u) FILTER (c > 0 AND u <= 2) AS supports, string_agg(leg, ', ' ORDER BY d) FILTER (c < 0 AND d <= 2) AS weighs FROM o GROUP BY 1"""),
    "score_reasoning": (score_reasoning, f"""WITH s AS ({SCORE_SQL}) SELECT security_id, 'Ranked ' || coalesce(CAST(percentile AS VARCHAR), '-') || ' of 100: ' || CASE WHEN percentile >= 75 THEN 'leading' WHEN percentile >= 60 THEN 'above average' WHEN percentile >= 40 THEN 'average'
  WHEN percentile >= 25 THEN 'below average' WHEN percentile IS NOT NULL THEN 'trailing' ELSE 'not ranked' END || ' within its ' || scope AS reasoning FROM s"""),
    "recompute_windows": (recompute_windows, f"""WITH {_RET}, x AS (SELECT security_id, session_date, CASE WHEN ret > 0 THEN 'rise' ELSE 'fall' END AS reason FROM r WHERE abs(ret) > 5)
SELECT security_id, min(session_date) - {LOOKBACK} AS start, CAST(max(session_date) + INTERVAL 1 MONTH AS DATE) AS end, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM x GROUP BY 1"""),
    "replay_coverage": (replay_coverage, f"""WITH {fr.BARS}, c AS (SELECT CAST(unnest(range(DATE '1994-10-01', DATE '2002-02-02', INTERVAL 1 MONTH)) AS DATE) AS session_date)
SELECT session_date, count(DISTINCT security_id) AS n, count(DISTINCT security_id) >= 85 AS enough FROM c LEFT JOIN bars USING (session_date) GROUP BY 1"""),
    "incomplete_securities": (incomplete_securities, f"""WITH {fr.BARS}, g AS (SELECT security_id, count(*) AS n, min(session_date) AS first_date FROM bars GROUP BY 1)
SELECT s_suppkey AS security_id, coalesce(n, 0) AS n, first_date FROM supplier LEFT JOIN g ON security_id = s_suppkey WHERE coalesce(n, 0) < (SELECT count(DISTINCT session_date) FROM bars)"""),
    "value_changes": (value_changes, """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, day, round(v - lag(v) OVER w, 6) AS change, day - lag(day) OVER w AS days FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day)"""),
    "relevant_titles": (relevant_titles, f"""SELECT doc_id FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents) WHERE regexp_matches(t, '\\bOnthe\\b') OR contains(lower(trim(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ' ', 'g'))), 'ther in')"""),
    "profile_check": (profile_check, """WITH g AS (SELECT o_custkey, bool_or(o_orderpriority = '5-LOW') AND NOT bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS fpi FROM orders GROUP BY 1),
x AS (SELECT c_custkey, CASE WHEN fpi THEN 'FPI' ELSE 'DOMESTIC' END AS found, CASE WHEN c_mktsegment = 'BUILDING' THEN 'FPI' ELSE 'DOMESTIC' END AS given FROM customer JOIN g ON c_custkey = o_custkey) SELECT * FROM x WHERE found <> given"""),
}
