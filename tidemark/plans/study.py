"""Queries that study signals: by leg, against benchmarks, between variants, replayed by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import attribution as A
from tidemark.operators import perf as P
from tidemark.operators import sessions as N
from tidemark.operators import study as D
from tidemark.operators import xsec
from tidemark.sources import frames as fr

from . import scoring
from .explain import _outcomes
from .series import _LONG, _RET, _ics, _long, _p_sql, _spear_sql

SIGNALS = {"level": "ln(close)", "flow": "ln(volume + 1)", "reversal": "-back_3"}
VARIANTS = {"champion": (1.0, 0.0, 0.0), "even": (1.0, 1.0, 1.0), "turned": (0.0, 0.0, -1.0)}
HORIZONS = (1, 3)
COST = 0.001


def _signals(spark, d):
    """Signals of each security and date, with its forward returns."""
    x = N.with_returns(fr.month_bars(spark, d), (1, 3))
    x = x.select("security_id", "session_date", F.round("fwd_1", 10).alias("fwd_1"), F.round("fwd_3", 10).alias("fwd_3"), *[F.round(F.expr(e), 10).alias(k) for k, e in SIGNALS.items()])
    return x.unpivot(["security_id", "session_date", "fwd_1", "fwd_3"], list(SIGNALS), "leg", "x")


def leg_ic(spark, d):
    out = D.matched_ic(_signals(spark, d), "x", "fwd_1", ["leg", "session_date"])
    return out.select("leg", "session_date", "population", "candidates", F.round("coverage", 8).alias("coverage"), F.round("ic", 8).alias("ic"))


def leg_ic_means(spark, d):
    """Mean rank correlation of each leg over the dates, with its populations."""
    x = D.matched_ic(_signals(spark, d), "x", "fwd_1", ["leg", "session_date"])
    return x.groupBy("leg").agg(F.count("ic").alias("dates"), F.round(F.avg("ic"), 7).alias("ic"), F.sum("population").alias("population"), F.sum("candidates").alias("candidates"))


def leg_pair_means(spark, d):
    """Mean over the dates of the correlations between legs at each date."""
    x = _signals(spark, d).filter("x IS NOT NULL").select("security_id", "session_date", "leg", "x")
    wide = x.groupBy("security_id", "session_date").pivot("leg", list(SIGNALS)).agg(F.first("x"))
    names = sorted(SIGNALS)
    pairs = [F.struct(F.lit(a).alias("leg_a"), F.lit(b).alias("leg_b"), F.col(a).alias("xa"), F.col(b).alias("xb")) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = wide.select("session_date", F.inline(F.array(*pairs)))
    r = P.pearson(both, "xa", "xb", ["leg_a", "leg_b", "session_date"], "r").filter("r IS NOT NULL")
    return r.groupBy("leg_a", "leg_b").agg(F.count("r").alias("dates"), F.round(F.avg("r"), 6).alias("r"), F.sum("population").alias("population"))


def benchmark_by_date(spark, d):
    """The market's mean return and the rank correlation of plain momentum, by date."""
    x = N.with_returns(fr.month_bars(spark, d), (1, 3)).withColumn("f", F.round("fwd_1", 10)).withColumn("b", F.round("back_3", 10))
    mean = x.groupBy("session_date").agg(F.avg("f").alias("equal_weight"))
    ic = P.spearman(x, "b", "f", ["session_date"], "momentum_ic")
    return mean.join(ic, "session_date", "left").select("session_date", "population", F.round("equal_weight", 8).alias("equal_weight"), F.round("momentum_ic", 8).alias("momentum_ic"))


def paired_comparison(spark, d):
    """The level signal against the market-flow signal, by date."""
    x = D.matched_ic(_signals(spark, d), "x", "fwd_1", ["leg", "session_date"])
    x = x.groupBy("session_date").agg(F.max(F.when(F.col("leg") == "level", F.col("ic"))).alias("a"), F.max(F.when(F.col("leg") == "flow", F.col("ic"))).alias("b"))
    out = D.paired(x.withColumn("name", F.lit("level-flow")), "a", "b", ["name"])
    return out.select("name", "n", *[F.round(c, 8).alias(c) for c in ("mean_difference", "std", "wins")])


def trimmed_returns(spark, d):
    x = N.with_returns(fr.month_bars(spark, d), (1,)).withColumn("f", F.round("fwd_1", 10))
    return D.trimmed_mean(x, "f", ["session_date"], 2.0).select("session_date", F.round("trimmed", 8).alias("trimmed"), F.col("dropped").cast("long"))


def net_spread(spark, d):
    """Spread of each date after the cost of its turnover; null where either is missing."""
    s = P.turnover(P.spread(_long(spark, d), "score", "fwd", ["horizon", "session_date"], "security_id"), "top_ids", ["horizon"], "session_date")
    return s.select("horizon", "session_date", F.round(D.net_of_costs(F.col("spread"), F.col("turnover"), COST), 8).alias("net"))


def ic_autocorrelation(spark, d):
    out = D.autocorrelations(_ics(spark, d), "ic", ["horizon"], "session_date", 3)
    inflation = D.overlap_inflation(F.col("horizon"), F.col("n")).cast("long")
    return out.select("horizon", "n", inflation.alias("inflation"), *[F.round(c, 7).alias(c) for c in ("rho_1", "rho_2", "rho_3", "effective")])


def disposition_hit_rate(spark, d):
    """Hit rates of suggestions that were followed and of those that were not."""
    x = _outcomes(spark, d).withColumn("accepted", F.pmod("security_id", F.lit(2)) == 0)
    out = A.hit_rates(x, ["accepted"], "fwd", "peer", F.when(F.col("action") == "SELL", -1.0).otherwise(1.0))
    return out.select("accepted", "n", F.round("hit_rate", 8).alias("hit_rate"))


def _variant_ics(spark, d):
    """Rank correlations of each variant's scores, on the securities that all variants score."""
    x = _signals(spark, d)
    g = x.groupBy("leg", "session_date").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = x.join(g, ["leg", "session_date"]).withColumn("z", S.zscore(F.col("x"), F.col("m"), F.col("s")))
    weights = F.create_map(*[y for leg, w in zip(SIGNALS, zip(*VARIANTS.values(), strict=True), strict=True) for y in (F.lit(leg), F.array(*map(F.lit, w)))])
    z = z.withColumn("w", F.element_at(weights, F.col("leg")))
    sums = [F.sum(F.col("w")[i] * F.col("z")).alias(v) for i, v in enumerate(VARIANTS)]
    s = z.groupBy("security_id", "session_date").agg(F.count("z").alias("k"), F.max("fwd_1").alias("1"), F.max("fwd_3").alias("3"), *sums).filter(F.col("k") == len(SIGNALS))
    s = s.unpivot(["security_id", "session_date", "1", "3"], list(VARIANTS), "variant", "score").withColumn("score", F.round("score", 8))
    s = s.unpivot(["security_id", "session_date", "variant", "score"], ["1", "3"], "horizon", "fwd").withColumn("horizon", F.col("horizon").cast("int"))
    return P.spearman(s, "score", "fwd", ["variant", "horizon", "session_date"])


def _comparisons(spark, d):
    return D.against(_variant_ics(spark, d), "champion", S.Z_BY_CONFIDENCE[0.95], HORIZONS).withColumn("verdict", D.verdict(3, 10))


def promotion_verdicts(spark, d):
    out = _comparisons(spark, d)
    return out.select("variant", "horizon", "n", *[F.round(c, 7).alias(c) for c in ("mean_difference", "se", "low", "high", "p", "q")], "excludes_zero", "significant", "verdict")


def shadow_metrics(spark, d):
    """The report of the study as metric rows."""
    x = _comparisons(spark, d).withColumn("dates", F.col("n").cast("double"))
    x = x.unpivot(["variant", "horizon"], ["mean_difference", "low", "high", "dates"], "metric_type", "value")
    return x.select(F.concat(F.lit("shadow_"), "metric_type").alias("metric_type"), F.concat_ws(":", "variant", "horizon").alias("scope"), F.round("value", 7).alias("value"))


def metric_rows(spark, d):
    """Families of metrics in one table, each row with its detail."""
    ic = _ics(spark, d).groupBy("horizon").agg(F.count("ic").alias("n"), F.avg("ic").alias("value"), F.max("session_date").alias("as_of"))
    s = P.spread(_long(spark, d), "score", "fwd", ["horizon", "session_date"], "security_id")
    s = s.groupBy("horizon").agg(F.count("spread").alias("n"), F.avg("spread").alias("value"), F.max("session_date").alias("as_of"))
    out = None
    for name, x in (("composite_ic", ic), ("top_bottom_spread", s)):
        row = x.select(
            F.lit(name).alias("metric_type"), F.concat_ws("", F.lit("h"), "horizon").alias("scope"), "as_of", F.round("value", 7).alias("value"),
            D.detail(dates=F.col("n"), positive=F.col("value") > 0, value=D.plain_decimal(F.round("value", 6))).alias("detail"),
        )
        out = row if out is None else out.unionByName(row)
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("detail")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("detail", joined)


def latest_metrics(spark, d):
    """The last measured value of each horizon."""
    x = _ics(spark, d).filter("ic IS NOT NULL").select("horizon", "session_date", "population", F.round("ic", 8).alias("ic"))
    return D.latest(x, ["horizon"], "session_date")


def newest_metrics(spark, d):
    """The fifty newest metric rows."""
    x = _ics(spark, d).filter("ic IS NOT NULL").select("horizon", "session_date", F.round("ic", 8).alias("ic"))
    return x.orderBy(F.desc("session_date"), "horizon").limit(50)


#: Dates that a replay has still to score; those done before are left out.
REPLAY = ("2000-01-01", "2001-06-30")
DONE = ("2000-03-01", "2000-04-01")


def scoring_replay(spark, d):
    """Every session of a span scored as of its own day: one job instead of a loop over days."""
    x = N.with_returns(fr.month_bars(spark, d), (3,))
    x = x.filter(f"session_date BETWEEN DATE '{REPLAY[0]}' AND DATE '{REPLAY[1]}'").filter(~F.col("session_date").isin(*[F.lit(x).cast("date") for x in DONE]))
    legs = x.select(
        "security_id", "session_date", F.ln("close").alias("thesis_linkage"), F.ln(F.col("volume") + 1).alias("attention"), F.round(F.col("high") / F.col("low"), 10).alias("narrative"),
        F.round("back_3", 10).alias("health"), (F.col("close") / F.col("open")).alias("smart_money"), (-F.ln("open")).alias("valuation"),
    ).unpivot(["security_id", "session_date"], list(fr.LEGS), "leg", "x")
    sized = xsec.scopes(fr.securities(spark, d).select("security_id", "cohort", "parent", "profile"))
    z = xsec.blended_zscores(legs.join(sized, "security_id"), keys=("leg", "session_date"))
    scored = xsec.composite(xsec.weighted(z), ("security_id", "cohort", "parent", "session_date"))
    out = xsec.blended_percentiles(scored.withColumn("composite", F.round("composite", 8)), "composite", ("session_date",))
    return out.select("session_date", "security_id", F.round("composite", 6).alias("composite"), F.round("coverage", 6).alias("coverage"), "percentile")


def sessions_scored(spark, d):
    """Whether enough sessions have enough securities for a replay to count as complete."""
    n = fr.month_bars(spark, d).groupBy("session_date").agg(F.count(F.lit(1)).alias("n"))
    g = n.agg(F.count(F.lit(1)).alias("sessions"), F.sum((F.col("n") >= 85).cast("long")).alias("full"))
    return g.select("sessions", F.coalesce("full", F.lit(0)).alias("full"), (F.coalesce("full", F.lit(0)) >= 370).alias("valid"))


_SIG = _RET + """,
sg AS (SELECT security_id, session_date, round(fwd_1, 10) AS fwd_1, round(fwd_3, 10) AS fwd_3, unnest(['level', 'flow', 'reversal']) AS leg, unnest([round(ln(close), 10), round(ln(volume + 1), 10), round(-back_3, 10)]) AS x FROM r),
sgo AS (SELECT * FROM sg WHERE x IS NOT NULL AND fwd_1 IS NOT NULL)"""
_LEG = f"""{_SIG}, cand AS (SELECT leg, session_date, count(*) AS candidates FROM sg WHERE x IS NOT NULL GROUP BY 1, 2), {_spear_sql('li', 'x', 'fwd_1', 'sgo', 'leg, session_date')},
lic AS (SELECT leg, session_date, coalesce(n, 0) AS population, candidates, coalesce(n, 0) / candidates AS coverage, v AS ic FROM cand LEFT JOIN li USING (leg, session_date))"""
_VAR = f"""{_SIG}, zz AS (SELECT *, CASE WHEN stddev_pop(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w END AS z FROM sg WINDOW w AS (PARTITION BY leg, session_date)),
sc AS (SELECT security_id, session_date, max(fwd_1) AS f1, max(fwd_3) AS f3, """ + ", ".join(
    "round(sum(CASE leg " + " ".join(f"WHEN '{leg}' THEN {w}" for leg, w in zip(SIGNALS, ws, strict=True)) + f" END * z), 8) AS {v}" for v, ws in VARIANTS.items()
) + f""" FROM zz GROUP BY 1, 2 HAVING count(z) = {len(SIGNALS)}),
u1 AS (SELECT security_id, session_date, f1, f3, unnest([{', '.join(repr(v) for v in VARIANTS)}]) AS variant, unnest([{', '.join(VARIANTS)}]) AS score FROM sc),
u2 AS (SELECT * FROM (SELECT security_id, session_date, variant, score, unnest([1, 3]) AS horizon, unnest([f1, f3]) AS fwd FROM u1) WHERE score IS NOT NULL AND fwd IS NOT NULL),
{_spear_sql('vi', 'score', 'fwd', 'u2', 'variant, horizon, session_date')},
df AS (SELECT a.variant, a.horizon, a.session_date, a.v - b.v AS d FROM vi a JOIN vi b ON a.horizon = b.horizon AND a.session_date = b.session_date AND b.variant = 'champion' AND a.variant <> 'champion' WHERE a.v - b.v IS NOT NULL),
dm AS (SELECT variant, horizon, d, d - avg(d) OVER (PARTITION BY variant, horizon) AS e, row_number() OVER (PARTITION BY variant, horizon ORDER BY session_date) AS i FROM df),
lg AS (SELECT a.variant, a.horizon, sum(a.e * b.e) FILTER (a.i = b.i) AS g0, coalesce(sum(a.e * b.e) FILTER (a.i = b.i + 1), 0) AS g1, coalesce(sum(a.e * b.e) FILTER (a.i = b.i + 2), 0) AS g2 FROM dm a JOIN dm b ON a.variant = b.variant AND a.horizon = b.horizon AND a.i - b.i BETWEEN 0 AND 2 GROUP BY 1, 2),
mm AS (SELECT variant, horizon, count(*) AS n, avg(d) AS mean_difference FROM dm GROUP BY 1, 2),
se AS (SELECT mm.*, CASE WHEN n >= 2 AND v > 0 THEN sqrt(v / n) END AS se FROM (SELECT mm.*, g0 / n + CASE WHEN horizon = 3 THEN 2 * (2.0 / 3) * g1 / n + 2 * (1.0 / 3) * g2 / n ELSE 0 END AS v FROM mm JOIN lg USING (variant, horizon)) mm),
iv AS (SELECT *, mean_difference - {S.Z_BY_CONFIDENCE[0.95]} * se AS low, mean_difference + {S.Z_BY_CONFIDENCE[0.95]} * se AS high, round({_p_sql('(mean_difference / se)')}, 9) AS p FROM se),
rk2 AS (SELECT *, row_number() OVER (ORDER BY p, variant || ':' || horizon) AS rank, count(*) OVER () AS m FROM iv WHERE p IS NOT NULL),
bh AS (SELECT variant, horizon, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC)) AS q, rank <= coalesce((SELECT max(rank) FROM rk2 WHERE p <= rank / m * 0.05), 0) AS significant FROM rk2),
cmp AS (SELECT iv.*, q, significant, coalesce(low < high AND (low > 0 OR high < 0), false) AS excludes_zero FROM iv LEFT JOIN bh USING (variant, horizon)),
vd AS (SELECT *, CASE WHEN horizon <> 3 THEN 'not_primary' WHEN n / least(3, n) < 10 THEN 'insufficient_evidence' WHEN mean_difference <= 0 THEN 'no_improvement' WHEN NOT excludes_zero OR NOT coalesce(significant, false) THEN 'insufficient_evidence' ELSE 'promote' END AS verdict FROM cmp)"""
_SPREAD = f"""{_LONG}, sk AS (SELECT *, row_number() OVER (PARTITION BY horizon, session_date ORDER BY score, security_id) AS k, count(*) OVER (PARTITION BY horizon, session_date) AS n FROM ok),
sz AS (SELECT *, greatest(1, least(floor(n * 0.2 + 1e-9), floor(n / 2))) AS size FROM sk WHERE n >= 2),
sp AS (SELECT horizon, session_date, avg(fwd) FILTER (k > n - size) - avg(fwd) FILTER (k <= size) AS spread, list(security_id) FILTER (k > n - size) AS ids FROM sz GROUP BY 1, 2)"""
_DETAIL = "'dates=' || n || ',positive=' || (value > 0) || ',value=' || regexp_replace(regexp_replace(CAST(CAST(round(value, 6) AS DECIMAL(38, 10)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_REPLAY = scoring._COMP.replace(fr.RAW, fr.SECURITIES + f""", {fr.BARS}, rr AS (SELECT *, round(close / lag(close, 3) OVER (PARTITION BY security_id ORDER BY session_date) - 1, 10) AS back FROM bars),
long AS (SELECT * FROM (SELECT security_id, cohort, parent, profile, session_date, unnest([{', '.join(repr(x) for x in fr.LEGS)}]) AS leg, unnest([ln(close), ln(volume + 1), round(high / low, 10), back, close / open, -ln(open)]) AS x FROM rr JOIN sec USING (security_id)
  WHERE session_date BETWEEN DATE '{REPLAY[0]}' AND DATE '{REPLAY[1]}' AND session_date NOT IN ({', '.join(f"DATE '{x}'" for x in DONE)})))""")
_REPLAY = _REPLAY.replace("PARTITION BY leg", "PARTITION BY session_date, leg").replace("SELECT security_id, cohort, parent, profile, leg, x, scope", "SELECT session_date, security_id, cohort, parent, profile, leg, x, scope").replace("SELECT security_id, cohort, parent, scope, confidence, wc, wp, wu,", "SELECT session_date, security_id, cohort, parent, scope, confidence, wc, wp, wu,")

QUERIES = {
    "leg_ic": (leg_ic, f"WITH {_LEG} SELECT leg, session_date, population, candidates, round(coverage, 8) AS coverage, round(ic, 8) + 0.0 AS ic FROM lic"),
    "leg_ic_means": (leg_ic_means, f"WITH {_LEG} SELECT leg, count(ic) AS dates, round(avg(ic), 7) AS ic, CAST(sum(population) AS BIGINT) AS population, CAST(sum(candidates) AS BIGINT) AS candidates FROM lic GROUP BY 1"),
    "leg_pair_means": (leg_pair_means, f"""WITH {_SIG}, pr AS (SELECT a.leg AS leg_a, b.leg AS leg_b, session_date, count(*) AS population, CASE WHEN count(*) >= 2 AND var_pop(a.x) > 1e-12 AND var_pop(b.x) > 1e-12 THEN corr(a.x, b.x) END AS r
FROM sg a JOIN sg b USING (security_id, session_date) WHERE a.leg < b.leg AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2, 3)
SELECT leg_a, leg_b, count(r) AS dates, round(avg(r), 6) AS r, CAST(sum(population) AS BIGINT) AS population FROM pr WHERE r IS NOT NULL GROUP BY 1, 2"""),
    "benchmark_by_date": (benchmark_by_date, f"""WITH {_RET}, o AS (SELECT session_date, round(back_3, 10) AS b, round(fwd_1, 10) AS f FROM r), p AS (SELECT * FROM o WHERE b IS NOT NULL AND f IS NOT NULL), {_spear_sql('m', 'b', 'f', 'p', 'session_date')}
SELECT e.session_date, m.n AS population, round(e.w, 8) AS equal_weight, round(m.v, 8) + 0.0 AS momentum_ic FROM (SELECT session_date, avg(f) AS w FROM o GROUP BY 1) e LEFT JOIN m USING (session_date)"""),
    "paired_comparison": (paired_comparison, f"""WITH {_LEG}, x AS (SELECT session_date, max(ic) FILTER (leg = 'level') - max(ic) FILTER (leg = 'flow') AS d FROM lic GROUP BY 1)
SELECT 'level-flow' AS name, count(d) AS n, round(avg(d), 8) AS mean_difference, round(stddev_samp(d), 8) AS std, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 8) AS wins FROM x WHERE d IS NOT NULL"""),
    "trimmed_returns": (trimmed_returns, f"""WITH {_RET}, f AS (SELECT session_date, round(fwd_1, 10) AS f FROM r WHERE fwd_1 IS NOT NULL), g AS (SELECT *, avg(f) OVER w AS m, stddev_samp(f) OVER w AS s FROM f WINDOW w AS (PARTITION BY session_date)),
k AS (SELECT *, NOT coalesce(s > 0, false) OR abs(f - m) <= 2 * s AS near FROM g)
SELECT session_date, round(coalesce(avg(f) FILTER (near), max(m)), 8) AS trimmed, CASE WHEN count(*) FILTER (near) > 0 THEN count(*) FILTER (NOT near) ELSE 0 END AS dropped FROM k GROUP BY 1"""),
    "net_spread": (net_spread, f"""WITH {_SPREAD}, t AS (SELECT *, lag(ids) OVER (PARTITION BY horizon ORDER BY session_date) AS before FROM sp)
SELECT horizon, session_date, round(CASE WHEN before IS NOT NULL THEN spread - {COST} * len(list_filter(ids, lambda i: NOT list_contains(before, i))) / len(ids) END, 8) AS net FROM t"""),
    "ic_autocorrelation": (ic_autocorrelation, f"""WITH {_LONG}, s AS (SELECT horizon, ic - avg(ic) OVER (PARTITION BY horizon) AS e, row_number() OVER (PARTITION BY horizon ORDER BY session_date) AS i FROM ic WHERE ic IS NOT NULL),
g AS (SELECT a.horizon, count(*) FILTER (a.i = b.i) AS n, sum(a.e * b.e) FILTER (a.i = b.i) AS v, sum(a.e * b.e) FILTER (a.i = b.i + 1) AS g1, sum(a.e * b.e) FILTER (a.i = b.i + 2) AS g2, sum(a.e * b.e) FILTER (a.i = b.i + 3) AS g3 FROM s a JOIN s b ON a.horizon = b.horizon AND a.i - b.i BETWEEN 0 AND 3 GROUP BY 1),
h AS (SELECT horizon, n, g1 / v AS r1, g2 / v AS r2, g3 / v AS r3 FROM g)
SELECT horizon, n, CASE WHEN horizon > 1 THEN least(horizon, n) ELSE 1 END AS inflation, round(r1, 7) AS rho_1, round(r2, 7) AS rho_2, round(r3, 7) AS rho_3, round(n / greatest(1.0, 1 + 2 * (0.75 * r1 + 0.5 * r2 + 0.25 * r3)), 7) AS effective FROM h"""),
    "disposition_hit_rate": (disposition_hit_rate, f"""WITH {fr.SECURITIES}, {_RET}, x AS (SELECT r.*, parent, round(fwd_3, 10) AS fwd FROM r JOIN sec USING (security_id) WHERE fwd_3 IS NOT NULL),
m AS (SELECT *, median(fwd) OVER (PARTITION BY session_date, parent) AS peer, CASE WHEN back_3 < -0.3 THEN 'BUY' WHEN back_3 > 0.5 THEN 'SELL' END AS action FROM x)
SELECT security_id % 2 = 0 AS accepted, count(*) AS n, round(avg(CASE WHEN action = 'SELL' AND fwd < peer OR action = 'BUY' AND fwd > peer THEN 1.0 ELSE 0.0 END), 8) AS hit_rate FROM m WHERE action IS NOT NULL GROUP BY 1"""),
    "promotion_verdicts": (promotion_verdicts, f"WITH {_VAR} SELECT variant, horizon, n, round(mean_difference, 7) AS mean_difference, round(se, 7) AS se, round(low, 7) AS low, round(high, 7) AS high, round(p, 7) AS p, round(q, 7) AS q, excludes_zero, significant, verdict FROM vd"),
    "shadow_metrics": (shadow_metrics, f"WITH {_VAR} SELECT 'shadow_' || unnest(['mean_difference', 'low', 'high', 'dates']) AS metric_type, variant || ':' || horizon AS scope, round(unnest([mean_difference, low, high, n::DOUBLE]), 7) AS value FROM vd"),
    "metric_rows": (metric_rows, f"""WITH {_SPREAD}, f AS (SELECT 'composite_ic' AS metric_type, horizon, count(ic) AS n, avg(ic) AS value, max(session_date) AS as_of FROM ic GROUP BY 2 UNION ALL SELECT 'top_bottom_spread', horizon, count(spread), avg(spread), max(session_date) FROM sp GROUP BY 2)
SELECT metric_type, 'h' || horizon AS scope, as_of, round(value, 7) AS value, {_DETAIL} AS detail FROM f"""),
    "latest_metrics": (latest_metrics, f"WITH {_LONG} SELECT horizon, session_date, population, round(ic, 8) + 0.0 AS ic FROM ic WHERE ic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY session_date DESC) = 1"),
    "newest_metrics": (newest_metrics, f"WITH {_LONG} SELECT horizon, session_date, round(ic, 8) + 0.0 AS ic FROM ic WHERE ic IS NOT NULL ORDER BY session_date DESC, horizon LIMIT 50"),
    "scoring_replay": (scoring_replay, f"""WITH {_REPLAY}, cr AS (SELECT * REPLACE (round(composite, 8) AS composite) FROM comp),
f AS (SELECT *, {scoring._FRACTION.format(k='session_date, cohort,')} AS fc, {scoring._FRACTION.format(k='session_date, parent,')} AS fp, {scoring._FRACTION.format(k='session_date,')} AS fu FROM cr)
SELECT session_date, security_id, round(composite, 6) AS composite, round(coverage, 6) AS coverage, CASE WHEN composite IS NOT NULL THEN CAST(floor(round(100 * (wc * fc + wp * fp + wu * fu) / (wc + wp + wu), 9) + 0.5) AS BIGINT) END AS percentile FROM f"""),
    "sessions_scored": (sessions_scored, f"WITH {fr.BARS}, n AS (SELECT session_date, count(*) AS n FROM bars GROUP BY 1) SELECT count(*) AS sessions, count(*) FILTER (n >= 85) AS full, count(*) FILTER (n >= 85) >= 370 AS valid FROM n"),
}
