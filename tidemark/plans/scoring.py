"""Queries of the scoring family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import xsec
from tidemark.sources import frames as fr


def _members(spark, d):
    return fr.securities(spark, d).select("security_id", "cohort", "parent")


def score_universe(spark, d):
    out = xsec.score_universe(fr.legs_long(spark, d), _members(spark, d))
    return out.select(
        "security_id", "cohort", "scope", "confidence",
        F.round("composite", 6).alias("composite"), F.round("coverage", 6).alias("coverage"), "percentile",
    )


_W = "CASE leg " + " ".join(
    f"WHEN '{leg}' THEN CASE profile WHEN 'DOMESTIC' THEN {xsec.WEIGHTS['DOMESTIC'][leg]} ELSE {xsec.WEIGHTS['FPI'].get(leg, 'NULL')} END"
    for leg in fr.LEGS
) + " END"
_SIZED = (
    fr.RAW
    + """,
n AS (
  SELECT security_id, cn, pn, cn / (cn + 12.0) AS wc, (1 - cn / (cn + 12.0)) * (pn / (pn + 12.0)) AS wp,
         (1 - cn / (cn + 12.0)) * (1 - pn / (pn + 12.0)) AS wu,
         CASE WHEN cn >= 12 THEN 'cohort' WHEN pn >= 8 THEN 'parent' ELSE 'universe' END AS scope,
         CASE WHEN cn >= 12 THEN 'HIGH' WHEN pn >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM (SELECT security_id, count(*) OVER (PARTITION BY cohort) AS cn, count(*) OVER (PARTITION BY parent) AS pn FROM sec))"""
)
_Z = (
    _SIZED
    + """,
st AS (
  SELECT long.*, wc, wp, wu, scope, confidence,
         avg(x) OVER c AS cm, stddev_pop(x) OVER c AS cs, count(x) OVER c AS cc,
         avg(x) OVER p AS pm, stddev_pop(x) OVER p AS ps, count(x) OVER p AS pc,
         avg(x) OVER u AS um, stddev_pop(x) OVER u AS us, count(x) OVER u AS uc
  FROM long JOIN n USING (security_id)
  WINDOW c AS (PARTITION BY leg, cohort), p AS (PARTITION BY leg, parent), u AS (PARTITION BY leg)),
zz AS (
  SELECT *, CASE WHEN x IS NOT NULL AND cc >= 2 AND cs > 0 THEN wc ELSE 0 END AS kc,
         CASE WHEN x IS NOT NULL AND pc >= 2 AND ps > 0 THEN wp ELSE 0 END AS kp,
         CASE WHEN x IS NOT NULL AND uc >= 2 AND us > 0 THEN wu ELSE 0 END AS ku FROM st),
z AS (
  SELECT security_id, cohort, parent, profile, leg, x, scope, confidence, wc, wp, wu,
         CASE WHEN kc + kp + ku > 0 THEN
           (CASE WHEN kc > 0 THEN kc * (x - cm) / cs ELSE 0 END + CASE WHEN kp > 0 THEN kp * (x - pm) / ps ELSE 0 END
            + CASE WHEN ku > 0 THEN ku * (x - um) / us ELSE 0 END) / (kc + kp + ku) END AS z
  FROM zz)"""
)
_COMP = (
    _Z
    + f""",
comp AS (
  SELECT security_id, cohort, parent, scope, confidence, wc, wp, wu,
         CASE WHEN count(z) > 0 THEN sum(CASE WHEN z IS NULL THEN 0 ELSE w * greatest(-2.5, least(2.5, z)) END) / sum(w) END AS composite,
         count(z) / count(*) AS coverage
  FROM (SELECT *, {_W} AS w FROM z) WHERE w IS NOT NULL GROUP BY ALL)"""
)
_FRACTION = """(rank() OVER (PARTITION BY {k} (composite IS NULL) ORDER BY composite) - 1
            + count(*) OVER (PARTITION BY {k} composite) / 2.0) / count(*) OVER (PARTITION BY {k} (composite IS NULL))"""
SCORE_SQL = f"""
WITH {_COMP},
f AS (
  SELECT *, {_FRACTION.format(k='cohort,')} AS fc, {_FRACTION.format(k='parent,')} AS fp, {_FRACTION.format(k='')} AS fu FROM comp)
SELECT security_id, cohort, scope, confidence, round(composite, 6) AS composite, round(coverage, 6) AS coverage,
       CASE WHEN composite IS NOT NULL THEN CAST(floor(round(100 * (wc * fc + wp * fp + wu * fu) / (wc + wp + wu), 9) + 0.5) AS BIGINT) END AS percentile
FROM f"""


def blended_z(spark, d):
    sized = xsec.scopes(_members(spark, d)).select("security_id", "cohort_n", "parent_n")
    z = xsec.blended_zscores(fr.legs_long(spark, d).join(sized, "security_id"))
    return z.select("security_id", "leg", F.round("z", 6).alias("z"), F.round(S.winsorise(F.col("z")), 6).alias("winsorised"))


def cohort_scopes(spark, d):
    """Customers as securities, so that all three scopes occur."""
    n = fr.read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    c = fr.read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    m = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("security_id"),
        F.concat_ws("/", "n_name", "c_mktsegment").alias("cohort"),
        F.concat_ws("/", F.col("n_regionkey"), F.when(F.col("c_acctbal") < -900, "debt").otherwise("any")).alias("parent"),
    )
    out = xsec.scopes(m)
    w = S.tier_weights(F.col("cohort_n"), F.col("parent_n"))
    return out.select(
        "security_id", "cohort", "parent", "cohort_n", "parent_n", "scope", "confidence",
        *[F.round(x, 8).alias(f"weight_{t}") for x, t in zip(w, xsec.TIERS, strict=True)],
    )


def leg_percentiles(spark, d):
    """Each leg's percentile among all, midpoint of ties."""
    x = fr.legs_long(spark, d, in_order=True)
    f = xsec.percentile_fraction("x", ["leg"])
    return x.select("security_id", "leg", F.round(f, 8).alias("fraction"), S.half_up(F.round(100 * f, 9)).alias("percentile"))


def leg_availability(spark, d):
    """State and coverage of each leg: computable, missing or not applicable."""
    x = xsec.weighted(fr.legs_long(spark, d))
    state = F.when(F.col("weight").isNull(), "not_applicable").when(F.col("x").isNull(), "unavailable").otherwise("available")
    return x.select("profile", "leg", state.alias("state")).groupBy("profile", "leg", "state").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "score_universe": (score_universe, SCORE_SQL),
    "blended_zscores": (
        blended_z,
        f"WITH {_Z} SELECT security_id, leg, round(z, 6) AS z, round(CASE WHEN z IS NOT NULL THEN greatest(-2.5, least(2.5, z)) END, 6) AS winsorised FROM z",
    ),
    "cohort_scopes": (
        cohort_scopes,
        """WITH m AS (SELECT c_custkey AS security_id, n_name || '/' || c_mktsegment AS cohort,
  n_regionkey || '/' || CASE WHEN c_acctbal < -900 THEN 'debt' ELSE 'any' END AS parent
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT *, count(*) OVER (PARTITION BY cohort) AS cohort_n, count(*) OVER (PARTITION BY parent) AS parent_n FROM m)
SELECT *, CASE WHEN cohort_n >= 12 THEN 'cohort' WHEN parent_n >= 8 THEN 'parent' ELSE 'universe' END AS scope,
  CASE WHEN cohort_n >= 12 THEN 'HIGH' WHEN parent_n >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  round(cohort_n / (cohort_n + 12.0), 8) AS weight_cohort,
  round((1 - cohort_n / (cohort_n + 12.0)) * (parent_n / (parent_n + 12.0)), 8) AS weight_parent,
  round((1 - cohort_n / (cohort_n + 12.0)) * (1 - parent_n / (parent_n + 12.0)), 8) AS weight_universe FROM n""",
    ),
    "leg_percentiles": (
        leg_percentiles,
        f"""WITH {fr.RAW}, f AS (SELECT security_id, leg, CASE WHEN x IS NOT NULL THEN
  ((SELECT count(*) FROM long b WHERE b.leg = a.leg AND b.x < a.x) + (SELECT count(*) FROM long b WHERE b.leg = a.leg AND b.x = a.x) / 2.0)
  / (SELECT count(x) FROM long b WHERE b.leg = a.leg) END AS f FROM long a)
SELECT security_id, leg, round(f, 8) AS fraction, CAST(floor(round(100 * f, 9) + 0.5) AS BIGINT) AS percentile FROM f""",
    ),
    "leg_availability": (
        leg_availability,
        f"""WITH {fr.RAW}
SELECT profile, leg, CASE WHEN {_W} IS NULL THEN 'not_applicable' WHEN x IS NULL THEN 'unavailable' ELSE 'available' END AS state, count(*) AS n
FROM long GROUP BY ALL""",
    ),
}
