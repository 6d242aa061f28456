"""Scalar column expressions: scoring, statistics, money, policy and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring semantics.
SHRINKAGE_K = 12
COHORT_MIN, PARENT_MIN = 12, 8
WINSOR_SIGMA = 2.5
DECAY_DAYS = 90.0
STRONGER, WEAKER = 0.15, -0.15
#: Fixed values of the error function's rational approximation (five terms).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
Z_BY_CONFIDENCE = {0.80: 1.2815515655, 0.90: 1.6448536270, 0.95: 1.9599639845, 0.99: 2.5758293035}


def shrinkage(n: Column, k: int = SHRINKAGE_K) -> Column:
    """Trust in a group of ``n``: n / (n + k), 0 for none."""
    return F.when(n > 0, n / (n + k)).otherwise(F.lit(0.0))


def tier_weights(cohort_n: Column, parent_n: Column) -> tuple[Column, Column, Column]:
    """Shares of cohort, parent and universe in a blend; they sum to one."""
    c, p = shrinkage(cohort_n), shrinkage(parent_n)
    return c, (1 - c) * p, (1 - c) * (1 - p)


def scope(cohort_n: Column, parent_n: Column) -> Column:
    return F.when(cohort_n >= COHORT_MIN, "cohort").when(parent_n >= PARENT_MIN, "parent").otherwise("universe")


def confidence(cohort_n: Column, parent_n: Column) -> Column:
    return F.when(cohort_n >= COHORT_MIN, "HIGH").when(parent_n >= PARENT_MIN, "MEDIUM").otherwise("LOW")


def clip(x: Column, low: float, high: float) -> Column:
    """Held to [low, high]; null stays null (least and greatest would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def winsorise(z: Column, sigma: float = WINSOR_SIGMA) -> Column:
    return clip(z, -sigma, sigma)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (x - mean) / std)


def decay(age_days: Column, days: float = DECAY_DAYS) -> Column:
    """e-folding decay by age."""
    return F.exp(-age_days / F.lit(days))


def direction(delta: Column) -> Column:
    return (
        F.when(delta > STRONGER, "STRENGTHENING").when(delta < WEAKER, "WEAKENING").otherwise("STABLE")
    )


def half_up(x: Column) -> Column:
    """The nearest whole number, halves up, of a number that isn't negative."""
    return F.floor(x + F.lit(0.5)).cast("long")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def guarded_pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson from sums; null under two pairs or without variance (where corr fails)."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    ok = (n >= 2) & (vx > 1e-12 * F.greatest(F.lit(1.0), sxx)) & (vy > 1e-12 * F.greatest(F.lit(1.0), syy))
    return F.when(ok, (sxy - sx * sy / n) / F.sqrt(vx * vy))


def fisher_z(r: Column) -> Column:
    return F.when(F.abs(r) < 1, 0.5 * F.ln((1 + r) / (1 - r)))


def erf(x: Column) -> Column:
    t = F.lit(1.0) / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return clip(0.5 * (1 + erf(x / F.sqrt(F.lit(2.0)))), 0.0, 1.0)


def two_sided_p(t: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(t)))


def effective_size(n: Column, horizon: Column) -> Column:
    """Independent observations among ``n`` that overlap over ``horizon``."""
    return F.when(horizon <= 1, n.cast("double")).otherwise(n / F.least(horizon, n))


def money(x: Column, places: int = 2) -> Column:
    """Half-up at two places, exact: through a wide decimal."""
    return F.round(x.cast("decimal(38,10)"), places).cast("double")


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def squeezed(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def verified_excerpt(source: Column, excerpt: Column) -> Column:
    """The excerpt if the source holds it; without a final "..." if it holds that much."""
    s, e = squeezed(source), squeezed(excerpt)
    cut = F.trim(F.substring(e, 1, F.char_length(e) - 3))
    return F.when((e != "") & F.contains(s, e), e).when(
        F.endswith(e, F.lit("...")) & (cut != "") & F.contains(s, cut), cut
    )


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in (start, end], in closed form."""

    def upto(d: Column) -> Column:  # weekdays since Monday 1970-01-05
        n = F.datediff(d, F.lit("1970-01-05").cast("date")) + 1
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return (upto(end) - upto(start)).cast("long")


def quantity_band(q: Column) -> Column:
    """Exact below 10, else two significant figures, half up."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(q))) - 1)
    return F.when(F.abs(q) < 10, q).otherwise(F.floor(F.abs(q) / step + 0.5) * step * F.signum(q))


def target_weight(percentile: Column, most: float, floor: float) -> Column:
    return F.when(percentile.isNull(), F.lit(floor)).otherwise(
        F.greatest(F.lit(most) * percentile / 100, F.lit(floor))
    )


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def ahead(t: Column, now: Column) -> Column:
    """Whether ``t``, rounded to whole seconds (halves to even), is later than ``now`` so rounded."""
    return F.rint(micros(t) / 1e6) > F.rint(micros(now) / 1e6)
