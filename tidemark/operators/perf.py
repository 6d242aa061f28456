"""Measuring signals: rank correlations, distributions, spreads, intervals, testing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpointed
from tidemark.functions.scalar import effective_size, guarded_pearson, two_sided_p


def average_rank(value: str, keys: list[str]):
    """Rank from 1, ties given their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def pearson(rows: DataFrame, x: str, y: str, keys: list[str], name: str) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    ok = rows.filter(a.isNotNull() & b.isNotNull())
    g = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"),
        F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"),
    )
    r = guarded_pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return g.select(*keys, F.col("n").alias("population"), r.alias(name))


def spearman(rows: DataFrame, x: str, y: str, keys: list[str], name: str = "ic") -> DataFrame:
    """Rank correlation in each group, of the rows that have both values."""
    ok = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ok.select(*keys, average_rank(x, keys).alias("_x"), average_rank(y, keys).alias("_y"))
    return pearson(ranked, "_x", "_y", keys, name)


def distribution(series: DataFrame, value: str, keys: list[str], horizon) -> DataFrame:
    """Moments, quantiles, information ratio, effective size, t and p of a series."""
    v = F.col(value)
    q = [F.percentile(v, p).alias(n) for p, n in ((0.1, "q10"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.9, "q90"))]
    g = series.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"),
        *q, F.avg((v > 0).cast("double")).alias("positive"),
    )
    ess = effective_size(F.col("n"), horizon)
    ir = F.when(F.col("std") > 0, F.col("mean") / F.col("std"))
    g = g.withColumn("ess", ess).withColumn("information_ratio", ir)
    g = g.withColumn("t", F.when(F.col("ess") >= 10, F.col("information_ratio") * F.sqrt("ess")))
    return g.withColumn("p", two_sided_p(F.col("t")))


def spread(rows: DataFrame, score: str, ret: str, keys: list[str], key_id: str, fraction: float = 0.2) -> DataFrame:
    """Mean return of the top bucket less that of the bottom one, by (score, id)."""
    ok = rows.filter(F.col(score).isNotNull() & F.col(ret).isNotNull())
    part = Window.partitionBy(*keys)
    x = ok.select(
        *keys, key_id, F.col(ret).alias("_r"),
        F.row_number().over(part.orderBy(score, key_id)).alias("_k"),
        F.count(F.lit(1)).over(part).alias("_n"),
    )
    size = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * F.lit(fraction) + F.lit(1e-9)), F.floor(F.col("_n") / 2)))
    x = x.filter("_n >= 2").withColumn("_size", size)
    top, bottom = F.col("_k") > F.col("_n") - F.col("_size"), F.col("_k") <= F.col("_size")
    return x.groupBy(*keys).agg(
        F.max("_n").cast("long").alias("population"),
        F.avg(F.when(top, F.col("_r"))).alias("top_return"),
        F.avg(F.when(bottom, F.col("_r"))).alias("bottom_return"),
        F.array_sort(F.collect_list(F.when(top, F.col(key_id)))).alias("top_ids"),
    ).withColumn("spread", F.col("top_return") - F.col("bottom_return"))


def turnover(groups: DataFrame, ids: str, keys: list[str], order: str):
    """Share of a group's ids that the one before did not hold; null for the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(ids).over(w)
    share = F.size(F.array_except(F.col(ids), before)) / F.size(ids)
    return groups.withColumn("turnover", F.when(before.isNotNull(), F.when(F.size(ids) == 0, 0.0).otherwise(share)))


def drawdown(series: DataFrame, ret: str, keys: list[str], order: str) -> DataFrame:
    """Worst fall from a running peak of the compounded path, which starts at one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = series.withColumn("_v", F.exp(F.sum(F.ln(1 + F.col(ret))).over(w)))
    x = x.withColumn("_p", F.greatest(F.lit(1.0), F.max("_v").over(w)))
    g = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("_v") / F.col("_p") - 1).alias("worst"))
    return g.select(*keys, F.when(F.col("n") >= 2, F.least(F.lit(0.0), F.col("worst"))).alias("max_drawdown"))


#: Parts that the tests of a family are cut into before they are ranked.
CUTS = 64


def benjamini_hochberg(tests: DataFrame, p: str, keys: list[str], order: str, alpha: float = 0.05) -> DataFrame:
    """Step-up adjusted values, and which are significant at ``alpha``.

    A family may have as many tests as there are securities: these are cut into parts
    by p (which lies in 0 to 1), ranked within each part, and what the other parts add
    comes from their totals, CUTS rows a family. Tests are written first, so that each
    is in the same part whenever it is read.
    """
    x = checkpointed(tests.filter(F.col(p).isNotNull()))
    at = F.percentile_approx(p, F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), F.lit(10_000))
    x = x.join(x.groupBy(*keys).agg(at.alias("_cuts")), keys)
    x = x.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(p)))).drop("_cuts")
    part = Window.partitionBy(*keys, "_part")
    x = x.withColumn("_here", F.row_number().over(part.orderBy(p, order)))
    family = Window.partitionBy(*keys)
    sizes = x.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_t")).withColumn("_m", F.sum("_t").over(family))
    sizes = sizes.withColumn("_below", F.sum("_t").over(family.orderBy("_part")) - F.col("_t")).drop("_t")
    x = x.join(sizes, [*keys, "_part"]).withColumn("rank", F.col("_below") + F.col("_here"))
    x = x.withColumn("_raw", F.col(p) * F.col("_m") / F.col("rank"))
    fits = F.col(p) <= F.col("rank") / F.col("_m") * alpha
    parts = x.groupBy(*keys, "_part").agg(F.min("_raw").alias("_least"), F.max(F.when(fits, F.col("rank"))).alias("_last"))
    behind = family.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_later", F.min("_least").over(behind)).withColumn("_last", F.max("_last").over(family)).drop("_least")
    x = x.join(parts, [*keys, "_part"])
    suffix = part.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(suffix), F.col("_later")))
    x = x.withColumn("significant", F.col("rank") <= F.coalesce("_last", F.lit(0)))
    return x.drop("_m", "_part", "_here", "_below", "_raw", "_later", "_last")


def newey_west(series: DataFrame, value: str, keys: list[str], order: str, horizon: int, z: float) -> DataFrame:
    """Mean with an interval from Bartlett-weighted autocovariances to lag horizon - 1."""
    part = Window.partitionBy(*keys)
    w = part.orderBy(order)
    x = series.withColumn("_d", F.col(value) - F.avg(value).over(part))
    lags = range(horizon)
    x = x.select(*keys, value, *[(F.col("_d") * F.lag("_d", k).over(w)).alias(f"_g{k}") for k in lags])
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        *[F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_g{k}") for k in lags],
    )
    top = F.least(F.lit(horizon - 1), F.col("n") - 1)
    var = F.col("_g0") / F.col("n")
    for k in range(1, horizon):
        var += F.when(F.lit(k) <= top, 2 * (1 - F.lit(k) / (top + 1)) * F.col(f"_g{k}") / F.col("n")).otherwise(0.0)
    se = F.when((F.col("n") >= 2) & (var > 0), F.sqrt(var / F.col("n")))
    return g.select(*keys, "n", "mean", se.alias("se"), (F.col("mean") - z * se).alias("low"), (F.col("mean") + z * se).alias("high"))


class SplitMix:
    """The splitmix64 generator, with unbiased bounded draws by rejection."""

    GAMMA, A, B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def __init__(self, seed: int):
        self.state = seed % 2**64

    def draw(self) -> int:
        self.state = (self.state + self.GAMMA) % 2**64
        z = self.state
        for shift, factor in ((30, self.A), (27, self.B)):
            z = (z ^ z >> shift) * factor % 2**64
        return z ^ z >> 31

    def below(self, bound: int) -> int:
        usable = 2**64 - 2**64 % bound
        while (x := self.draw()) >= usable:
            pass
        return x % bound

    def draws(self, count: int) -> np.ndarray:
        """The next ``count`` draws at once: each is a function of its place alone."""
        with np.errstate(over="ignore"):
            z = np.uint64(self.state) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(self.GAMMA)
            for shift, factor in ((30, self.A), (27, self.B)):
                z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
        self.state = (self.state + count * self.GAMMA) % 2**64
        return z ^ z >> np.uint64(31)

    def below_each(self, bounds: np.ndarray) -> np.ndarray:
        """``below`` for one bound after another; drawn one by one only if a draw is refused."""
        start, b = self.state, bounds.astype(np.uint64)
        x = self.draws(len(b))
        with np.errstate(over="ignore"):
            refused = (np.uint64(0) - b) % b  # 2 ** 64 modulo the bound
        if (x > np.uint64(2**64 - 1) - refused).any():
            self.state = start
            return np.array([self.below(int(k)) for k in bounds], dtype=np.int64)
        return (x % b).astype(np.int64)

    def shuffles(self, times: int, n: int) -> np.ndarray:
        """``times`` results of ``shuffled``, one a row."""
        swaps = self.below_each(np.tile(np.arange(n, 1, -1), times)).reshape(times, max(n - 1, 0))
        out, row = np.tile(np.arange(n), (times, 1)), np.arange(times)
        for k in range(n - 1):
            last, other = n - 1 - k, swaps[:, k]
            held = out[row, other]
            out[row, other] = out[:, last]
            out[:, last] = held
        return out

    def shuffled(self, n: int) -> list[int]:
        out = list(range(n))
        for last in reversed(range(1, n)):
            other = self.below(last + 1)
            out[last], out[other] = out[other], out[last]
        return out


def seed_of(text: str) -> int:
    import hashlib

    return int(hashlib.sha256(text.encode()).hexdigest()[:16], 16)


def bootstrap(series: DataFrame, value: str, key: str, order: str, horizon: int, replicates: int = 1000, confidence: float = 0.95) -> DataFrame:
    """Moving-block bootstrap of each series' mean; a series is one group, by its dates."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(dtype=float)
        n, name = len(x), pdf[key].iloc[0]
        if n < 2:
            return pd.DataFrame({key: [name], "n": [n], "point": [x.mean() if n else np.nan], "low": [np.nan], "high": [np.nan], "se": [np.nan]})
        size = min(max(horizon, 1), n)
        blocks = -(-n // size)
        rng = SplitMix(seed_of(f"{name}:{horizon}"))
        starts = rng.below_each(np.full(replicates * blocks, n - size + 1)).reshape(replicates, blocks)
        at = (starts[:, :, None] + np.arange(size)).reshape(replicates, -1)[:, :n]
        means = x[at].mean(1)
        low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame({key: [name], "n": [n], "point": [x.mean()], "low": [low], "high": [high], "se": [means.std(ddof=1)]})

    kind = series.schema[key].dataType.simpleString()
    return series.filter(F.col(value).isNotNull()).groupBy(key).applyInPandas(run, f"{key} {kind}, n long, point double, low double, high double, se double")


#: Numbers of random rankings that are held at once.
HELD = 4_000_000


def random_band(rows: DataFrame, ret: str, key: str, key_id: str, replicates: int = 200) -> DataFrame:
    """Rank correlations of seeded random rankings with each group's returns: mean, std, 95 % of |IC|."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(key_id)
        y = pdf[ret].rank().to_numpy(dtype=float)
        n, name = len(y), pdf[key].iloc[0]
        rng, ics = SplitMix(seed_of(str(name))), []
        dy = y - y.mean()
        left = replicates if n >= 2 and dy.any() else 0
        while left:
            some = min(left, max(1, HELD // n))
            d = rng.shuffles(some, n) - (n - 1) / 2
            ics.extend(d @ dy / np.sqrt((d * d).sum(1) * (dy @ dy)))
            left -= some
        if not ics:
            return pd.DataFrame({key: [name], "n": [n], "mean": [np.nan], "std": [np.nan], "p95": [np.nan]})
        return pd.DataFrame({key: [name], "n": [n], "mean": [np.mean(ics)], "std": [np.std(ics, ddof=1)], "p95": [np.quantile(np.abs(ics), 0.95)]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.filter(F.col(ret).isNotNull()).groupBy(key).applyInPandas(run, f"{key} {kind}, n long, mean double, std double, p95 double")


def non_overlapping(dates: DataFrame, key: str, number: str, horizon: int) -> DataFrame:
    """Sessions taken greedily so that none is within ``horizon`` of the last one taken."""

    def run(pdf):
        pdf = pdf.sort_values(number)
        keep, last = [], None
        for x in pdf[number]:
            keep.append(last is None or x >= last + horizon)
            last = x if keep[-1] else last
        return pdf[keep]

    return dates.groupBy(key).applyInPandas(run, dates.schema)
