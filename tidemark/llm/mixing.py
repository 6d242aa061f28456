"""Mixing sources to target weights by nested hash thresholds, without sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Bits of a document's hash, and bits that each histogram looks at.
HASH_BITS = 60
STEP_BITS = 12
WORD = r"[^\x20\x09-\x0D]++"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Each source's share of all words, held to ``most`` times its own.

    ``sizes``: source, source_size; one row for each source. The excess of
    sources that stop there is shared by weight among the others. That is the
    water level at which sum(min(most * size, level * weight)) is the total:
    sources fill in the order of most * size / weight, and running sums give the
    level. The windows here run over one row for each source, never over
    documents.
    """
    n = len(weights)
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(ordered) - 1) % n + 1)
    s = sizes.withColumn("w", w.cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    s = s.select(
        "*",
        F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)).alias("filled"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
        F.sum("source_size").over(every).alias("total"),
        F.sum("w").over(every).alias("w_all"),
    )
    s = s.select(
        "*",
        (F.col("total") - F.col("filled")).alias("left"),
        (F.col("w_all") - F.col("w_before")).alias("w_left"),
    )
    # a source is full if its cap is under the level that would hold from it on
    s = s.withColumn(
        "full", F.col("left") * F.col("w") > most * F.col("source_size") * F.col("w_left")
    )
    # the first that is not full gives the level for all after it
    first = F.min(F.when(~F.col("full"), F.struct("filled", "left", "w_left"))).over(every)
    s = s.withColumn("level", first)
    return s.select(
        "source",
        "source_size",
        F.when(
            F.col("full") | F.col("level").isNull(), (most * F.col("source_size")).cast("double")
        )
        .otherwise(F.col("w") * F.col("level.left") / F.col("level.w_left"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
) -> DataFrame:
    """How many words of each document the mix takes.

    A source is taken whole as often as it fits into its target; what is left of
    the target goes to the documents whose hash is under the source's threshold.
    The threshold is found by nested histograms: words are summed by source and
    bucket of the hash, the running sum shows the bucket in which the budget ends,
    and only that bucket is looked at again, in finer buckets, until its documents
    have one hash. That last unit is taken if this comes nearer to the target.
    Hashes come from ids alone: reruns agree, and a larger target takes a superset.

    Returns one row for each row: ``id_col``, ``source_col``, size, source_size,
    target, copies (how often it is taken) and taken (size * copies).

    Null text: size 0. Null source: a source of its own, last. Null ids share one
    hash, as repeated ids do: such rows are taken or left together. A source of no
    words has target 0. An empty table gives an empty result.
    """
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))), F.lit(0))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10)
    base = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.greatest(size, F.lit(0)).cast("long").alias("size"),
            hashed.cast("long").alias("h"),
        ),
        "sizes",
    )
    goal = cut(
        targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most),
        "targets",
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goal.select(
        F.col("source").alias("src"),
        whole.cast("long").alias("whole"),
        F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("prefix"),  # of the bucket where the budget ends
        F.lit(0).cast("long").alias("under"),  # words in the buckets before it
    )
    for bits in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        shift = HASH_BITS - bits
        inside = base.select("source", "size", F.shiftright("h", shift).alias("bucket"))
        if bits > STEP_BITS:  # boundary buckets only
            inside = inside.join(
                state.select("src", "prefix"),
                F.col("source").eqNullSafe(F.col("src"))
                & (F.shiftright("bucket", STEP_BITS) == F.col("prefix")),
            )
        sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("run", F.sum("words").over(run) - F.col("words"))
        at = sums.join(
            state.select("src", "whole", "budget", "under"), F.col("source").eqNullSafe(F.col("src"))
        )
        # the last bucket that starts within the budget
        state = cut(
            at.groupBy("src", "whole", "budget")
            .agg(
                F.max(
                    F.when(
                        F.col("under") + F.col("run") <= F.col("budget"),
                        F.struct("bucket", (F.col("under") + F.col("run")).alias("under"), "words"),
                    )
                ).alias("b")
            )
            .select(
                "src",
                "whole",
                "budget",
                F.col("b.bucket").alias("prefix"),
                F.col("b.under").alias("under"),
                F.col("b.words").alias("words"),
            ),
            "thresholds",
        )
    near = F.col("words") > 0
    near &= 2 * (F.col("budget") - F.col("under")) >= F.col("words")
    state = state.select("src", "whole", (F.col("prefix") + near.cast("long")).alias("below"))
    out = base.join(state, F.col("source").eqNullSafe(F.col("src")))
    goal = goal.select(F.col("source").alias("src2"), "source_size", "target")
    out = out.join(goal, F.col("source").eqNullSafe(F.col("src2")))
    copies = F.col("whole") + (
        (F.col("h") < F.col("below")) & (F.col("whole") < most)
    ).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
         sum(source_size) OVER () AS total, sum(w) OVER () AS w_all
  FROM s),
u AS (
  SELECT *, total - filled AS rest, w_all - w_before AS w_rest,
         (total - filled) * w > 3 * source_size * (w_all - w_before) AS full_
  FROM f),
v AS (SELECT *, min(struct_pack(filled, rest, w_rest)) FILTER (NOT full_) OVER () AS level FROM u),
g AS (
  SELECT source, source_size,
         CASE WHEN full_ OR level IS NULL THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(w * level.rest AS DOUBLE) / CAST(level.w_rest AS DOUBLE) END AS target
  FROM v),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM g),
units AS (
  SELECT source, h, sum(size) AS words,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS start_
  FROM d GROUP BY source, h),
edge AS (
  SELECT b.source, max(units.h) AS h
  FROM units JOIN b ON units.source IS NOT DISTINCT FROM b.source
  WHERE start_ <= greatest(0.0, target - whole * source_size) GROUP BY b.source),
t AS (
  SELECT units.source, units.h,
         units.h < edge.h OR (units.h = edge.h AND words > 0
           AND 2 * (greatest(0.0, target - whole * source_size) - start_) >= words) AS more
  FROM units JOIN edge ON units.source IS NOT DISTINCT FROM edge.source
  JOIN b ON units.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, b.source_size, b.target,
       CAST(d.size * (b.whole + CASE WHEN t.more AND b.whole < 3 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN t ON d.source IS NOT DISTINCT FROM t.source AND d.h = t.h
"""
