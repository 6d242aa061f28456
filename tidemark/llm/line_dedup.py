"""Line dedup: lines that recur in many documents stay in one of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, lower_ascii, table


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Drop lines whose key occurs in at least ``min_docs`` documents.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys
    under ``min_chars`` code points are never dropped. A frequent key keeps its
    lines in the document of the largest id that holds it. Returns the input
    columns ``id_col``, ``text_col`` and those named in ``carry`` with ``kept_text``,
    ``n_lines`` and ``n_dropped``.

    Keys travel as two 64-bit hashes. Counting first makes (key, document) rows
    distinct, then adds them up, so a key that a third of all documents share is
    summed before it is shuffled; the join back to its lines is a plain
    sort-merge join, whose skewed partitions Spark splits.

    Null or empty text: one empty line. Null ids: such rows count together as one
    document that is never the largest, so their frequent lines go unless no row
    with an id has the key. Repeated rows: one document, alike in each row. Rows
    of one id with different texts: one document when counting, and each row keeps
    its own lines. An empty table gives an empty result.
    """
    t = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(text_col).alias("raw"),
        F.struct(F.lit(0).alias("none"), *carry).alias("more"),
    ).withColumn("at", F.xxhash64("text"))

    # explode normalised lines, hash
    key = lower_ascii(F.btrim(F.col("line"), F.lit(BLANKS)))
    lines = t.select("id", "at", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "at", "pos", key.alias("key")).filter(
        F.char_length("key") >= min_chars
    )
    lines = cut(
        lines.select(
            "id",
            "at",
            "pos",
            F.xxhash64(F.lit(1), "key").alias("h1"),
            F.xxhash64(F.lit(2), "key").alias("h2"),
        ),
        "lines",
    )

    # count distinct documents for each hash
    # (written, so that both sides of the join below are plain exchanges)
    frequent = cut(
        lines.select("h1", "h2", "id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "last"),
        "frequent",
    )

    # drop lines over the threshold, reassemble by position
    drops = (
        lines.join(frequent, ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("last")) & F.col("last").isNotNull())
        .groupBy("id", "at")
        .agg(F.collect_set("pos").alias("gone"))
        .select(F.col("id").alias("id_"), F.col("at").alias("at_"), "gone")
    )
    both = t.join(
        drops.hint("shuffle_hash"),
        t["id"].eqNullSafe(drops["id_"]) & (t["at"] == drops["at_"]),
        "left",
    )
    both = both.withColumn("parts", F.split("text", "\n", -1))
    stay = F.array_except(
        F.sequence(F.lit(0), F.size("parts") - 1), F.coalesce("gone", F.array().cast("array<int>"))
    )
    # parts is named three times, so that it is not computed anew for each line
    kept = F.array_join(F.transform(stay, lambda p: F.element_at("parts", p + 1)), "\n")
    return both.select(
        F.col("id").alias(id_col),
        F.col("raw").alias(text_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col("more")[c].alias(c) for c in carry],
    )


def query(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, f.last IS NOT NULL AND f.last <> k.doc_id AS gone
  FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
