"""Writes: idempotent upserts, partition replacement, exports and marks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, payload=None) -> tuple[DataFrame, DataFrame]:
    """(old and the rows of unknown keys, rows whose known key holds other contents)."""
    shared = [c for c in new.columns if c != key]
    digest = F.sha2(F.to_json(F.struct(*sorted(shared))), 256) if payload is None else payload
    have = old.select(key, digest.alias("_old"))
    marked = new.withColumn("_new", digest).join(have, key, "left")
    fresh = marked.filter("_old IS NULL").select(*new.columns)
    return old.unionByName(fresh), marked.filter("_old IS NOT NULL AND _old <> _new").select(*new.columns)


def purge(rows: DataFrame, column: str, value) -> tuple[DataFrame, int]:
    """Rows without a partition, and how many it had."""
    gone = rows.filter(F.col(column) == value)
    return rows.filter(~F.col(column).eqNullSafe(F.lit(value))), gone.count()


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write only the partitions that ``df`` holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def marks(old: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """High-water marks, which only move forward."""
    return old.unionByName(rows.groupBy(key).agg(F.max(value).alias(value))).groupBy(key).agg(F.max(value).alias(value))


def export(df: DataFrame, path: str, order: list[str]) -> str:
    """Sorted JSON lines, compressed; returns a digest of the contents, not of the files.

    The digest adds up a hash of each row, so it is taken where the rows are and does
    not depend on how they are dealt out.
    """
    line = F.to_json(F.struct(*sorted(df.columns)))
    df.orderBy(*order).select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    h = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    total = df.agg(F.sum(h).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{total.s}:{total.n}".encode()).hexdigest()
