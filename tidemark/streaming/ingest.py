"""Incremental ingest: keyed upserts, high-water marks, and the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def apply_batch(state: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """State after a batch: of the rows of one key the last by ``order``.

    Rows may come late or twice: the outcome is that of all rows in one batch, so no
    row is lost to a mark that has moved on.
    """
    rows = batch if state is None else state.unionByName(batch)
    best = F.max_by(F.struct(*rows.columns), F.col(order)).alias("b")
    return rows.groupBy(F.col(key).alias("_k")).agg(best).select("b.*")


def rejected(events: DataFrame, key: str, time: str, arrival: list[str]) -> DataFrame:
    """Rows that are not after their key's high-water mark when they arrive."""
    w = Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("mark", F.max(time).over(w)).filter(F.col(time) <= F.col("mark"))


#: Parts that a streamed table's keys are dealt into; a batch rewrites those that it touches.
PARTS = 64


def current(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a streamed table: of each part what its last version holds."""
    parts = _latest(spark, target)
    paths = [f"{target}/rows/version={v}/part={p}" for p, v in sorted(parts.items())]
    return spark.read.parquet(*paths)


def _latest(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """The version of each part, by the list that the last batch (before ``before``) left."""
    files = _children(spark, f"{target}/lists")
    done = [int(f.split("=")[1]) for f in files if f.startswith("batch=")]
    done = [n for n in done if before is None or n < before]
    if not done:
        return {}
    return {r.part: r.version for r in spark.read.parquet(f"{target}/lists/batch={max(done)}").collect()}


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _forget(spark: SparkSession, target: str, number: int, keep: dict[int, int]) -> None:
    """Remove versions and lists that neither this batch nor the one before needs."""
    before = _latest(spark, target, number)
    used = {(p, v) for parts in (keep, before) for p, v in parts.items()}
    for version in _children(spark, f"{target}/rows"):
        v = int(version.split("=")[1])
        for part in _children(spark, f"{target}/rows/{version}"):
            if part.startswith("part=") and (int(part.split("=")[1]), v) not in used and v <= number:
                at, fs = _path(spark, f"{target}/rows/{version}/{part}")
                fs.delete(at, True)


def stream_upserts(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, order: str) -> None:
    """Read what is new in ``source`` once, and merge it into the table ``target``.

    Keys are dealt into PARTS parts. A micro-batch rewrites the parts that its keys are
    in, as a version named by its number, and then writes a list of each part's version
    (PARTS rows), which makes the batch visible. A batch that is run again after a
    failure overwrites its own version and list, so a restart neither loses rows nor
    counts them twice. Versions that the last two lists do not name are removed.
    Readers take ``current``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
        rows = batch.withColumn("part", part)
        touched = sorted(r.part for r in rows.select("part").distinct().collect())  # at most PARTS
        if not touched:
            return
        known = _latest(own, target, number)
        old = [f"{target}/rows/version={known[p]}/part={p}" for p in touched if p in known]
        state = own.read.schema(batch.schema).parquet(*old) if old else None
        merged = apply_batch(state, batch, key, order).withColumn("part", part)
        merged.write.mode("overwrite").partitionBy("part").parquet(f"{target}/rows/version={number}")
        now = known | dict.fromkeys(touched, number)
        listed = own.createDataFrame(sorted(now.items()), "part int, version long").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{target}/lists/batch={number}")
        _forget(own, target, number, now)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """First row of each key, as long as rows come at most ``late`` after."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str = "1 hour") -> DataFrame:
    """Rows and total value by window and key."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
