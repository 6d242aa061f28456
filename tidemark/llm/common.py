"""Helpers that the text operators share.

Intermediate tables are written as Parquet under ``spark.checkpoint.dir``, so
that an executor lost later costs nothing that was finished before it.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The six characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"

_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; made here only in local mode, if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{_RUN}"


_to_remove: dict[str, SparkSession] = {}


def _remove() -> None:
    for path, spark in _to_remove.items():
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone already: nothing can be done here
            return


atexit.register(_remove)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage."""
    spark = df.sparkSession
    base = shared_dir(spark)
    _to_remove[base] = spark
    path = f"{base}/{label}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _tidy(run: Callable) -> Callable:
    """``run``, which gives its free memory back when it ends: idle workers hold little."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` in batches of bounded size: a batch of long texts has few rows.

    The bound is a setting of the session; it is lowered only if it is Spark's default.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH).rstrip("b") == str(64 << 20):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(_tidy(run), schema)


#: Ids that may be broadcast to pick rows out of a scan (8 bytes each).
PICKED = 1_000_000


def _picker(wanted, inside: bool):
    def run(batches):
        ids = wanted.value
        for b in batches:
            own = b.column("id").to_numpy()
            yield b.filter(pa.array(np.isin(own, ids) == inside))

    return run


def pick(t: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``t`` whose id is among ``ids``, or those whose id is not.

    Up to PICKED ids are broadcast, so that texts are not shuffled; more are joined.
    No id of ``t`` may be null.
    """
    ids = cut(ids.select("id").distinct(), "ids")
    if ids.count() > PICKED:
        return t.join(ids, "id", "left_semi" if inside else "left_anti")
    wanted = t.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["id"].to_numpy()))
    return arrow(t, _picker(wanted, inside), t.schema)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the faster built-in path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, LOWER)
    )


def crc_mod(c: Column, n: int) -> Column:
    """``crc32(c as text) mod n``; null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n
