"""From documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet and reads it again for the next. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.langid import UNDETERMINED, identify, learn
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letter) go; an unknown one is filled in."""
    found = identify(docs.select(*COLUMNS), learn(docs))
    kept = found.filter(F.col("lang_pred") != UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one; texts and n_chars change, no document goes."""
    rest = [c for c in COLUMNS if c not in ("text", "n_chars")]
    done = line_dedup(docs, carry=tuple(c for c in rest if c != "doc_id"))
    return done.select(
        *rest,
        F.col("kept_text").alias("text"),
        F.char_length("kept_text").cast("long").alias("n_chars"),
    ).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest id."""
    docs = docs.select(*COLUMNS)
    classes = cut(near_duplicates(docs).filter("doc_id IS NOT NULL").select("doc_id", "kept"), "kept")
    # texts meet the short list of those that go, which Spark broadcasts if it is small
    gone = cut(classes.filter("NOT kept").select("doc_id").distinct(), "gone")
    rest = docs.join(gone, "doc_id", "left_anti")
    repeated = classes.filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    repeated = cut(repeated.filter("rows > 1").select("doc_id"), "repeated")
    if repeated.limit(1).count():  # rows of one id are one document
        one = rest.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row"))
        one = one.select("row.*")  # the smallest, so that reruns agree
        rest = rest.join(repeated, "doc_id", "left_anti").unionByName(one)
    return rest.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, bench, carry=tuple(c for c in COLUMNS if c not in ("doc_id", "text")))
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often, and with how many words, the mix takes each document."""
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the language model and the components of near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
