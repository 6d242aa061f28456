"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, crc_mod, table

#: Components of a vector; letters of the alphabet (the first is the gap).
DIM = 1024
LETTERS = 64
SEED = 20240229
UNDETERMINED = "und"

#: Bytes to letters: a-z without case, UTF-8 bytes folded, all others the gap.
_LETTER = bytes(
    b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 27 + b % 32 if 0x80 <= b < 0xC0
    else 59 + b % 5 if b >= 0xC0 else 0
    for b in range(256)
)


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random vectors of +1 and -1 for letters, as such, permuted once and twice."""
    v = np.random.default_rng(SEED).integers(0, 2, (LETTERS, DIM)) * 2.0 - 1.0
    return v, np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)


def _codes(text: bytes) -> np.ndarray:
    """The text's trigrams as numbers; runs of gaps are one, with one at each end."""
    s = np.frombuffer(b"\0" + text.translate(_LETTER) + b"\0", dtype=np.uint8)
    s = s[np.append(True, (s[1:] | s[:-1]) != 0)].astype(np.int32)
    return (s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:]


def _bundle(counts: np.ndarray) -> np.ndarray:
    """Sum of the trigram vectors, each as often as counted.

    A trigram's vector binds (multiplies) its letters' vectors, permuted twice, once
    and not at all. The sum is taken letter by letter, so that no table of all
    trigram vectors is needed; counts are whole numbers, so it is exact.
    """
    one, two, three = _letters()
    c = counts.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
    total = np.zeros(DIM)
    for a in np.flatnonzero(c.any((1, 2))):
        total += three[a] * (two * (c[a] @ one)).sum(0)
    return total


def _learn(batches):
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        codes = defaultdict(list)
        texts = b.column("text").cast(pa.binary()).to_pylist()
        for lang, text in zip(b.column("lang").to_pylist(), texts, strict=True):
            codes[lang].append(_codes(text))
        for lang, c in codes.items():  # one table of counts at a time
            sums[lang] = sums.get(lang, 0) + _bundle(np.bincount(np.concatenate(c), minlength=LETTERS**3))
    langs = sorted(sums)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()),
            pa.array([sums[x].astype(np.int64) for x in langs], pa.list_(pa.int64())),
        ],
        names=["lang", "bundle"],
    )


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """One bundle for each language, of all trigrams of all its texts.

    Tasks bundle their own texts, so what is shuffled and gathered is DIM numbers
    for each language and task, then for each language: it does not grow with the
    texts. Rows without text or language teach nothing.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    parts = rows.transform(arrow, _learn, "lang string, bundle array<long>")
    sums = (
        parts.select("lang", F.posexplode("bundle"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("x"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    )
    return {r.lang: [x.x for x in r.xs] for r in sums.collect()}


def _table(profiles: dict[str, list[int]]) -> tuple[list[str], np.ndarray]:
    """Each trigram's inner product with each language's prototype.

    Prototypes are bundles of length one, less their mean, of length one again. The
    inner product with a bundle is the sum of those with its parts: scoring a text
    needs no vector of it.
    """
    langs = sorted(profiles)
    p = np.array([profiles[x] for x in langs], dtype=np.float64).reshape(len(langs), DIM)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        p -= p.mean(0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    one, two, three = _letters()
    out = np.empty((LETTERS, LETTERS, LETTERS, len(langs)), dtype=np.float32)
    for k in range(len(langs)):
        for a in range(LETTERS):
            out[a, :, :, k] = (two * (three[a] * p[k])) @ one.T
    return langs, out.reshape(LETTERS**3, len(langs))


_tables: dict[str, tuple] = {}


def _predictor(profiles, key: str, text_col: str):
    def run(batches):
        if key not in _tables:
            _tables.clear()
            _tables[key] = _table(profiles.value)
        langs, inner = _tables[key]
        for b in batches:
            pred, score = [], []
            for text in b.column(text_col).to_pylist():
                if not langs or text is None or not any(map(str.isalpha, text)):
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                codes = _codes(text.encode("utf-8", "replace"))
                cos = np.maximum(inner[codes].sum(0, dtype=np.float64), 0.0)
                best = int(cos.argmax())
                pred.append(langs[best])
                score.append(float(cos[best] / cos.sum()) if cos[best] > 0 else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text of each row alone.

    lang_pred is the language whose prototype has the largest cosine with the text's
    bundle (the first by code point among equals); score is that cosine's share of
    all positive ones, which the bundle's own length leaves unchanged. Null texts and
    texts without a letter (a character of the Unicode categories L) are ``und`` with
    score 0, as all are if nothing was learned. Columns named lang_pred or score are
    replaced, unless one of them is ``text_col``; all others stay, whatever their names.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c == text_col or c not in ("lang_pred", "score")]
    rows = docs.select(*keep)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    fields = T.StructType(rows.schema.fields + added)
    key = hashlib.sha256(repr(sorted(profiles.items())).encode()).hexdigest()
    return rows.transform(arrow, _predictor(spark.sparkContext.broadcast(profiles), key, text_col), fields)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    remainder = crc_mod(F.col("doc_id"), 5)
    profiles = learn(docs.filter(remainder != 0))
    rows = docs.select("doc_id", (remainder == 0).alias("held_out"), "text")
    return identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
