"""LM scoring: whole words and subword lattices, learnt from the corpus."""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, crc_mod, cut, table
from .lattice import BYTE_MASS, Lattice, load_pieces

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Most words that are broadcast, and the longest of them in bytes.
COMMON = 150_000
COMMON_BYTES = 48
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
DISCOUNT = 0.75
PRIOR = 200.0  # pieces that the vocabulary's own scores are worth
PASSES = 1


def _count(batches):
    seen, learnt = Counter(), Counter()

    def flush():
        ws = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ws, pa.binary()).cast(pa.string()),
                pa.array(list(map(seen.get, ws)), pa.int64()),
                pa.array(list(map(learnt.get, ws, repeat(0))), pa.int64()),
            ],
            names=["word", "n", "c"],
        )
        seen.clear()
        learnt.clear()

    for b in batches:
        rows = zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("learn").to_pylist(), strict=True)
        for text, learn in rows:
            ws = text.lower().split() if text else []  # bytes: A-Z, and blanks as listed
            seen.update(ws)
            if learn:
                learnt.update(ws)
            if len(seen) > HELD:
                yield from flush()
    yield from flush()


def _expect(model):
    def run(batches):
        lattice = Lattice(*model.value)
        total = np.zeros(lattice.n)
        for b in batches:
            ws = b.column("word").cast(pa.binary()).to_pylist()
            total += lattice.expected(ws, np.ones(len(ws)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "e"])

    return run


def _spell(model, plain, stats):
    def run(batches):
        lattice, given = Lattice(*model.value), Lattice(*plain.value)
        n, v, words_n, words_v, stop = stats
        other = DISCOUNT * words_v / words_n if words_n else 1.0
        for b in batches:
            ws = b.column("word").cast(pa.binary()).to_pylist()
            c = b.column("c").to_numpy().astype(np.float64)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - DISCOUNT, 0.0) / max(words_n, 1))
            p = (lattice.log_prob(ws, whole, np.log(other)) + np.log1p(-stop)) / np.log(10.0)
            q = given.log_prob(ws) / np.log(10.0)
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("n"), b.column("c"), pa.array(base), pa.array(p), pa.array(q)],
                names=["word", "n", "c", "base", "p", "q"],
            )

    return run


def _score(common):
    def run(batches):
        number, c, base, p, q = common.value
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for text in b.column("text").cast(pa.binary()).to_pylist():
                tf = Counter(text.lower().split()) if text else Counter()
                at = np.fromiter(map(number.get, tf, repeat(-1)), dtype=np.int64, count=len(tf))
                n = np.fromiter(tf.values(), dtype=np.int64, count=len(tf))
                known = at >= 0
                i, k = at[known], n[known]
                out[0].append(int(n.sum()))
                out[1].append(int(k[c[i] > 0].sum()))
                out[2].append(float(base[i] @ k))
                out[3].append(float(p[i] @ k))
                out[4].append(float(q[i] @ k))
                out[5].append([w for w, x in zip(tf, at, strict=True) if x < 0])
                out[6].append(n[~known].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("uid"),
                    b.column("id"),
                    b.column("learn"),
                    pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.float64()),
                    pa.array(out[3], pa.float64()),
                    pa.array(out[4], pa.float64()),
                    pa.array(out[5], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array(out[6], pa.list_(pa.int64())),
                ],
                names=["uid", "id", "learn", "n", "known", "base", "p", "q", "rare", "rare_n"],
            )

    return run


def score(
    docs: DataFrame,
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Log10 probability of each whole text, and that of a plain word model.

    Tokens are words (runs of other than blanks, A-Z lower-cased) and one end. The
    model: a token is the end with the share that ends have among the tokens learnt;
    else a word, whose probability is the sum over all paths of its lattice, by the
    forward recursion in logarithms. Its arcs are the pieces of an existing vocabulary,
    and one that spans the whole word, with the word's discounted share among the words
    learnt (the discounts go to the paths of pieces). Piece probabilities start as the
    vocabulary's scores say, and are re-estimated PASSES times on all words learnt,
    each once (as spelling is for words seen rarely or never), with the start as prior;
    the pieces themselves stay as they are. lattice_score is the same without the
    corpus: the marginal probability of the words by the vocabulary's own scores.

    ``learn`` marks the rows to learn from (all if not given). Words are counted by
    task, then over all; spelling is done once for each distinct word. The COMMON
    most frequent words, at most, are broadcast with their values; the others meet
    their words by a join, so nothing that grows with the corpus is sent to a task.

    Returns ``id_col``, learn, n_tokens, n_known (tokens that were learnt),
    train_tokens, base_score, score and lattice_score; one row for each row. Null or empty text: the
    end alone. Null ids and repeated rows pass through. If nothing is learnt, words
    are spelt by the vocabulary's scores. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    t = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).alias("learn"),
    )
    # text corpus statistics, over all texts
    counted = t.select("text", "learn").transform(arrow, _count, "word string, n long, c long")
    vocab = cut(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "words")
    got = vocab.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    words_n, words_v = got[0] or 0, got[1] or 0
    ends = t.filter("learn").count()
    n, v = words_n + ends, words_v + (ends > 0)
    stop = (ends + 0.5) / (n + 1)

    pieces, prior = load_pieces(vocabulary)
    logp = prior
    for _ in range(PASSES if words_n else 0):
        model = spark.sparkContext.broadcast((pieces, logp))
        e = np.zeros(len(pieces))
        rows = vocab.filter("c > 0").select("word").transform(arrow, _expect(model), "piece long, e double")
        for r in rows.groupBy("piece").agg(F.sum("e").alias("e")).collect():  # one row a piece
            e[r.piece] = r.e
        q = (e + PRIOR * np.exp(prior)) / (e.sum() + PRIOR * np.exp(prior).sum())
        logp = np.round(np.log(q) + np.log1p(-BYTE_MASS), 9)
    model, plain = spark.sparkContext.broadcast((pieces, logp)), spark.sparkContext.broadcast((pieces, prior))
    stats = (n, v, words_n, words_v, stop)
    valued = cut(
        vocab.transform(arrow, _spell(model, plain, stats), "word string, n long, c long, base double, p double, q double"),
        "values",
    )

    # the most frequent words: by a histogram of their counts, at most COMMON
    short = valued.filter(F.octet_length("word") <= COMMON_BYTES)
    steps = short.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("k"))
    edge, total = 10**9, 0
    for r in sorted(steps.collect(), key=lambda r: -r.step):
        total += r.k
        if total > COMMON:
            break
        edge = r.step
    often = (F.octet_length("word") <= COMMON_BYTES) & (F.floor(F.log2("n") * 8) >= edge)
    top = valued.filter(often).toArrow()
    number = {w: i for i, w in enumerate(top["word"].cast(pa.binary()).to_pylist())}
    common = spark.sparkContext.broadcast(
        (number, top["c"].to_numpy(), top["base"].to_numpy(), top["p"].to_numpy(), top["q"].to_numpy())
    )
    del top, number

    fields = "uid long, id " + t.schema["id"].dataType.simpleString() + (
        ", learn boolean, n long, known long, base double, p double, q double, rare array<string>, rare_n array<long>"
    )
    rows = t.withColumn("uid", F.monotonically_increasing_id())
    rows = cut(rows.transform(arrow, _score(common), fields), "scored")
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
    rare = rare.select("uid", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("k"))
    rest = (
        rare.join(valued.filter(~often).select("word", "c", "base", "p", "q"), "word")
        .groupBy("uid")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known_"),
            F.sum(F.col("k") * F.col("base")).alias("base_"),
            F.sum(F.col("k") * F.col("p")).alias("p_"),
            F.sum(F.col("k") * F.col("q")).alias("q_"),
        )
    )
    out = rows.drop("rare", "rare_n").join(rest, "uid", "left")
    end_base = float(np.log10((ends + 0.5) / (n + 0.5 * (v + 1))))
    more = {c: F.coalesce(c, F.lit(0)) for c in ("known_", "base_", "p_", "q_")}
    return out.select(
        F.col("id").alias(id_col),
        "learn",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + more["known_"] + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more["base_"] + end_base).alias("base_score"),
        (F.col("p") + more["p_"] + float(np.log10(stop))).alias("score"),
        (F.col("q") + more["q_"]).alias("lattice_score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    got = score(docs, learn=crc_mod(F.col("doc_id"), 5) != 1)
    return got.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "lattice_score",
    )
