"""Benchmark decontamination: Wu-Manber search for many word windows at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, table

#: Bytes outside words become blanks, A-Z become a-z; bytes from 0x80 on are kept.
_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
#: Benchmark text that one index may hold: what is broadcast is never larger.
BLOCK_BYTES = 8_000_000

_OUT = "array<struct<start:long,end:long>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class WordIndex:
    """Windows of one or more items, searched by Wu-Manber over words.

    The alphabet is words, not characters: each word of a window has a number, all
    other words have none, and none of these can be part of an occurrence. Windows
    of one length m form a group. The shift table says for a block of two words how
    far the search can move on; blocks that end a window have shift 0, and the
    bucket of such a suffix block lists the windows to compare.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for item, ws in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in ws]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(item)
        self.groups = []
        for m, windows in sorted(by_length.items()):
            shift: dict[int, int] = {}
            bucket: dict[int, list] = {}
            for w, found in windows.items():
                for end in range(min(1, m - 1), m):
                    block = self._block(w, end, m)
                    shift[block] = min(shift.get(block, m), m - 1 - end)
                bucket.setdefault(self._block(w, m - 1, m), []).append((list(w), found))
            self.groups.append((m, shift, bucket))

    @staticmethod
    def _block(ids, end: int, m: int) -> int:
        return ids[end] if m == 1 else ids[end - 1] << 32 | ids[end]

    def search(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans that windows cover, and the items they come from."""
        ids = list(map(self.number.get, ws, repeat(0)))
        n, hits, items = len(ids), [], set()
        for m, shift, bucket in self.groups:
            get, far, i = shift.get, max(1, m - 1), m - 1
            while i < n:
                last = ids[i]
                if not last:
                    i += m  # no window holds this word
                    continue
                block = last if m == 1 else ids[i - 1] << 32 | last
                step = get(block, far)
                if step:
                    i += step
                    continue
                at = ids[i - m + 1 : i + 1]
                for w, found in bucket[block]:
                    if w == at:
                        hits.append((i - m + 1, i + 1))
                        items |= found
                i += 1
        merged: list[tuple[int, int]] = []
        for s, e in sorted(hits):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, items


def _blocks(bench: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    block: list = []
    size = 0
    for row in bench.toLocalIterator():
        text = (row[1] or "").encode("utf-8", "replace")
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], words(text)))
        size += len(text)
    yield block


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item, or the whole item if it
    has fewer. Returns ``id_col``, ``text_col``, those named in ``carry``, n_words,
    hits (merged word spans, end exclusive) and items (ids of the items with occurring
    windows, as strings, sorted). One row for each row of ``docs``, without a shuffle.

    The windows are broadcast in blocks of at most BLOCK_BYTES of benchmark text. One
    block is searched for without a shuffle or a write. If there are more, the texts
    are written once with what the first block finds; each further one reads them and
    gives only the documents that it hits, which are joined in the end.

    Null or empty text: no words, no hits. Items without words have no windows. An
    item without an id marks hits but is not listed. Repeated items count once. An
    empty benchmark contaminates nothing.
    """
    spark = docs.sparkSession
    out = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.struct(F.lit(0).alias("none"), *carry).alias("more"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_OUT).alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    bench = bench.select(F.col(item_col).cast("string"), F.col(item_text_col))
    blocks = _blocks(bench)
    index = lambda block: spark.sparkContext.broadcast(WordIndex(block, window))
    out = out.transform(arrow, _searcher(index(next(blocks))), out.schema)
    more = []
    for block in blocks:
        if not more:
            out = cut(out.withColumn("uid", F.monotonically_increasing_id()), "searched")
        texts = out.select("uid", "text")
        more.append(cut(texts.transform(arrow, _hitter(index(block)), f"uid long, hits {_OUT}, items array<string>"), "hits"))
    if more:
        found = more[0]
        for x in more[1:]:
            found = found.unionByName(x)
        gathered = [F.flatten(F.collect_list(c)).alias(f"{c}_") for c in ("hits", "items")]
        out = out.join(found.groupBy("uid").agg(*gathered), "uid", "left")
        joined = {c: F.when(F.col(f"{c}_").isNull(), F.col(c)).otherwise(F.concat(c, f"{c}_")) for c in ("hits", "items")}
        out = out.withColumns(joined).withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("hits", _merged(F.col("hits")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("text").alias(text_col),
        *[F.col("more")[c].alias(c) for c in carry],
        "n_words",
        "hits",
        "items",
    )


def _merged(hits: Column) -> Column:
    """Spans in order, those that touch or overlap made one."""
    empty = F.array().cast(_OUT)

    def step(done: Column, h: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))
        apart = (F.size(done) == 0) | (last["end"] < h["start"])
        return F.when(apart, F.concat(done, F.array(h))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(F.array_sort(hits), empty, step)


def _hitter(index):
    """Only the documents that a block hits, with their spans and items."""

    def run(batches):
        search = index.value.search
        for b in batches:
            uids, hits, items = [], [], []
            for uid, text in zip(b.column("uid").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ws = words(text)
                spans, found = search(ws) if ws else ([], set())
                if spans:
                    uids.append(uid)
                    hits.append([{"start": s, "end": e} for s, e in spans])
                    items.append(sorted(x for x in found if x is not None))
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.int64()), pa.array(hits, pa.list_(span)), pa.array(items, pa.list_(pa.string()))],
                names=["uid", "hits", "items"],
            )

    return run


def _searcher(index):
    def run(batches):
        search = index.value.search
        for b in batches:
            n_words, hits, items = [], [], []
            rows = zip(
                b.column("text").cast(pa.binary()).to_pylist(),
                b.column("hits").to_pylist(),
                b.column("items").to_pylist(),
                strict=True,
            )
            for text, old_hits, old_items in rows:
                ws = words(text)
                spans, found = search(ws) if ws else ([], set())
                n_words.append(len(ws))
                if old_hits:
                    spans = _union(spans + [(h["start"], h["end"]) for h in old_hits])
                hits.append([{"start": s, "end": e} for s, e in spans])
                items.append(sorted({x for x in found if x is not None} | set(old_items)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    b.column("text"),
                    b.column("more"),
                    pa.array(n_words, pa.int64()),
                    pa.array(hits, b.schema.field("hits").type),
                    pa.array(items, b.schema.field("items").type),
                ],
                names=["id", "text", "more", "n_words", "hits", "items"],
            )

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    got = decontaminate(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"),
    )
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return got.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS v, least(10, len(w)) AS m
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
pos AS (
  SELECT uid, m, i, list_slice(w, i, i + m - 1) AS v
  FROM (SELECT uid, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT uid, i, pos.m AS m, item_id FROM pos JOIN win ON pos.m = win.m AND pos.v = win.v),
n AS (
  SELECT uid, count(DISTINCT p) AS n_hit
  FROM (SELECT uid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY uid),
it AS (
  SELECT uid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (uid) LEFT JOIN it USING (uid)
"""
