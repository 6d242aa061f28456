"""MinHash near-dedup: an LSH forest proposes pairs, full shingle sets confirm them."""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import components

from .common import PICKED, arrow, cut, table

#: Trees of the forest, and hashes of each: a tree sorts by its own hashes in order.
TREES, DEPTH = 16, 6
#: Documents that share this many leading hashes in a tree are in one region.
SHALLOW = 3
#: A region of more documents is split by its next hash, down to DEPTH.
REGION = 4000
HASHES = TREES * DEPTH
SEED = 7
#: Standard deviations that an estimate may be below the threshold.
SLACK = 3.5
#: Hashes of the long sketches that the second round compares.
LONG = 512
#: Bytes of text whose shingles are hashed at once.
CHUNK = 4_000_000

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _C
    return x ^ (x >> np.uint64(29))


def _shingles(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The distinct hashed shingles of each text, sorted; none for a text without words."""
    number: dict[bytes, int] = {}
    ids, lengths = [], []
    for text in texts:
        ws = text.lower().split() if text else []
        for w in ws:
            if w not in number:
                number[w] = len(number)
        ids.extend(map(number.get, ws))
        lengths.append(len(ws))
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, number, repeat(SEED)), dtype=np.uint64, count=len(number))
    seq = hashed[np.array(ids, dtype=np.int64)] if ids else np.empty(0, dtype=np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in lengths:
            w = seq[at : at + n]
            at += n
            k = min(size, n)
            if not k:
                out.append(w)
                continue
            h = w[: n - k + 1].copy()
            for j in range(1, k):
                h = _mix(h * _A + w[j : n - k + 1 + j])
            if k < size:  # the whole of a shorter text is no shingle of a longer one
                h = _mix(h + np.uint64(k))
            out.append(np.unique(_mix(h * _B)))
    return out


def _chunks(batch, size: int):
    """(rows, their shingles) for slices of bounded text."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    lo, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total > CHUNK or i == len(texts) - 1:
            yield lo, _shingles(texts[lo : i + 1], size)
            lo, total = i + 1, 0


def _sign(size: int):
    rng = np.random.default_rng(SEED)
    mul = rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for b in batches:
            n, x, y, sig = [], [], [], []
            for _, sets in _chunks(b, size):
                lengths = np.array([len(s) for s in sets])
                full = np.flatnonzero(lengths)
                n.extend(lengths.tolist())
                sigs: list = [None] * len(sets)
                xs, ys = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
                if len(full):
                    s = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
                    with np.errstate(over="ignore"):
                        least = np.empty((len(full), HASHES), dtype=np.uint32)
                        for j in range(HASHES):
                            h = (s * mul[j]) >> np.uint64(32)
                            least[:, j] = np.minimum.reduceat(h.astype(np.uint32), starts)
                        xs[full] = np.add.reduceat(_mix(s * _A), starts).astype(np.int64)
                        ys[full] = np.add.reduceat(_mix(s * _B + _A), starts).astype(np.int64)
                    for i, row in zip(full, least, strict=True):
                        sigs[i] = row.tobytes()
                x.extend(xs.tolist())
                y.extend(ys.tolist())
                sig.extend(sigs)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(sig, pa.binary())],
                names=["id", "n", "x", "y", "sig"],
            )

    return run


def _plant(batches):
    """A row for each tree: its keys at each depth, and eight bits of every hash."""
    for b in batches:
        ids, n = b.column("id"), b.column("n")
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint32).reshape(len(ids), HASHES)
        sketch = pa.array([r.tobytes() for r in (sig & np.uint32(255)).astype(np.uint8)], pa.binary())
        with np.errstate(over="ignore"):
            for t in range(TREES):
                key = np.full(len(ids), t + 1, dtype=np.uint64)
                keys = []
                for d in range(DEPTH):
                    key = _mix(key * _A + sig[:, t * DEPTH + d])
                    if d >= SHALLOW - 1:
                        keys.append(pa.array(key.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*keys, ids, n, sketch],
                    names=[*[f"k{d}" for d in range(SHALLOW, DEPTH + 1)], "id", "n", "sketch"],
                )


def _runs(batches):
    """Whole regions (key, rows), of batches that are sorted by region."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        keys = held.column("region").to_numpy()
        if not len(keys) or keys[0] == keys[-1]:
            continue
        ends = np.flatnonzero(np.diff(keys)) + 1
        for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
            if hi - lo > 1:
                yield held.slice(lo, hi - lo)
        held = held.slice(ends[-1])
    if held is not None and held.num_rows > 1:
        yield held


def _agree(sketch: np.ndarray, row: int) -> np.ndarray:
    return (sketch == sketch[row]).sum(1)


def _least_agreement(similarity: float, hashes: int = HASHES) -> int:
    """Equal hashes that a pair of this similarity has, but for rare bad luck."""
    dev = (similarity * (1 - similarity) / hashes) ** 0.5
    return int(np.floor(hashes * (similarity - SLACK * dev)))


def _first(similarity: float):
    """Pairs of each region: its maximum spanning forest by estimated similarity.

    Partners have the longest common prefix in some tree; how alike they are is told
    by all hashes, and among equals by a hash of both ids. So no two pairs weigh the
    same, and all trees propose the same pair for the same documents. Rows of a region
    that has any pair are handed on as well.
    """
    floor = _least_agreement(similarity)

    def run(batches):
        for r in _runs(batches):
            order = np.argsort(r.column("id").to_numpy())
            ids, n = r.column("id").to_numpy()[order], r.column("n").to_numpy()[order]
            raw = r.column("sketch").to_pylist()
            sketch = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(ids), HASHES)[order]
            m = len(ids)
            with np.errstate(over="ignore"):
                salt = _mix(ids.astype(np.uint64) * _A + _B)
            best, link = np.full(m, -1.0), np.zeros(m, dtype=np.int64)  # for the forest
            done = np.zeros(m, dtype=bool)
            pairs, linked = [], np.zeros(m, dtype=bool)
            here = 0
            for _ in range(m):
                done[here] = True
                agree = _agree(sketch, here)
                fit = (agree >= floor) & (np.minimum(n, n[here]) >= similarity * np.maximum(n, n[here]) - 1e-9)
                fit[here] = False
                linked[here] = fit.any()
                at = np.flatnonzero(fit & ~done)
                if len(at):
                    with np.errstate(over="ignore"):
                        tie = _mix((salt[at] ^ salt[here]) * _C) >> np.uint64(12)
                    weight = agree[at] + tie.astype(np.float64) / 2.0**53
                    better = weight > best[at]
                    best[at[better]], link[at[better]] = weight[better], here
                rest = np.where(done, -2.0, best)
                here = int(rest.argmax())
                if rest[here] >= 0:
                    pairs.append((min(here, int(link[here])), max(here, int(link[here]))))
            if not pairs:
                continue
            p = np.array(pairs)
            yield _out(ids[p[:, 0]], ids[p[:, 1]])
            at = np.flatnonzero(linked)
            yield _out(ids[at], None, r.column("region")[0].as_py(), n[at])

    return run


_FIRST = "a long, b long, region long, n long"


def _out(a, b, region=None, n=None):
    m = len(a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a, pa.int64()),
            pa.nulls(m, pa.int64()) if b is None else pa.array(b, pa.int64()),
            pa.array([region] * m, pa.int64()),
            pa.nulls(m, pa.int64()) if n is None else pa.array(n, pa.int64()),
        ],
        names=["a", "b", "region", "n"],
    )


def _second(percent: int):
    """All likely pairs of a region whose documents are not yet in one component.

    shared: how many of a document's shingles any other one has. Two documents have
    no more in common than the smaller of these, which bounds their similarity.
    """
    floor = _least_agreement(percent / 100, LONG)

    def run(batches):
        for r in _runs(batches):
            comp = r.column("comp").to_numpy()
            if (comp == comp[0]).all():
                continue
            ids, n, shared = (r.column(c).to_numpy() for c in ("id", "n", "shared"))
            sketch = np.frombuffer(b"".join(r.column("long").to_pylist()), dtype=np.uint8).reshape(len(ids), LONG)
            sizes = dict(zip(*np.unique(comp, return_counts=True), strict=True))
            large = max(sizes, key=sizes.get)
            for i in np.flatnonzero(comp != large):  # pairs within the largest are linked
                most = np.minimum(shared, shared[i])
                fit = 100 * most >= percent * (n + n[i] - most)
                fit &= (comp != comp[i]) & ((comp == large) | (np.arange(len(ids)) > i))
                at = np.flatnonzero(fit)
                at = at[(sketch[at] == sketch[i]).sum(1) >= floor]
                if len(at):
                    p = ids[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(p, ids[i])), pa.array(np.maximum(p, ids[i]))], names=["a", "b"]
                    )

    return run


def _linked(percent: int):
    """The links of a block between components that were apart, confirmed on full sets.

    Of each two components one link is enough, so a block gives fewer links than it
    has documents, however many pairs are likely.
    """
    floor = _least_agreement(percent / 100, LONG)

    def run(batches):
        for r in _runs(batches):
            names, comp = np.unique(r.column("comp").to_numpy(), return_inverse=True)
            if len(names) == 1:
                continue
            ids, n, shared = (r.column(c).to_numpy() for c in ("id", "size", "shared"))
            sketch = np.frombuffer(b"".join(r.column("long").to_pylist()), dtype=np.uint8).reshape(len(ids), LONG)
            sets = r.column("shingles").combine_chunks()
            ends = np.cumsum(sets.value_lengths().to_numpy())
            found, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            own = np.split(flat, ends[:-1])
            mark = np.zeros(len(found), dtype=bool)
            a, b = [], []
            for i in np.flatnonzero(comp != np.bincount(comp).argmax()):
                most = np.minimum(shared, shared[i])
                fit = (comp != comp[i]) & (100 * most >= percent * (n + n[i] - most))
                at = np.flatnonzero(fit)
                agree = (sketch[at] == sketch[i]).sum(1)
                at = at[np.lexsort((at, -agree))][: int((agree >= floor).sum())]
                mark[own[i]] = True
                for j in at.tolist():
                    if comp[i] == comp[j]:
                        continue
                    common = int(mark[own[j]].sum())
                    if 100 * common >= percent * (n[i] + n[j] - common):
                        a.append(min(ids[i], ids[j]))
                        b.append(max(ids[i], ids[j]))
                        comp[comp == comp[j]] = comp[i]
                mark[own[i]] = False
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _long_sketches(sets: list[np.ndarray]) -> list[bytes | None]:
    """Eight bits of LONG minimum hashes of each set."""
    rng = np.random.default_rng(SEED + 1)
    mul = rng.integers(0, 2**63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    full = [k for k, s in enumerate(sets) if len(s)]
    out: list[bytes | None] = [None] * len(sets)
    if full:
        s = np.concatenate([sets[k] for k in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
        least = np.empty((len(full), LONG), dtype=np.uint8)
        with np.errstate(over="ignore"):
            for j in range(LONG):
                h = ((s * mul[j]) >> np.uint64(32)).astype(np.uint32)
                least[:, j] = (np.minimum.reduceat(h, starts) & np.uint32(255)).astype(np.uint8)
        for k, row in zip(full, least, strict=True):
            out[k] = row.tobytes()
    return out


def _sets(size: int, wanted):
    def run(batches):
        ids = wanted.value
        for b in batches:
            if ids is not None:
                own = b.column("id").to_numpy()
                b = b.filter(pa.array(np.isin(own, ids)))
            sets, sketches = [], []
            for _, part in _chunks(b, size):
                sets.extend(s.astype(np.int64) for s in part)
                sketches.extend(_long_sketches(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(sets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["id", "shingles", "long"],
            )

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("s", "t"))
    union = F.size("s") + F.size("t") - common
    return both.filter(100 * common >= percent * union).select("a", "b").distinct()


def _pick_sets(t: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Shingle sets of the documents in ``ids``."""
    spark = t.sparkSession
    ids = cut(ids.distinct(), "paired")
    few = ids.count() <= PICKED
    wanted = np.sort(ids.toArrow()["id"].to_numpy()) if few else None
    rows = t if few else t.join(ids, "id", "left_semi")
    picked = rows.transform(arrow, _sets(size, spark.sparkContext.broadcast(wanted)), "id long, shingles array<long>, long binary")
    return cut(picked, "sets")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Classes of documents linked by the similarity of their word shingles.

    A document's set: its distinct shingles of ``words`` words (A-Z lower-cased, split
    at blanks), or the whole sequence if it has fewer. Documents are linked if
    100 * intersection >= percent * union; classes are connected components.

    1. Equal sets (by a 128-bit sum) are one class at once; one document of each, the
       smallest id, goes on.
    2. LSH forest: TREES signature orders of DEPTH MinHash values each. Documents
       with a common prefix of SHALLOW values are a region; a region of more than
       REGION documents is split by the next value, so depth adapts to how crowded
       a place is. Two sets of similarity 0.8 share no region with probability
       (1 - 0.8 ** 3) ** 16 = 1e-5.
    3. First round: each region proposes the maximum spanning forest of its
       estimated similarities.
    4. Full sets confirm or refuse each pair; components are taken.
    5. Second round: for regions that are not in one component, every pair across
       components that can be similar and was not tried yet is confirmed as well.
       Whether it can be is told by the shingles that no other of these documents
       has (exactly) and by a longer sketch. So pairs that are left out are those
       within a component, which change nothing, and those that can't be linked.
    6. All documents of a region that was split are compared under its prefix of
       SHALLOW values, block by block, wherever they are not in one component yet:
       splitting costs no pair.

    Returns one row for each row: ``id_col``, n_shingles, component_id and kept
    (``id_col`` = component_id). Null or blank texts have an empty set and are linked
    with nothing. Rows without an id are classes of their own: component_id null,
    kept true. Rows that share an id are one document, and their classes one. An
    empty table gives an empty result.
    """
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(t.transform(arrow, _sign(words), "id long, n long, x long, y long, sig binary"), "signed")
    some = signed.filter("n > 0 AND id IS NOT NULL")
    reps = cut(
        some.groupBy("x", "y", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "reps"
    )
    similarity = percent / 100

    keys = ", ".join(f"k{d} long" for d in range(SHALLOW, DEPTH + 1))
    forest = reps.select(F.col("rep").alias("id"), "n", "sig").transform(
        arrow, _plant, f"{keys}, id long, n long, sketch binary"
    )
    forest = _adapted(cut(forest, "forest"))
    wide = forest.filter("wide IS NOT NULL").select("id", F.col("wide").alias("region"), "n")
    found = cut(
        forest.drop("wide").repartition("region").sortWithinPartitions("region").transform(arrow, _first(similarity), _FIRST),
        "found",
    )
    pairs = cut(found.filter("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    texts = t.filter("id IS NOT NULL")
    sets = _pick_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), words)
    links = cut(_confirm(pairs, sets, percent), "confirmed")
    first = cut(components(links, partial(cut, label="links")), "components")

    members = found.filter("b IS NULL").select(F.col("a").alias("id"), "region", "n")
    members = cut(_apart(members, first), "members")
    # shingles that no other of these documents has can't be common to a pair of them
    own_sets = sets.join(members.select("id").distinct(), "id")
    alone = own_sets.select("id", F.explode("shingles").alias("s")).groupBy("s")
    alone = alone.agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).filter("k = 1")
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    facts = cut(own_sets.select("id", "long").join(alone, "id", "left"), "facts")
    members = members.join(facts, "id").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
    members = _split(members.filter(100 * F.col("shared") >= percent * F.col("n")))
    more = (
        members.select("region", "id", "n", "shared", "comp", "long")
        .repartition("region")
        .sortWithinPartitions("region")
        .transform(arrow, _second(percent), "a long, b long")
        .distinct()
    )
    more = cut(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        links = cut(links.unionByName(_confirm(more, sets, percent)), "confirmed")
    if wide.limit(1).count():
        links = cut(links.unionByName(_across(wide, links, texts, sets, words, percent)), "confirmed")
    # rows of one id may have several sets: they are one document
    own = some.select("id", "x", "y", "n").distinct()
    own = own.join(reps.select("x", "y", "n", "rep"), ["x", "y", "n"])
    own = cut(own.select("id", "rep"), "classes")
    versions = own.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    versions = versions.filter("lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    whole = components(links.unionByName(versions), partial(cut, label="links"))
    own = own.join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = signed.select("id", "n").join(own, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _split(members: DataFrame) -> DataFrame:
    """The members of regions that are in more than one component."""
    crowded = members.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return members.join(crowded.filter("lo <> hi").select("region"), "region")


def _apart(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members, with their components, of regions that are in more than one."""
    members = members.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "comp", F.coalesce("component", "id")
    )
    return _split(members).select("region", "id", "n", "comp")


def _across(wide: DataFrame, links: DataFrame, texts: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the components that are left of each region that was split."""
    members = cut(_apart(wide, components(links, partial(cut, label="links"))), "members")
    lone = cut(members.select("id").distinct().join(sets, "id", "left_anti"), "lone")
    if lone.limit(1).count():  # the first round gave them no partner
        sets = cut(sets.unionByName(_pick_sets(texts, lone, words)), "sets")
    # as in the second round: what no other document has is common to no pair
    own = sets.join(members.select("id").distinct(), "id")
    own = own.select("id", "long", F.size("shingles").alias("size"), "shingles", F.monotonically_increasing_id().alias("row"))
    own = cut(own, "own")
    held = own.select("id", "row", F.explode("shingles").alias("s"))
    often = held.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("row").alias("row"))
    alone = often.filter("k = 1").groupBy("row").agg(F.count(F.lit(1)).alias("alone"))
    own = own.join(alone, "row", "left").withColumn("shared", F.col("size") - F.coalesce("alone", F.lit(0)))
    own = cut(own.filter(100 * F.col("shared") >= percent * F.col("size")).drop("row", "alone"), "own")
    members = members.select("region", "id", "comp").distinct().join(own.select("id").distinct(), "id")
    blocks = _blocks(cut(_split(members), "members")).join(own, "id")
    blocks = blocks.select("region", "id", "comp", "size", "shared", "long", "shingles")
    blocks = blocks.repartition("region").sortWithinPartitions("region")
    return cut(blocks.transform(arrow, _linked(percent), "a long, b long").distinct(), "across")


def _blocks(members: DataFrame) -> DataFrame:
    """The members with each region of more than REGION dealt into blocks.

    Documents outside a region's largest component probe all of it. Probes are dealt
    into parts, and so are all members: a block is one part of each, so that every
    probe meets every member in a block, and no block has more than about 2 * REGION
    rows. A region that is not crowded is one block.
    """
    sizes = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("region").agg(F.sum("k").alias("crowd"), F.max(F.struct("k", "comp"))["comp"].alias("large"), F.max("k").alias("k"))
    sizes = sizes.filter(F.col("crowd") > REGION).select(
        "region", "large", F.ceil(F.col("crowd") / REGION).alias("parts"), F.ceil((F.col("crowd") - F.col("k")) / REGION).alias("probes")
    )
    sizes = cut(sizes, "sizes")
    if not sizes.limit(1).count():
        return members
    small = members.join(sizes.select("region"), "region", "left_anti")
    x = members.join(sizes, "region")
    part = lambda n: F.pmod(F.xxhash64("id"), n)
    every = F.sequence(F.lit(0).cast("long"), F.col("probes") - 1)
    own = F.transform(every, lambda p: F.struct(p.alias("p"), part(F.col("parts")).alias("q")))
    along = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    probing = F.transform(along, lambda q: F.struct(part(F.col("probes")).alias("p"), q.alias("q")))
    probing = F.when(F.col("comp") != F.col("large"), probing).otherwise(F.slice(probing, 1, 0))
    x = x.withColumn("block", F.explode(F.array_distinct(F.concat(own, probing))))
    x = x.withColumn("region", F.xxhash64("region", "block.p", "block.q")).select(members.columns)
    return small.unionByName(x)


def _adapted(forest: DataFrame) -> DataFrame:
    """The forest with each row's region: the shallowest key that is not too crowded.

    Documents that still share a crowded key at full depth are dealt by id into
    parts of about REGION. ``wide`` is the shallowest key of those whose region was
    split: what the parts miss of each other is found by ``_across``.
    """
    out = forest.withColumn("region", F.col(f"k{SHALLOW}")).withColumn("wide", F.lit(None).cast("long"))
    for d in range(SHALLOW + 1, DEPTH + 2):
        crowds = out.groupBy("region").agg(F.count(F.lit(1)).alias("crowd")).filter(F.col("crowd") > REGION)
        crowds = cut(crowds, "crowds")
        if not crowds.limit(1).count():
            break
        parts = F.ceil(F.col("crowd") / REGION)
        key = F.col(f"k{d}") if d <= DEPTH else F.xxhash64("region", F.pmod(F.xxhash64("id"), parts))
        out = out.join(crowds, "region", "left")
        wide = F.when(F.col("crowd").isNull(), F.col("wide")).otherwise(F.col(f"k{SHALLOW}"))
        out = out.withColumn("region", F.when(F.col("crowd").isNull(), F.col("region")).otherwise(key)).withColumn("wide", wide)
        out = cut(out.drop("crowd"), "forest")
    return out.select("region", "wide", "id", "n", "sketch")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=4)
