"""Operators that learn or estimate, against brute force and held-out rows."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import extract, langid, lm_score, near_dedup, passages, queries
from tidemark.llm.dom import blocks
from tidemark.llm.labelled_pages import labelled_pages
from tidemark.llm.lattice import BYTE_MASS, Lattice
from tidemark.operators.components import components

from ..oracle import SF
from .cases import documents, nothing, prose

SF1 = "/root/testdata/sf0.01"


# near copies


def shingles(text, k):
    w = (text or "").encode().lower().split()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def classes(sets, percent=80):
    """Components of the exact similarity graph, by all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    common = Counter()
    for ids in by.values():
        common.update((a, b) for a in ids for b in ids if a < b)
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def near_family(r, n, base, edits):
    """Copies of a text with some words changed."""
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = "new" + str(r.randint(0, 10**6))
        out.append(" ".join(w))
    return out


def check_classes(spark, rows, words=4):
    sets = {i: shingles(t, words) for i, t in rows if i is not None}
    want = classes(sets)
    got = near_dedup.near_duplicates(documents(spark, rows), words=words).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)


def test_near_copies(spark):
    r = random.Random(1)
    texts = [None, "", "  ", "one", "One", "one two", "one two three four", "ONE two three four five", *near_family(r, 60, prose(r, 120), 6)]
    texts += near_family(r, 40, prose(r, 60), 5) + [prose(r, r.randint(1, 200)) for _ in range(60)] + ["same text here and there"] * 9
    rows = list(enumerate(texts, 10)) + [(None, texts[8]), (None, None)]
    r.shuffle(rows)
    check_classes(spark, rows)


def test_crowded_regions_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 12)
    r = random.Random(2)
    rows = list(enumerate(near_family(r, 70, prose(r, 150), 3)))
    check_classes(spark, rows)


def test_parts_of_a_crowded_region_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 8)
    r = random.Random(12)
    base = prose(r, 300).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 90):  # each like the base, but not like one another
        w = list(base)
        for at in range(6, 300, 60):
            w[at + r.randint(0, 45)] = f"own{i}x{at}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 5) for i, t in rows}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    linked = [i for i in sets if i and alike(0, i)]
    assert len(linked) > 60 and sum(alike(a, b) for a in linked for b in linked if a < b) < 40
    check_classes(spark, rows, words=5)


def test_near_copies_without_rows_and_with_repeats(spark):
    assert near_dedup.near_duplicates(nothing(spark)).count() == 0
    r = random.Random(3)
    a, b = prose(r, 40), prose(r, 40)
    got = near_dedup.near_duplicates(documents(spark, [(5, a), (5, a), (9, b), (5, b), (7, prose(r, 30))])).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(5, 5), (5, 5), (5, 5), (7, 7), (9, 5)]


@pytest.mark.parametrize("chunk", [100_000, 17])
def test_components_of_chains_and_stars(spark, monkeypatch, chunk):
    monkeypatch.setattr("tidemark.operators.components.CHUNK", chunk)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(600, 640)] + [(640, 639), (1, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in [500, *range(600, 641)]}


# passages


def test_chains_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = rng.integers(0, 60, 14), rng.integers(0, 60, 14)
        best = [0.0] * 14
        for i in np.lexsort((y, x)):
            best[i] = passages.SEED_WORDS + max([0.0] + [best[j] - passages.GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(14) if x[j] < x[i] and y[j] < y[i]])
        c = passages.chain(x, y)[0]
        score = passages.SEED_WORDS * len(c) - passages.GAP * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
        assert score == pytest.approx(max(best))


def test_alignment():
    a = np.arange(100)
    b = np.concatenate([[900, 901], a[10:30], [700], a[31:60], [800, 801]])
    s, e, p, q, equal = passages.align(a, b, [12, 20, 40], [4, 12, 32])
    assert (s, e, p, q) == (10, 60, 2, 52) and equal == 49


def test_passages(spark):
    r = random.Random(5)
    shared, fuzzy = prose(r, 80), prose(r, 90)
    rows = [(i, prose(r, 40) + " " + shared + " " + prose(r, 30)) for i in range(10, 16)]
    rows += [(i, prose(r, 25) + " " + near_family(r, 1, fuzzy, 4)[0] + " " + prose(r, 20)) for i in range(20, 26)]
    rows += [(30, prose(r, 200)), (31, prose(r, 60)), (40, "x " + shared), (41, "X  " + shared), (42, "x " + shared), (50, None), (51, ""), (None, shared), (60, " ".join(shared.split()[:30]) + " " + prose(r, 50))]
    rows += [(70, "la " * 400), (71, "la " * 300)]
    got = passages.shared_passages(documents(spark, rows)).collect()
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert {i for i in by if i < 70} == {11, 12, 13, 14, 15, 21, 22, 23, 24, 25, 40, 41, 42}
    # a long seed near the passage's end may first be sampled in a later document than the first
    assert all(any(x.other_id == 10 for x in by[i]) for i in range(11, 16))
    assert all(x.end - x.start == 80 and x.similarity == 1.0 for i in range(11, 16) for x in by[i])
    assert all(x.passage_end - x.passage_start >= 85 for i in range(21, 26) for x in by[i])
    assert [(x.kind, x.other_id) for x in by[41]] == [("copy", 40)]
    assert passages.shared_passages(nothing(spark)).count() == 0


def test_passages_apart_in_both_documents(spark):
    r = random.Random(11)
    rows, want = [], {}
    for k, (size, one, two) in enumerate([(60, 40, 40), (60, 100, 100), (60, 0, 100), (100, 100, 100), (200, 200, 200)]):
        p, q = prose(r, size), prose(r, size)
        for i, gap in ((2 * k, one), (2 * k + 1, two)):
            rows.append((i, " ".join([prose(r, 30), p, prose(r, gap), q, prose(r, 30)])))
        want[2 * k + 1] = [(30, 30 + size), (30 + size + two, 30 + 2 * size + two)]
    got = passages.shared_passages(documents(spark, rows)).collect()
    assert all(x.similarity >= passages.SIMILARITY for x in got)
    for i, spans in want.items():
        for s, e in spans:
            assert any(x.doc_id == i and x.passage_start <= s and x.passage_end >= e for x in got), (i, s, e)


def test_passages_of_lines_that_came_before(spark):
    r = random.Random(13)
    shared = prose(r, 60).split()  # all its short runs occur in earlier documents
    rows = [(i, " ".join([prose(r, 40), *shared[10 * i : 10 * i + 14], prose(r, 40)])) for i in range(6)]
    rows += [(i, " ".join([prose(r, 30), *shared, prose(r, 30)])) for i in (10, 11)]
    got = passages.shared_passages(documents(spark, rows)).collect()
    assert any(x.doc_id == 11 and x.other_id == 10 and x.passage_start <= 30 and x.passage_end >= 90 for x in got)


def test_passages_of_many_changed_words(spark):
    r = random.Random(14)
    rows = []
    for k in range(40):
        one = prose(r, 80).split()
        two = list(one)
        for at in r.sample(range(80), 12):
            two[at] = f"new{k}x{at}"
        rows += [(i, " ".join([prose(r, 30), *w, prose(r, 30)])) for i, w in ((2 * k, one), (2 * k + 1, two))]
    got = {x.doc_id for x in passages.shared_passages(documents(spark, rows)).collect() if x.other_id == x.doc_id - 1}
    assert len(got) >= 38


def test_passages_find_every_exact_repeat(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    have = defaultdict(set)
    for x in passages.query(spark, SF).collect():
        have[x.doc_id].update(range(x.passage_start, x.passage_end))
    first, texts = {}, {x.doc_id: (x.text or "").encode().lower().split() for x in docs.collect()}
    for i in sorted(texts):
        w = texts[i]
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) != i:
                assert have[i] >= set(range(j, j + 50))


def test_two_documents_and_pairs_of_very_many_matches(spark):
    r = random.Random(21)
    shared, long = prose(r, 60), prose(r, 40_000)
    rows = [(1, prose(r, 20) + " " + shared), (2, shared + " " + prose(r, 20))]
    got = passages.shared_passages(documents(spark, rows).coalesce(1)).collect()
    assert [(x.doc_id, x.other_id, x.passage_start, x.passage_end) for x in got] == [(2, 1, 0, 60)]
    rows = [(1, long), (2, long + " more"), (3, "other " + long[: len(long) // 2])]
    got = {x.doc_id: x for x in passages.shared_passages(documents(spark, rows).coalesce(1)).collect()}
    assert (got[2].passage_start, got[2].passage_end) == (0, 40_000) and got[3].passage_end >= 19_990


def test_gaps_of_any_length(spark):
    r = random.Random(22)
    rows = []
    for k, gap in enumerate([20, 60, 100, 150, 200, 300, 600, 1000]):
        p, q = prose(r, 200), prose(r, 200)
        rows += [(2 * k + i, " ".join([p, prose(r, gap), q])) for i in (0, 1)]
    have = defaultdict(set)
    for x in passages.shared_passages(documents(spark, rows)).collect():
        have[x.doc_id].update(range(x.passage_start, x.passage_end))
    for k, gap in enumerate([20, 60, 100, 150, 200, 300, 600, 1000]):
        assert have[2 * k + 1] >= {*range(200), *range(200 + gap, 400 + gap)}


def test_passages_within_a_document(spark):
    r = random.Random(23)
    shared = prose(r, 80)
    rows = [(1, " ".join([shared, prose(r, 30), shared])), (2, prose(r, 90)), (3, "la " * 3000)]
    assert passages.shared_passages(documents(spark, rows)).count() == 0
    got = {x.doc_id: x for x in passages.shared_passages(documents(spark, rows), within=True).collect()}
    assert (got[1].other_id, got[1].passage_start, got[1].passage_end) == (1, 110, 190) and 2 not in got


def test_seeds_of_very_many_documents(spark, monkeypatch):
    monkeypatch.setattr(passages, "GATHERED", 200)
    monkeypatch.setattr(passages, "BUCKET", 100)
    r = random.Random(24)
    shared = prose(r, 70)
    rows = [(i, " ".join([prose(r, 30), shared, prose(r, 10), shared])) for i in range(60)]
    have = defaultdict(set)
    for x in passages.shared_passages(documents(spark, rows)).collect():
        assert x.other_id < x.doc_id
        have[x.doc_id].update(range(x.passage_start, x.passage_end))
    assert set(have) == set(range(1, 60)) and all(v >= {*range(30, 100), *range(110, 180)} for v in have.values())


def test_passages_of_changed_words_whose_runs_came_before(spark):
    r = random.Random(25)
    rows, links = [], []
    for k in range(12):
        one = prose(r, 70).split()
        two = list(one)
        for i in range(9, 70, 12):  # runs of 11 words between changed ones
            two[i] = f"other{k}x{i}"
        # each run occurs before, in documents of their own; in the last families too often for all pairs
        times = 1 if k < 6 else passages.NEAR + 4
        for i in range(10, 70, 12):
            rows += [(1000 * k + 20 * i + n, " ".join([prose(r, 30), *one[i : i + 11], prose(r, 30)])) for n in range(times)]
        a, b = 100_000 + 2 * k, 100_001 + 2 * k
        rows += [(a, " ".join([prose(r, 20), *one, prose(r, 20)])), (b, " ".join([prose(r, 20), *two, prose(r, 20)]))]
        links.append((b, a))
    got = [(x.doc_id, x.other_id) for x in passages.shared_passages(documents(spark, rows)).collect() if x.passage_end - x.passage_start >= 60]
    assert set(got) == set(links)


def test_matched_occurrences_of_seeds():
    r = random.Random(26)
    seeds = np.array([r.choice([1, 2, 3, 3, 3, 3]) for _ in range(120)], dtype=np.uint64)
    seeds[np.flatnonzero(seeds == 1)[passages.NEAR :]] = 2
    around = np.array([(r.randrange(9) << 32) + r.randrange(9) for _ in seeds], dtype=np.uint64)
    ids, at = np.array([r.randrange(50) for _ in seeds]), np.array(r.sample(range(1000), len(seeds)))
    got = set(zip(*(c.tolist() for c in passages._partners(seeds, ids, at, around)), strict=True))
    want = set()
    keys = [lambda i: (seeds[i],), lambda i: (seeds[i], "l", around[i] >> 32), lambda i: (seeds[i], "r", around[i] % 2**32), lambda i: (seeds[i], around[i])]
    for n, key in enumerate(keys):
        groups = defaultdict(list)
        for i in sorted(range(len(seeds)), key=lambda i: (ids[i], at[i])):
            groups[key(i)].append(i)
        for (seed, *_), g in groups.items():
            if not n or (seeds == seed).sum() > passages.NEAR:
                want |= {(i, g[0]) for i in g[1:]} | ({(i, j) for k, i in enumerate(g) for j in g[:k]} if len(g) <= passages.NEAR else set())
    assert got == want


# extraction


def test_extraction_of_unseen_layouts():
    model, right, total = extract.trained(), 0, 0
    for html, main in labelled_pages(150, 4242):
        page = blocks(html)
        for b, y in zip(page, model.decode(page), strict=True):
            right += y == (b.text in main)
            total += 1
    assert right / total > 0.99


def small_pages():
    r = random.Random(31)
    out = []
    for html, main in labelled_pages(30, 77):
        page = blocks(html)
        lo = r.randrange(max(1, len(page) - 6))
        page = page[lo : lo + 6]
        if page:
            out.append((page, [int(b.text in main) for b in page]))
    return out


def labelling_score(model, page, labels):
    total = model.start[labels[0]]
    for fs, y in zip(extract._features(page), labels, strict=True):
        total += sum(model.weights.get(f, (0.0, 0.0))[y] for f in fs)
    return total + sum(model.moves[a][b] for a, b in zip(labels, labels[1:], strict=False))


def test_decoding_is_the_best_of_all_labellings():
    model = extract.trained()
    for page, _ in small_pages():
        best = max(itertools.product((0, 1), repeat=len(page)), key=lambda ys: labelling_score(model, page, ys))
        assert labelling_score(model, page, model.decode(page)) == pytest.approx(labelling_score(model, page, best))


def test_fit_is_a_maximum_of_the_likelihood(monkeypatch):
    monkeypatch.setattr(extract, "STEPS", 600)
    pages = small_pages()
    model = extract.Chain.fit(pages)

    def objective(m):
        total = 0.0
        for page, labels in pages:
            scores = [labelling_score(m, page, ys) for ys in itertools.product((0, 1), repeat=len(page))]
            total += labelling_score(m, page, labels) - np.logaddexp.reduce(scores)
        squares = sum(u * u + v * v for u, v in m.weights.values()) + sum(x * x for row in m.moves for x in row)
        return total / len(pages) - extract.PENALTY * squares / 2

    best, rng = objective(model), np.random.default_rng(5)
    for _ in range(20):
        moved = {f: (u + 0.05 * a, v + 0.05 * b) for (f, (u, v)), (a, b) in zip(model.weights.items(), rng.normal(size=(len(model.weights), 2)), strict=True)}
        assert objective(extract.Chain(moved, model.moves, model.start)) < best
        moves = [[x + 0.2 * rng.normal() for x in row] for row in model.moves]
        assert objective(extract.Chain(model.weights, moves, model.start)) < best + 1e-4


def test_leaf_blocks():
    page = blocks("<title>t</title><p>a<b>b</b>c&nbsp;&amp;lt; <br>d<li>x<p>y</li>1 < 2<script>s</scripty></script><div>z&eacute; <!-- c --> w</div><!-- open")
    assert [b.text for b in page] == ["abc &lt; d", "x", "y", "1 < 2", "zé w"]
    assert blocks("<" * 5000 + "a" * 10)[0].text.endswith("aaa")
    assert [b.text for b in blocks("<div>" * 3000 + "deep")] == ["deep"]


def test_extraction_rows(spark):
    article = "<html><body><nav><a href=x>Home</a></nav><article><h1>A title</h1><p>Some text of it.</p></article><footer>&copy; z</footer></body></html>"
    rows = [(1, "u", article, "n"), (2, None, None, "n"), (3, "v", "", "n"), (None, "w", article, "n"), (1, "u", article, "n"), (4, "k", "<script>only</script>", "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract.extract_text(df).collect()), key=repr)
    text = "A title\nSome text of it."
    assert got == sorted([(1, "u", text, 24), (2, None, "", 0), (3, "v", "", 0), (None, "w", text, 24), (1, "u", text, 24), (4, "k", "", 0)], key=repr)
    assert extract.extract_text(df.limit(0)).count() == 0


# language


def test_language_on_held_out_rows(spark):
    got = queries.queries()["op5_langid"](spark, SF1).filter("held_out").join(spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 100 and sum(x.lang == x.lang_pred for x in got) / len(got) > 0.97
    assert all(0 <= x.score <= 1 for x in got)


def test_language_of_awkward_rows(spark):
    r = random.Random(1)
    train = [(i, prose(r, 50), "la") for i in range(20)] + [(100 + i, "zzz qqq xxx " * 20, "zz") for i in range(20)] + [(200, None, "la"), (201, "x", None)]
    profiles = langid.learn(documents(spark, train))
    assert set(profiles) == {"la", "zz"}
    rows = [(1, prose(r, 40)), (2, "qqq zzz"), (3, None), (4, ""), (5, "½ ² Ⅷ ① 12 34 !!"), (6, "x"), (None, "qqq"), (7, "— “”"), (8, "zzz " * 30000)]
    got = {x.doc_id: x for x in langid.identify(documents(spark, rows), profiles).collect()}
    assert got[1].lang_pred == "la" and got[2].lang_pred == got[8].lang_pred == "zz"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 7))
    assert langid.identify(documents(spark, rows), {}).filter("lang_pred <> 'und'").count() == 0
    assert langid.learn(nothing(spark)) == {}
    clash = documents(spark, rows).withColumn("body", F.col("text")).withColumn("text", F.lit(1))
    clash = langid.identify(clash, profiles, text_col="body").collect()
    assert {x.doc_id: x.lang_pred for x in clash} == {i: x.lang_pred for i, x in got.items()}


def test_bundles_are_sums_of_bound_letters():
    one, two, three = langid._letters()
    codes = langid._codes(b"Abc, d\xc3\xa9 ")
    s = langid.LETTERS
    want = sum(three[c // s // s] * two[c // s % s] * one[c % s] for c in codes)
    got = langid._bundle(np.bincount(codes, minlength=s**3))
    assert (got == want).all()


# language model


def test_lattice_against_all_segmentations():
    pieces = [b" a", b"a", b"b", b"ab", b" ab", "é".encode()]
    p = dict(zip(pieces, [0.1, 0.2, 0.2, 0.3, 0.15, 0.049], strict=True))
    lattice = Lattice(pieces, np.log(list(p.values())))

    def walk(w):
        if not w:
            return 1.0
        total = sum(p[x] * walk(w[len(x) :]) for x in pieces if w.startswith(x))
        return total + BYTE_MASS / 256 * walk(w[1:])

    words = [b"abab", b"a", b"ba", b"x", "éa".encode(), b"ababab"]
    assert lattice.log_prob(words) == pytest.approx([math.log(walk(b" " + w)) for w in words])
    assert lattice.expected([b"ab"], np.array([2.0])).sum() == pytest.approx(2 * (0.15 * 1 + 0.1 * 0.2 * 2) / 0.17, rel=1e-3)


def test_scores(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (None, "The the THE"), (10**6 + 2, "w" * 5000), (10**6 + 3, "é\xa0É ﬀ"), (rows[0][0], rows[0][1])]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = lambda t: (t or "").encode().lower().split()
    c, ends = Counter(), 0
    for i, t in rows:
        if crc(i) != 1:
            c.update(tokens(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    c[b""] = ends
    from tidemark.llm.common import crc_mod

    got = defaultdict(list)
    for x in lm_score.score(documents(spark, rows), learn=crc_mod(F.col("doc_id"), 5) != 1).collect():
        got[x.doc_id].append(x)
    for i, t in rows:
        ws = [*tokens(t), b""]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        for x in got[i]:
            assert (x.n_tokens, x.n_known, x.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
            assert x.base_score == pytest.approx(base) and -1e6 < x.score < 0


def test_score_is_the_sum_over_all_paths(spark, monkeypatch):
    pieces = [b" a", b"a", b"b", b"ab", b" ab", b"ba"]
    prior = np.log(np.array([0.1, 0.2, 0.2, 0.25, 0.15, 0.1]) * (1 - BYTE_MASS))
    monkeypatch.setattr(lm_score, "load_pieces", lambda path: (pieces, prior))

    def paths(w):
        """(probability, pieces) of every segmentation of the bytes w."""
        if not w:
            return [(1.0, ())]
        out = [(BYTE_MASS / 256 * x, used) for x, used in paths(w[1:])]
        for k, piece in enumerate(pieces):
            if w.startswith(piece):
                out += [(p[k] * x, (k, *used)) for x, used in paths(w[len(piece) :])]
        return out

    texts = ["ab ba ab abba", "a AB b ab", "abab ba", "bb ab abba x", "", None]
    rows = list(enumerate(texts))
    learn = [0, 1, 4]
    words = [(t or "").lower().split() for t in texts]
    c = Counter(w for i in learn for w in words[i])
    p = np.exp(prior)
    e = np.zeros(len(pieces))
    for w in c:  # each word once
        found = paths(b" " + w.encode())
        total = sum(x for x, _ in found)
        for x, used in found:
            for k in used:
                e[k] += x / total
    p = (e + lm_score.PRIOR * np.exp(prior)) / (e.sum() + lm_score.PRIOR * np.exp(prior).sum()) * (1 - BYTE_MASS)
    n, ends = sum(c.values()), len(learn)
    stop = (ends + 0.5) / (n + ends + 1)

    def score(ws):
        total = math.log10(stop)
        for w in ws:
            spelt = lm_score.DISCOUNT * len(c) / n * sum(x for x, _ in paths(b" " + w.encode()))
            total += math.log10((1 - stop) * (max(c[w] - lm_score.DISCOUNT, 0) / n + spelt))
        return total

    got = lm_score.score(documents(spark, rows), learn=F.col("doc_id").isin(learn)).collect()
    want = {i: score(ws) for i, ws in enumerate(words)}
    assert {x.doc_id: x.score for x in got} == pytest.approx(want, rel=1e-6)
    p = np.exp(prior)
    plain = {i: sum(math.log10(sum(x for x, _ in paths(b" " + w.encode()))) for w in ws) for i, ws in enumerate(words)}
    assert {x.doc_id: x.lattice_score for x in got} == pytest.approx(plain, rel=1e-6)


def test_scores_without_rows_or_learning(spark):
    assert lm_score.score(nothing(spark)).count() == 0
    got = lm_score.score(documents(spark, [(1, "hello world"), (2, None)]), learn=F.lit(False)).collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 and x.score < 0 for x in got)


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes
        rows = {r.doc_id: r for r in out.collect()}
        seen[name] = rows
        docs = spark.createDataFrame(list(rows.values()), out.schema)
    assert set(seen["line_dedup"]) == set(seen["language_id"])
    want = classes({i: shingles(r.text, 5) for i, r in seen["line_dedup"].items()})
    assert set(seen["near_dedup"]) == {i for i, c in want.items() if i == c}
    assert set(seen["decontaminate"]) <= set(seen["near_dedup"])
    assert set(seen["mixing"]) == set(seen["decontaminate"])
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: r.taken for i, r in seen["mixing"].items()}


def test_pipeline_drops_what_it_should(spark):
    r = random.Random(4)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    a = prose(r, 80)
    rows = [(1, None, "en"), (2, "123 !", "en"), (3, a, "en"), (4, a + " more", "en"), (5, prose(r, 30) + " " + bench, "en"), (6, prose(r, 50), None), (6, prose(r, 50), None)]
    docs = documents(spark, rows, extra=False)
    one = corpus_pipeline.language_id(spark, docs, SF)
    assert sorted(x.doc_id for x in one.collect()) == [3, 4, 5, 6, 6] and one.filter("lang IS NULL").count() == 0
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, one, SF).collect()) == [3, 5, 6]
    assert sorted(x.doc_id for x in corpus_pipeline.drop_contaminated(spark, one, SF).collect()) == [3, 4, 6, 6]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing(spark), SF).count() == 0
