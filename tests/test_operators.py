import datetime as dt
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import groups, integrity, ledger, perf, policy, repair, sessions, texts, xsec
from tidemark.plans import registry
from tidemark.plans import repair as plan_repair
from tidemark.plans import texts as plan_texts
from tidemark.sources import sinks
from tidemark.streaming import ingest

from .oracle import SF, compare, connect

DAY = dt.date(2024, 1, 1)


def days(*ns):
    return [DAY + dt.timedelta(n) for n in ns]


def test_percentiles_of_a_population_average_to_one_half(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(k, float(r.choice((1, 2, 3)) if k % 2 else r.random())) for k in range(60)], "k int, v double")
    df = df.withColumn("g", F.col("k") % 3)
    got = df.withColumn("f", xsec.percentile_fraction("v", ["g"])).groupBy("g").agg(F.avg("f").alias("m"), F.min("f").alias("lo"), F.max("f").alias("hi"))
    for row in got.collect():
        assert row.m == pytest.approx(0.5)
        assert 0 < row.lo <= row.hi < 1


def test_composite_counts_missing_legs_with_their_weight(spark):
    legs = spark.createDataFrame(
        [(1, "a", "p", "thesis_linkage", 1.0, 0.2), (1, "a", "p", "health", None, 0.2), (2, "a", "p", "health", None, 0.2)],
        "security_id int, cohort string, parent string, leg string, z double, weight double",
    )
    got = {r.security_id: r for r in xsec.composite(legs).collect()}
    assert got[1].composite == pytest.approx(0.5)
    assert got[1].coverage == 0.5
    assert got[2].composite is None


def test_streaks_and_gaps(spark):
    df = spark.createDataFrame([("a", d, s) for d, s in zip(days(0, 1, 2, 3, 4), [True, True, False, True, None], strict=True)], "k string, d date, s boolean")
    got = [r.streak for r in sessions.streaks(df, F.col("s"), "k", "d").orderBy("d").collect()]
    assert got == [1, 2, 0, 1, 0]


def test_as_of_join_takes_the_last_value_not_too_old(spark):
    left = spark.createDataFrame([("a", d) for d in days(0, 5, 20)] + [("b", DAY)], "k string, d date")
    right = spark.createDataFrame([("a", days(1)[0], 1.0), ("a", days(5)[0], 2.0)], "k string, d date, v double")
    got = {(r.k, r.d): r.as_of_value for r in sessions.as_of_join(left, right, "k", "d", "v", max_age=7).collect()}
    assert got == {("a", days(0)[0]): None, ("a", days(5)[0]): 2.0, ("a", days(20)[0]): None, ("b", DAY): None}


def test_sessions_strictly_between(spark):
    cal = sessions.calendar(spark.createDataFrame([(d,) for d in days(0, 1, 4, 8)], "session_date date"))
    rows = spark.createDataFrame([(1, *days(0, 8)), (2, *days(1, 2)), (3, *days(-3, 20)), (4, *days(8, 0))], "k int, s date, e date")
    got = {r.k: r.between for r in sessions.strictly_between(cal, rows, "s", "e").collect()}
    assert got == {1: 2, 2: 0, 3: 4, 4: 0}


def test_pearson_is_null_without_variance(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 5.0), ("c", 1.0, 2.0), ("c", 2.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.r for r in perf.pearson(df, "x", "y", ["g"], "r").collect()}
    assert got["a"] is None and got["b"] is None
    assert got["c"] == pytest.approx(-1.0)


def test_fixed_draws():
    rng = perf.SplitMix(0)
    assert [rng.draw() for _ in range(2)] == [16294208416658607535, 7960286522194355700]
    assert sorted(perf.SplitMix(9).shuffled(20)) == list(range(20))
    assert perf.SplitMix(9).shuffled(20) == perf.SplitMix(9).shuffled(20)


def test_non_overlapping_is_greedy(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 4, 5, 6, 9)], "k string, n int")
    assert sorted(r.n for r in perf.non_overlapping(df, "k", "n", 3).collect()) == [1, 4, 9]


def test_lots_match_a_walk_with_overselling(spark):
    r = random.Random(3)
    rows, lots = [], defaultdict(list)
    for i in range(300):
        k, side, q = r.choice("abc"), r.choice(("BUY", "BUY", "SELL")), float(r.randint(1, 9))
        rows.append((i, k, side, q))
        if side == "BUY":
            lots[k].append([i, q])
            continue
        while q > 0 and lots[k]:
            take = min(q, lots[k][0][1])
            q -= take
            lots[k][0][1] -= take
            if lots[k][0][1] <= 0:
                lots[k].pop(0)
    df = spark.createDataFrame(rows, "id int, k string, side string, quantity double")
    got = {x.id: x.rest for x in ledger.open_lots(df, ["k"], ["id"]).collect()}
    assert got == {i: q for own in lots.values() for i, q in own}


def test_corrections_hide_their_targets(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "id string, corrects string")
    assert {r.id for r in ledger.effective(df).collect()} == {"c", "d"}


def test_values_are_inherited_along_chains(spark):
    rows = [("a", None, 1.0), ("b", "a", None), ("c", "b", None), ("d", "c", 2.0), ("e", "d", None), ("x", "y", None), ("y", "x", None), ("z", "gone", None)]
    df = spark.createDataFrame(rows, "id string, corrects string, v double")
    got = {r.id: r.v for r in ledger.inherited(df, "v").collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 2.0, "e": 2.0, "x": None, "y": None, "z": None}


def test_allocation_keeps_to_its_budgets(spark):
    r = random.Random(1)
    rows = [
        (p, i, r.choice(("BUY", "ADD", "SELL")), r.randint(50, 99), r.choice(("STRENGTHENING", "STABLE")), float(r.randint(500, 9000)), 20.0, float(r.randint(0, 14)), r.choice("xy"), r.choice(("g", None)), r.choice((None, 0.2, 0.5)), 1e6)
        for p in range(3)
        for i in range(12)
    ]
    cols = "portfolio int, security_id int, action string, percentile int, direction string, requested double, cost double, weight double, cohort string, grp string, volatility double, daily_value double"
    lim = policy.Limits()
    got = policy.allocate(spark.createDataFrame(rows, cols), "portfolio", lim).collect()
    for p in range(3):
        buys = [x for x in got if x.portfolio == p and x.action != "SELL"]
        assert sum(x.allocated for x in buys) <= lim.total * lim.turnover / 100 + 1e-6
        assert all(x.allocated == 0 or x.allocated >= lim.least for x in buys)
        assert all(x.weight + x.allocated / lim.total * 100 <= lim.position + 1e-9 for x in buys)
        assert all(x.allocated == x.requested for x in got if x.portfolio == p and x.action == "SELL")


def test_draws_at_once_are_those_one_by_one():
    for seed in (0, 9, 2**64 - 5):
        a, b = perf.SplitMix(seed), perf.SplitMix(seed)
        assert a.draws(50).tolist() == [b.draw() for _ in range(50)]
        bounds = np.array([1, 2, 3, 10, 2**63 + 1, 7])  # half of the draws are refused for the large one
        assert a.below_each(bounds.astype(np.uint64)).astype(np.uint64).tolist() == [b.below(int(k)) for k in bounds]
        assert a.shuffles(5, 9).tolist() == [b.shuffled(9) for _ in range(5)] and a.state == b.state


def test_bootstrap_and_random_band_one_by_one(spark):
    r = random.Random(8)
    rows = [("s", i, r.gauss(0.1, 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, d int, x double")
    got = perf.bootstrap(df, "x", "k", "d", 3, replicates=60).first()
    x, rng, means = [v for _, _, v in rows], perf.SplitMix(perf.seed_of("s:3")), []
    for _ in range(60):
        taken = [v for _ in range(14) for s in [rng.below(38)] for v in x[s : s + 3]][:40]
        means.append(sum(taken) / 40)
    assert (got.n, got.point) == (40, pytest.approx(sum(x) / 40))
    assert [got.low, got.high] == pytest.approx(np.quantile(means, [0.025, 0.975]).tolist()) and got.se == pytest.approx(np.std(means, ddof=1))
    got = perf.random_band(df, "x", "k", "d", replicates=30).first()
    rank, rng = np.argsort(np.argsort(x)), perf.SplitMix(perf.seed_of("s"))
    ics = [np.corrcoef(rng.shuffled(40), rank)[0, 1] for _ in range(30)]
    assert [got.mean, got.std, got.p95] == pytest.approx([np.mean(ics), np.std(ics, ddof=1), np.quantile(np.abs(ics), 0.95)])


def test_allocation_counts_what_is_held(spark):
    fields = "p string, security_id long, action string, percentile int, direction string, requested double, cost double, weight double, cohort string, grp string, cohort_weight double, volatility double, daily_value double"
    rows = [("p", 1, "BUY", 90, "STABLE", 8000.0, 10.0, 0.0, "c", None, 33.0, None, 1e9), ("p", 2, "BUY", 80, "STABLE", 2000.0, 10.0, 0.0, "d", None, None, None, 1e9)]
    got = {x.security_id: (x.allocated, x.bound) for x in policy.allocate(spark.createDataFrame(rows, fields), "p").collect()}
    assert got == {1: (pytest.approx(2000.0), "cohort"), 2: (2000.0, "")}


def test_dedupe_keeps_the_last(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("b", 1, 2)], "k string, d int, id int")
    kept, lost = integrity.dedupe_bars(df, ("k", "d"), ("id",))
    assert {r.id for r in kept.collect()} == {7, 2}
    assert {r.id for r in lost.collect()} == {5}


def test_groups_are_connected_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a int, b int")
    got = {r.node: r.label for r in groups.linked_groups(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_groups_and_chains_of_any_length(spark, monkeypatch):
    path = spark.createDataFrame([(i, i + 1) for i in range(1000)], "a int, b int")
    assert {r.label for r in groups.linked_groups(path).collect()} == {0}
    monkeypatch.setattr("tidemark.operators.components.CHUNK", 100)
    assert {r.label for r in groups.linked_groups(path.union(spark.createDataFrame([(5000, 5001)], path.schema))).collect()} == {0, 5000}
    rows = [(str(i), str(i - 1) if i else None, 7.0 if i == 0 else None) for i in range(1000)] + [("x", "y", None), ("y", "x", None), ("z", "x", None)]
    got = {r.id: r.fees for r in ledger.inherited(spark.createDataFrame(rows, "id string, corrects string, fees double"), "fees").collect()}
    assert got == {str(i): 7.0 for i in range(1000)} | {"x": None, "y": None, "z": None}


def test_wide_fractions_and_tests_by_parts(spark):
    r = random.Random(3)
    rows = [(i, f"g{i % 2}", None if i % 17 == 0 else round(r.random() ** 3, 2 if i % 3 else 6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    plain = df.withColumn("f", xsec.percentile_fraction("x", ["g"]))
    want = {x.id: x.f for x in plain.collect()}
    got = {x.id: x.f for x in xsec.wide_fraction(df, "x", ("g",), "f").collect()}
    assert got == pytest.approx(want)
    p = sorted((x, i) for i, g, x in rows if g == "g0" and x is not None)
    q, last, m = {}, 0, len(p)
    for k in range(m, 0, -1):
        q[p[k - 1][1]] = min(1.0, p[k - 1][0] * m / k, q[p[k][1]] if k < m else 1.0)
        last = max(last, k if p[k - 1][0] <= k / m * 0.05 else 0)
    got = {x.id: x for x in perf.benjamini_hochberg(df.filter("g = 'g0'"), "x", ["g"], "id").collect()}
    assert {i: x.q for i, x in got.items()} == pytest.approx(q)
    assert {i for i, x in got.items() if x.significant} == {i for _, i in p[:last]} and last


def test_correlations_by_blocks(spark, monkeypatch):
    r = random.Random(4)
    rows = [(s, d, r.gauss(0, 1)) for s in range(30) for d in range(25) if r.random() < 0.95]
    df = spark.createDataFrame(rows, "s long, d int, x double")
    one = {(x.a, x.b): (x.n, x.r) for x in groups.pair_correlations(df, "s", "d", "x").collect()}
    monkeypatch.setattr(groups, "BLOCK", 4)
    many = {(x.a, x.b): (x.n, x.r) for x in groups.pair_correlations(df, "s", "d", "x").collect()}
    by = {(s, d): x for s, d, x in rows}
    for a in range(30):
        for b in range(a + 1, 30):
            both = [(by[a, d], by[b, d]) for d in range(25) if (a, d) in by and (b, d) in by]
            if len(both) >= 20:
                assert one[a, b][0] == many[a, b][0] == len(both)
                assert one[a, b][1] == pytest.approx(np.corrcoef(*zip(*both, strict=True))[0, 1]) == pytest.approx(many[a, b][1])


def test_a_second_repair_rewrites_no_verified_series(spark):
    again = repair.plan(repair.applied(plan_repair._plan(spark, SF).filter("NOT array_contains(codes_now, 'DUPLICATE_BAR')"), 1), plan_repair.HORIZONS)
    assert again.filter("new_adjusted IS NOT NULL AND verified").count() == 0


def test_sections_against_every_pair_of_places():
    r = random.Random(0)
    lines = {
        "10-K": ["Item 1. Business", "Item 1A. Risk Factors", "Item 7. Management's Discussion of things", "Item 2. Properties"],
        "10-Q": ["Item 2. Management's discussion", "Results of Operations", "Item 1A. Risk factors", "Item 3. q"],
        "S-1": ["Business", "Risk Factors", "Use of Proceeds", "Item 4. z"],
    }
    for _ in range(600):
        form = r.choice(list(lines))
        body = "\n".join(r.choice(lines[form]) if r.random() < 0.4 else "w" * r.randint(1, 9) for _ in range(r.randint(1, 14)))
        starts = sorted((m.start(), i) for i, ps in texts.HEADINGS[form].items() for p in ps for m in re.finditer(p, body, re.I | re.M))
        ends = {m.start() for m in re.finditer(r"^\s*item\s*\d+[a-z]?\.?", body, re.I | re.M)} | {len(body)} | ({a for a, _ in starts} if form == "S-1" else set())
        longest = {}
        for a, i in starts:
            found = body[a : min(e for e in ends if e > a)]
            if i not in longest or len(found.strip()) > len(longest[i][1].strip()):
                longest[i] = (a, found)
        a, found = longest.get("mda", (0, ""))
        want = [(i, x.strip()) for i, (b, x) in sorted(longest.items(), key=lambda x: x[1][0]) if not (i == "results_of_operations" and a <= b < a + len(found))]
        assert texts.sections_of(form, body) == want


def test_sections_skip_the_table_of_contents():
    text = "Item 1. Business\nItem 1A. Risk Factors\nItem 1. Business\nwe make things\nItem 1A. Risk Factors\nfire, water\nItem 2. Properties\nnone"
    assert texts.sections_of("10-K", text) == [("item_1_business", "Item 1. Business\nwe make things"), ("item_1a_risk_factors", "Item 1A. Risk Factors\nfire, water")]
    assert texts.sections_of("8-K", text) == []
    assert texts.sections_of("10-K", None) == []


def test_sections_of_whole_documents(spark):
    want = {}
    for x in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if x.text is None:
            continue
        t = re.sub(r"[\x20\x09-\x0D]+", " ", x.text).strip(" ")
        n = -(-len(t) // 3)
        toc = "Item 1. Business\nItem 1A. Risk Factors\nItem 7. Management's Discussion\n"
        body = f"{toc}Item 1. Business\n{t[:n]}\nItem 1A - Risk Factors\n{t[n : 2 * n]}\nItem 2. Properties\nnone\nItem 7. Management's Discussion\n{t[2 * n :]}"
        left = 300_000
        for pos, (item, text) in enumerate(texts.sections_of("10-K", body)):
            if left > 0:
                want[x.doc_id, pos] = (item, min(left, len(text)))
                left -= len(text)
    got = {(x.doc_id, x.pos): (x.item, x.n_chars) for x in plan_texts.filing_sections(spark, SF).collect()}
    assert got == want and max(n for _, n in got.values()) > 450


def test_plain_text():
    assert texts.plain_text("no tags < 1") == "no tags < 1"
    assert texts.plain_text("<head>x</head><p>a&amp;b  <b>c</b></p><script>d</script><div>e</div>") == "a&b c\ne"
    assert texts.plain_text(None) is None


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("s", 1, 8, False), ("s", 2, 5, False), ("s", 3, 2, True), ("s", 4, 1, True)], "k string, r int, c int, v boolean")
    got = {r.r: r.kept for r in texts.packed(df, "k", "r", "c", "v", 10, 1).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_stream_equals_one_batch(spark, tmp_path):
    rows = [(f"k{n % 7}", n * 37 % 50, n) for n in range(60)]
    df = spark.createDataFrame(rows, "id string, at int, v int")
    for part in range(3):
        df.filter(F.col("v") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.stream_upserts(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), "id", "at")
    got = {r.id: r.at for r in ingest.current(spark, str(tmp_path / "out")).collect()}
    want = {r.id: r.at for r in ingest.apply_batch(None, df, "id", "at").collect()}
    assert got == want
    again = ingest.apply_batch(ingest.apply_batch(None, df, "id", "at"), df, "id", "at")
    assert {r.id: r.at for r in again.collect()} == want


def test_a_stream_rewrites_the_parts_that_it_touches(spark, tmp_path):
    df = spark.createDataFrame([(f"k{n}", n, n) for n in range(200)], "id string, at int, v int")
    df.filter("v < 190").coalesce(1).write.parquet(str(tmp_path / "in"))
    go = lambda: ingest.stream_upserts(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), "id", "at")
    go()
    df.filter("v = 195").withColumn("id", F.lit("k3")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert len(list((tmp_path / "out" / "rows" / "version=1").glob("part=*"))) == 1
    got = {r.id: r.v for r in ingest.current(spark, str(tmp_path / "out")).collect()}
    assert got == {f"k{n}": n for n in range(190)} | {"k3": 195}


def test_partitions_are_replaced_and_exports_have_a_digest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "id int, p string, v double")
    at = str(tmp_path / "t")
    sinks.replace_partitions(df, at, "p")
    sinks.replace_partitions(df.filter("id = 2").withColumn("v", F.lit(9.0)), at, "p")
    assert sorted((r.id, r.p, r.v) for r in spark.read.parquet(at).collect()) == [(2, "a", 9.0), (3, "b", 3.0)]
    one, two = (sinks.export(df.repartition(n), str(tmp_path / f"e{n}"), ["id"]) for n in (1, 3))
    assert one == two != sinks.export(df.limit(2), str(tmp_path / "e9"), ["id"])


@pytest.mark.parametrize("which", ["windows", "dedupe"])
def test_stateful_streams(spark, tmp_path, which):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h // 2), "a", 1.0) for h in range(12)], "ts timestamp, k string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = ingest.windowed_counts(stream, "ts", "k", "2 hours") if which == "windows" else ingest.deduplicated(stream, "ts", ["k", "ts"])
    q = out.writeStream.format("memory").queryName(which).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql(f"SELECT * FROM {which}").collect()
    assert all(r.n == 4 for r in got) if which == "windows" else len(got) == 6


@pytest.fixture(scope="module")
def views(tmp_path_factory):
    """Last views near each limit, whole, below, at and above half a second; and none with a time."""
    sf = tmp_path_factory.mktemp("views")
    near = [dt.datetime(2024, 1, d, 12) for d in (28, 29, 30)] + [dt.datetime(2024, 1, 30)]
    off = (-2_000_000, -1_000_000, -500_001, -500_000, -1, 0, 1, 499_999, 500_000, 500_001, 999_999, 1_500_000, 1_500_001)
    times = [t + dt.timedelta(microseconds=u) for t in near for u in off] + [None]
    rows = [(2 * k + v, t, k, "view" if v else "click") for k, t in enumerate(times) for v in (0, 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", [*rows, (999, DAY, 999, "click")])
    con.execute(f"COPY e TO '{sf}/events.parquet' (FORMAT parquet)")
    return str(sf)


def test_views_of_part_seconds_have_their_state(spark, views):
    compare(spark, *registry.ALL["overview_states"], views)


def test_views_of_part_seconds_are_fetched_again(spark, views):
    compare(spark, *registry.ALL["overviews_to_fetch"], views)


def test_equal_suppliers_tie_however_their_files_are_split(spark, tmp_path):
    con = connect(SF)
    con.execute("SET threads = 1")
    for name, more in (("supplier", ""), ("lineitem", ", ROW_GROUP_SIZE 2048")):
        key = f"{name[0]}_suppkey"
        rows = f"(SELECT *, row_number() OVER () AS n FROM {name}) t ORDER BY i, n"
        con.execute(f"COPY (SELECT t.* EXCLUDE (n) REPLACE ({key} + 1000 * i AS {key}) FROM range(9) r(i), {rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet{more})")
    for name in ("nation", "region"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = registry.ALL["leg_percentiles"][0](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    have = defaultdict(set)
    for x in got:
        have[x.security_id % 1000, x.leg].add((x.fraction, x.percentile))
    assert len(got) == 9 * len(have) and all(len(v) == 1 for v in have.values())
