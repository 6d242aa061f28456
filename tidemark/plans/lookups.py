"""Queries of small rules and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import ledger as L
from tidemark.operators import lookups as U
from tidemark.operators import sessions as N
from tidemark.operators import valuation as V
from tidemark.operators import xsec
from tidemark.sources import decoders as D
from tidemark.sources import frames as fr
from tidemark.sources import sinks

from .feeds import flattened_facts
from .groups import VARIANTS, _variants_sql
from .portfolio import _EV, _LOTS, _ORDER, _effective, _events
from .series import _LONG, _RET, _ics
from .valuation import _MU, _ST, _multiples, _ratios, blended_sql


def prior_sessions(spark, d):
    """The fifth session before each security's last bar, and before a fixed day."""
    b = fr.month_bars(spark, d)
    last = b.groupBy("security_id").agg(F.max("session_date").alias("last_day"))
    x = U.sessions_back(N.calendar(b), last, "last_day", 5)
    x = U.sessions_back(N.calendar(b), x.withColumn("day", F.lit("1999-05-17").cast("date")), "day", 1, "before")
    return x.select("security_id", "last_day", "prior", "before")


def stored_streaks(spark, d):
    """Length of each security's run of falls that ends at its newest bar, over the bars that it has."""
    x = N.with_returns(fr.month_bars(spark, d), (1,))
    x = N.streaks(x, F.col("ret") < 0, "security_id", "session_date")
    return x.groupBy("security_id").agg(F.max_by("streak", "session_date").alias("streak"))


def directions(spark, d):
    """Direction of each price against five sessions back, with a hash of what it rests on."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    x = fr.month_bars(spark, d).withColumn("delta", F.round(F.ln("close") - F.ln(F.lag("close", 5).over(w)), 6)).filter("session_date = DATE '2001-05-01' AND delta IS NOT NULL")
    told = F.concat_ws("|", F.col("security_id"), F.col("session_date"), F.col("volume"), S.direction(F.col("delta")))
    return x.select("security_id", "delta", S.direction(F.col("delta")).alias("direction"), F.sha2(told, 256).alias("package"))


def visible_inputs(spark, d):
    """The three newest orders of each customer that were known by a day, by all of their dates."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("known", F.to_date("o_orderdate"))
    o = o.withColumn("published", F.when(F.pmod("o_orderkey", F.lit(3)) > 0, F.date_add("known", F.pmod("o_orderkey", F.lit(40)).cast("int")))).drop("o_orderdate")
    x = U.visible(o, "o_custkey", "o_orderkey", F.lit("1999-06-30").cast("date"), "known", "published")
    return U.newest(x, "o_custkey", 3, F.desc("known"), F.desc("o_orderkey")).select("o_custkey", "place", "o_orderkey")


def statements_to_fetch(spark, d):
    """Securities whose figures changed since they were verified."""
    x = fr.read(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_tax", "l_shipdate")
    g = x.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.sum("l_tax"), 4).alias("tax"))
    w = Window.partitionBy("l_suppkey").orderBy("y")
    known = F.when(F.pmod("l_suppkey", F.lit(3)) == 0, F.col("y")).otherwise(F.lag("y").over(w))
    g = g.withColumn("known", known).withColumn("last", F.max("y").over(Window.partitionBy("l_suppkey"))).filter("y = last")
    same = U.same_statement(F.col("y"), F.col("known"), (F.col("revenue"), F.col("revenue")), (F.col("tax"), F.col("tax")))
    return g.filter(~same).select("l_suppkey", F.col("y").cast("long").alias("year"))


def position_limits(spark, d):
    """Caps of each customer by the objective of their segment."""
    names = {"AUTOMOBILE": "CAPITAL_PRESERVATION", "BUILDING": "INCOME", "FURNITURE": "BALANCED_GROWTH"}
    c = fr.read(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    objective = F.lit("CAPITAL_GROWTH")
    for k, v in names.items():
        objective = F.when(F.col("c_mktsegment") == k, v).otherwise(objective)
    spendable = F.greatest(F.lit(0.0), F.col("c_acctbal") - 3000)
    return c.select("c_custkey", objective.alias("objective"), U.position_cap(objective, F.lit(11.0)).alias("cap"), F.round(spendable, 2).alias("spendable"))


def health_texts(spark, d):
    """What each security's sub-scores say, the strongest and the weakest of them."""
    parts = ("roic", "net_cash_ratio", "fcf_margin")
    long = _ratios(spark, d).unpivot(["security_id", "cohort", "parent", "cohort_n", "parent_n"], list(parts), "leg", "x")
    z = xsec.blended_zscores(long).withColumn("z", F.round("z", 7))
    g = z.groupBy("security_id").agg(*[F.max(F.when(F.col("leg") == p, F.col("z"))).alias(p) for p in parts], F.max(F.struct("z", "leg")).alias("hi"), F.min(F.struct("z", "leg")).alias("lo"))
    text = F.concat_ws("; ", *[U.sign_text(p, F.col(p)) for p in parts])
    return g.select("security_id", text.alias("text"), F.when(F.col("hi.z") > 0, F.col("hi.leg")).alias("strongest"), F.when(F.col("lo.z") < 0, F.col("lo.leg")).alias("weakest"))


def contribution_deltas(spark, d):
    """Weighted changes of two signals, summed for each security; what is missing counts nothing."""
    x = N.with_returns(fr.month_bars(spark, d), (1,)).filter("session_date = DATE '2001-03-01'")
    price = U.contribution_delta(F.col("ret"), F.when(F.pmod("security_id", F.lit(2)) == 0, 0.6))
    flow = U.contribution_delta(F.when(F.col("volume") % 3 > 0, F.ln("volume")), F.lit(0.4))
    return x.select("security_id", F.round(price, 8).alias("price"), F.round(flow, 8).alias("flow"), F.round(price + flow, 7).alias("total"))


def overview_states(spark, d):
    """Whether each user's last view may be shown for a day."""
    e = fr.read(spark, d, "events", "ts", "user_id", "event_type")
    g = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("cached"))
    return g.select("user_id", U.availability(F.col("cached"), F.lit("2024-01-30 12:00:00").cast("timestamp"), F.lit("2024-01-29").cast("date")).alias("state"))


def performance_page(spark, d):
    """The newest value of each horizon next to its mean and count."""
    x = _ics(spark, d).filter("ic IS NOT NULL")
    g = x.groupBy("horizon").agg(F.max_by("ic", "session_date").alias("last"), F.max("session_date").alias("as_of"), F.avg("ic").alias("mean"), F.count("ic").alias("n"))
    return g.select("horizon", "as_of", "n", F.round("last", 7).alias("last"), F.round("mean", 7).alias("mean"))


def evidence_excerpts(spark, d):
    """The first claim of each source's newest document: a theme if it has one, else a risk."""
    x = fr.read(spark, d, "documents", "doc_id", "source", "text").filter("text IS NOT NULL")
    best = x.groupBy("source").agg(F.max_by(F.struct("doc_id", "text"), "doc_id").alias("b"))
    t = S.squeezed(F.col("b.text"))
    theme = F.regexp_extract(t, "([A-Z][a-z]+ [a-z]+ [a-z]+)", 1)
    return best.select("source", F.col("b.doc_id").alias("doc_id"), F.sha2(F.coalesce(F.nullif(theme, F.lit("")), F.substring(t, 1, 20)), 256).alias("excerpt"))


def partition_counts(spark, d):
    """What a clean-up of some partitions would remove: how many rows, and which ids."""
    e = fr.read(spark, d, "events", "event_id", "user_id", "event_type").filter("event_type = 'error' AND user_id % 10 = 3")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def purged_rows(spark, d):
    """Events without one user's partition."""
    e = fr.read(spark, d, "events", "event_id", "user_id", "value")
    kept, gone = sinks.purge(e, "user_id", 7)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.lit(gone).cast("long").alias("gone"), F.round(F.sum("value"), 4).alias("total"))


def shared_rows(spark, d):
    """Rows of no owner, of some kinds, on some days."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    days = [F.lit(x).cast("date") for x in ("1997-03-03", "1998-05-05", "1999-07-07", "2000-09-09")]
    owner = F.when(F.pmod("o_custkey", F.lit(3)) > 0, F.col("o_custkey"))
    x = o.withColumn("owner", owner).filter(F.col("owner").isNull() & F.col("o_orderstatus").isin("F", "O") & F.to_date("o_orderdate").isin(*days))
    return x.select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))


def news_scan(spark, d):
    """News of a span with the hash of its contents."""
    e = fr.read(spark, d, "events", "event_id", "ts", "event_type", "props").filter("ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-23 00:00:00'")
    return e.select("event_id", F.to_date("ts").alias("day"), S.content_hash(F.concat("event_type", "props")).alias("content_hash"))


def wanted_archives(spark, d):
    """Members of an archive that the universe asks for."""
    c = fr.read(spark, d, "customer", "c_custkey", "c_name").withColumn("member", F.format_string("CIK%010d.json", "c_custkey"))
    s = fr.read(spark, d, "supplier", "s_suppkey").select(F.format_string("CIK%010d.json", "s_suppkey").alias("member"))
    return c.join(s, "member", "left_semi").select("member", "c_name")


def retrieval_plans(spark, d):
    """Plans from JSON, some broken, some with reversed dates; names once each, in their order."""
    c = fr.read(spark, d, "customer", "c_custkey", "c_nationkey")
    n = F.col("c_nationkey").cast("string")
    raw = F.when(F.pmod("c_custkey", F.lit(9)) == 0, "{bad").otherwise(F.to_json(F.struct(
        F.array(F.concat(F.lit("N"), n), F.lit("N3"), F.concat(F.lit("N"), n)).alias("tickers"), F.lit("2024-01-10").alias("date_from"),
        F.when(F.pmod("c_custkey", F.lit(4)) == 0, "2024-01-05").otherwise("2024-02-01").alias("date_to"),
    )))
    x = c.select("c_custkey", U.sane_plan(raw).alias("p"))
    return x.select("c_custkey", F.col("p").isNotNull().alias("valid"), F.array_join(F.array_distinct("p.tickers"), ",").alias("tickers"))


def narrative_context(spark, d):
    """Turns that fit a bounded context of each conversation, the last dropped first."""
    c = fr.read(spark, d, "conversations", "conv_id", "turn", "text").withColumn("size", F.char_length("text").cast("long"))
    return U.within_budget(c, "conv_id", "size", 200, F.col("turn")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("size").alias("size"))


def fact_snapshots(spark, d):
    """Facts of each accession together."""
    f = flattened_facts(spark, d).withColumn("accn", F.concat_ws("-", "l_suppkey", "fy")).withColumn("form", F.lit("10-K")).withColumn("end", F.col("fy"))
    out = D.snapshots_by_accession(f, "l_suppkey")
    return out.select("l_suppkey", "accn", "n", "form", F.array_join("concepts", ",").alias("concepts"))


def fisher_bounds(spark, d):
    """Interval of each horizon's mean rank correlation by its z and back."""
    g = _ics(spark, d).filter("ic IS NOT NULL").groupBy("horizon").agg(F.avg("ic").alias("m"), F.count("ic").alias("n"))
    z, half = S.fisher_z(F.col("m")), 1.96 / F.sqrt(F.col("n") - 3)
    return g.select("horizon", F.round(z, 8).alias("z"), F.round(F.tanh(z - half), 8).alias("low"), F.round(F.tanh(z + half), 8).alias("high"))


def short_titles(spark, d):
    """First lines of documents, cut at forty characters."""
    x = fr.read(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return x.select("doc_id", F.sha2(S.truncated(F.substring_index("text", "\n", 1), 40), 256).alias("title"))


def attention_texts(spark, d):
    """How each user's activity of the last ten days compares with the ten before, with the three largest events."""
    e = _events(spark, d).filter("age < 20 AND event_type <> 'error'").withColumn("recent", F.col("age") < 10)
    g = e.groupBy("user_id").agg(F.sum(F.col("recent").cast("long")).alias("now"), F.sum((~F.col("recent")).cast("long")).alias("then"))
    top = U.newest(e.filter("recent"), "user_id", 3, F.desc("value"), "event_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "event_id"))).alias("e"))
    word = F.when(F.col("now") > F.col("then"), "more than").when(F.col("now") < F.col("then"), "less than").otherwise("as much as")
    x = g.join(top, "user_id", "left")
    return x.select("user_id", F.concat(F.col("now"), F.lit(" events, "), word, F.lit(" before")).alias("text"), F.array_join(F.transform("e", lambda s: s["event_id"]), ",").alias("evidence"))


def narrative_claims(spark, d):
    """Kinds of what was claimed of each user, strongest first, and how old the newest claim is."""
    e = _events(spark, d).filter("event_type IN ('click', 'signup', 'purchase')")
    g = e.groupBy("user_id", "event_type").agg(F.max("value").alias("strength"), F.min("age").alias("age"))
    x = g.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), F.col("event_type").alias("t")))).alias("k"), F.min("age").alias("newest_age"))
    return x.select("user_id", F.array_join(F.transform("k", lambda c: c["t"]), ",").alias("kinds"), F.col("newest_age").cast("long").alias("newest_age"))


def valuation_texts(spark, d):
    """What the multiples say of each security against its peers."""
    x = V.brake(V.signals(_multiples(spark, d))).withColumn("brake", F.round("brake", 6))
    word = F.when(F.col("brake") > 0.5, "cheap").when(F.col("brake") < -0.5, "dear").otherwise("in line")
    text = F.when(F.col("brake").isNull(), "no multiple can be ranked").otherwise(F.concat(word, F.lit(" by "), F.col("signals"), F.lit(" multiples")))
    return x.select("security_id", text.alias("text"))


def backfill_windows(spark, d):
    """Months of a span that each security has no bar of: what a backfill is to fetch."""
    months = F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month"))
    b = fr.month_bars(spark, d).groupBy("security_id").agg(F.collect_set("session_date").alias("have"))
    x = fr.securities(spark, d).select("security_id").join(b, "security_id", "left")
    x = x.withColumn("gaps", F.array_except(months, F.coalesce("have", F.array().cast("array<date>")))).filter(F.size("gaps") > 0)
    return x.select("security_id", F.size("gaps").cast("long").alias("n"), F.array_min("gaps").alias("first_gap"), F.array_max("gaps").alias("last_gap"))


def registered_variants(spark, d):
    """Each scoring variant's weights and a hash of them, whatever their order."""
    rows = [(v, leg, float(w)) for v, by in VARIANTS.items() for leg, w in by.items()]
    x = spark.createDataFrame(rows, "variant string, leg string, w double")
    g = x.groupBy("variant").agg(F.count(F.lit(1)).alias("legs"), F.round(F.sum("w"), 6).alias("total"), F.array_sort(F.collect_list(F.format_string("%s=%.4f", "leg", "w"))).alias("p"))
    return g.select("variant", "legs", "total", F.sha2(F.array_join("p", ","), 256).alias("fingerprint"))


def current_projection(spark, d):
    """Each ticker's open quantity, revalued at the last price, next to the mean of its seven last prices."""
    e = _effective(spark, d)
    lots = L.open_lots(e, ["owner", "ticker"], _ORDER).groupBy("ticker").agg(F.sum("rest").alias("quantity"), F.count_distinct("owner").alias("owners"))
    p = U.newest(e, "ticker", 7, F.desc("day"), F.desc("id")).groupBy("ticker").agg(F.max(F.when(F.col("place") == 1, F.col("price"))).alias("last"), F.avg("price").alias("mean"))
    x = lots.join(p, "ticker", "left")
    return x.select("ticker", "owners", F.round("quantity", 4).alias("quantity"), F.round(F.col("quantity") * F.col("last"), 4).alias("value"), F.round("mean", 6).alias("mean_price"))


_HT = f"{_ST}, hl AS (SELECT security_id, cohort, parent, cn, pn, unnest(['roic', 'net_cash_ratio', 'fcf_margin']) AS leg, unnest([roic, net_cash_ratio, fcf_margin]) AS x FROM ra), {blended_sql('hz', 'hl')}"


def _says(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN '{p} is missing' ELSE '{p} is ' || CASE WHEN {p} > 0 THEN 'above' WHEN {p} < 0 THEN 'below' ELSE 'in line with' END || ' peers' END"


QUERIES = {
    "attention_texts": (attention_texts, f"""WITH {_EV}, w AS (SELECT *, age < 10 AS recent FROM ev WHERE age < 20 AND event_type <> 'error'), g AS (SELECT user_id, count(*) FILTER (recent) AS a, count(*) FILTER (NOT recent) AS b FROM w GROUP BY 1),
t AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM w WHERE recent) WHERE rn <= 3 GROUP BY 1)
SELECT user_id, a || ' events, ' || CASE WHEN a > b THEN 'more than' WHEN a < b THEN 'less than' ELSE 'as much as' END || ' before' AS text, evidence FROM g LEFT JOIN t USING (user_id)"""),
    "narrative_claims": (narrative_claims, f"""WITH {_EV}, g AS (SELECT user_id, event_type, max(value) AS s, min(age) AS age FROM ev WHERE event_type IN ('click', 'signup', 'purchase') GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY s DESC, event_type) AS kinds, CAST(min(age) AS BIGINT) AS newest_age FROM g GROUP BY 1"""),
    "valuation_texts": (valuation_texts, f"""WITH {_MU}, b AS (SELECT security_id, count(signal) AS n, round(avg(signal), 6) AS b FROM sg GROUP BY 1)
SELECT security_id, CASE WHEN b IS NULL THEN 'no multiple can be ranked' ELSE CASE WHEN b > 0.5 THEN 'cheap' WHEN b < -0.5 THEN 'dear' ELSE 'in line' END || ' by ' || n || ' multiples' END AS text FROM b"""),
    "backfill_windows": (backfill_windows, f"""WITH {fr.BARS}, m AS (SELECT CAST(unnest(range(DATE '1995-01-01', DATE '2001-12-02', INTERVAL 1 MONTH)) AS DATE) AS m), g AS (SELECT s_suppkey AS security_id, m FROM supplier CROSS JOIN m ANTI JOIN bars ON bars.security_id = s_suppkey AND session_date = m)
SELECT security_id, count(*) AS n, min(m) AS first_gap, max(m) AS last_gap FROM g GROUP BY 1"""),
    "registered_variants": (registered_variants, f"SELECT variant, count(*) AS legs, round(sum(w), 6) AS total, sha256(string_agg(leg || '=' || printf('%.4f', w), ',' ORDER BY leg)) AS fingerprint FROM {_variants_sql()} GROUP BY 1"),
    "current_projection": (current_projection, f"""WITH {_LOTS}, q AS (SELECT ticker, sum(rest) AS quantity, count(DISTINCT owner) AS owners FROM lots GROUP BY 1),
p AS (SELECT ticker, max(price) FILTER (k = 1) AS last, avg(price) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC, id DESC) AS k FROM eff) WHERE k <= 7 GROUP BY 1)
SELECT ticker, owners, round(quantity, 4) AS quantity, round(quantity * last, 4) AS value, round(mean, 6) AS mean_price FROM q LEFT JOIN p USING (ticker)"""),
    "prior_sessions": (prior_sessions, f"""WITH {fr.BARS}, c AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS no FROM (SELECT DISTINCT session_date FROM bars)), l AS (SELECT security_id, max(session_date) AS last_day FROM bars GROUP BY 1)
SELECT security_id, last_day, p.session_date AS prior, (SELECT session_date FROM c WHERE no = (SELECT max(no) - 1 FROM c WHERE session_date <= DATE '1999-05-17')) AS before FROM l JOIN c a ON a.session_date = last_day LEFT JOIN c p ON p.no = a.no - 5"""),
    "stored_streaks": (stored_streaks, f"""WITH {_RET}, s AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY session_date DESC) AS k, coalesce(ret < 0, false) AS f FROM r)
SELECT security_id, coalesce(min(k) FILTER (NOT f), count(*) + 1) - 1 AS streak FROM s GROUP BY 1"""),
    "directions": (directions, f"""WITH {fr.BARS}, x AS (SELECT *, round(ln(close) - ln(lag(close, 5) OVER (PARTITION BY security_id ORDER BY session_date)), 6) AS delta FROM bars), y AS (SELECT *, CASE WHEN delta > {S.STRONGER} THEN 'STRENGTHENING' WHEN delta < {S.WEAKER} THEN 'WEAKENING' ELSE 'STABLE' END AS direction FROM x WHERE session_date = DATE '2001-05-01' AND delta IS NOT NULL)
SELECT security_id, delta, direction, sha256(security_id || '|' || session_date || '|' || volume || '|' || direction) AS package FROM y"""),
    "visible_inputs": (visible_inputs, """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS known FROM orders), v AS (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN known + CAST(o_orderkey % 40 AS INT) END AS published FROM o)
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY known DESC, o_orderkey DESC) AS place, o_orderkey FROM v WHERE known <= DATE '1999-06-30' AND (published IS NULL OR published <= DATE '1999-06-30') QUALIFY place <= 3"""),
    "statements_to_fetch": (statements_to_fetch, "SELECT l_suppkey, max(year(l_shipdate)) AS year FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1"),
    "position_limits": (position_limits, """WITH c AS (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CAPITAL_PRESERVATION' WHEN 'BUILDING' THEN 'INCOME' WHEN 'FURNITURE' THEN 'BALANCED_GROWTH' ELSE 'CAPITAL_GROWTH' END AS objective FROM customer)
SELECT c_custkey, objective, CASE objective WHEN 'CAPITAL_PRESERVATION' THEN 8.0 WHEN 'INCOME' THEN 10.0 ELSE 11.0 END::DOUBLE AS cap, round(greatest(0, c_acctbal - 3000), 2) AS spendable FROM c"""),
    "health_texts": (health_texts, f"""WITH {_HT}, g AS (SELECT security_id, max(round(z, 7)) FILTER (leg = 'roic') AS roic, max(round(z, 7)) FILTER (leg = 'net_cash_ratio') AS net_cash_ratio, max(round(z, 7)) FILTER (leg = 'fcf_margin') AS fcf_margin,
  max(struct_pack(z := round(z, 7), leg)) FILTER (z IS NOT NULL) AS hi, min(struct_pack(z := round(z, 7), leg)) FILTER (z IS NOT NULL) AS lo FROM hz GROUP BY 1)
SELECT security_id, {" || '; ' || ".join(_says(p) for p in ('roic', 'net_cash_ratio', 'fcf_margin'))} AS text, CASE WHEN hi.z > 0 THEN hi.leg END AS strongest, CASE WHEN lo.z < 0 THEN lo.leg END AS weakest FROM g"""),
    "contribution_deltas": (contribution_deltas, f"""WITH {_RET}, x AS (SELECT security_id, coalesce(CASE WHEN security_id % 2 = 0 THEN 0.6::DOUBLE * ret END, ret, 0) AS price, coalesce(CASE WHEN volume % 3 > 0 THEN 0.4::DOUBLE * ln(volume) END, 0) AS flow FROM r WHERE session_date = DATE '2001-03-01')
SELECT security_id, round(price, 8) AS price, round(flow, 8) AS flow, round(price + flow, 7) AS total FROM x"""),
    "overview_states": (overview_states, """WITH g AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS c FROM events GROUP BY 1)
SELECT user_id, CASE WHEN c IS NULL THEN 'missing' WHEN epoch(c)::BIGINT > epoch(TIMESTAMP '2024-01-30 12:00:00') THEN 'future' WHEN CAST(c AS DATE) > DATE '2024-01-29' THEN 'after_date' WHEN floor(epoch(c)) < epoch(TIMESTAMP '2024-01-28 12:00:00') THEN 'stale' ELSE 'fresh' END AS state FROM g"""),
    "performance_page": (performance_page, f"WITH {_LONG} SELECT horizon, max(session_date) AS as_of, count(ic) AS n, round(arg_max(ic, session_date), 7) AS last, round(avg(ic), 7) AS mean FROM ic WHERE ic IS NOT NULL GROUP BY 1"),
    "evidence_excerpts": (evidence_excerpts, r"""WITH b AS (SELECT source, doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1)
SELECT source, doc_id, sha256(coalesce(nullif(regexp_extract(t, '([A-Z][a-z]+ [a-z]+ [a-z]+)', 1), ''), substr(t, 1, 20))) AS excerpt FROM b"""),
    "partition_counts": (partition_counts, "SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE event_type = 'error' AND user_id % 10 = 3 GROUP BY 1"),
    "purged_rows": (purged_rows, "SELECT count(*) FILTER (user_id <> 7) AS kept, count(*) FILTER (user_id = 7) AS gone, round(sum(value) FILTER (user_id <> 7), 4) AS total FROM events"),
    "shared_rows": (shared_rows, "SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus IN ('F', 'O') AND CAST(o_orderdate AS DATE) IN (DATE '1997-03-03', DATE '1998-05-05', DATE '1999-07-07', DATE '2000-09-09')"),
    "news_scan": (news_scan, "SELECT event_id, CAST(ts AS DATE) AS day, 'sha256:' || sha256(event_type || props) AS content_hash FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-23 00:00:00'"),
    "wanted_archives": (wanted_archives, "SELECT printf('CIK%010d.json', c_custkey) AS member, c_name FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)"),
    "retrieval_plans": (retrieval_plans, """SELECT c_custkey, c_custkey % 9 <> 0 AND c_custkey % 4 <> 0 AS valid, CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 4 <> 0 THEN CASE WHEN c_nationkey = 3 THEN 'N3' ELSE 'N' || c_nationkey || ',N3' END END AS tickers FROM customer"""),
    "narrative_context": (narrative_context, """WITH s AS (SELECT conv_id, length(text) AS size, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations) SELECT conv_id, count(*) AS turns, CAST(sum(size) AS BIGINT) AS size FROM s WHERE upto <= 200 GROUP BY 1"""),
    "fact_snapshots": (fact_snapshots, "SELECT l_suppkey, l_suppkey || '-' || year(l_shipdate) AS accn, CAST(1 AS BIGINT) AS n, '10-K' AS form, 'Revenue' AS concepts FROM lineitem GROUP BY l_suppkey, year(l_shipdate)"),
    "fisher_bounds": (fisher_bounds, f"WITH {_LONG}, g AS (SELECT horizon, avg(ic) AS m, count(ic) AS n FROM ic WHERE ic IS NOT NULL GROUP BY 1) SELECT horizon, round(atanh(m), 8) AS z, round(tanh(atanh(m) - 1.96::DOUBLE / sqrt(n - 3)), 8) AS low, round(tanh(atanh(m) + 1.96::DOUBLE / sqrt(n - 3)), 8) AS high FROM g"),
    "short_titles": (short_titles, "WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '...' ELSE t END) AS title FROM t"),
}
