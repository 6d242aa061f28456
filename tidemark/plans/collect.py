"""Queries over collectors, runs and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sessions as N
from tidemark.sources import frames as fr
from tidemark.streaming import collect as C

FORMS = ("1-URGENT", "2-HIGH")


def collected_news(spark, d):
    """Two readings of a feed: the second begins at the mark, adds new contents, and fills excerpts in."""
    e = fr.read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    digest = F.sha2(F.concat("event_type", F.floor(F.col("value") / 10).cast("string")), 256)
    e = e.select("user_id", "event_id", "ts", digest.alias("digest"), F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("event_id")).alias("excerpt"))
    first = e.filter("ts < TIMESTAMP '2024-01-15 00:00:00'")
    stored = C.new_contents(first, first.limit(0), "user_id", "digest", "ts", "event_id")
    marks = first.groupBy("user_id").agg(F.max("ts").alias("mark"))
    more = C.after_marks(e, marks, "user_id", "ts", inclusive=True)
    new = C.new_contents(more, stored, "user_id", "digest", "ts", "event_id")
    out = C.enriched(stored, more, "user_id", "digest", "excerpt").select(*stored.columns).unionByName(new.select(*stored.columns))
    return out.select("user_id", "digest", "event_id", "excerpt")


def collected_filings(spark, d):
    """Filings of some forms beyond each customer's mark, in the order of their numbers as texts."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    o = o.withColumn("accession", F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).withColumn("digest", F.floor("o_totalprice"))
    done = o.filter("o_orderkey % 4 = 0")
    marks = done.groupBy("o_custkey").agg(F.max("accession").alias("mark"))
    new = C.after_marks(o, marks, "o_custkey", "accession").filter(F.col("o_orderpriority").isin(*FORMS))
    return C.new_contents(new, done, "o_custkey", "digest", "accession").select("o_custkey", "accession", "o_orderpriority")


def collected_trades(spark, d):
    """Trades of reports filed after each customer's mark."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("filed", F.to_date("o_orderdate"))
    marks = o.filter("o_orderkey % 5 = 0").groupBy("o_custkey").agg(F.max("filed").alias("mark"))
    new = C.after_marks(o, marks, "o_custkey", "filed")
    x = fr.read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    g = new.join(x, F.col("o_orderkey") == F.col("l_orderkey"))
    return g.groupBy("o_custkey", "filed").agg(F.count(F.lit(1)).alias("trades"), F.sum("l_quantity").alias("shares"))


def collected_facts(spark, d):
    """Filings that were not processed yet, by the set of those that were."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey")
    x = fr.read(spark, d, "lineitem", "l_orderkey", "l_extendedprice")
    done = x.filter("l_extendedprice > 30000").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.unprocessed(o, done, "o_orderkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


def seeded_marks(spark, d):
    """Marks by collector and security, never moved back."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey")
    have = o.groupBy("o_custkey").agg(F.max(F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("seen"))
    old = F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.lit("0000009000"))
    return have.select(C.mark_key("filings", F.col("o_custkey").cast("string")).alias("key"), F.greatest("seen", old).alias("mark"))


def overviews_to_fetch(spark, d):
    """Users whose last view is a day old or more, or ahead of the clock."""
    e = fr.read(spark, d, "events", "ts", "user_id", "event_type").filter("event_type = 'view' AND ts IS NOT NULL")
    g = e.groupBy("user_id").agg(F.max("ts").alias("cached"))
    return g.filter(C.stale(F.col("cached"), F.lit("2024-01-30 12:00:00").cast("timestamp"))).select("user_id")


def throttled(spark, d):
    """Requests of each user against a bucket of three tokens that gains one a day."""
    e = fr.read(spark, d, "events", "event_id", "ts", "user_id")
    return C.token_bucket(e, "user_id", "ts", ["event_id"], 3.0, 1.0 / 86400).select("user_id", "event_id", "allowed")


def resumed_runs(spark, d):
    """Where each run goes on: its first step that is not done."""
    c = fr.read(spark, d, "conversations", "conv_id", "turn", "text")
    k = F.pmod(F.char_length("text"), F.lit(5))
    c = c.withColumn("status", F.when(k < 3, "SUCCESS").when(k == 3, "SKIPPED").otherwise("FAILED"))
    return C.resume_at(c, "conv_id", "turn", "status")


def run_outcomes(spark, d):
    """How each day's run ended: shares of its steps, and a status."""
    e = fr.read(spark, d, "events", "ts", "event_type").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("failed"))
    status = F.when(F.col("failed") == 0, "SUCCESS").when(F.col("failed") < 0.25, "DEGRADED").otherwise("FAILED")
    return e.select("day", "n", F.round("failed", 8).alias("failed"), status.alias("status")).orderBy(F.desc("day")).limit(30)


def replay_state(spark, d):
    """What a replay holds on a day: the last bar of each security, not older than a hundred days."""
    b = fr.month_bars(spark, d)
    last = N.latest_as_of(b, F.lit("2001-08-15").cast("date"), "security_id", "session_date", "close")
    return C.kept_state(last, "security_id", "session_date", F.lit("2001-08-15").cast("date"), 100)


def coverage_audit(spark, d):
    """Expected weekdays with how many users were seen, and which of the first ten were not."""
    e = fr.read(spark, d, "events", "ts", "user_id").select(F.to_date("ts").alias("day"), "user_id").distinct()
    seen = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("user_id") <= 10, F.col("user_id"))).alias("ids"))
    x = C.expected_weekdays(spark, "2024-02-15", 60).join(seen, "day", "left")
    first = F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))
    missing = F.array_except(first, F.coalesce("ids", F.array().cast("array<long>")))
    return x.select("day", F.coalesce("n", F.lit(0)).alias("n"), F.array_join(missing, ",").alias("missing"))


def user_activity(spark, d):
    """Users by status, as their last event tells."""
    e = fr.read(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    status = F.when(F.col("last") == "error", "SUSPENDED").when(F.col("last") == "signup", "PENDING").otherwise("ACTIVE")
    return last.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("users"), F.min("user_id").alias("first_user"))


def backfill_starts(spark, d):
    """From when raw data and extractions are to be fetched, for each customer's last order."""
    o = fr.read(spark, d, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("today"))
    return o.select("o_custkey", F.date_sub("today", 36 * 30).alias("raw_start"), F.date_sub("today", 18 * 30).alias("extraction_start"))


_E = "e AS (SELECT user_id, event_id, ts, sha256(event_type || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)) AS digest, CASE WHEN event_id % 3 > 0 THEN event_id END AS excerpt FROM events)"
_ACC = "o AS (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS accession, floor(o_totalprice) AS digest FROM orders)"
QUERIES = {
    "collected_news": (collected_news, f"""WITH {_E}, f AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-15 00:00:00'), s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, digest ORDER BY ts, event_id) = 1),
m AS (SELECT user_id, max(ts) AS mark FROM f GROUP BY 1), o AS (SELECT e.* FROM e LEFT JOIN m USING (user_id) WHERE mark IS NULL OR ts >= mark),
n AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY user_id, digest ORDER BY ts, event_id) = 1), x AS (SELECT user_id, digest, min(excerpt) AS x FROM o WHERE excerpt IS NOT NULL GROUP BY 1, 2)
SELECT s.user_id, s.digest, s.event_id, coalesce(s.excerpt, x.x) AS excerpt FROM s LEFT JOIN x USING (user_id, digest) UNION ALL SELECT user_id, digest, event_id, excerpt FROM n ANTI JOIN s USING (user_id, digest)"""),
    "collected_filings": (collected_filings, f"""WITH {_ACC}, d AS (SELECT * FROM o WHERE o_orderkey % 4 = 0), m AS (SELECT o_custkey, max(accession) AS mark FROM d GROUP BY 1),
n AS (SELECT o.* FROM o LEFT JOIN m USING (o_custkey) WHERE (mark IS NULL OR accession > mark) AND o_orderpriority IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY o_custkey, digest ORDER BY accession) = 1)
SELECT o_custkey, accession, o_orderpriority FROM n ANTI JOIN d USING (o_custkey, digest)"""),
    "collected_trades": (collected_trades, """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS filed FROM orders), m AS (SELECT o_custkey, max(filed) AS mark FROM o WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT o_custkey, filed, count(*) AS trades, sum(l_quantity) AS shares FROM o LEFT JOIN m USING (o_custkey) JOIN lineitem ON l_orderkey = o_orderkey WHERE mark IS NULL OR filed > mark GROUP BY 1, 2"""),
    "collected_facts": (collected_facts, "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_extendedprice > 30000) GROUP BY 1"),
    "seeded_marks": (seeded_marks, "SELECT 'filings:' || o_custkey AS key, CASE WHEN o_custkey % 3 = 0 THEN greatest(max(lpad(CAST(o_orderkey AS VARCHAR), 10, '0')), '0000009000') ELSE max(lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) END AS mark FROM orders GROUP BY o_custkey"),
    "overviews_to_fetch": (overviews_to_fetch, "SELECT user_id FROM events WHERE event_type = 'view' GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-29 12:00:00' OR epoch(max(ts))::BIGINT > epoch(TIMESTAMP '2024-01-30 12:00:00')"),
    "throttled": (throttled, """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS before, 3.0::DOUBLE AS level, false AS allowed FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, k, event_id, ts, l - CASE WHEN l >= 1 THEN 1 ELSE 0 END, l >= 1 FROM (SELECT e.user_id, e.k, e.event_id, e.ts, CASE WHEN before IS NULL THEN level ELSE least(3.0, level + (epoch_us(ts) - epoch_us(before)) / 1e6 * (1.0::DOUBLE / 86400)) END AS l FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, event_id, allowed FROM r WHERE k > 0"""),
    "resumed_runs": (resumed_runs, "SELECT conv_id, min(turn) FILTER (length(text) % 5 = 4) AS resume_at FROM conversations GROUP BY 1"),
    "run_outcomes": (run_outcomes, """WITH g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS f FROM events GROUP BY 1)
SELECT day, n, round(f, 8) AS failed, CASE WHEN f = 0 THEN 'SUCCESS' WHEN f < 0.25 THEN 'DEGRADED' ELSE 'FAILED' END AS status FROM g ORDER BY day DESC LIMIT 30"""),
    "replay_state": (replay_state, f"WITH {fr.BARS}, l AS (SELECT security_id, session_date, close FROM bars WHERE session_date <= DATE '2001-08-15' QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY session_date DESC) = 1) SELECT * FROM l WHERE session_date >= DATE '2001-08-15' - 100"),
    "coverage_audit": (coverage_audit, """WITH d AS (SELECT CAST(unnest(range(DATE '2023-10-18', DATE '2024-02-16', INTERVAL 1 DAY)) AS DATE) AS day), w AS (SELECT day FROM d WHERE isodow(day) < 6 ORDER BY day DESC LIMIT 60),
s AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n, list(DISTINCT user_id) AS ids FROM events GROUP BY 1)
SELECT day, coalesce(n, 0) AS n, array_to_string(list_filter(range(1, 11), lambda i: NOT list_contains(coalesce(ids, []), i)), ',') AS missing FROM w LEFT JOIN s USING (day)"""),
    "user_activity": (user_activity, """WITH l AS (SELECT user_id, arg_max(event_type, struct_pack(ts, event_id)) AS last FROM events GROUP BY 1)
SELECT CASE last WHEN 'error' THEN 'SUSPENDED' WHEN 'signup' THEN 'PENDING' ELSE 'ACTIVE' END AS status, count(*) AS users, min(user_id) AS first_user FROM l GROUP BY 1"""),
    "backfill_starts": (backfill_starts, "SELECT o_custkey, max(CAST(o_orderdate AS DATE)) - 1080 AS raw_start, max(CAST(o_orderdate AS DATE)) - 540 AS extraction_start FROM orders GROUP BY 1"),
}
