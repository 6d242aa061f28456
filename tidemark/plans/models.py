"""Read models: what pages, briefings and answers are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import policy as P
from tidemark.operators import sessions as N
from tidemark.operators import xsec
from tidemark.sources import frames as fr

from .explain import _CON
from .groups import _z
from .portfolio import _CTX, _EV, _context, _decide_sql, _events
from .scoring import _Z
from .series import _RET

#: Which action counts more.
PRIORITY = {"SELL": 4, "TRIM": 3, "ADD": 2, "BUY": 1}


def _decided(spark, d):
    return P.decide(_context(spark, d))


def top_recommendations(spark, d):
    """The five suggestions of each portfolio with the largest gap of weight; sales first among equals."""
    rank = F.lit(0)
    for action, k in PRIORITY.items():
        rank = F.when(F.col("action") == action, k).otherwise(rank)
    x = _decided(spark, d).withColumn("gap", F.round(F.abs(F.col("target_weight") - F.col("weight")), 8)).withColumn("priority", rank).filter("priority > 0")
    w = Window.partitionBy("portfolio").orderBy(F.desc("gap"), F.desc("priority"), "security_id")
    x = x.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 5")
    return x.select("portfolio", "place", "security_id", "action", F.round("gap", 6).alias("gap"))


def recommendation_cards(spark, d):
    """Each decision with its rationale and the gates that stand in its way."""
    x = _decided(spark, d).withColumn("told", F.split("trace", ","))
    failed = F.transform(F.filter("told", lambda g: g.endswith("=0")), lambda g: F.substring_index(g, "=", 1))
    blocking = F.filter(failed, lambda g: ~g.isin("held", "not_held", "confidence_not_low"))
    passed = F.size(F.filter("told", lambda g: g.endswith("=1")))
    label = F.initcap(F.replace(F.col("action"), F.lit("_"), F.lit(" ")))
    text = F.concat(label, F.lit(" - "), passed, F.lit("/"), F.size("told"), F.lit(" policy gates passed."))
    return x.select("security_id", text.alias("rationale"), F.col("action").isin("BUY", "ADD").alias("buy_ready"), F.array_join(blocking, ",").alias("blocking"))


def grounding_recommendations(spark, d):
    """Actionable decisions of each portfolio, and five held back that would weigh most."""
    x = _decided(spark, d)
    acting = x.filter("action IN ('BUY', 'ADD', 'TRIM', 'SELL')").select("portfolio", "security_id", "action")
    w = Window.partitionBy("portfolio").orderBy(F.desc("target_weight"), "security_id")
    blocked = x.filter("action LIKE 'HOLD%' AND weight < 5").withColumn("_r", F.row_number().over(w)).filter("_r <= 5")
    return acting.unionByName(blocked.select("portfolio", "security_id", "action"))


def action_counts(spark, d):
    """Decisions of each portfolio by kind."""
    x = _decided(spark, d)
    acting = F.col("action").isin("BUY", "ADD", "TRIM", "SELL")
    return x.groupBy("portfolio").agg(F.count(F.lit(1)).alias("decisions"), F.sum(acting.cast("long")).alias("actionable"), F.sum((F.col("action") == "SELL").cast("long")).alias("sales"))


def recommendation_history(spark, d):
    """Orders of the last two days of each customer, whether they were followed, and when they mature."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").withColumn("day", F.to_date("o_orderdate"))
    done = fr.read(spark, d, "lineitem", "l_orderkey").filter("l_orderkey % 3 = 0").distinct()
    w = Window.partitionBy("o_custkey").orderBy(F.desc("day"))
    x = o.withColumn("_r", F.dense_rank().over(w)).filter("_r <= 2 AND o_orderstatus <> 'P'")
    followed = x.join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").withColumn("followed", F.lit(True))
    x = x.join(followed.select("o_orderkey", "followed"), "o_orderkey", "left")
    return x.select("o_custkey", "o_orderkey", "day", F.coalesce("followed", F.lit(False)).alias("followed"), F.date_add("day", 180).alias("matures"))


def leg_displays(spark, d):
    """Each leg's percentile among the same cohort, as a page shows it."""
    z = _z(spark, d)
    f = xsec.percentile_fraction("z", ["leg", "cohort"])
    return z.withColumn("z", F.round("z", 8)).select("security_id", "leg", S.half_up(F.round(100 * f, 9)).alias("shown"))


def largest_leg(spark, d):
    """The leg that says most of each score, and in which direction."""
    x = xsec.weighted(_z(spark, d)).filter("weight IS NOT NULL AND z IS NOT NULL")
    x = x.withColumn("c", F.round(F.col("weight") * S.winsorise(F.col("z")), 7))
    w = Window.partitionBy("security_id").orderBy(F.desc(F.abs("c")), "leg")
    return x.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("security_id", "leg", F.col("c").alias("contribution"))


def top_leg_changes(spark, d):
    """The eighteen largest changes of a signal between two months, all securities together."""
    b = fr.month_bars(spark, d).filter("session_date IN (DATE '2001-08-01', DATE '2001-09-01')")
    x = b.select("security_id", "session_date", F.explode(F.create_map(F.lit("level"), F.ln("close"), F.lit("flow"), F.ln(F.col("volume") + 1))).alias("leg", "x"))
    now, then = (F.max(F.when(F.col("session_date") == F.lit(day).cast("date"), F.col("x"))) for day in ("2001-09-01", "2001-08-01"))
    g = x.groupBy("security_id", "leg").agg(F.round(now - then, 8).alias("change")).filter("change IS NOT NULL")
    return g.orderBy(F.desc(F.abs("change")), "security_id", "leg").limit(18)


def mover_texts(spark, d):
    """One line for each security on how its price moved."""
    x = N.with_returns(fr.month_bars(spark, d), (1,)).filter("session_date = DATE '2001-06-01' AND ret IS NOT NULL")
    word = F.when(F.col("ret") > 0.1, "rose").when(F.col("ret") < -0.1, "fell").otherwise("held")
    size = F.round(F.abs("ret") * 100, 0).cast("long")
    return x.select("security_id", F.concat(F.lit("Price "), word, F.lit(" by "), size, F.lit("% in a month.")).alias("summary"))


def theme_evidence(spark, d):
    """The three strongest themes of each user, by summed decayed strength, each with its strongest event."""
    e = _events(spark, d).filter("age < 60 AND event_type <> 'error'")
    e = e.withColumn("s", F.col("value") * S.decay(F.col("age")))
    g = e.groupBy("user_id", F.col("event_type").alias("theme")).agg(F.round(F.sum("s"), 6).alias("strength"), F.max_by("event_id", F.struct("s", "event_id")).alias("evidence"))
    w = Window.partitionBy("user_id").orderBy(F.desc("strength"), "theme")
    x = g.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3")
    return x.select("user_id", "place", "theme", "strength", "evidence")


def insider_sides(spark, d):
    """Bought against sold by each customer, and the three largest orders of the leading side."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").filter("o_orderstatus IN ('F', 'O') AND o_totalprice > 0")
    o = o.withColumn("signed", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")))
    net = o.groupBy("o_custkey").agg(F.round(F.sum("signed"), 2).alias("net"))
    x = o.join(net, "o_custkey").filter("sign(signed) = sign(net)")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey")
    x = x.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").groupBy("o_custkey", "net").agg(F.array_sort(F.collect_list(F.struct("_r", "o_orderkey"))).alias("e"))
    return x.select("o_custkey", F.when(F.col("net") > 0, "bought").otherwise("sold").alias("side"), "net", F.array_join(F.transform("e", lambda s: s["o_orderkey"]), ",").alias("evidence"))


def document_page(spark, d):
    """The newest three documents of each source and language, good ones marked."""
    x = fr.read(spark, d, "documents", "doc_id", "source", "lang").join(fr.read(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    w = Window.partitionBy("source", "lang").orderBy(F.desc("doc_id"))
    x = x.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3")
    return x.select("source", "lang", "place", "doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("digest"))


def newest_digests(spark, d):
    """Eight documents of each language: evidence first, then the newest."""
    x = fr.read(spark, d, "documents", "doc_id", "lang").filter("lang IS NOT NULL").join(fr.read(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    evidence = F.coalesce(F.col("quality") == 1, F.lit(False))
    w = Window.partitionBy("lang").orderBy(F.desc(evidence), F.desc("doc_id"))
    return x.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 8").select("lang", "place", "doc_id", evidence.alias("evidence"))


def risk_differences(spark, d):
    """What each conversation's last turn says that the one before did not, and the other way round."""
    c = fr.read(spark, d, "conversations", "conv_id", "turn", "text")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    x = c.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").withColumn("words", words)
    g = x.groupBy("conv_id").agg(F.max(F.when(F.col("_r") == 1, F.col("words"))).alias("now"), F.max(F.when(F.col("_r") == 2, F.col("words"))).alias("then")).filter("then IS NOT NULL")
    return g.select("conv_id", F.size(F.array_except("now", "then")).cast("long").alias("added"), F.size(F.array_except("then", "now")).cast("long").alias("removed"))


def price_points(spark, d):
    """Closes scaled between the lowest low and the highest high of each security."""
    b = fr.month_bars(spark, d)
    g = b.groupBy("security_id").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    return b.join(g, "security_id").select("security_id", "session_date", F.round(S.safe_div(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")), 8).alias("y"))


def portfolio_values(spark, d):
    """Total of each user's last event of every type, by day: a range of projections."""
    e = fr.read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("day", F.to_date("ts"))
    last = e.groupBy("user_id", "day", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return last.filter("day BETWEEN DATE '2024-01-05' AND DATE '2024-02-05'").groupBy("user_id", "day").agg(F.round(F.sum("v"), 6).alias("total"), F.count(F.lit(1)).alias("positions"))


def security_page(spark, d):
    """Each security with its last bar, its change, its score's strongest leg and three orders that touch it."""
    r = N.with_returns(fr.month_bars(spark, d), (1,))
    last = r.groupBy("security_id").agg(F.max_by(F.struct("session_date", "close", "ret"), "session_date").alias("b"))
    news = fr.read(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_shipdate")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"))
    news = news.distinct().withColumn("_r", F.row_number().over(w)).filter("_r <= 3").groupBy(F.col("l_suppkey").alias("security_id")).agg(F.array_sort(F.collect_list(F.struct("_r", "l_orderkey"))).alias("n"))
    x = fr.securities(spark, d).select("security_id", "name").join(last, "security_id", "left").join(largest_leg(spark, d), "security_id", "left").join(news, "security_id", "left")
    return x.select(
        "security_id", "name", F.col("b.session_date").alias("session_date"), F.round("b.close", 6).alias("close"), F.round("b.ret", 8).alias("change"), "leg",
        F.array_join(F.transform("n", lambda s: s["l_orderkey"]), ",").alias("news"),
    )


def briefing(spark, d):
    """A day's briefing in one table: sections with their lines in order."""
    top = fr.read(spark, d, "supplier", "s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(4)
    top = top.select(F.lit("top").alias("section"), F.col("s_suppkey").alias("security_id"), F.round("s_acctbal", 2).alias("value"))
    moves = top_leg_changes(spark, d).orderBy(F.desc(F.abs("change")), "security_id", "leg").limit(10)
    moves = moves.select(F.concat(F.lit("leg:"), "leg").alias("section"), "security_id", F.round("change", 6).alias("value"))
    recommended = top_recommendations(spark, d).filter("portfolio = 3").select(F.concat(F.lit("do:"), "action").alias("section"), "security_id", F.col("gap").alias("value"))
    return top.unionByName(moves).unionByName(recommended)


_DEC = f"a AS ({_decide_sql()}), b AS (WITH {_CTX} SELECT * FROM x), ab AS (SELECT * FROM a JOIN b USING (security_id))"
_TOP = f"""{_DEC}, tr AS (SELECT *, round(abs(target_weight - weight), 8) AS gap, CASE action WHEN 'SELL' THEN 4 WHEN 'TRIM' THEN 3 WHEN 'ADD' THEN 2 WHEN 'BUY' THEN 1 ELSE 0 END AS pr FROM ab),
tt AS (SELECT portfolio, row_number() OVER (PARTITION BY portfolio ORDER BY gap DESC, pr DESC, security_id) AS place, security_id, action, round(gap, 6) AS gap FROM tr WHERE pr > 0 QUALIFY place <= 5)"""
_CHG = f"""{fr.BARS}, lc AS (SELECT security_id, session_date, unnest(['level', 'flow']) AS leg, unnest([ln(close), ln(volume + 1)]) AS x FROM bars WHERE session_date IN (DATE '2001-08-01', DATE '2001-09-01')),
ch AS (SELECT security_id, leg, round(max(x) FILTER (session_date = DATE '2001-09-01') - max(x) FILTER (session_date = DATE '2001-08-01'), 8) AS change FROM lc GROUP BY 1, 2)"""
_BIG = f"{_CON}, bg AS (SELECT security_id, leg, c AS contribution FROM k WHERE w IS NOT NULL AND z IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY abs(c) DESC, leg) = 1)"
QUERIES = {
    "top_recommendations": (top_recommendations, f"WITH {_TOP} SELECT * FROM tt"),
    "recommendation_cards": (recommendation_cards, f"""WITH a AS ({_decide_sql()}), t AS (SELECT security_id, action, string_split(trace, ',') AS g FROM a)
SELECT security_id, array_to_string(list_transform(string_split(lower(action), '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ' - ' || len(list_filter(g, lambda x: ends_with(x, '=1'))) || '/' || len(g) || ' policy gates passed.' AS rationale, action IN ('BUY', 'ADD') AS buy_ready,
  array_to_string(list_filter(list_transform(list_filter(g, lambda x: ends_with(x, '=0')), lambda x: string_split(x, '=')[1]), lambda x: x NOT IN ('held', 'not_held', 'confidence_not_low')), ',') AS blocking FROM t"""),
    "grounding_recommendations": (grounding_recommendations, f"""WITH {_DEC} SELECT portfolio, security_id, action FROM ab WHERE action IN ('BUY', 'ADD', 'TRIM', 'SELL')
UNION ALL SELECT portfolio, security_id, action FROM (SELECT * FROM ab WHERE action LIKE 'HOLD%' AND weight < 5 QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY target_weight DESC, security_id) <= 5)"""),
    "action_counts": (action_counts, f"WITH {_DEC} SELECT portfolio, count(*) AS decisions, count(*) FILTER (action IN ('BUY', 'ADD', 'TRIM', 'SELL')) AS actionable, count(*) FILTER (action = 'SELL') AS sales FROM ab GROUP BY 1"),
    "recommendation_history": (recommendation_history, """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT * FROM o QUALIFY dense_rank() OVER (PARTITION BY o_custkey ORDER BY day DESC) <= 2)
SELECT o_custkey, o_orderkey, day, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0) AS followed, day + 180 AS matures FROM r WHERE o_orderstatus <> 'P'"""),
    "leg_displays": (leg_displays, f"""WITH {_Z}, q AS (SELECT security_id, cohort, leg, round(z, 8) AS z FROM z)
SELECT security_id, leg, CASE WHEN z IS NOT NULL THEN CAST(floor(round(100 * ((SELECT count(*) FROM q b WHERE b.leg = a.leg AND b.cohort = a.cohort AND b.z < a.z) + (SELECT count(*) FROM q b WHERE b.leg = a.leg AND b.cohort = a.cohort AND b.z = a.z) / 2.0)
  / (SELECT count(z) FROM q b WHERE b.leg = a.leg AND b.cohort = a.cohort), 9) + 0.5) AS BIGINT) END AS shown FROM q a"""),
    "largest_leg": (largest_leg, f"WITH {_BIG} SELECT * FROM bg"),
    "top_leg_changes": (top_leg_changes, f"WITH {_CHG} SELECT * FROM ch WHERE change IS NOT NULL ORDER BY abs(change) DESC, security_id, leg LIMIT 18"),
    "mover_texts": (mover_texts, f"WITH {_RET} SELECT security_id, 'Price ' || CASE WHEN ret > 0.1 THEN 'rose' WHEN ret < -0.1 THEN 'fell' ELSE 'held' END || ' by ' || CAST(round(abs(ret) * 100, 0) AS BIGINT) || '% in a month.' AS summary FROM r WHERE session_date = DATE '2001-06-01' AND ret IS NOT NULL"),
    "theme_evidence": (theme_evidence, f"""WITH {_EV}, s AS (SELECT *, value * exp(-age / 90.0) AS s FROM ev WHERE age < 60 AND event_type <> 'error'),
g AS (SELECT user_id, event_type AS theme, round(sum(s), 6) AS strength, arg_max(event_id, struct_pack(s, event_id)) AS evidence FROM s GROUP BY 1, 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, theme) AS place, theme, strength, evidence FROM g QUALIFY place <= 3"""),
    "insider_sides": (insider_sides, """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE -o_totalprice END AS s FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 0), n AS (SELECT o_custkey, round(sum(s), 2) AS net FROM o GROUP BY 1),
r AS (SELECT o_custkey, net, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS r FROM o JOIN n USING (o_custkey) WHERE sign(s) = sign(net))
SELECT o_custkey, CASE WHEN net > 0 THEN 'bought' ELSE 'sold' END AS side, net, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r) AS evidence FROM r WHERE r <= 3 GROUP BY 1, 2, 3"""),
    "document_page": (document_page, "SELECT source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS place, doc_id, coalesce(quality = 1, false) AS digest FROM documents LEFT JOIN labels USING (doc_id) QUALIFY place <= 3"),
    "newest_digests": (newest_digests, "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY coalesce(quality = 1, false) DESC, doc_id DESC) AS place, doc_id, coalesce(quality = 1, false) AS evidence FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NOT NULL QUALIFY place <= 8"),
    "risk_differences": (risk_differences, """WITH c AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations QUALIFY r <= 2)
SELECT a.conv_id, len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) AS added, len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) AS removed FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.r = 1 AND b.r = 2"""),
    "price_points": (price_points, f"WITH {fr.BARS}, g AS (SELECT *, min(low) OVER (PARTITION BY security_id) AS lo, max(high) OVER (PARTITION BY security_id) AS hi FROM bars) SELECT security_id, session_date, round((close - lo) / nullif(hi - lo, 0), 8) AS y FROM g"),
    "portfolio_values": (portfolio_values, """WITH l AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, arg_max(value, struct_pack(ts, event_id)) AS v FROM events GROUP BY 1, 2, 3)
SELECT user_id, day, round(sum(v), 6) AS total, count(*) AS positions FROM l WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-02-05' GROUP BY 1, 2"""),
    "security_page": (security_page, f"""WITH {_BIG}, {_RET}, lb AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY session_date DESC) = 1),
nw AS (SELECT l_suppkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY k) AS news FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC) AS k FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_shipdate FROM lineitem)) WHERE k <= 3 GROUP BY 1)
SELECT s_suppkey AS security_id, s_name AS name, session_date, round(close, 6) AS close, round(ret, 8) AS change, leg, news FROM supplier LEFT JOIN lb ON lb.security_id = s_suppkey LEFT JOIN bg ON bg.security_id = s_suppkey LEFT JOIN nw ON l_suppkey = s_suppkey"""),
    "briefing": (briefing, f"""WITH {_TOP}, {_CHG} (SELECT 'top' AS section, s_suppkey AS security_id, round(s_acctbal, 2) AS value FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 4)
UNION ALL (SELECT 'leg:' || leg, security_id, round(change, 6) FROM ch WHERE change IS NOT NULL ORDER BY abs(change) DESC, security_id, leg LIMIT 10) UNION ALL SELECT 'do:' || action, security_id, gap FROM tt WHERE portfolio = 3"""),
}
