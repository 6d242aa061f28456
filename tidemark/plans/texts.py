"""Queries over texts, conversations and read models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import texts as X
from tidemark.sources import frames as fr


#: Characters that the sections of a filing have together at most, as in the reference.
SECTION_CHARS = 300_000


def _docs(spark, d, *more):
    return fr.read(spark, d, "documents", "doc_id", "text", *more)


def content_hashes(spark, d):
    """Documents of one source and content: the smallest id, and how many there are."""
    x = _docs(spark, d, "source").withColumn("content_hash", S.content_hash(F.col("text")))
    return x.groupBy("source", "content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def verified_excerpts(spark, d):
    """Claims about each document: its own words, cut words, and words of the one before it."""
    x = _docs(spark, d)
    t = S.squeezed(F.col("text"))
    before = x.select((F.col("doc_id") + 1).alias("doc_id"), F.substring(t, 1, 40).alias("_other"))
    x = x.join(before, "doc_id", "left")
    claims = x.select(
        "doc_id", F.col("text").alias("source"),
        F.array(F.substring(t, 5, 30), F.concat(F.substring(t, 1, 20), F.lit("...")), F.coalesce("_other", F.lit(""))).alias("claims"),
    )
    claims = claims.select("doc_id", "source", F.posexplode("claims").alias("claim_no", "excerpt"))
    out = X.grounded(claims, "source", "excerpt")
    return out.select("doc_id", F.col("claim_no").cast("long"), "verified")


def filing_text(spark, d):
    p = fr.read(spark, d, "pages", "page_id", "html")
    t = X.text_of("html")
    return p.select("page_id", t.alias("text")).select("page_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def filing_sections(spark, d):
    """Sections of filings that are put together from the thirds of whole documents."""
    x = _docs(spark, d).withColumn("t", S.squeezed(F.col("text")))
    toc = F.lit("Item 1. Business\nItem 1A. Risk Factors\nItem 7. Management's Discussion\n")
    third = F.ceil(F.char_length("t") / 3).cast("int")
    part = lambda n: F.substring(F.col("t"), 1 + n * third, third)
    body = F.concat(toc, F.lit("Item 1. Business\n"), part(0), F.lit("\nItem 1A - Risk Factors\n"), part(1), F.lit("\nItem 2. Properties\nnone\nItem 7. Management's Discussion\n"), part(2))
    x = x.select("doc_id", X.bounded(X.target_sections(F.lit("10-K"), body), SECTION_CHARS).alias("s"))
    x = x.select("doc_id", F.posexplode("s").alias("pos", "s"))
    return x.select("doc_id", F.col("pos").cast("long"), F.col("s.item").alias("item"), F.char_length("s.text").cast("long").alias("n_chars"))


def latest_turns(spark, d):
    """The last turn of each conversation."""
    c = fr.read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    out = c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", F.char_length("text").cast("long").alias("n_chars")), "turn").alias("b"))
    return out.select("conv_id", "b.*")


def citations(spark, d):
    """Markers of answers that do not lead to one of the three items retrieved."""
    c = fr.read(spark, d, "conversations", "conv_id", "turn", "role", "text").filter("role = 'assistant'")
    answer = F.concat(F.col("text"), F.lit(" [cite:"), F.col("turn"), F.lit("] and [cite:"), F.pmod("conv_id", F.lit(7)), F.lit("]"))
    ids = F.array(*[F.lit(str(i)) for i in (1, 3, 5)])
    x = c.select("conv_id", "turn", X.citation_markers(answer).alias("m"), X.unresolved(answer, ids).alias("u"))
    return x.select("conv_id", "turn", F.size("m").cast("long").alias("markers"), F.array_join("u", ",").alias("unresolved"))


def packed_items(spark, d):
    """What fits of each conversation's turns into a budget of tokens, at most three verbatim."""
    c = fr.read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    x = c.select("conv_id", "turn", F.greatest(F.lit(1), F.floor(F.char_length("text") / 4)).cast("long").alias("cost"), (F.col("role") == "assistant").alias("verbatim"))
    return X.packed(x, "conv_id", "turn", "cost", "verbatim", 60, 3).select("conv_id", "turn", "kept")


def top_scores(spark, d):
    x = fr.read(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal")
    return x.orderBy(F.desc("s_acctbal"), "s_name").limit(4)


def movers(spark, d):
    """Three largest gains and losses of a month against the one before."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    x = fr.month_bars(spark, d).withColumn("change", F.round(F.col("close") - F.lag("close").over(w), 6))
    x = x.filter("session_date = DATE '1999-05-01' AND change <> 0").select("security_id", "change")
    up = x.filter("change > 0").orderBy(F.desc("change"), "security_id").limit(3).withColumn("side", F.lit("up"))
    down = x.filter("change < 0").orderBy("change", "security_id").limit(3).withColumn("side", F.lit("down"))
    return up.unionByName(down)


def security_list(spark, d):
    """Every security with its last bar, if it has one at the latest session."""
    b = fr.month_bars(spark, d)
    last = b.agg(F.max("session_date").alias("session_date"))
    now = b.join(F.broadcast(last), "session_date").select("security_id", "session_date", "close")
    return fr.securities(spark, d).select("security_id", "name", "cohort").join(now, "security_id", "left")


def digests(spark, d):
    """One document of each source and language: good ones first, then the newest."""
    x = _docs(spark, d, "lang", "source").join(fr.read(spark, d, "labels", "doc_id", "quality", "toxic"), "doc_id", "left")
    x = x.withColumn("key", F.concat_ws("/", "source", "lang"))
    out = X.preferred(x, "key", F.desc(F.coalesce("quality", F.lit(-1))), F.desc("doc_id"))
    return out.select("key", "doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"))


def search_names(spark, d):
    """Parts whose name or brand holds a text, whatever its case."""
    p = fr.read(spark, d, "part", "p_partkey", "p_name", "p_brand")
    q = F.lit("part_1")
    return p.filter(F.contains(F.lower("p_name"), q) | F.contains(F.lower("p_brand"), F.lit("#1"))).select("p_partkey", "p_name")


def daily_counts(spark, d):
    """Events of each day by type, with weekdays since the first day."""
    e = fr.read(spark, d, "events", "ts", "event_type").withColumn("day", F.to_date("ts"))
    g = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))
    return g.withColumn("weekdays", S.business_days(F.lit("2023-12-30").cast("date"), F.col("day")))


def reconciliation(spark, d):
    """Documents without a label and labels without a document."""
    a = fr.read(spark, d, "documents", "doc_id").distinct()
    b = fr.read(spark, d, "labels", "doc_id").distinct()
    return a.join(b, "doc_id", "left_anti").withColumn("missing", F.lit("label")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("missing", F.lit("document")))


def attribution_counts(spark, d):
    """Orders by whether they were followed and are mature."""
    o = fr.read(spark, d, "orders", "o_orderstatus", "o_orderdate")
    mature = F.datediff(F.lit("2001-08-01"), F.to_date("o_orderdate")) >= 180
    return o.groupBy((F.col("o_orderstatus") == "F").alias("followed"), mature.alias("mature")).agg(F.count(F.lit(1)).alias("n"))


def rate_limit(spark, d):
    """Errors of each user that come when five were let through within two days."""
    e = fr.read(spark, d, "events", "event_id", "ts", "user_id")

    def run(pdf):
        from collections import deque

        seen, ok = deque(), []
        for t in pdf.sort_values(["ts", "event_id"])["ts"]:
            while seen and (t - seen[0]).total_seconds() >= 172800:
                seen.popleft()
            ok.append(len(seen) < 5)
            if ok[-1]:
                seen.append(t)
        return pdf.sort_values(["ts", "event_id"]).assign(allowed=ok)[["event_id", "user_id", "allowed"]]

    return e.groupBy("user_id").applyInPandas(run, "event_id long, user_id long, allowed boolean")


_WS = r"[\x20\x09-\x0D]+"
_SQ = f"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"

QUERIES = {
    "content_hashes": (content_hashes, "SELECT source, 'sha256:' || sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY ALL"),
    "verified_excerpts": (verified_excerpts, f"""WITH t AS (SELECT doc_id, {_SQ} AS t FROM documents),
c AS (SELECT t.doc_id, t.t, unnest([0, 1, 2]) AS claim_no, unnest([substr(t.t, 5, 30), substr(t.t, 1, 20) || '...', coalesce(substr(b.t, 1, 40), '')]) AS x FROM t LEFT JOIN t b ON b.doc_id + 1 = t.doc_id),
e AS (SELECT doc_id, claim_no, t, trim(regexp_replace(x, '{_WS}', ' ', 'g')) AS e FROM c)
SELECT doc_id, CAST(claim_no AS BIGINT) AS claim_no, CASE WHEN e <> '' AND contains(t, e) THEN e WHEN ends_with(e, '...') AND trim(substr(e, 1, length(e) - 3)) <> '' AND contains(t, trim(substr(e, 1, length(e) - 3))) THEN trim(substr(e, 1, length(e) - 3)) END AS verified FROM e"""),
    "filing_text": (filing_text, None),
    "filing_sections": (filing_sections, None),
    "latest_turns": (latest_turns, "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"),
    "citation_checks": (citations, r"""WITH a AS (SELECT conv_id, turn, regexp_extract_all(text || ' [cite:' || turn || '] and [cite:' || (conv_id % 7) || ']', '\[cite:([^\]]+)\]', 1) AS m FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, len(m) AS markers, coalesce(array_to_string(list_filter(m, lambda x: NOT list_contains(['1', '3', '5'], x)), ','), '') AS unresolved FROM a"""),
    "packed_items": (packed_items, """WITH RECURSIVE i AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS cost, role = 'assistant' AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS turn, CAST(60 AS BIGINT) AS left_, CAST(0 AS BIGINT) AS used, false AS kept FROM (SELECT DISTINCT conv_id FROM i)
  UNION ALL SELECT i.conv_id, i.k, i.turn, left_ - CASE WHEN (NOT v OR used < 3) AND cost <= left_ THEN cost ELSE 0 END, used + CASE WHEN v AND used < 3 THEN 1 ELSE 0 END, (NOT v OR used < 3) AND cost <= left_ FROM r JOIN i ON i.conv_id = r.conv_id AND i.k = r.k + 1)
SELECT conv_id, turn, kept FROM r WHERE k > 0"""),
    "top_scores": (top_scores, "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 4"),
    "movers": (movers, f"""WITH {fr.BARS}, c AS (SELECT security_id, session_date, round(close - lag(close) OVER (PARTITION BY security_id ORDER BY session_date), 6) AS change FROM bars),
n AS (SELECT security_id, change FROM c WHERE session_date = DATE '1999-05-01' AND change <> 0)
(SELECT security_id, change, 'up' AS side FROM n WHERE change > 0 ORDER BY change DESC, security_id LIMIT 3) UNION ALL (SELECT security_id, change, 'down' FROM n WHERE change < 0 ORDER BY change, security_id LIMIT 3)"""),
    "security_list": (security_list, f"""WITH {fr.SECURITIES}, {fr.BARS}, l AS (SELECT security_id, session_date, close FROM bars WHERE session_date = (SELECT max(session_date) FROM bars))
SELECT security_id, name, cohort, session_date, close FROM sec LEFT JOIN l USING (security_id)"""),
    "preferred_digests": (digests, """SELECT source || '/' || lang AS key, doc_id, CAST(coalesce(quality, -1) AS BIGINT) AS quality FROM documents LEFT JOIN labels USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY source || '/' || lang ORDER BY coalesce(quality, -1) DESC, doc_id DESC) = 1"""),
    "search_names": (search_names, "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'part_1') OR contains(lower(p_brand), '#1')"),
    "daily_counts": (daily_counts, """WITH g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT day, n, errors, len(list_filter(range(DATE '2023-12-31', day + 1, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS weekdays FROM g"""),
    "reconciliation": (reconciliation, """SELECT DISTINCT doc_id, 'label' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""),
    "attribution_counts": (attribution_counts, "SELECT o_orderstatus = 'F' AS followed, DATE '2001-08-01' - CAST(o_orderdate AS DATE) >= 180 AS mature, count(*) AS n FROM orders GROUP BY ALL"),
    "rate_limit": (rate_limit, """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, []::TIMESTAMP[] AS seen, false AS allowed FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN len(list_filter(seen, lambda t: t > ts - INTERVAL 2 DAY)) < 5 THEN list_append(list_filter(seen, lambda t: t > ts - INTERVAL 2 DAY), CAST(ts AS TIMESTAMP)) ELSE list_filter(seen, lambda t: t > ts - INTERVAL 2 DAY) END,
    len(list_filter(seen, lambda t: t > ts - INTERVAL 2 DAY)) < 5 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, user_id, allowed FROM r WHERE k > 0"""),
}
