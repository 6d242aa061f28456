"""Queries over semi-structured feeds, made of the input tables, and over writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import decoders as D
from tidemark.sources import frames as fr
from tidemark.sources import sinks as K


def _series(spark, d):
    """One JSON document for each supplier: its monthly closes by day."""
    b = fr.month_bars(spark, d)
    bar = F.create_map(F.lit("close"), F.format_string("%.4f", "close"), F.lit("adjusted"), F.when(F.col("volume") % 50 == 0, "n/a").otherwise(F.format_string("%.4f", F.col("close") / 2)))
    return b.groupBy("security_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("session_date").cast("string"), bar)))).alias("payload"))


def decoded_series(spark, d):
    x = D.daily_series(_series(spark, d), "payload", "security_id")
    return x.select("security_id", "session_date", F.col("close_adjusted").isNotNull().alias("has_adjusted"), F.round("adjustment_factor", 3).alias("factor"))


def rate_rows(spark, d):
    e = fr.read(spark, d, "events", "ts", "event_type", "value").groupBy(F.to_date("ts").cast("string").alias("day"), F.upper(F.rpad(F.substring("event_type", 1, 6), 6, "X")).alias("pair")).agg(F.round(F.max("value"), 2).alias("rate"))
    doc = e.groupBy("day").agg(F.to_json(F.create_map(F.first("day"), F.map_from_entries(F.collect_list(F.struct("pair", "rate"))))).alias("payload"))
    return D.rate_table(doc, "payload")


def filing_rows(spark, d):
    """Orders as filings: parallel arrays for each customer, read from a floor on."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    g = o.withColumn("s", F.struct(F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderpriority").alias("f"), F.to_date("o_orderdate").cast("string").alias("d")))
    g = g.groupBy("o_custkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    doc = g.select("o_custkey", F.to_json(F.struct(F.col("s.a").alias("accession"), F.col("s.f").alias("form"), F.col("s.d").alias("filed"))).alias("payload"))
    return D.filing_index(doc, "payload", F.lit("1998-01-01").cast("date"), "o_custkey")


def latest_filings(spark, d):
    x = filing_rows(spark, d).withColumn("accession", F.lpad("accession", 10, "0"))
    return D.latest_filing(x, "o_custkey", ("1-URGENT", "2-HIGH"), F.lit("2001-01-01").cast("date"))


def flattened_facts(spark, d):
    """Yearly revenue and tax of each supplier, nested by taxonomy, concept and unit, and back."""
    x = fr.read(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_tax", "l_shipdate")
    g = x.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.round(F.sum("l_extendedprice"), 2).alias("Revenue"), F.round(F.sum("l_tax"), 4).alias("Tax"))
    fact = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("val"), F.format_string("%d-12-31", "y").alias("end"), F.concat_ws("-", "l_suppkey", "y").alias("accn"), F.col("y").alias("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), F.format_string("%d-02-01", F.col("y") + 1).alias("filed"))))
    g = g.groupBy("l_suppkey").agg(fact("Revenue").alias("r"), fact("Tax").alias("t"))
    body = lambda c: F.struct(F.create_map(F.lit("USD"), F.col(c)).alias("units"))
    doc = g.select("l_suppkey", F.to_json(F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenue"), body("r")), F.lit("other"), F.create_map(F.lit("Tax"), body("t")))).alias("payload"))
    return D.fact_rows(doc, "payload", "l_suppkey").select("l_suppkey", "concept", "unit", F.col("fy").cast("long"), F.round("val", 1).alias("val"), "filed")


def ownership_trades(spark, d):
    """Order lines of urgent orders as ownership reports in XML, and back."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    value = lambda tag, c: F.concat(F.lit(f"<{tag}><value>"), c, F.lit(f"</value></{tag}>"))
    xml = F.concat(
        F.lit("<ownershipDocument><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode>"),
        F.when(F.col("o_orderstatus") == "F", "P").when(F.col("o_orderstatus") == "O", "S").otherwise("Z"),
        F.lit("</transactionCode></transactionCoding>"), value("transactionDate", F.to_date("o_orderdate").cast("string")),
        F.lit("<transactionAmounts>"), value("transactionShares", F.floor(F.col("o_totalprice") / 100).cast("string")),
        value("transactionPricePerShare", F.lit("12.5")), F.lit("</transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"),
    )
    return D.trades(o.select("o_orderkey", xml.alias("payload")), "payload", "o_orderkey")


def overview_metrics(spark, d):
    """Customers as overview envelopes, with numbers, placeholders and junk."""
    c = fr.read(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    payload = F.to_json(F.create_map(F.lit("cap"), F.format_string("%.2f", "c_acctbal"), F.lit("pe_ratio"), F.format_string("%d", F.col("c_nationkey") - 5), F.lit("beta"), F.when(F.col("c_custkey") % 4 == 0, "None").when(F.col("c_custkey") % 4 == 1, "NaN").when(F.col("c_custkey") % 4 == 2, "1.5x").otherwise("0.9")))
    x = D.overview(c.select("c_custkey", payload.alias("payload")), "payload", ("cap", "pe_ratio", "beta"), "c_custkey")
    return x.select("c_custkey", F.col("metrics")["pe_ratio"].alias("pe"), F.col("metrics")["beta"].alias("beta"), F.col("unavailable")["pe_ratio"].alias("pe_reason"), F.col("unavailable")["beta"].alias("beta_reason"))


def sane_claims(spark, d):
    """Answers with claims as JSON, some broken; what stays after checks."""
    x = fr.read(spark, d, "documents", "doc_id", "text").withColumn("t", F.substring("text", 1, 200))
    claim = lambda theme, e: F.struct(F.lit(theme).alias("theme"), e.alias("excerpt"))
    body = F.to_json(F.struct(F.array(claim("ai", F.substring("t", 1, 12)), claim("ai", F.lit("@@ not there @@")), claim("zz", F.substring("t", 1, 5)), claim("cloud", F.substring("t", 3, 4))).alias("claims")))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Here: "), body, F.lit(" done"))).when(F.col("doc_id") % 3 == 1, F.lit("no json")).otherwise(body)
    got = D.model_json(answer, "claims array<struct<theme:string,excerpt:string>>")
    x = x.select("doc_id", "t", got["claims"].alias("claims"))
    kept = D.sane_claims(F.coalesce("claims", F.array().cast("array<struct<theme:string,excerpt:string>>")), ("ai", "cloud"), F.col("t"))
    return x.select("doc_id", F.size(kept).cast("long").alias("kept"), F.size(F.coalesce("claims", F.array().cast("array<struct<theme:string,excerpt:string>>"))).cast("long").alias("claims"))


def upserted(spark, d):
    """Suppliers of one half with new balances put over all."""
    s = fr.read(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal")
    return K.upsert(s, s.filter("s_acctbal > 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), "s_suppkey")


def rejected_inserts(spark, d):
    """Rows that come again under their key, but with other contents."""
    s = fr.read(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal")
    new = s.withColumn("s_name", F.when(F.col("s_acctbal") < 0, "changed").otherwise(F.col("s_name")))
    return K.insert_if_absent(s.filter("s_acctbal < 5000"), new, "s_suppkey")[1]


def collector_marks(spark, d):
    """Marks of each user's last event, moved on by what came later."""
    e = fr.read(spark, d, "events", "user_id", "ts")
    old = e.filter("ts < TIMESTAMP '2024-01-15'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return K.marks(old, e.filter("ts >= TIMESTAMP '2024-01-15'"), "user_id", "ts")


def pending(spark, d):
    """Orders that no line was processed of, and the distinct customers they belong to."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey")
    x = o.join(fr.read(spark, d, "lineitem", "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return x.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def verified_currencies(spark, d):
    """The currency of each supplier's figures, proven by consensus, by quarters or by a year."""
    x = fr.read(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_shipdate").filter("l_shipdate < TIMESTAMP '2001-01-01'")
    end = lambda unit, months: F.date_sub(F.add_months(F.trunc("l_shipdate", unit), months), 1)
    code = F.when(F.col("l_suppkey") % 3 == 0, "USD").otherwise("EUR")
    report = lambda c: F.struct(F.col("end"), code.alias("currency"), F.col(c).alias("amount"))
    q = x.groupBy("l_suppkey", end("quarter", 3).alias("end")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    q = q.groupBy("l_suppkey").agg(F.collect_list(report("v")).alias("quarters"))
    y = x.groupBy("l_suppkey", end("year", 12).alias("end")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    y = y.groupBy("l_suppkey").agg(F.collect_list(report("v")).alias("years"), F.max_by("v", "end").alias("total"))
    today = F.lit("2001-01-15").cast("date")
    z = q.join(y, "l_suppkey").withColumn("total", F.col("total") * F.when(F.col("l_suppkey") % 5 == 0, 1.5).otherwise(1.0))
    z = z.withColumn("quarters", D.report_dates(F.col("quarters"), today)).withColumn("years", D.report_dates(F.col("years"), today))
    got = D.verified_currency(F.col("quarters"), F.col("years"), F.col("total"), F.lit("USD"), today)
    return z.select("l_suppkey", F.size("quarters").cast("long").alias("quarters"), got.alias("currency"))


QUERIES = {
    "verified_currencies": (verified_currencies, """WITH q AS (SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS e, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER w AS r, lag(e) OVER w - e AS gap FROM q WINDOW w AS (PARTITION BY l_suppkey ORDER BY e DESC)),
y AS (SELECT l_suppkey, year(l_shipdate) AS y, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY y DESC) = 1),
t AS (SELECT l_suppkey, v AS year_v, v * CASE WHEN l_suppkey % 5 = 0 THEN 1.5 ELSE 1.0 END AS total FROM y),
g AS (SELECT l_suppkey, count(*) AS n, sum(v) FILTER (r <= 4) AS s, count(*) FILTER (r <= 4) AS c, bool_and(r > 4 OR r = 1 OR gap BETWEEN 80 AND 100) AS even, bool_or(DATE '2001-01-15' - e <= 366) AS recent FROM k GROUP BY 1)
SELECT l_suppkey, n AS quarters, CASE WHEN l_suppkey % 3 = 0 AND recent THEN 'USD' WHEN c = 4 AND even AND abs(s - total) <= 1e-4 * total OR abs(year_v - total) <= 1e-4 * total THEN CASE WHEN l_suppkey % 3 = 0 THEN 'USD' ELSE 'EUR' END END AS currency
FROM g JOIN t USING (l_suppkey)"""),
    "decoded_series": (decoded_series, f"WITH {fr.BARS} SELECT security_id, session_date, volume % 50 <> 0 AS has_adjusted, CASE WHEN volume % 50 <> 0 THEN 0.5 END AS factor FROM bars WHERE close < 1e6"),
    "rate_rows": (rate_rows, "SELECT pair, CAST(day AS DATE) AS day, rate FROM (SELECT CAST(ts AS DATE) AS day, upper(rpad(substr(event_type, 1, 6), 6, 'X')) AS pair, round(max(value), 2) AS rate FROM events GROUP BY 1, 2) WHERE rate > 0"),
    "filing_rows": (filing_rows, "SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS accession, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderdate >= DATE '1998-01-01'"),
    "latest_filings": (latest_filings, "SELECT o_custkey, max(lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS accession, max(CAST(o_orderdate AS DATE)) AS filed FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '2001-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1"),
    "flattened_facts": (flattened_facts, "SELECT l_suppkey, 'Revenue' AS concept, 'USD' AS unit, year(l_shipdate) AS fy, round(round(sum(l_extendedprice), 2), 1) AS val, (year(l_shipdate) + 1) || '-02-01' AS filed FROM lineitem GROUP BY ALL"),
    "ownership_trades": (ownership_trades, "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'P' ELSE 'S' END AS code, CAST(o_orderdate AS DATE) AS day, floor(o_totalprice / 100) AS shares, 12.5::DOUBLE AS price FROM orders WHERE o_orderstatus IN ('F', 'O')"),
    "overview_metrics": (overview_metrics, """SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN CAST(c_nationkey - 5 AS DOUBLE) END AS pe, CASE WHEN c_custkey % 4 = 3 THEN 0.9::DOUBLE END AS beta,
  CASE WHEN c_nationkey <= 5 THEN 'non_positive' END AS pe_reason, CASE c_custkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'non_finite' WHEN 2 THEN 'invalid' END AS beta_reason FROM customer"""),
    "sane_claims": (sane_claims, """SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE CAST(substr(text, 1, 12) <> '' AS BIGINT) + CAST(length(text) >= 3 AS BIGINT) END AS kept, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 4 END AS claims FROM documents"""),
    "upserted": (upserted, "SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "rejected_inserts": (rejected_inserts, "SELECT s_suppkey, 'changed' AS s_name, s_acctbal FROM supplier WHERE s_acctbal < 0"),
    "collector_marks": (collector_marks, "SELECT user_id, max(ts) AS ts FROM events GROUP BY 1"),
    "pending_accessions": (pending, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1"),
}
