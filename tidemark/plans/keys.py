"""Queries over keys, fingerprints, links and checks of texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import keys as K
from tidemark.operators import policy as P
from tidemark.sources import frames as fr

from .portfolio import _CTX, _context, _decide_sql


def _docs(spark, d, *more):
    return fr.read(spark, d, "documents", "doc_id", "text", *more)


def cache_lookups(spark, d):
    """Keys under which results are kept, and which documents have one already."""
    x = _docs(spark, d, "source", "lang").withColumn("content_hash", S.content_hash(F.coalesce("text", F.lit(""))))
    claims = K.piped(F.col("source"), F.col("content_hash"), F.lit("m1"), F.lit("extract-v1"), F.lit("4.0"), F.lit("t1"))
    digest = K.piped(F.col("source"), F.col("content_hash"), F.lit("m1"), F.lit("digest-v2"))
    x = x.withColumn("claims_key", claims).withColumn("digest_key", digest)
    kept = x.filter("doc_id % 5 = 0").groupBy("claims_key").agg(F.min("doc_id").alias("hit"))
    out = x.join(kept, "claims_key", "left")
    return out.select("doc_id", F.sha2("claims_key", 256).alias("claims_key"), F.sha2("digest_key", 256).alias("digest_key"), "hit")


def input_fingerprints(spark, d):
    c = fr.read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    plain = F.regexp_replace("text", r'["\\\x00-\x1f/]', " ")
    return c.select("conv_id", "turn", K.canonical_hash(system_prompt=F.col("role"), user_content=plain).alias("fingerprint"))


def decision_prints(spark, d):
    """What a decision rests on, in the short forms that signatures are made of."""
    x = P.decide(_context(spark, d))
    evidence = K.evidence_print(F.col("percentile"), F.col("coverage"), F.col("confidence"), F.col("direction"))
    return x.select("security_id", K.gate_print(F.col("trace")).alias("gates"), evidence.alias("evidence"), K.bucketed(F.col("weight"), 2.5).alias("weight"))


def suppressions(spark, d):
    """Suggestions that an earlier answer hides."""
    x = P.decide(_context(spark, d)).withColumn("signature", F.concat_ws("/", "action", "direction"))
    answer = F.element_at(F.array(F.lit("ACCEPTED"), F.lit("REJECTED"), F.lit("DEFERRED")), (F.pmod("security_id", F.lit(3)) + 1).cast("int"))
    answered = F.when(F.pmod("security_id", F.lit(4)) == 0, "BUY/STABLE").otherwise(F.col("signature"))
    expires = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("security_id", F.lit(10)).cast("int"))
    hidden = K.suppressed(F.col("signature"), answered, answer, expires, F.lit("2024-01-05").cast("date"))
    return x.select("security_id", "action", hidden.alias("suppressed"))


def source_links(spark, d):
    """Addresses of documents: their own where it is one, else that of their filing."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey").cast("string")
    accession = F.when(F.pmod("o_orderkey", F.lit(9)) == 0, k).otherwise(F.concat(F.lpad(k, 10, "0"), F.lit("-24-"), F.lpad(F.pmod("o_custkey", F.lit(1000)).cast("string"), 6, "0")))
    url = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit("HTTPS://news.example/a"), k)).when(F.pmod("o_orderkey", F.lit(3)) == 1, F.concat(F.lit("ftp://x/"), k))
    source = F.when(F.col("o_orderstatus") == "P", "news").otherwise("edgar")
    return o.select("o_orderkey", K.source_url(url, source, F.col("o_custkey").cast("string"), accession).alias("url"))


def answer_checks(spark, d):
    """What answers do wrong: markers that lead nowhere, none at all, cuts that are not told."""
    c = fr.read(spark, d, "conversations", "conv_id", "turn", "role", "text").filter("role = 'assistant'")
    cited = F.when(F.pmod("conv_id", F.lit(3)) > 0, F.concat(F.col("text"), F.lit(" [cite:"), F.pmod("conv_id", F.lit(5)), F.lit("]"))).otherwise(F.col("text"))
    answer = F.when(F.pmod("turn", F.lit(4)) == 1, F.concat(cited, F.lit(" I only READ a part."))).otherwise(cited)
    ids = F.when(F.pmod("conv_id", F.lit(7)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1"), F.lit("3")))
    return c.select("conv_id", "turn", F.array_join(K.violations(answer, ids, F.pmod("turn", F.lit(2)) == 1), ",").alias("violations"))


def readings(spark, d):
    """How many documents of each form are read in which way."""
    forms = F.array(*[F.lit(f) for f in ("10-K", "8-K", "NEWS", "4", "S-1", "6-K")])
    x = _docs(spark, d).select(F.element_at(forms, (F.pmod("doc_id", F.lit(6)) + 1).cast("int")).alias("form"))
    return x.groupBy("form", K.reading(F.col("form")).alias("reading")).agg(F.count(F.lit(1)).alias("n"))


def sane_digests(spark, d):
    """Digests from JSON, some of it broken, with the risks that their document bears out."""
    x = _docs(spark, d).filter("text IS NOT NULL")
    t = F.regexp_replace(S.squeezed(F.col("text")), r'["\\\x00-\x1f/]', "")
    x = x.select("doc_id", t.alias("t"))
    risk = lambda category, severity, text: F.struct(category.alias("category"), severity.alias("severity"), text.alias("text"))
    category = F.element_at(F.array(F.lit("macro"), F.lit("WEATHER"), F.lit("Regulatory")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    risks = F.array(risk(category, F.lit("high"), F.substring("t", 11, 25)), risk(category, F.lit("?"), F.lit("no such words")), risk(category, F.lit("LOW"), F.lit("")))
    raw = F.to_json(F.struct(F.substring("t", 1, 12).alias("summary"), risks.alias("risks")))
    x = x.withColumn("g", K.sane_digest(F.when(F.pmod("doc_id", F.lit(11)) == 0, "{broken").otherwise(raw)))
    kept = K.grounded_risks(F.col("g.risks"), F.col("t"))
    shown = F.array_join(F.transform(kept, lambda r: F.concat_ws("/", r["category"], r["severity"])), ",")
    return x.select("doc_id", F.col("g.summary").alias("summary"), F.size("g.risks").cast("long").alias("risks"), shown.alias("grounded"))


def mentions(spark, d):
    """Companies that questions name, in the order of their first listing."""
    s = fr.read(spark, d, "nation", "n_nationkey", "n_name")
    q = fr.read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    asked = F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.concat(F.lit("What of $N"), F.col("c_nationkey"), F.lit("?"))).otherwise(F.concat(F.lit("tell me about NATION_"), F.col("c_nationkey"), F.lit(" and N1")))
    q = q.select("c_custkey", asked.alias("question"))
    named = s.select("n_nationkey", F.concat(F.lit("N"), F.col("n_nationkey")).alias("ticker"), F.concat(F.lit("nation_"), F.col("n_nationkey"), F.lit(" ")).alias("name"))
    # a question meets its candidates by the words in it, not every company
    words = q.select("c_custkey", "question", F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit(r"[0-9]+"), F.lit(0)))).alias("no"))
    x = words.join(named, F.col("no") == F.col("n_nationkey").cast("string"))
    x = x.filter(K.mentioned(F.col("question"), F.col("ticker"), F.col("name")))
    return x.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("n_nationkey")), lambda i: F.concat(F.lit("N"), i)), ",").alias("tickers"))


def prior_filings(spark, d):
    """Each order's last earlier one of the same customer and priority."""
    o = fr.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").withColumn("day", F.to_date("o_orderdate"))
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, -1)
    return o.select("o_orderkey", F.max(F.struct("day", "o_orderkey")).over(w)["o_orderkey"].alias("prior"))


def registry_check(spark, d):
    """Suppliers whose number in the registry is missing or another one."""
    s = fr.read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    given = F.lpad(F.col("s_suppkey").cast("string"), 10, "0")
    registry = s.filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("k"), F.when(F.pmod("s_suppkey", F.lit(7)) == 0, F.lit("0000000001")).otherwise(given).alias("found"))
    x = s.join(registry, F.col("s_suppkey") == F.col("k"), "left").withColumn("given", given)
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("given"), "different")
    return x.select("s_suppkey", fault.alias("fault")).filter("fault IS NOT NULL")


_FORM = "['10-K', '8-K', 'NEWS', '4', 'S-1', '6-K'][doc_id % 6 + 1]"
QUERIES = {
    "cache_lookups": (cache_lookups, """WITH k AS (SELECT doc_id, source || '|' || 'sha256:' || sha256(coalesce(text, '')) || '|m1|' AS k FROM documents), h AS (SELECT k, min(doc_id) AS hit FROM k WHERE doc_id % 5 = 0 GROUP BY 1)
SELECT doc_id, sha256(k || 'extract-v1|4.0|t1') AS claims_key, sha256(k || 'digest-v2') AS digest_key, hit FROM k LEFT JOIN h USING (k)"""),
    "input_fingerprints": (input_fingerprints, """SELECT conv_id, turn, sha256('{"system_prompt": "' || role || '", "user_content": "' || regexp_replace(text, '["\\\\\\x00-\\x1f/]', ' ', 'g') || '"}') AS fingerprint FROM conversations"""),
    "decision_prints": (decision_prints, f"""WITH a AS ({_decide_sql()}), b AS (WITH {_CTX} SELECT * FROM x)
SELECT security_id, array_to_string(list_sort(string_split(trace, ',')), ',') AS gates, 'pct=' || coalesce(CAST(CAST(floor(percentile / 10) AS INT) AS VARCHAR), '-') || '|cov=' || CAST(CAST(floor(round(coverage * 10, 9)) AS INT) AS VARCHAR) || '|conf=' || confidence || '|dir=' || direction AS evidence,
  printf('%.1f', floor(round(weight / 2.5, 9) + 0.5) * 2.5) AS weight FROM a JOIN b USING (security_id)"""),
    "suppressions": (suppressions, f"""WITH a AS ({_decide_sql()}), b AS (WITH {_CTX} SELECT * FROM x)
SELECT security_id, action, (security_id % 4 <> 0 OR action || '/' || direction = 'BUY/STABLE') AND (security_id % 3 = 1 OR security_id % 3 = 2 AND security_id % 10 > 4) AS suppressed FROM a JOIN b USING (security_id)"""),
    "source_links": (source_links, """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'HTTPS://news.example/a' || o_orderkey WHEN o_orderstatus <> 'P' AND o_custkey > 0 AND o_orderkey % 9 <> 0 THEN
  'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '24' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 6, '0') || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-24-' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 6, '0') || '-index.html' END AS url FROM orders"""),
    "answer_checks": (answer_checks, r"""WITH a AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 3 > 0 THEN ' [cite:' || (conv_id % 5) || ']' ELSE '' END AS t, CASE WHEN conv_id % 7 = 0 THEN []::VARCHAR[] ELSE ['1', '3'] END AS ids FROM conversations WHERE role = 'assistant'),
m AS (SELECT *, regexp_extract_all(t, '\[cite:([^\]]+)\]', 1) AS m FROM a)
SELECT conv_id, turn, array_to_string(list_concat(list_transform(list_filter(m, lambda x: NOT list_contains(ids, x)), lambda x: 'unresolved_citation'), list_concat(CASE WHEN len(ids) > 0 AND len(m) = 0 THEN ['missing_citation'] ELSE [] END,
  CASE WHEN turn % 2 = 1 AND turn % 4 <> 1 AND NOT regexp_matches(lower(t), 'truncat|narrowed|did not have the full|only read') THEN ['undisclosed_truncation'] ELSE [] END)), ',') AS violations FROM m"""),
    "readings": (readings, f"SELECT {_FORM} AS form, CASE WHEN {_FORM} = 'NEWS' THEN 'news' WHEN {_FORM} IN ('8-K', '6-K') THEN 'whole' WHEN {_FORM} IN ('10-K', 'S-1') THEN 'sections' ELSE 'skipped' END AS reading, count(*) AS n FROM documents GROUP BY 1, 2"),
    "sane_digests": (sane_digests, r"""WITH t AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), '["\\\x00-\x1f/]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, trim(regexp_replace(substr(t, 11, 25), '[\x20\x09-\x0D]+', ' ', 'g')) AS e, trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g')) AS s, ['MACRO', 'OTHER', 'REGULATORY'][doc_id % 3 + 1] AS c FROM t)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE substr(t, 1, 12) END AS summary, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 + CAST(substr(t, 11, 25) <> '' AS INT) END AS BIGINT) AS risks,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE array_to_string(list_concat(CASE WHEN e <> '' AND contains(s, e) THEN [c || '/HIGH'] ELSE [] END, CASE WHEN contains(s, 'no such words') THEN [c || '/LOW'] ELSE [] END), ',') END AS grounded FROM x"""),
    "mentions": (mentions, """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_nationkey WHEN c_nationkey = 1 THEN 'N1' ELSE array_to_string(list_transform(list_sort([1, c_nationkey]), lambda i: 'N' || i), ',') END AS tickers FROM customer"""),
    "prior_filings": (prior_filings, """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, arg_max(o_orderkey, struct_pack(day, o_orderkey)) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior FROM o"""),
    "registry_check": (registry_check, "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' ELSE 'different' END AS fault FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 AND s_suppkey <> 1"),
}
