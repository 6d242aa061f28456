"""Decoders of semi-structured feeds: nested maps, parallel arrays, envelopes, markup.

A feed is a column of JSON or XML text; each decoder is one projection, or one
projection and an explode, with a declared schema. Nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAXONOMIES = ("us-gaap", "ifrs-full", "dei")
NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def strict_number(c: Column) -> Column:
    """A double if the text is a plain finite number, else null."""
    return F.when(F.trim(c).rlike(NUMBER), F.trim(c).try_cast("double"))


def number_reason(c: Column) -> Column:
    """Why a number is missing: null text, a placeholder, or no number."""
    t = F.trim(c)
    return (
        F.when(c.isNull() | t.isin("", "None", "-"), "missing")
        .when(t.isin("NaN", "Infinity", "-Infinity"), "non_finite")
        .when(~t.rlike(NUMBER), "invalid")
    )


def daily_series(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """{"day": {"close": "1.0", ...}} to one row for each day, numbers checked."""
    days = F.from_json(payload, "map<string,map<string,string>>")
    x = df.select(*keep, F.explode(days).alias("day", "bar"))
    adj, close = strict_number(F.col("bar")["adjusted"]), strict_number(F.col("bar")["close"])
    return x.select(
        *keep,
        F.col("day").try_cast("date").alias("session_date"),
        close.alias("close"),
        adj.alias("close_adjusted"),
        F.when(close == 0, 1.0).otherwise(adj / close).alias("adjustment_factor"),
    ).filter("session_date IS NOT NULL")


def rate_table(df: DataFrame, payload: str) -> DataFrame:
    """{"day": {"PAIR": rate}} to (pair, day, rate): two maps exploded one after the other."""
    x = df.select(F.explode(F.from_json(payload, "map<string,map<string,double>>")).alias("day", "rates"))
    x = x.select(F.col("day").try_cast("date").alias("day"), F.explode("rates").alias("pair", "rate"))
    return x.filter(F.col("pair").rlike("^[A-Z]{6}$") & (F.col("rate") > 0)).select("pair", "day", "rate")


def filing_index(df: DataFrame, payload: str, floor, *keep: str) -> DataFrame:
    """A struct of parallel arrays to one row for each filing not before ``floor``."""
    s = F.from_json(payload, "accession array<string>, form array<string>, filed array<string>")
    z = F.arrays_zip(s["accession"].alias("accession"), s["form"].alias("form"), s["filed"].alias("filed"))
    z = F.filter(z, lambda r: r["filed"].try_cast("date") >= floor)
    x = df.select(*keep, F.explode(z).alias("r"))
    return x.select(*keep, F.col("r.accession").alias("accession"), F.col("r.form").alias("form"), F.col("r.filed").cast("date").alias("filed"))


def latest_filing(index: DataFrame, key: str, forms: tuple[str, ...], before=None) -> DataFrame:
    """Largest accession and date of the wanted forms, strictly before a date."""
    x = index.filter(F.col("form").isin(*forms))
    x = x if before is None else x.filter(F.col("filed") < before)
    return x.groupBy(key).agg(F.max("accession").alias("accession"), F.max("filed").alias("filed"))


def fact_rows(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """taxonomy -> concept -> unit -> facts, flattened; known taxonomies only."""
    schema = "map<string,map<string,struct<units:map<string,array<struct<val:double,`end`:string,accn:string,fy:int,fp:string,form:string,filed:string>>>>>>"
    x = df.select(*keep, F.explode(F.from_json(payload, schema)).alias("taxonomy", "concepts")).filter(F.col("taxonomy").isin(*TAXONOMIES))
    x = x.select(*keep, "taxonomy", F.explode("concepts").alias("concept", "body"))
    x = x.select(*keep, "taxonomy", "concept", F.explode("body.units").alias("unit", "facts"))
    return x.select(*keep, "taxonomy", "concept", "unit", F.explode("facts").alias("f")).select(*keep, "taxonomy", "concept", "unit", "f.*")


def snapshots_by_accession(facts: DataFrame, key: str) -> DataFrame:
    """Facts of each accession together, with the last one's heading."""
    return facts.groupBy(key, "accn").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("form", F.struct("filed", "concept", "end")).alias("form"),
        F.max("filed").alias("filed"),
        F.array_sort(F.collect_set("concept")).alias("concepts"),
    )


def trades(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Non-derivative trades of an ownership report; rows without date or shares go."""
    path = "/ownershipDocument/nonDerivativeTable/nonDerivativeTransaction"
    values = lambda tail: F.xpath(payload, F.lit(f"{path}{tail}/text()"))
    z = F.arrays_zip(
        values("/transactionCoding/transactionCode").alias("code"), values("/transactionDate/value").alias("day"),
        values("/transactionAmounts/transactionShares/value").alias("shares"), values("/transactionAmounts/transactionPricePerShare/value").alias("price"),
    )
    x = df.select(*keep, F.explode(z).alias("t"))
    x = x.select(*keep, F.col("t.code").alias("code"), F.col("t.day").try_cast("date").alias("day"), strict_number(F.col("t.shares")).alias("shares"), F.coalesce(strict_number(F.col("t.price")), F.lit(0.0)).alias("price"))
    return x.filter(F.col("code").isin("P", "S", "M", "A", "F", "G", "C", "D") & F.col("day").isNotNull() & F.col("shares").isNotNull())


def overview(df: DataFrame, payload: str, metrics: tuple[str, ...], *keep: str) -> DataFrame:
    """An envelope's numbers as a map, and a reason for each that is not available."""
    m = F.from_json(payload, "map<string,string>")
    x = df.select(*keep, m.alias("m"))
    names = F.array(*[F.lit(k) for k in metrics])
    values = F.map_from_arrays(names, F.array(*[F.when(strict_number(F.col("m")[k]) > 0, strict_number(F.col("m")[k])) if k.endswith("ratio") else strict_number(F.col("m")[k]) for k in metrics]))
    why = F.map_from_arrays(names, F.array(*[F.coalesce(number_reason(F.col("m")[k]), F.when(F.lit(k.endswith("ratio")) & (strict_number(F.col("m")[k]) <= 0), "non_positive")) for k in metrics]))
    return x.select(*keep, F.map_filter(values, lambda _, v: v.isNotNull()).alias("metrics"), F.map_filter(why, lambda _, v: v.isNotNull()).alias("unavailable"))


def model_json(c: Column, schema: str) -> Column:
    """JSON of a model's answer; if it can't be read, without broken \\u escapes, then the braces alone."""
    first = F.from_json(c, schema)
    fixed = F.from_json(F.regexp_replace(c, r"\\u(?![0-9a-fA-F]{4})", "u"), schema)
    inner = F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)
    read = lambda s: F.when(s.isNotNull() & F.exists(F.map_values(F.from_json(F.to_json(s), "map<string,string>")), lambda v: v.isNotNull()), s)
    return F.coalesce(read(first), read(fixed), read(inner))


def sane_claims(claims: Column, allowed: tuple[str, ...], source: Column) -> Column:
    """Claims whose theme is known and whose excerpt the source holds."""
    return F.filter(claims, lambda c: c["theme"].isin(*allowed) & F.contains(source, c["excerpt"]) & (c["excerpt"] != ""))


def report_dates(reports: Column, today: Column) -> Column:
    """Reports newest first; null if an end is missing, in the future or there twice."""
    ends = F.transform(reports, lambda r: r["end"])
    sound = F.forall(ends, lambda e: e.isNotNull() & (e <= today)) & (F.size(F.array_distinct(ends)) == F.size(ends))
    return F.when(sound, F.reverse(F.array_sort(reports)))


def currency_consensus(reports: Column, quote: Column, today: Column, days: int = 366) -> Column:
    """The quoted currency, if every report of the last year is in it."""
    recent = F.filter(reports, lambda r: F.datediff(today, r["end"]) <= days)
    return F.when((F.size(recent) > 0) & F.forall(recent, lambda r: r["currency"] == quote), quote)


def totals_proven(reports: Column, total: Column, periods: int, lo: int, hi: int, tolerance: float = 1e-4) -> Column:
    """Whether the last ``periods`` amounts, ``lo`` to ``hi`` days apart, add up to the total."""
    last = F.slice(reports, 1, periods)
    gaps = F.zip_with(F.slice(last, 1, periods - 1), F.slice(last, 2, periods - 1), lambda a, b: F.datediff(a["end"], b["end"])) if periods > 1 else F.array().cast("array<int>")
    s = F.aggregate(last, F.lit(0.0), lambda a, r: a + r["amount"])
    even = F.forall(gaps, lambda g: g.between(lo, hi))
    return (F.size(last) == periods) & even & (F.abs(s - total) <= tolerance * F.abs(total))


def verified_currency(quarters: Column, years: Column, total: Column, quote: Column, today: Column) -> Column:
    """Consensus, else the currency in which quarters, else a year, prove the total; null if both fail."""
    one = lambda rs, n: F.when(F.size(F.array_distinct(F.transform(F.slice(rs, 1, n), lambda r: r["currency"]))) == 1, rs[0]["currency"])
    return F.coalesce(
        currency_consensus(quarters, quote, today),
        F.when(totals_proven(quarters, total, 4, 80, 100), one(quarters, 4)),
        F.when(totals_proven(years, total, 1, 0, 0), one(years, 1)),
    )
