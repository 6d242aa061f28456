"""Keys, fingerprints, links and checks of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import verified_excerpt
from tidemark.operators.texts import HEADINGS, citation_markers

#: Forms that are read as a whole, and what tells that something was cut.
WHOLE_FORMS = ("8-K", "6-K")
DISCLOSURES = ("truncat", "narrowed", "did not have the full", "only read")
ACCESSION = r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$"
CATEGORIES = ("COMPETITION", "REGULATORY", "SUPPLY_CHAIN", "MACRO", "OTHER")
SEVERITIES = ("LOW", "MEDIUM", "HIGH")
_RISK = "array<struct<category:string,severity:string,text:string>>"


def piped(*parts: Column) -> Column:
    """A cache key: its parts in order."""
    return F.concat_ws("|", *parts)


def canonical_hash(**parts: Column) -> Column:
    """SHA-256 of a JSON object with sorted names; nulls are written as such."""
    pairs = [F.concat(F.lit(f'"{k}": '), F.coalesce(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2), F.lit("null"))) for k, v in sorted(parts.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")), 256)


def bucketed(x: Column, width: float) -> Column:
    """The nearest multiple, halves up; a dash for null."""
    steps = F.floor(F.round(F.abs(x) / width, 9) + 0.5) * F.signum(x)
    return F.coalesce(F.format_string("%.1f", steps * width), F.lit("-"))


def gate_print(trace: Column) -> Column:
    """Gates and their outcomes, sorted by name."""
    return F.array_join(F.array_sort(F.split(trace, ",")), ",")


def evidence_print(percentile: Column, coverage: Column, confidence: Column, direction: Column) -> Column:
    """Decile, tenth of coverage, confidence and direction."""
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.concat(
        F.lit("pct="), dash(F.floor(percentile / 10)), F.lit("|cov="), dash(F.floor(F.round(coverage * 10, 9))), F.lit("|conf="), dash(confidence), F.lit("|dir="), dash(direction)
    )


def suppressed(signature: Column, answered: Column, answer: Column, expires: Column, now: Column) -> Column:
    """Whether an earlier answer to the same question hides a suggestion."""
    held = (answer == "REJECTED") | ((answer == "DEFERRED") & (expires > now))
    return F.coalesce((signature == answered) & held, F.lit(False))


def filing_url(cik: Column, accession: Column) -> Column:
    """Address of a filing's index; null unless both coordinates are valid."""
    valid = cik.rlike("^[0-9]{1,10}$") & (cik.cast("long") > 0) & accession.rlike(ACCESSION)
    return F.when(valid, F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("long").cast("string"), F.lit("/"), F.replace(accession, F.lit("-")), F.lit("/"), accession, F.lit("-index.html")))


def source_url(url: Column, source: Column, cik: Column, accession: Column) -> Column:
    """A document's own address if it is one, else that of its filing."""
    own = url.rlike(r"^(?i:https?)://[^/\s:?#]+") & ~url.rlike(r"\s")
    return F.when(F.coalesce(own, F.lit(False)), url).when(source == "edgar", filing_url(cik, accession))


def violations(answer: Column, ids: Column, truncated: Column) -> Column:
    """Names of what an answer does wrong with what was retrieved for it."""
    markers = citation_markers(answer)
    unknown = F.transform(F.filter(markers, lambda m: ~F.array_contains(ids, m)), lambda m: F.lit("unresolved_citation"))
    silent = F.lit(True)
    for word in DISCLOSURES:
        silent &= ~F.contains(F.lower(answer), F.lit(word))
    rest = F.array(
        F.when((F.size(ids) > 0) & (F.size(markers) == 0), F.lit("missing_citation")), F.when(truncated & silent, F.lit("undisclosed_truncation"))
    )
    return F.concat(unknown, F.array_compact(rest))


def reading(form: Column) -> Column:
    """How a document of a form is read: by sections, as a whole, as news, or not at all."""
    return F.when(form == "NEWS", "news").when(form.isin(*WHOLE_FORMS), "whole").when(form.isin(*HEADINGS), "sections").otherwise("skipped")


def sane_digest(raw: Column) -> Column:
    """A digest from JSON: risks need a text; unknown categories and severities get defaults."""
    parsed = F.from_json(raw, f"summary string, risks {_RISK}")
    sane = lambda r: F.struct(
        F.when(F.upper(r["category"]).isin(*CATEGORIES), F.upper(r["category"])).otherwise("OTHER").alias("category"),
        F.when(F.upper(r["severity"]).isin(*SEVERITIES), F.upper(r["severity"])).otherwise("LOW").alias("severity"),
        r["text"].alias("text"),
    )
    risks = F.transform(F.filter(F.coalesce(parsed["risks"], F.array().cast(_RISK)), lambda r: F.coalesce(r["text"], F.lit("")) != ""), sane)
    return F.struct(F.coalesce(parsed["summary"], F.lit("")).alias("summary"), risks.alias("risks"))


def grounded_risks(risks: Column, source: Column) -> Column:
    """Risks whose text stands in the source, word for word."""
    return F.filter(risks, lambda r: verified_excerpt(source, r["text"]).isNotNull())


def mentioned(question: Column, ticker: Column, name: Column) -> Column:
    """Whether a question names a company: its ticker in capitals or after $, or its name."""
    mark = F.concat(F.lit(r"(?:^|[^A-Za-z0-9])\$?"), ticker, F.lit(r"(?:[^A-Za-z0-9]|$)"))
    return F.regexp_like(question, mark) | F.contains(F.lower(question), F.lower(name))
