"""Personal data: expressions propose spans, checksums confirm, context scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: What each kind looks like. The look-behinds only keep a search
#: from starting again within a run that failed already (or, for cards, cut runs of
#: other lengths off early); possessive quantifiers keep the matcher off the stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![0-9A-Za-z_])",
    "ssn": r"(?<![0-9A-Za-z_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_])",
    "secret": r"(?<![0-9A-Za-z_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|[0-9a-f]{32,64}+)(?![0-9A-Za-z_])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
#: Characters that any match of the kind holds: texts without them are not searched.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a confirmed span, and the words nearby that raise it by BONUS.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "ip|address|adresse|host|server|client",
    "card": "card|karte|carte|tarjeta|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax|anruf|appel",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "ssn": "ssn|social security|security number|sozialversicherung",
    "secret": "secret|token|api|key|password|passwort|credential",
}
BONUS = 0.4
NEAR = 40
ADDED_FROM = 0.6  # added kinds need this score; base kinds stay whatever their score


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    d = F.split(F.reverse(digits), "")
    d = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(2 * k // 10 + 2 * k % 10) for k in range(10)]), x.cast("int") + 1)
    ))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code gives 1 mod 97, its first four characters put last."""
    turned = F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda c: F.when(c == "", F.lit(None)).otherwise(
        F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    ))
    rest = F.aggregate(digits, F.lit(0), lambda a, x: F.when(x.isNull(), a).otherwise(
        (F.when(x > 9, a * 100).otherwise(a * 10) + x) % 97
    ))
    return rest == 1


def _confirmed(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        # leading zeros don't count
        return F.forall(F.split(v, "[.]"), lambda x: (
            (F.length(F.ltrim(x, F.lit("0"))) <= 3)
            & (F.coalesce(F.substring(F.ltrim(x, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        ))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(v, "\\x20", ""))
    if kind == "ssn":
        return ~v.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _located(text: Column, found: Column, pattern: str) -> Column:
    """The matches with start and end: what lies between them tells where they are."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("g"), v.alias("v")))
    walk = F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + F.char_length(x["v"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["g"]).alias("start"),
                (a["at"] + x["g"] + F.char_length(x["v"])).alias("end"),
                x["v"].alias("value"),
            ))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(found) == 0, none).otherwise(walk)


def _scored(rank: int, kind: str) -> Column:
    """The confirmed spans of one kind as (start, rank, end, score)."""
    spans = _located(F.col("text"), F.col(f"m_{kind}"), PATTERNS[kind])
    spans = F.filter(spans, lambda s: _confirmed(kind, s["value"]))

    def score(s: Column) -> Column:
        first = F.greatest(s["start"] - NEAR, F.lit(0))
        around = F.substring(F.col("text"), first + 1, s["end"] - first + NEAR)
        bonus = F.when(F.lower(around).rlike(CONTEXT[kind]), BONUS).otherwise(0.0)
        return F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.least(F.lit(1.0), F.lit(SCORES[kind]) + bonus).alias("score"),
        )

    spans = F.transform(spans, score)
    if kind in BASE_KINDS:
        return spans
    return F.filter(spans, lambda s: s["score"] >= ADDED_FROM)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each whole text.

    Returns ``id_col`` and ``spans``: array of (kind, start, end, score), ordered by
    start, then kind; code points, end exclusive. Each kind's matches are leftmost
    and do not overlap; a match that its check refuses is dropped and not tried
    again. Checks: Luhn for card numbers, mod 97 for bank accounts, number ranges
    for the others. A span's score is its kind's, plus BONUS if a context word
    stands within NEAR characters. Email, ip, card and phone spans stay whatever
    their score; iban, ssn and secret (keys and tokens, told from other hexadecimal
    runs by their context) spans need ADDED_FROM.

    Null or empty text: no spans. One row for each input row, in a single pass
    without a shuffle; null ids and repeated rows pass through.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = {}
    for kind in KINDS:
        got = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        if kind in NEEDS:
            got = F.when(F.contains("text", F.lit(NEEDS[kind])), got).otherwise(F.array().cast("array<string>"))
        found[kind] = got
    t = t.select("id", "text", *[v.alias(f"m_{k}") for k, v in found.items()])
    parts = [_scored(rank, kind) for rank, kind in enumerate(KINDS)]
    kinds = F.array(*[F.lit(k) for k in KINDS])
    out = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(
        F.element_at(kinds, s["rank"] + 1).alias("kind"),
        s["start"].alias("start"),
        s["end"].alias("end"),
        s["score"].alias("score"),
    ))
    return t.select(F.col("id").alias(id_col), out.alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    got = find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.col("spans")
    return got.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
        F.round(F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)), 2).alias("top_score"),
    )


def _sql() -> str:
    """The same by the plain expressions, without the look-behinds."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "secret": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|[0-9a-f]{32,64})\b",
    }
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    code = "replace(value, ' ', '')"
    turned = f"(substr({code}, 5) || substr({code}, 1, 4))"
    rest = (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({turned}, ''), "
        "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE ascii(c) - 55 END)), "
        "lambda a, x: (CASE WHEN x > 9 THEN a * 100 ELSE a * 10 END + x) % 97)"
    )
    check = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(value, '.'), lambda x: length(ltrim(x, '0')) <= 3 "
        "AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), "
        "lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT ELSE (2 * x::INT) // 10 + (2 * x::INT) % 10 END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"{rest} = 1",
        "ssn": "NOT regexp_matches(value, '^(000|666|9)|-00-|-0000$')",
        "secret": "true",
    }
    each = []
    for rank, kind in enumerate(KINDS):
        score = (
            f"least(1, {SCORES[kind]} + CASE WHEN regexp_matches(lower(substr(text, greatest(s - {NEAR}, 0) + 1, "
            f"e - greatest(s - {NEAR}, 0) + {NEAR})), '{CONTEXT[kind]}') THEN {BONUS} ELSE 0 END)"
        )
        more = "" if kind in BASE_KINDS else f" AND score >= {ADDED_FROM}"
        each.append(
            f"SELECT uid, {rank} AS rank, '{kind}' AS kind, s, e, {score} AS score FROM (SELECT uid, text, value, "
            "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + "
            "coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s0, CAST(s0 AS BIGINT) AS s, "
            "s + length(value) AS e FROM (SELECT *, found[i] AS value FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i "
            f"FROM (SELECT uid, text, regexp_extract_all(text, '{plain[kind]}') AS found, "
            f"regexp_split_to_array(text, '{plain[kind]}') AS gaps FROM d)))) WHERE {check[kind]}{more}"
        )
    base = "FILTER (rank < 4)"
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return (
        "WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents), "
        f"x AS ({' UNION ALL '.join(each)}) "
        f"SELECT doc_id, {counts}, "
        f"sha256(coalesce(string_agg({one}, ',' ORDER BY s, rank) {base}, '')) AS base_sha256, "
        f"coalesce(string_agg({one}, ',' ORDER BY s, rank), '') AS spans, "
        "count(kind) AS n_spans, CAST(round(coalesce(max(score), 0), 2) AS DOUBLE) AS top_score "
        "FROM d LEFT JOIN x USING (uid) GROUP BY uid, doc_id"
    )


SQL = _sql()
