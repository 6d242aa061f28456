"""Every query of the library but those of the text operators, with its SQL."""

from __future__ import annotations

from . import collect, explain, feeds, groups, keys, lookups, models, money, portfolio, repair, scoring, series, study, texts, valuation

FAMILIES = (scoring, series, portfolio, texts, groups, feeds, explain, repair, valuation, study, money, keys, models, collect, lookups)
ALL = {name: pair for family in FAMILIES for name, pair in family.QUERIES.items()}


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
