"""Formulas of configuration files, compiled to columns.

A formula has numbers, quoted decimals, names, + - * /, unary signs, min and max.
Anything else is refused; the columns run inside generated code like any other.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?![\d.]))|'([0-9.]+)'|\"([0-9.]+)\"|([A-Za-z_]\w*)|([-+*/(),]))")


class FormulaError(ValueError):
    """The text is no formula, or names something that isn't given."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected text at {at}: {text[at : at + 10]!r}")
        whole, single, double, name, sign = m.groups()
        number = whole or single or double
        out.append(("number", number) if number else ("name", name) if name else ("sign", sign))
        at = m.end()
    return out


def compile_formula(text: str, variables: dict[str, Column], exact: bool = False) -> Column:
    """The formula as a column of the given variables.

    ``exact``: numbers are decimals with just their own digits; with decimal variables
    sums, products, minima and maxima are exact as long as 38 digits are enough.
    """
    tokens = _tokens(text)
    at = 0

    def peek() -> str | None:
        return tokens[at][1] if at < len(tokens) and tokens[at][0] == "sign" else None

    def take(sign: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens) or sign and tokens[at] != ("sign", sign):
            raise FormulaError(f"expected {sign or 'more'} in {text!r}")
        at += 1
        return tokens[at - 1]

    def total() -> Column:
        left = product()
        while peek() in ("+", "-"):
            left = left + product() if take()[1] == "+" else left - product()
        return left

    def product() -> Column:
        left = unary()
        while peek() in ("*", "/"):
            left = left * unary() if take()[1] == "*" else left / unary()
        return left

    def unary() -> Column:
        if peek() in ("+", "-"):
            return unary() if take()[1] == "+" else -unary()
        return atom()

    def atom() -> Column:
        if peek() == "(":
            take()
            inner = total()
            take(")")
            return inner
        kind, value = take()
        if kind == "number":
            return F.lit(Decimal(value) if exact else float(Decimal(value)))
        if kind == "sign":
            raise FormulaError(f"unexpected {value} in {text!r}")
        if value in ("min", "max") and peek() == "(":
            take()
            args = [total()]
            while peek() == ",":
                take()
                args.append(total())
            take(")")
            if len(args) == 1:
                return args[0]
            return F.least(*args) if value == "min" else F.greatest(*args)
        if value not in variables:
            raise FormulaError(f"undefined name {value}")
        return variables[value]

    out = total()
    if at != len(tokens):
        raise FormulaError(f"unexpected {tokens[at][1]} in {text!r}")
    return out
