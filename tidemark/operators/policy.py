"""Rule cascade over gates, costs, joint allocation, decision signatures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rule thresholds, by profile.
THRESHOLDS = {
    "CONSERVATIVE": dict(buy_pct=85, cover=0.90, conf=2, brake=-0.5, result=10.0, cash=5000.0, cost=0.0075, trade=2000.0, add_pct=80, gap=4.0, trim_w=10.0, trim_pct=50, sell_pct=30, sell_run=8, sell_z=-0.75, top=10.0, floor=3.0),
    "MODERATE": dict(buy_pct=75, cover=0.80, conf=1, brake=-1.0, result=15.0, cash=3000.0, cost=0.01, trade=2000.0, add_pct=70, gap=3.0, trim_w=15.0, trim_pct=40, sell_pct=25, sell_run=10, sell_z=-1.0, top=15.0, floor=4.0),
    "AGGRESSIVE": dict(buy_pct=65, cover=0.70, conf=1, brake=-1.5, result=20.0, cash=1000.0, cost=0.015, trade=1000.0, add_pct=60, gap=2.0, trim_w=20.0, trim_pct=30, sell_pct=20, sell_run=15, sell_z=-1.25, top=20.0, floor=5.0),
}
CONFIDENCE = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
FEE = "min(max(notional * '0.0010', 10), 100)"
FX_SPREAD = "notional * '0.0015'"


def _is(c: Column) -> Column:
    """False for null: a gate that lacks its value does not pass."""
    return F.coalesce(c, F.lit(False))


def rank_of(c: Column) -> Column:
    out = F.lit(0)
    for name, rank in CONFIDENCE.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def gates(t: dict) -> dict[str, Column]:
    """Each gate's outcome, by name, over the columns of a policy context."""
    c = F.col
    cost = _is(F.when(c("notional") == 0, False).otherwise(c("cost") / c("notional") <= t["cost"]))
    weak = c("direction") == "WEAKENING"
    return {
        "coverage_min": _is(c("coverage") >= t["cover"]),
        "confidence_not_low": _is(c("confidence") != "LOW"),
        "not_held": _is(~c("held")),
        "held": _is(c("held")),
        "buy_percentile": _is(c("percentile") >= t["buy_pct"]),
        "confidence_min": _is(rank_of(c("confidence")) >= t["conf"]),
        "valuation_min": _is(c("valuation_z") >= t["brake"]),
        "resulting_weight": _is(c("resulting_weight") <= t["result"]),
        "cash_after": _is(c("cash_after") >= t["cash"]),
        "cost_pct": cost,
        "trade_min": _is(c("notional") >= t["trade"]),
        "add_percentile": _is(c("percentile") >= t["add_pct"]),
        "weight_gap": _is(c("target_weight") - c("weight") >= t["gap"]),
        "overweight": _is(c("weight") > t["trim_w"]),
        "sell_percentile": _is(c("percentile") < t["sell_pct"]),
        "sell_streak": _is(weak & (c("streak") >= t["sell_run"])),
        "thesis_broken": _is(c("thesis_z") < t["sell_z"]),
        "trim_percentile": _is(c("percentile") < t["trim_pct"]),
        "weakening": _is(weak),
    }


#: Which gates each rule needs, in the order in which rules are tried.
FIRST = ("coverage_min", "confidence_not_low")
BUY = ("not_held", "buy_percentile", "coverage_min", "confidence_min", "valuation_min", "resulting_weight", "cash_after", "cost_pct", "trade_min")
ADD = ("held", "add_percentile", "weight_gap", "cash_after", "cost_pct", "trade_min")
HELD_RULES = (("ADD", ADD), ("TRIM", ("overweight",)), ("SELL", ("sell_percentile", "sell_streak", "thesis_broken")), ("TRIM", ("trim_percentile", "weakening")))


def decide(context: DataFrame, profile: str = "MODERATE") -> DataFrame:
    """``context`` with action and trace: the gates that were tried, as name=0 or 1."""
    g = gates(THRESHOLDS[profile])

    def every(names) -> Column:
        out = F.lit(True)
        for n in names:
            out &= g[n]
        return out

    def told(names) -> Column:
        return F.array(*[F.concat(F.lit(f"{n}="), g[n].cast("int").cast("string")) for n in names])

    action, trace, seen = F.lit("HOLD_NO_ACTION"), None, told(FIRST)
    tried = [FIRST]
    for _, names in HELD_RULES:
        tried.append(names)
    trace = F.concat(*[told(n) for n in tried])
    done: list = []
    for i in range(len(HELD_RULES) - 1, -1, -1):
        name, names = HELD_RULES[i]
        action = F.when(every(names), name).otherwise(action)
        trace = F.when(every(names), F.concat(*[told(n) for n in tried[: i + 2]])).otherwise(trace)
        done.append(name)
    buy = F.when(every(BUY), "BUY").otherwise("HOLD_NO_ACTION")
    held = _is(F.col("held"))
    action = F.when(~every(FIRST), "HOLD_INSUFFICIENT_DATA").when(~held, buy).otherwise(action)
    trace = F.when(~every(FIRST), seen).when(~held, F.concat(seen, told(BUY))).otherwise(trace)
    return context.withColumn("action", action).withColumn("trace", F.array_join(trace, ","))


def signature(action: str, ident: str, *parts: Column) -> Column:
    """A versioned hash of what a decision rests on."""
    return F.concat(F.lit("v1:"), F.sha2(F.concat_ws("\n", F.col(action), F.col(ident).cast("string"), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256))


@dataclass(frozen=True)
class Limits:
    """Budgets and caps that one portfolio's trades share (percent of total value)."""

    total: float = 100_000.0
    cash: float = 13_000.0
    reserve: float = 3_000.0
    position: float = 15.0
    cohort: float = 35.0
    group: float = 25.0
    turnover: float = 10.0
    participation: float = 0.01
    least: float = 1_000.0
    volatility: float | None = 0.30


def _allocate(trades, limits: Limits):
    """Shares out one portfolio's budgets, trade by trade; the caps move as it goes on."""
    import numpy as np

    buys = trades[trades.action.isin(["BUY", "ADD"])]
    sales = trades[trades.action.isin(["SELL", "TRIM"])]
    known = buys.volatility[buys.volatility > 0]
    usual = float(np.median(known)) if len(known) else None
    cash = max(limits.cash - limits.reserve, 0.0) + float((sales.requested - sales.cost).clip(lower=0).sum())
    turnover = max(limits.total * limits.turnover / 100, 0.0)
    used: dict = {}
    for kind, by, held in (("c", "cohort", "cohort_weight"), ("g", "grp", "group_weight")):
        if held in trades:  # what the portfolio holds already
            used |= {(kind, name): float(w) for name, w in zip(trades[by], trades[held], strict=True) if name is not None and w == w}
    out = {i: (float(r), "") for i, r in zip(trades.index, trades.requested, strict=True) if i not in buys.index}
    order = buys.assign(
        up=(buys.direction != "STRENGTHENING").astype(int), more=(buys.action != "BUY").astype(int)
    ).sort_values(["percentile", "up", "more", "security_id"], ascending=[False, True, True, True])

    def room(share: float) -> float:
        return limits.total * share / 100 if limits.total > 0 and share > 0 else 0.0

    for i, t in order.iterrows():
        scale = 1.0
        if t.volatility == t.volatility and t.volatility > 0:
            near = usual / t.volatility if usual else 1.0
            far = limits.volatility / t.volatility if limits.volatility else 1.25
            scale = min(max(min(near, far), 0.5), 1.25)
        asked = max(float(t.requested), 0.0)
        want = asked * scale
        caps = {
            "cash": max(cash - t.cost, 0.0),
            "turnover": turnover,
            "position": room(limits.position - t.weight),
            "cohort": room(limits.cohort - used.get(("c", t.cohort), 0.0)),
            "group": room(limits.group - used.get(("g", t.grp), 0.0)) if t.grp is not None else want,
            "liquidity": t.daily_value * limits.participation if t.daily_value and t.daily_value > 0 else 0.0,
        }
        got = min(want, *caps.values())
        bound = [k for k, v in caps.items() if got < want and v <= got]
        if 0 < got < limits.least:
            got, bound = 0.0, ["minimum"]
        out[i] = (got, "+".join(bound))
        cash -= got + (t.cost * got / asked if asked > 0 else 0.0)
        turnover -= got
        for kind, name in (("c", t.cohort), ("g", t.grp)):
            if name is not None and limits.total > 0:
                used[kind, name] = used.get((kind, name), 0.0) + got / limits.total * 100
    return trades.assign(allocated=[out[i][0] for i in trades.index], bound=[out[i][1] for i in trades.index])


def allocate(candidates: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    """Joint allocation of each portfolio's candidates; a portfolio is one group.

    Columns cohort_weight and group_weight, if there are any, say how much (percent) of
    a candidate's cohort and correlated group the portfolio holds at the start.

    The order matters and every trade changes what is left, so a portfolio's own
    trades are taken one after another; portfolios are independent.
    """
    import pyspark.sql.types as T

    fields = [*candidates.schema.fields, T.StructField("allocated", T.DoubleType()), T.StructField("bound", T.StringType())]
    return candidates.groupBy(key).applyInPandas(lambda pdf: _allocate(pdf.reset_index(drop=True), limits), T.StructType(fields))
