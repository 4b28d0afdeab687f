"""Odds arithmetic: implied and fair prices, expected value, Kelly stakes, margins, closing-line value."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from fieldlark.functions.scalars import clamp


def implied(odds: Column) -> Column:
    return F.when(odds > 1, 1 / odds)


def fair_odds(p: Column) -> Column:
    return 1 / clamp(p, 1e-6, 1 - 1e-6)


def expected_value(p: Column, odds: Column) -> Column:
    return F.when(odds > 1, p * odds - 1)


def kelly(p: Column, odds: Column, no_price: float | None = None, cap: float | None = 1.0) -> Column:
    """The Kelly share, at least 0 and at most ``cap`` (None: no cap); ``no_price`` where odds are 1 or less or missing."""
    share = F.greatest((p * odds - 1) / (odds - 1), F.lit(0.0))
    share = F.least(share, F.lit(cap)) if cap is not None else share
    return F.when(odds > 1, share).otherwise(F.lit(no_price).cast("double"))


def quarter_kelly(p: Column, odds: Column, **options) -> Column:
    return 0.25 * kelly(p, odds, **options)


def no_vig(odds: Column, *group: str, bad: str = "null") -> Column:
    """The share of a price in its group's implied total. ``bad`` legs (odds of 1 or less): "null" the group, or "drop" the leg."""
    over = Window.partitionBy(*group)
    share = F.when(odds > 1, 1 / odds)
    out = share / F.sum(share).over(over)
    return out if bad == "drop" else F.when(F.min(F.coalesce(odds, F.lit(0.0))).over(over) > 1, out)


def overround(odds: Column, *group: str) -> Column:
    return F.sum(implied(odds)).over(Window.partitionBy(*group)) - 1


def product(values: Column) -> Column:
    """The product of an array."""
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def clv(placed: Column, closing: Column) -> Column:
    """Closing-line value: the price taken over the closing price, less one."""
    return F.when((placed > 1) & (closing > 1), placed / closing - 1)


def unit_result(result: Column, odds: Column) -> Column:
    return F.when(result == "win", F.round(odds - 1, 6)).when(result == "loss", F.lit(-1.0)).otherwise(F.lit(0.0))


#: What the ladders say; fixed values.
SAYS = {
    "paper": "PAPER ONLY - model trust too low",
    "edge": "NO BET - edge too small",
    "kelly": "NO BET - Kelly zero",
    "watch": "WATCHLIST VALUE - model not trusted enough for staking",
    "strong": "STRONG VALUE - still verify market/liquidity",
    "small": "VALUE - small stake only",
    "risk": "NO BET - correlation risk too high",
    "combined_edge": "NO BET - combined edge too small",
    "builder": "VALUE BUILDER - verify same-game pricing",
    "small_builder": "SMALL VALUE BUILDER - tiny stake only",
}
#: Bounds of trust, edge and risk in the ladders; fixed values.
TRUST_PAPER, TRUST_WATCH = 0.50, 0.75
EDGE_LEAST, EDGE_STRONG = 0.02, 0.08
TICKET_RISK, TICKET_EDGE, TICKET_STRONG = 0.45, 0.03, 0.10


def ladder(*steps: tuple[Column, str], last: str) -> Column:
    """What the first step that holds says, else ``last``."""
    return F.coalesce(*(F.when(holds, SAYS[key]) for holds, key in steps), F.lit(SAYS[last]))


def decision(edge: Column, kelly_share: Column, trust: Column) -> Column:
    """What to do with a price; below a trust of a half everything stays on paper."""
    refused = ((trust < TRUST_PAPER, "paper"), (edge < EDGE_LEAST, "edge"), (kelly_share <= 0, "kelly"))
    return ladder(*refused, (trust < TRUST_WATCH, "watch"), (edge >= EDGE_STRONG, "strong"), last="small")


def ticket_decision(edge: Column, quarter: Column, risk: Column, trust: Column) -> Column:
    """What to do with a ticket, whose legs hang together by ``risk``."""
    refused = ((trust < TRUST_PAPER, "paper"), (risk >= TICKET_RISK, "risk"), (edge < TICKET_EDGE, "combined_edge"), (quarter <= 0, "kelly"))
    return ladder(*refused, (edge >= TICKET_STRONG, "builder"), last="small_builder")


def brier(p: Column, label: Column) -> Column:
    return (p - label) * (p - label)


def log_loss(p: Column, label: Column, floor: float = 1e-12, ceiling: float | None = None) -> Column:
    """Binary log loss with the probability clamped to [floor, ceiling], by default symmetric."""
    q = clamp(p, floor, 1 - floor if ceiling is None else ceiling)
    return -(label * F.ln(q) + (1 - label) * F.ln(1 - q))


#: Floors of the multiclass log loss in use; fixed values.
FLOORS = {"scorer": 1e-12, "baseline": 1e-15}
