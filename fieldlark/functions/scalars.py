"""Derived columns: outcomes, targets, safe numbers, phases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome(home: Column, away: Column, labels: tuple[str, str, str] = ("H", "D", "A")) -> Column:
    """Home win, draw or away win; null unless both scores are known."""
    return F.when(home > away, labels[0]).when(home == away, labels[1]).when(home < away, labels[2])


def points(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, 3).when(scored == conceded, 1).when(scored < conceded, 0)


def over_target(home: Column, away: Column, line: float = 2.5, otherwise: int | None = 0) -> Column:
    """1 if the goals exceed the line, else ``otherwise``: 0 for the feature store's form, None for the gold form."""
    return F.when(home + away > line, 1).otherwise(F.when((home + away).isNotNull(), F.lit(otherwise).cast("int")))


def btts_target(home: Column, away: Column, otherwise: int | None = 0) -> Column:
    return F.when((home > 0) & (away > 0), 1).otherwise(F.when((home + away).isNotNull(), F.lit(otherwise).cast("int")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def number(text: Column) -> Column:
    """A double from text; blank, malformed and NaN become null."""
    value = blank_to_null(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def whole(text: Column) -> Column:
    """An integer from text, through truncation."""
    return number(text).try_cast("long")


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*(blank_to_null(t.cast("string")) for t in texts))


def feature(value: Column, home: Column, away: Column, default: float) -> Column:
    """A feature, else home less away, else home, else minus away, else a default."""
    return F.coalesce(value, home - away, home, -away, F.lit(default))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column, cap: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -cap, cap)))


def softmax(*logits: Column) -> list[Column]:
    top = F.greatest(*logits)
    each = [F.exp(x - top) for x in logits]
    total = sum(each[1:], each[0])
    return [e / total for e in each]


def rate(part: Column, total: Column, digits: int = 6) -> Column:
    """A rounded share, null without a total."""
    return F.round(F.try_divide(part.cast("double"), total), digits)


def is_final(status: Column) -> Column:
    """Whether a status means that the match has ended; none given does."""
    return F.lower(F.coalesce(blank_to_null(status), F.lit("final"))).isin("final", "finished", "complete", "completed", "ft")


#: Period names to their normal form; fixed values.
PERIODS = {
    "1": "first_half",
    "first half": "first_half",
    "2": "second_half",
    "second half": "second_half",
    "3": "extra_time_first_half",
    "first period of extra time": "extra_time_first_half",
    "extra time first half": "extra_time_first_half",
    "4": "extra_time_second_half",
    "second period of extra time": "extra_time_second_half",
    "extra time second half": "extra_time_second_half",
    "5": "penalty_shootout",
    "penalty shootout": "penalty_shootout",
}
#: period -> (phase, minute its stoppage begins at); fixed values.
STAGES = {
    "first_half": ("regulation_first_half", 45),
    "second_half": ("regulation_second_half", 90),
    "extra_time_first_half": ("extra_time_first_half", 105),
    "extra_time_second_half": ("extra_time_second_half", 120),
}


def period(text: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(text.cast("string"), F.lit(""))))
    names = F.create_map(*(F.lit(x) for pair in PERIODS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, plain), F.replace(plain, F.lit(" "), F.lit("_")))


def phase(minute: Column, period_text: Column, event_type: Column) -> Column:
    """The phase of play: by period with stoppage from the minute named in STAGES, else by the minute alone."""
    m, p, kind = F.coalesce(minute.cast("int"), F.lit(0)), period(period_text), F.lower(F.coalesce(event_type, F.lit("")))
    out = F.when(F.contains(p, F.lit("penalty shootout")) | F.contains(kind, F.lit("penalty shootout")) | (p == "penalty_shootout"), "penalty_shootout")
    for name, (stage, end) in STAGES.items():
        out = out.when((p == name) & (m >= end), f"{stage}_stoppage").when(p == name, stage)
    for stage, end in STAGES.values():
        out = out.when(m < end, stage)
    return out.when(F.contains(kind, F.lit("penalty")), "penalty_shootout").otherwise("extra_time_second_half_stoppage")


PHASES = [x for stage, _ in STAGES.values() for x in (stage, f"{stage}_stoppage")] + ["penalty_shootout", "unknown"]


def period_of_minute(elapsed: Column) -> Column:
    """The period that an elapsed minute falls into."""
    return F.when(elapsed.isNull(), None).when(elapsed <= 45, "1").when(elapsed <= 90, "2").when(elapsed <= 105, "3").when(elapsed <= 120, "4").otherwise("5")


def absolute_minute(seconds: Column, period_code: Column) -> Column:
    """The minute of the match from seconds into a period (1H, 2H, E1, E2, P)."""
    start = F.when(period_code == "2H", 45).when(period_code == "E1", 90).when(period_code == "E2", 105).when(period_code == "P", 120).otherwise(0)
    return (start + F.floor(seconds / 60)).cast("int")


def goal_bucket(minute: Column) -> Column:
    """Which fifteen minutes a goal falls into, 1 to 6, the last open; null without a minute."""
    return F.when(minute.isNotNull(), F.least(F.greatest(F.ceil(minute / 15), F.lit(1)), F.lit(6))).cast("int")


def confidence_label(trust: Column) -> Column:
    level = F.coalesce(trust, F.lit(0.25))
    return F.when(level >= 0.65, "high").when(level >= 0.4, "medium").otherwise("low")
