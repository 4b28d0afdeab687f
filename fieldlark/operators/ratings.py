"""Elo ratings: a recursion over a competition's matches, which no window expresses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("competition", T.StringType()), T.StructField("home_rating", T.DoubleType()), T.StructField("away_rating", T.DoubleType()), T.StructField("expected_home", T.DoubleType())])
START, SCALE = 1500.0, 400.0


class Elo:
    """Ratings of one competition's teams."""

    def __init__(self, k: float, ratings: dict | None = None):
        self.k, self.ratings = k, ratings or {}

    def play(self, home, away, home_goals: float, away_goals: float) -> tuple[float, float, float]:
        """Ratings and home's expectation before a match; the ratings then move."""
        h, a = self.ratings.get(home, START), self.ratings.get(away, START)
        expected = 1 / (1 + 10 ** ((a - h) / SCALE))
        if home_goals == home_goals and away_goals == away_goals:  # a match without a score moves nothing
            actual = 0.5 if home_goals == away_goals else float(home_goals > away_goals)
            self.ratings[home], self.ratings[away] = h + self.k * (actual - expected), a - self.k * (actual - expected)
        return h, a, expected


def elo(matches: DataFrame, domestic: float = 18.0, other: float = 14.0) -> DataFrame:
    """Ratings before each match of (match_id, competition, kind, day, home, away, home_goals, away_goals).

    A competition's matches are sorted by Spark and come to its task in chunks, so a task holds its teams'
    ratings and one chunk. Competitions are many and apart; one of them is as large as its fixture list.
    """

    def each(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict = {}
        last = None
        for chunk in chunks:
            for name, part in chunk.groupby("competition", sort=False, dropna=False):
                if name != last:
                    tables.clear()  # a competition's rows are together
                    last = name
                table = tables.setdefault(name, Elo(domestic if part["kind"].iloc[0] == "domestic" else other))
                rows = [table.play(*r) for r in part[["home", "away", "home_goals", "away_goals"]].itertuples(index=False)]
                yield pd.DataFrame({"match_id": part["match_id"], "competition": name} | dict(zip(("home_rating", "away_rating", "expected_home"), zip(*rows, strict=True), strict=True)))

    return matches.repartition("competition").sortWithinPartitions("competition", "day", "match_id").mapInPandas(each, SCHEMA)
