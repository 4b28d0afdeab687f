"""Ratings and form of a stream of matches, row by row what the batch operators give.

A match waits in state until the watermark has passed its time, so rows that come late, but within the watermark, take
their place in the order; then a competition's waiting matches are played in (time, match_id). State is by
competition: its teams' ratings and last results, and the matches that wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fieldlark.operators.ratings import START, Elo

#: Matches of a team, and of a team at home or away, that form looks back on; days of rest where no match is known, and at or below which a team is tired; fixed values.
LAST, ROLE, REST, TIRED = 5, 8, 7, 3
OUT = "competition string, match_id long, home_rating double, away_rating double, expected_home double, form_diff double, strength_diff double, rest_diff double, congestion_diff int"
_TEAM = "rating double, won string, at_home string, away string, last long"
DAY = 86_400_000
#: What a waiting match is kept as, with its result (none, away, draw, home) and whether it is domestic in ``mark``; where a pack lies.
_ROW = pa.schema([("time", pa.int64()), ("match_id", pa.int64()), ("home", pa.string()), ("away", pa.string()), ("mark", pa.int8())])
DOMESTIC = 4
_GOALS = ((float("nan"), float("nan")), (0.0, 1.0), (0.0, 0.0), (1.0, 0.0))
_PLACE = "day long, first long, n long"
#: Rows that a task packs together, bytes of packs that it holds before they wait in the state, and rows that it hands out at once.
HELD_ROWS, HELD_BYTES, OUT_ROWS = 500_000, 32_000_000, 100_000
_COLUMNS = [f.split(" ")[0] for f in OUT.split(", ")]
_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _struct(columns: str) -> T.StructType:
    """A schema of plain columns; workers have no session that could parse one."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in columns.split(", "))])


def _share(results: str) -> float:
    return results.count("1") / len(results) if results else 0.5


class _Team:
    """What is known of a team beside its rating: its last results as a string of 0 and 1, also those at home and away, and its last match's day."""

    __slots__ = ("won", "at_home", "away", "last")

    def __init__(self, won: str = "", at_home: str = "", away: str = "", last: int | None = None):
        self.won, self.at_home, self.away, self.last = won, at_home, away, last

    def row(self, rating: float) -> tuple:
        return float(rating), self.won, self.at_home, self.away, self.last

    def rest(self, day: int) -> int:
        return REST if self.last is None else day - self.last

    def played(self, won: bool, day: int) -> None:
        self.won, self.last = (self.won + ("1" if won else "0"))[-LAST:], day


def _pack(rows: pa.Table) -> bytes:
    return rows.select(_ROW.names).cast(_ROW).combine_chunks().to_batches()[0].serialize().to_pybytes()


def _unpacked(packs: bytes) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < len(packs):
        size = int.from_bytes(packs[at : at + 8], "little")
        yield pa.ipc.read_record_batch(pa.py_buffer(packs)[at + 8 : at + 8 + size], _ROW)
        at += 8 + size


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(competition, kickoff, time, pack) of the rows: those of one competition and time that a task sees close together are one pack."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= HELD_ROWS:
            yield _packs(held)
            held, n = [], 0
    if n:
        yield _packs(held)


def _packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).sort_by([("competition", "ascending"), ("kickoff", "ascending")]).combine_chunks()
    name, kickoff = rows["competition"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["kickoff"].cast(pa.int64()).to_numpy()
    starts = np.flatnonzero(np.append(True, (np.diff(name) != 0) | (np.diff(kickoff) != 0)))
    body = rows.select(_ROW.names).cast(_ROW).to_batches()[0]
    packs = [body.slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts, np.append(starts[1:], len(name)), strict=True)]
    first = rows.select(["competition", "kickoff", "time"]).take(starts).combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays([*first.columns, pa.array(packs, pa.binary())], ["competition", "kickoff", "time", "pack"])


class RatedProcessor(StatefulProcessor):
    """Plays a competition's waiting matches as the watermark passes them.

    Matches wait in packs of a day, so that what is played goes through memory by the day, and the state is asked once a pack and not
    once a match.
    """

    def __init__(self, domestic: float, other: float):
        self.factors = {True: domestic, False: other}

    def init(self, handle) -> None:
        self.handle = handle
        self.teams = handle.getMapState("teams", _struct("team string"), _struct(_TEAM))
        self.waiting = handle.getMapState("packs", _struct(_PLACE), T.StructType([T.StructField("pack", T.BinaryType())]))
        self.written = handle.getValueState("written", _struct("n long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days: dict[int, list[tuple[int, bytes]]] = {}
        size = 0
        for part in rows:
            for time, pack in zip(part["time"], part["pack"], strict=True):
                days.setdefault(int(time) // DAY, []).append((int(time), pack))
                size += len(pack)
            if size > HELD_BYTES:
                self._wait(days)
                days, size = {}, 0
        self._wait(days)
        return iter(())

    def _wait(self, days: dict[int, list[tuple[int, bytes]]]) -> None:
        """Add packs, by day, to those that wait, and a timer for the first of them."""
        if not days:
            return
        n = self.written.get()[0] if self.written.exists() else 0
        for day, packs in days.items():
            self.waiting.updateValue((day, min(t for t, _ in packs), n), (b"".join(len(p).to_bytes(8, "little") + p for _, p in packs),))
        self.written.update((n + 1,))
        self.handle.registerTimer(min(t for packs in days.values() for t, _ in packs))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()  # one timer stands for all that has become ready, and the next for what has not
        places: dict[int, list[tuple]] = {}
        for day, first, n in self.waiting.keys():
            places.setdefault(day, []).append((day, first, n))
        ready = sorted(day for day, there in places.items() if min(first for _, first, _ in there) <= upto)
        if not ready:
            return
        known: dict[str, _Team] = {}
        tables = {kind: Elo(k) for kind, k in self.factors.items()}
        tables[False].ratings = tables[True].ratings
        out: list[tuple] = []
        later = [first for day, there in places.items() if day not in ready for _, first, _ in there]
        for day in ready:
            rows = pa.Table.from_batches([b for at in sorted(places[day], key=lambda x: x[2]) for b in _unpacked(self.waiting.getValue(at)[0])]).combine_chunks()
            time = rows["time"].to_numpy()
            for at in places[day]:
                self.waiting.removeKey(at)
            if len(rest := np.flatnonzero(time > upto)):
                later.append(int(time[rest].min()))
                self._wait({day: [(later[-1], _pack(rows.take(rest)))]})
            order = np.lexsort((rows["match_id"].to_numpy(), time))
            rows = rows.take(order[time[order] <= upto])
            for row in zip(*(rows[x].to_pylist() for x in ("match_id", "home", "away", "mark")), strict=True):
                out.append((key[0], *self._play(day, *row, known, tables)))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        for name, team in known.items():
            self.teams.updateValue((name,), team.row(tables[True].ratings[name]))
        if later:
            self.handle.registerTimer(min(later))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def _team(self, name: str, known: dict[str, _Team], ratings: dict[str, float]) -> _Team:
        rating, *rest = self.teams.getValue((name,)) if self.teams.containsKey((name,)) else (START,)
        ratings[name] = rating
        known[name] = _Team(*rest)
        return known[name]

    def _play(self, day: int, match_id: int, home: str, away: str, mark: int, known: dict[str, _Team], tables: dict[bool, Elo]) -> tuple:
        table = tables[mark >= DOMESTIC]
        h = known.get(home) or self._team(home, known, table.ratings)
        a = known.get(away) or self._team(away, known, table.ratings)
        h_rest, a_rest = h.rest(day), a.rest(day)
        form = round(_share(h.won) - _share(a.won), 6), round(_share(h.at_home) - _share(a.away), 6), round((h_rest - a_rest) / REST, 6), (a_rest <= TIRED) - (h_rest <= TIRED)
        x, y = _GOALS[mark % DOMESTIC]
        before = table.play(home, away, x, y)
        if x == x:
            h.played(x > y, day)
            h.at_home = (h.at_home + h.won[-1])[-ROLE:]
            a.played(y > x, day)
            a.away = (a.away + a.won[-1])[-ROLE:]
        return match_id, *before, *form

    def close(self) -> None:
        pass


def rated(stream: DataFrame, late: str = "3 days", domestic: float = 18.0, other: float = 14.0) -> DataFrame:
    """OUT of each match of a stream (competition, match_id, kind, kickoff, home, away, home_goals, away_goals), once the watermark has passed it.

    Rows later than ``late`` are dropped by the watermark. A match without both scores gets a row and moves nothing. Needs the RocksDB state
    store. Rows without a time, competition, team or match_id are left out. Rows are packed before they are sent: a competition's matches
    are rated in one task, one after another, as the recursion needs, and all that can be done elsewhere is.
    """
    c = F.col
    named = stream.where("kickoff IS NOT NULL AND competition IS NOT NULL AND home IS NOT NULL AND away IS NOT NULL AND match_id IS NOT NULL")
    x, y = c("home_goals").cast("double"), c("away_goals").cast("double")
    there = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    result = F.when(there & (x > y), 3).when(there & (x == y), 2).when(there, 1).otherwise(0)
    mark = (result + F.when(c("kind") == "domestic", DOMESTIC).otherwise(0)).cast("byte")
    rows = named.select("competition", "kickoff", F.unix_millis("kickoff").alias("time"), c("match_id").cast("long").alias("match_id"), c("home").cast("string").alias("home"), c("away").cast("string").alias("away"), mark.alias("mark"))
    packs = rows.mapInArrow(_packed, "competition string, kickoff timestamp, time long, pack binary").withWatermark("kickoff", late)
    return packs.groupBy("competition").transformWithStateInPandas(RatedProcessor(domestic, other), outputStructType=_struct(OUT), outputMode="Append", timeMode="EventTime")
