"""Form before each bout as a stream: one state for each entity, bouts released in order of event time.

Bouts of an entity may arrive in any order within the watermark's delay: they wait as state, with a timer at their time each. When
the watermark passes a timer, the waiting bouts up to it are released in order of (ts, fight_id): each goes out with the
frames over the bouts released before it, then joins them. Entities are spread over all tasks. State of an entity: sums and counts, the
last five bouts, the streak, the last day, and what waits.

Rows that come later than the watermark can't be put in order any more. Spark drops them before the state, and counts them: see late_rows.
A row with a null entity or time is left out. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from duelframe.operators.form import ROLLED
from duelframe.session import workers_can_import

#: What a stream of sides must have, besides the entity.
INPUT = ("fight_id", "fighter_id", "ts", "won", *ROLLED)
LAST = {"recent": 5, "last3": 3}
OUTPUT = "fight_id long, fighter_id long, ts timestamp, " + ", ".join(f"{p}_{c} double" for p in ("avg", *LAST) for c in ROLLED) + ", career_won long, bouts long, streak int, days_since_last int"
_NAMES = [x.split()[0] for x in OUTPUT.split(", ")]
_DAY = 86_400_000


def mean(values: list[float | None]) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


class Form(StatefulProcessor):
    """Releases an entity's bouts in order; see the module."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, fight_id long, won int, x array<double>")
        self.known = handle.getValueState("known", "n array<long>, sums array<double>, recent array<array<double>>, won long, bouts long, streak int, day long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for t in rows:
            at = (t["ts"].astype("datetime64[ms]").astype("int64")).tolist()
            values = [[None if pd.isna(v) else float(v) for v in r] for r in t[list(ROLLED)].to_numpy(object)]
            self.waiting.appendList([(a, int(f), int(w or 0), x) for a, f, w, x in zip(at, t["fight_id"], t["won"], values)])
            for a in set(at):
                self.handle.registerTimer(a)
        yield pd.DataFrame(columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(map(tuple, self.waiting.get()), key=lambda r: r[:2])
        ready, rest = [r for r in waiting if r[0] <= until], [r for r in waiting if r[0] > until]
        if ready:  # another timer of this watermark may have released them
            state = self.known.get() if self.known.exists() else ([0] * len(ROLLED), [0.0] * len(ROLLED), [], 0, 0, 0, None)
            out = []
            for bout in ready:
                row, state = stepped(state, bout)
                out.append((bout[1], key[0], pd.Timestamp(bout[0], unit="ms"), *row))
            self.known.update(state)
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def stepped(state: tuple, bout: tuple) -> tuple[tuple, tuple]:
    """(what is known before the bout, the state after it)."""
    n, sums, recent, won, bouts, streak, day = state
    at, _, own, x = bout
    n, sums, recent = list(n), list(sums), [list(r) for r in recent]
    row = [s / k if k else None for s, k in zip(sums, n)]
    for size in LAST.values():
        row += [mean([r[i] for r in recent[-size:]]) for i in range(len(ROLLED))]
    today = at // _DAY
    row += [won, bouts, streak, None if day is None else today - day]
    n = [k + (v is not None) for k, v in zip(n, x)]
    sums = [s + (v or 0.0) for s, v in zip(sums, x)]
    streak = (streak + 1 if streak > 0 else 1) if own == 1 else (streak - 1 if streak < 0 else -1)
    return tuple(row), (n, sums, [*recent, list(x)][-max(LAST.values()) :], won + own, bouts + 1, streak, today)


def formed(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of sides (INPUT) with what is known before each bout, once the watermark has passed it."""
    workers_can_import(stream.sparkSession)
    x = stream.select(*INPUT).where("fighter_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return x.groupBy("fighter_id").transformWithStateInPandas(statefulProcessor=Form(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query has dropped so far because they came after the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
