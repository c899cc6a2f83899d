"""State of custom processors that event-time timers close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrystone.streaming import or_closing


def merged(runs: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, rows) of runs of time less than `gap` apart, in order."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(runs):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Sessions(StatefulProcessor):
    """Keeps each key's open sessions as three numbers each, and gives a session once its timer has run out: when the watermark is a gap past its last row."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def _timer(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timers.getCurrentWatermarkInMs() * 1000
        before = [tuple(x) for x in self.open.get()]
        new = [(t, t, 1) for part in rows for t in part["at"].dropna().astype("int64").tolist() if passed < t]
        after = merged(before + new, self.gap)
        if not new:
            return
        self.open.put(after)
        self._move_timer(before, after)
        yield from ()

    def _move_timer(self, before: list[tuple], after: list[tuple]) -> None:
        """One timer a key, of its first session, which is the first to be over."""
        old, now = ({self._timer(x[0][1])} if x else set() for x in (before, after))
        for t in old - now:
            self.handle.deleteTimer(t)
        for t in now - old:
            self.handle.registerTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        every = [tuple(x) for x in self.open.get()]
        done = [x for x in every if self._timer(x[1]) <= passed]
        left = every[len(done) :]
        if left:
            self.open.put(left)
            self._move_timer([], left)
        else:
            self.open.clear()
        if done:
            yield pd.DataFrame({"user_id": [key[0]] * len(done), "first": [x[0] for x in done], "last": [x[1] for x in done], "n": [x[2] for x in done]})

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, gap_hours: int = 12, late: str = "1 hour") -> DataFrame:
    """user_id, first, last (microseconds since 1970), n: runs of a user's rows less than the gap apart, each once, when it is over.

    Rows without a user or time are left out, and so are those later than `late`. Needs a session of `stateful_session`. A user's state is a row per open session,
    of which there are at most as many as gaps fit between the watermark and the newest row.
    """
    rows = stream.withWatermark("ts", late).where(or_closing("user_id is not null"))
    rows = rows.select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.when(F.col("user_id").isNotNull(), F.unix_micros("ts")).alias("at"), "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(Sessions(gap_hours * 3_600_000_000), "user_id long, first long, last long, n long", "Append", "EventTime")
