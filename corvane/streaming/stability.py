"""A stream of sightings of files, which lets a file through once it has stayed the same for some sightings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Equal sightings in a row that a file needs, and how long one that is not seen any more is remembered.
PROBES, FORGOTTEN = 3, "1 day"
SIGHTED = "path string, length long, modified timestamp, seen timestamp"
STABLE = "path string, length long, modified timestamp, sightings long"
STATE = "length long, modified long, seen long, sightings long, let_through boolean"


def sightings(files: DataFrame) -> DataFrame:
    """A listing (path, length, modificationTime) as sightings of now, to be added to what the stream reads."""
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.current_timestamp().alias("seen"))


def stable(seen: DataFrame, probes: int = PROBES, forgotten: str = FORGOTTEN) -> DataFrame:
    """STABLE rows of the files of a stream of SIGHTED rows: each once, when probes sightings in a row, in order of time, have
    told the same length and time of change. A file that changes starts anew, also after it was let through.

    State is kept for each path: what was seen last and how often in a row. It is dropped forgotten after the last sighting, by
    a timer in the time of sightings; one that comes later than that behind others is left out. A sighting that is not later
    than the path's last one counts for nothing, so that a listing that is read twice does no harm. Null paths and times of
    sighting are left out; a null length or time of change never counts as the same.
    """
    wait = int(pd.Timedelta(forgotten).total_seconds() * 1000)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        length, modified, last, n, passed = state.get if state.exists else (None, None, -(1 << 62), 0, False)
        out, rows = [], pd.concat(list(frames)).sort_values(["seen", "length"])
        for r in rows.itertuples(index=False):
            at = r.seen.value // 1000
            if at <= last:
                continue
            told = (int(r.length), r.modified.value // 1000) if pd.notna(r.length) and pd.notna(r.modified) else (None, None)
            last = at
            if told == (length, modified) and told[0] is not None:
                n += 1
            else:
                (length, modified), n, passed = told, int(told[0] is not None), False
            if n >= probes and not passed:
                passed = True
                out.append((key[0], length, r.modified, n))
        state.update((length, modified, last, n, passed))
        state.setTimeoutTimestamp(last // 1000 + wait)
        if out:
            yield pd.DataFrame(out, columns=["path", "length", "modified", "sightings"])

    named = seen.filter("path is not null and seen is not null").withWatermark("seen", forgotten)
    return named.groupBy("path").applyInPandasWithState(follow, STABLE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
