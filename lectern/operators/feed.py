"""What has arrived since the last look.

The feed is a pure function of the papers, a small state and a clock; the new state is
returned and takes effect when the caller stores it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_LOOK = timedelta(days=7)
FLOOR, MOST = 10, 500


@dataclass(frozen=True)
class FeedState:
    last_seen: datetime | None = None
    new_batch_from: datetime | None = None


@dataclass(frozen=True)
class Feed:
    rows: DataFrame
    label: str
    state: FeedState


def _arrived(papers: DataFrame, after: datetime) -> DataFrame:
    return papers.filter(F.col("added") > F.lit(after).cast("timestamp_ntz"))


def ordered(papers: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` arrivals; of equal arrival the latest date, then id."""
    return papers.orderBy(F.desc("added"), F.desc("date"), F.desc("id")).limit(n)


def feed(papers: DataFrame, state: FeedState, now: datetime, limit: int | None = None, floor: int = FLOOR, most: int = MOST) -> Feed:
    """Arrivals since ``state.last_seen`` (a week, at first); if there are none, the last
    batch again; if still fewer than ``floor``, the latest ``floor`` arrivals.  ``limit``
    cuts to exactly that many.  Two bounded top-k queries, no full sort."""
    since = state.last_seen or now - FIRST_LOOK
    fresh = _arrived(papers, since).limit(most).count()
    label, rows, new = f"{fresh} new since {since:%Y-%m-%d %H:%M}", ordered(_arrived(papers, since), most), fresh
    shown = fresh
    if not fresh and state.new_batch_from is not None:
        batch = _arrived(papers, state.new_batch_from)
        rows = ordered(batch, most)
        figures = rows.agg(F.count("*").alias("n"), F.max("added").alias("last")).first()
        shown = figures["n"]
        label = f"last batch, from {figures['last']:%Y-%m-%d %H:%M}" if shown else label
    if shown < floor:
        rows = ordered(papers.filter(F.col("added").isNotNull()), floor)
        label = f"{new} new since {since:%Y-%m-%d %H:%M}" if new else f"nothing new since {since:%Y-%m-%d %H:%M}"
    if limit is not None:
        rows = rows.limit(limit)
    kept = replace(state, last_seen=now, new_batch_from=since if fresh else state.new_batch_from)
    return Feed(rows, label, kept)


def since(papers: DataFrame, after: datetime, n: int = MOST) -> DataFrame:
    return ordered(_arrived(papers, after), n)


def window_start(last_harvest: Column, newest: Column, overlap_days: int = 2) -> Column:
    """Where an incremental harvest starts: the earlier of the last harvest and the
    newest paper, less an overlap; null (everything) if there was no harvest."""
    return F.when(last_harvest.isNotNull(), F.least(last_harvest, newest) - F.expr(f"INTERVAL '{overlap_days}' DAY"))


def incremental_from(papers: DataFrame, last_harvest: datetime | None, overlap_days: int = 2) -> DataFrame:
    """One row ``start``."""
    harvested = F.lit(last_harvest).cast("timestamp_ntz")
    newest = F.max(F.substring("date", 1, 19).try_cast("timestamp_ntz"))
    return papers.agg(newest.alias("newest")).select(window_start(harvested, F.col("newest"), overlap_days).alias("start"))


def stale(attempted: datetime | None, succeeded: datetime | None, now: datetime, after: timedelta = timedelta(hours=24), between: timedelta = timedelta(hours=1)) -> bool:
    """Whether a refresh is due: the last success is old, and the last attempt is not recent."""
    return (succeeded is None or now - succeeded > after) and (attempted is None or now - attempted >= between)
