"""Keyed current-state table kept by micro-batch upsert.

The state lives in a folder of Parquet snapshots. Each attempt to write one has
a folder of its own and is published by one small file (``commits.CommitLog``). Sequence
numbers are the store's own, so a stream that starts anew (and numbers its batches from 0
again) goes on behind what is there. A batch of a query that is committed already is a
replay and changes nothing. No job ever writes where another may read, and the newest
state is found by listing the commits, without a Spark job. Old versions and left-over
attempts are removed.

Upsert without a lakehouse format: state and batch are united and the batch's row wins
for its key (``upsert`` is the same as an anti-join and a union). The batch is first
reduced to one row per key (a MERGE source with two rows for a key is ambiguous) and
enriched with the master. A refresh is one job: what it processed and rejected is
observed on the way.

A version is one part or several. A batch is written as a part of its own, with the newest parts
that aren't much larger folded into it, so a version has about as many parts as the state has
doublings of a batch, and a row is written again as often. A batch's work goes with its
own rows and the master's, not with the state's; reading unites the parts by the same rule.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.status import KEY, enrich_status, latest_master, latest_per_station
from ..schemas import STATE_COLUMNS
from .commits import CommitLog
from .staging import mark_present

log = logging.getLogger(__name__)

ORDERS = ("arrival", "event_time")
#: A part is folded into the next one if it has at most so many times its rows.
FOLD = 2
Master = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True)
class Commit:
    """One published version."""

    sequence: int
    query: str
    batch: int
    path: str
    rows: int
    rejected: int = 0
    #: Rows of the part ``path`` and keys of the batch (0: written before there were parts).
    size: int = 0
    keys: int = 0
    #: Folders and rows of the parts below it, oldest first, and what decides between parts (None: the newer part).
    older: list[list] = field(default_factory=list)
    order: list[str] | None = None

    def parts(self) -> list[list]:
        return [*self.older, [self.path, self.size]]


class StateStore:
    """Versions of the state under ``root``; the newest ``keep`` ones stay readable."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 10):
        if keep < 1:
            raise ValueError("at least one version has to be kept")
        self.log, self.keep = CommitLog(spark, root), keep

    def commits(self) -> list[Commit]:
        """The kept commits, oldest first."""
        return [Commit(sequence=n, **e) for n, e in self.log.entries()]

    def latest(self) -> Commit | None:
        newest = self.log.newest()
        return None if newest is None else Commit(sequence=newest[0], **newest[1])

    def latest_version(self) -> int | None:
        """Sequence number of the newest version."""
        newest = self.latest()
        return None if newest is None else newest.sequence

    def committed(self, query: str, batch: int) -> Commit | None:
        """The commit of a query's batch, if it is among the kept ones."""
        return next((c for c in reversed(self.commits()) if (c.query, c.batch) == (query, batch)), None)

    def read(self, version: int | None = None) -> DataFrame | None:
        """A kept version by its sequence number, or the newest; None if nothing is published."""
        entry = (self.log.newest() or (0, None))[1] if version is None else self.log.read(version)
        return None if entry is None else self.frame(Commit(sequence=0, **entry))

    def frame(self, commit: Commit) -> DataFrame:
        return united([self.part(path) for path, _ in commit.parts()], commit.order)

    def part(self, path: str) -> DataFrame:
        return self.log.frame({"path": path})

    def write(self, df: DataFrame, query: str, batch: int, rows: int | Callable[[], int] = 0, rejected: int | Callable[[], int] = 0, **parts: object) -> Commit:
        """Write a version into a folder of its own, then publish it. The counts may be
        functions that know them when ``df`` is written; ``parts`` are the fields of a version of several parts."""
        sequence, entry = self.log.write(df, query=query, batch=int(batch), rows=rows, rejected=rejected, **parts)
        oldest = sequence - self.keep + 1
        below = [c.older for c in self.commits() if c.sequence >= oldest] if oldest > 0 else []
        self.log.forget(oldest, {path for older in below for path, _ in older})
        return Commit(sequence=sequence, **entry)


def united(parts: list[DataFrame], order: Sequence[str] | None) -> DataFrame:
    """One row per key of parts, oldest first: the newest part's, or the one that is greatest by ``order``."""
    if len(parts) == 1:
        return parts[0]
    # The newest comes first: if it is a batch, its session is the one that observes.
    numbered = [p if order else p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)][::-1]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return latest_per_station(both, order) if order else latest_per_station(both, ("_part",)).drop("_part")


def upsert(prev: DataFrame | None, batch: DataFrame, key: str = KEY) -> DataFrame:
    """MERGE: matched keys take the batch row, new keys are inserted, none deleted."""
    if prev is None:
        return batch
    return prev.join(batch.select(key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def _folded(prev: Commit | None, order: list[str] | None) -> tuple[list[list], list[list]]:
    """The parts of ``prev`` that stay and those that are folded into the next one, which is taken to be as
    large as the last batch. Where another rule decides from now on, all are."""
    stay = prev.parts() if prev else []
    if prev and prev.order != order:
        return [], stay
    folded, size = [], max(prev.keys, 1) if prev else 0
    while stay and (not stay[-1][1] or stay[-1][1] <= FOLD * size):
        folded = [stay[-1], *folded]
        size += stay.pop()[1]
    return stay, folded


def refresh_state(
    batch: DataFrame,
    batch_id: int,
    store: StateStore,
    master: Master,
    order_by: Sequence[str] = ("LAST_REPORTED", "TST_REC"),
    order: str = "arrival",
    query: str = "batch",
) -> str:
    """One refresh (G5): reduce and enrich the batch, upsert it into the newest
    state, publish the result; returns 'Processed N rows'.

    ``query`` and ``batch_id`` name the batch; one that is committed already is
    not applied again. ``master`` is a frame, or a function that reads the master
    as it is now; of several rows for a station the latest counts.
    ``order="arrival"`` (the reference): whatever arrives later wins, even with
    an older LAST_REPORTED. ``order="event_time"``: the newer ``order_by`` wins (G6).
    Inside a batch the newest ``order_by`` row per station is kept, then that of the
    last source file. Rows with a NULL key are dropped and counted (G7).
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    done = store.committed(query, batch_id)
    if done is not None:
        return f"Processed {done.rows} rows"
    prev = store.latest()
    # One job: the batch is reduced to one row per key, its row counts (those of the NULL key
    # too) are observed on the way, and each key's row of the batch meets that of the parts folded in.
    seen, wrote = Observation(), Observation()
    reduced = latest_per_station(batch, order_by, with_counts=True).observe(
        seen,
        F.coalesce(F.sum("_N"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col(KEY).isNull(), F.col("_N"))), F.lit(0)).alias("rejected"),
        F.count(KEY).alias("keys"),
    )
    # Both sides are hashed by the key already; a broadcast would send the master through the driver batch by batch.
    dimension = latest_master(master() if callable(master) else master).hint("merge")
    fresh = enrich_status(reduced.where(F.col(KEY).isNotNull()).drop("_N"), dimension)
    # What orders rows besides the state's own columns is kept, the file a row came from is not.
    extra = [c for c in order_by if c not in STATE_COLUMNS]
    fresh = fresh.select(*STATE_COLUMNS, *[c for c in extra if c in fresh.columns])
    rule = [*order_by] if order == "event_time" else None
    older, folded = _folded(prev, rule)
    parts = [store.frame(prev)] if prev and prev.order != rule else [store.part(path) for path, _ in folded]
    new = united([*parts, fresh], rule).observe(wrote, F.count(F.lit(1)).alias("rows"))
    commit = store.write(
        new, query, batch_id, lambda: seen.get["rows"], lambda: seen.get["rejected"], size=lambda: wrote.get["rows"], keys=lambda: seen.get["keys"], older=older, order=rule
    )
    if commit.rejected:
        log.warning("batch %s: %s rows without a station id were dropped", batch_id, commit.rejected)
    log.info("batch %s: processed %s rows", batch_id, commit.rows)
    return f"Processed {commit.rows} rows"


def start_state_refresh(
    source: DataFrame,
    master: Master,
    store_root: str,
    checkpoint_location: str,
    processing_time: str | None = "5 minutes",
    available_now: bool = False,
    order_by: Sequence[str] = ("LAST_REPORTED", "TST_REC"),
    order: str = "arrival",
    keep: int = 10,
    start: str = "first",
) -> StreamingQuery:
    """Run :func:`refresh_state` on every micro-batch of a streaming status
    source (G1, G3). ``start="now"`` leaves out what the source holds when its checkpoint is new
    (G2, see :func:`~.staging.mark_present`). Offsets commit only after the batch's version is published,
    and a batch that comes again is recognised by the stream's id; empty triggers
    run nothing (C8). Give ``master`` as a function for a master that changes: it
    is called for each batch.
    """
    if start not in ("first", "now"):
        raise ValueError("start must be 'first' or 'now'")
    if start == "now":
        mark_present(source, checkpoint_location)
    store = StateStore(source.sparkSession, store_root, keep)

    def run(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        refresh_state(batch, batch_id, store, master, order_by, order, query=stream or checkpoint_location)

    w = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
