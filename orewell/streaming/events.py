"""The ordered event log of scans: numbering, replay, late events, folding to a state, pairing and rate flags.

An event has ``scan_id``, ``seq`` (rising in a scan), ``at``, ``type`` and fields by type. The fold exists twice: over a table, by aggregates,
and over a stream, by state for each scan that a timer drops after the scan's end; both give the same rows when events arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from .buckets import token_bucket  # noqa: F401  one of the log's operators

EVENT = "scan_id long, seq long, type string, agent_ord long, progress double"
COLUMNS = [c.split(" ")[0] for c in EVENT.split(", ")]
#: An event ends its scan if its type is one of these.
TERMINAL = ("scan_complete", "scan_failed")
STATE = "last_seq long, state string, progress double, findings long, errors long"
#: Without an event of these types a scan is still queued.
STATE_OF = {"agent_started": "running", "agent_progress": "running", "agent_finding": "running", "agent_error": "degraded"}


def sequence(events: DataFrame, known: DataFrame, *order: str) -> DataFrame:
    """Numbers new events of each scan on from ``known`` (scan_id, last)."""
    n = F.row_number().over(Window.partitionBy("scan_id").orderBy(*order))
    return events.withColumn("n", n).join(known, "scan_id", "left").withColumn("seq", (F.col("n") + F.coalesce("last", F.lit(0))).cast("long")).drop("n", "last")


def replay(events: DataFrame, since: int) -> DataFrame:
    """Each event after ``since`` once, however often it was delivered."""
    return events.where(F.col("seq") > since).dropDuplicates(["scan_id", "seq"])


def late(events: DataFrame, arrival: str) -> DataFrame:
    """``events`` with ``is_late``: a number at or below the highest that had arrived before."""
    before = F.max("seq").over(Window.partitionBy("scan_id").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("is_late", F.coalesce(F.col("seq") <= before, F.lit(False)))


def state_of(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in STATE_OF.items():
        out = out.when(kind == k, v)
    return out


def fold(events: DataFrame) -> DataFrame:
    """Per scan the state after all its events; partial aggregates are combined before the shuffle."""
    known = state_of(F.col("type"))
    return events.groupBy("scan_id").agg(
        F.max("seq").alias("last_seq"),
        F.coalesce(F.max_by(known, F.when(known.isNotNull(), F.col("seq"))), F.lit("queued")).alias("state"),
        F.coalesce(F.max("progress"), F.lit(0.0)).alias("progress"),
        F.count_if(F.col("type") == "agent_finding").alias("findings"),
        F.count_if(F.col("type") == "agent_error").alias("errors"),
    )


#: With event times: how late an event may come, and how long the state of a scan is kept after its end.
LATENESS, KEEP_MS = "10 minutes", 600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Scan(StatefulProcessor):
    """State of one scan: what ``fold`` gives so far, and the number of its terminal event. A timer drops it after that event; events beyond the terminal one change nothing."""

    def __init__(self, terminal: tuple[str, ...], keep_ms: int | None):
        self.terminal, self.keep_ms = terminal, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", f"{STATE}, ended long")

    def _new(self, rows: Iterator[Row], last: int, ended: int | None) -> Iterator[Row]:
        """Rows beyond ``last`` in order of their numbers, each number once, up to the terminal one."""
        for r in sorted(rows, key=lambda r: r["seq"]):  # the events of one scan in one trigger
            if r["seq"] > last and (ended is None or r["seq"] <= ended):
                last = r["seq"]
                if r["type"] in self.terminal and ended is None:
                    ended = last
                yield r

    def _hold(self, state: tuple, end_ms: int | None) -> None:
        self.held.update(state)
        if end_ms is not None and self.keep_ms is not None:
            self.handle.registerTimer(end_ms + self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last, state, progress, findings, errors, ended = self.held.get() if self.held.exists() else (0, "queued", 0.0, 0, 0, None)
        end_ms = None
        for r in self._new(rows, last, ended):
            if r["type"] in self.terminal and ended is None:
                ended, end_ms = r["seq"], r["ms"]
            last, state, progress = r["seq"], STATE_OF.get(r["type"], state), max(progress, r["progress"] or 0.0)
            findings, errors = findings + (r["type"] == "agent_finding"), errors + (r["type"] == "agent_error")
        self._hold((last, state, progress, findings, errors, ended), end_ms)
        yield Row(scan_id=key[0], last_seq=last, state=state, progress=progress, findings=findings, errors=errors)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Log(_Scan):
    """The same state, but what comes out are the events themselves, in order, up to the terminal one."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last, *_, ended = self.held.get() if self.held.exists() else (0, None)
        end_ms = None
        for r in self._new(rows, last, ended):
            if r["type"] in self.terminal and ended is None:
                ended, end_ms = r["seq"], r["ms"]
            last = r["seq"]
            yield Row(**{c: r[c] for c in COLUMNS})
        self._hold((last, "", 0.0, 0, 0, ended), end_ms)


def _by_scan(events: DataFrame, columns: list[str], processor: type[_Scan], schema: str, mode: str, terminal: tuple[str, ...], at: str | None, lateness: str, keep_ms: int) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # state beyond memory; the only store with timers
    timed = events.withWatermark(at, lateness).select(*columns, at, F.unix_millis(at).alias("ms")) if at else events.select(*columns, F.lit(0).cast("long").alias("ms"))
    return timed.groupBy("scan_id").transformWithState(processor(terminal, keep_ms if at else None), schema, mode, "eventtime" if at else "none")


def fold_stream(events: DataFrame, terminal: tuple[str, ...] = TERMINAL, at: str | None = None, lateness: str = LATENESS, keep_ms: int = KEEP_MS) -> DataFrame:
    """``fold(until_terminal(events))`` over a stream, in update mode: late and repeated events change nothing.

    With the events' times ``at`` the state of a scan is dropped when the watermark is ``keep_ms`` beyond its terminal event, and events later than ``lateness`` are dropped; without them all state is kept.
    """
    return _by_scan(events, ["scan_id", "seq", "type", "progress"], _Scan, f"scan_id long, {STATE}", "update", terminal, at, lateness, keep_ms)


def agents(events: DataFrame) -> DataFrame:
    """Per scan and agent its status: an error stays, whatever comes later; else by the last event that says one."""
    said = F.when(F.col("type") == "agent_started", "started").when(F.col("type") == "agent_finding", "complete")
    last = F.max_by(said, F.when(said.isNotNull(), F.col("seq")))
    return events.groupBy("scan_id", "agent_ord").agg(F.when(F.bool_or(F.col("type") == "agent_error"), "error").otherwise(F.coalesce(last, F.lit("waiting"))).alias("status"), F.max("seq").alias("last_seq"))


def pairs(events: DataFrame, start: str, end: str, *key: str) -> DataFrame:
    """Per key its last ``start`` event and its last ``end`` event after that, in one grouping for each; null without one."""
    started = events.where(F.col("type") == start).groupBy(*key).agg(F.max("seq").alias("started_seq"))
    done = events.where(F.col("type") == end).groupBy(*key).agg(F.max("seq").alias("seq"))
    return started.join(done, list(key), "left").select(*key, "started_seq", F.when(F.col("seq") > F.col("started_seq"), F.col("seq")).alias("completed_seq"))


#: How many rows of each kind a view keeps of a scan: the last ones.
TAILS = {"log": 220, "agent_finding": 120, "agent_progress": 40}
def read_events(spark, path: str) -> DataFrame:
    """The event log as a stream of JSON lines."""
    return spark.readStream.schema("value string").text(path).select(F.from_json("value", EVENT).alias("e")).select("e.*").where("scan_id is not null and seq is not null")


def until_terminal(events: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Events up to each scan's first terminal one; what comes after is dropped. Scans without one keep all."""
    last = events.where(F.col("type").isin(*terminal)).groupBy("scan_id").agg(F.min("seq").alias("last"))
    return events.join(last, "scan_id", "left").where("last is null or seq <= last").drop("last")


def until_terminal_stream(events: DataFrame, terminal: tuple[str, ...] = TERMINAL, at: str | None = None, lateness: str = LATENESS, keep_ms: int = KEEP_MS) -> DataFrame:
    """The same over a stream with the columns of EVENT; a number that comes again or below one that has passed is dropped. State is dropped as in ``fold_stream``."""
    return _by_scan(events, COLUMNS, _Log, EVENT, "append", terminal, at, lateness, keep_ms)


def dedup_stream(events: DataFrame, at: str = "at", lateness: str = "1 hour") -> DataFrame:
    """Each (scan, seq) once over an unbounded log: repeats that arrive up to ``lateness`` after the event's own time are dropped, and state older than that is let go.

    Inside the lateness the rows are those of ``replay`` over the whole table. A repeat that comes later than that may pass, and an event that is itself later than the watermark is dropped.
    """
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["scan_id", "seq"])


def merge_logs_stream(stored: DataFrame, buffered: DataFrame, at: str = "at", lateness: str = "1 hour") -> DataFrame:
    """``merge_logs`` of two streams: each (scan, seq) once, whichever comes first; both logs hold the same event under a number."""
    return dedup_stream(stored.unionByName(buffered), at, lateness)


def tail(events: DataFrame, most: dict[str, int] = TAILS) -> DataFrame:
    """The last events of each kind of a scan."""
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("type")]
    place = F.row_number().over(Window.partitionBy("scan_id", "type").orderBy(F.desc("seq")))
    return events.where(F.col("type").isin(*most)).withColumn("place", place).where(F.col("place") <= max(most.values())).where(F.col("place") <= limit).drop("place")


def merge_logs(stored: DataFrame, buffered: DataFrame) -> DataFrame:
    """Stored and buffered events as one log: each (scan, seq) once, the stored one if both have it."""
    both = stored.withColumn("from", F.lit(0)).unionByName(buffered.withColumn("from", F.lit(1)))
    own = [c for c in stored.columns if c not in ("scan_id", "seq")]
    return both.groupBy("scan_id", "seq").agg(F.min_by(F.struct(*own), "from").alias("x")).select("scan_id", "seq", "x.*")
