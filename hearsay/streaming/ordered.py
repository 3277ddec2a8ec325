"""Keyed decisions that depend on order, over rows that come out of order: admission, attachment, and followed event logs.

Rows wait in state until the watermark has passed them, and are then decided in the order of (at, id): whatever order they
come in within the watermark's delay, the decisions are the same. A timer wakes a key when its earliest row is due. Rows
that come later than the watermark are dropped by Spark, as everywhere. State is what waits, which the delay bounds, and what
the decisions need, which closed days leave.

A stream's time stands still when no rows come; a source should then send ticks (rows of a key of their own).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearsay.streaming import runs

_DAY_US = 86_400_000_000


def _us(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class InOrder(StatefulProcessor):
    """Holds rows (at in µs, id, a number) of a key until they are due; decide() then sees them in order."""

    #: Schema of what the decisions of a key need, and what a key starts with.
    kept, start = "until long", (0,)
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, amount double")
        self.state = handle.getValueState("kept", self.kept)

    def decide(self, key: tuple, state: tuple, rows: list[tuple], now: int) -> tuple[tuple | None, list[tuple]]:
        """The next state (None forgets the key once nothing waits) and rows out; now: the watermark in µs."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [t for r in rows for t in zip(_us(r["at"]), r["id"].tolist(), r["amount"].tolist(), strict=True)]
        self.waiting.appendList(came)
        self.handle.registerTimer(min(came)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if not due:
            return
        state, out = self.decide(key, tuple(self.state.get() or self.start), due, now)
        if state is None and not rest:
            self.state.clear()
        elif state is not None:
            self.state.update(state)
        if out:
            yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass


class VisitorDay(InOrder):
    """One visitor's requests of one UTC day: a job at a time, and no more than ``per_ip`` of them. amount: seconds the job runs.

    ``own`` are the starts of what this visitor was let through to so far, with their ends, for the pool's decision."""

    kept, start = "starts array<long>, ends array<long>", ([], [])
    columns = ("request_id", "visitor", "day", "at", "verdict", "starts", "ends")

    def __init__(self, per_ip: int):
        self.per_ip = per_ip

    def decide(self, key, state, rows, now):
        starts, ends = list(state[0]), list(state[1])
        out = []
        for at, request, seconds in rows:
            if ends and at < ends[-1]:
                verdict = "in_flight"
            elif len(starts) >= self.per_ip:
                verdict = "ip_day_cap"
            else:
                verdict = "free"
            out.append((request, key[0], key[1], pd.Timestamp(at, unit="us"), verdict, list(starts), list(ends)))
            if verdict == "free":
                starts.append(at)
                ends.append(at + round(seconds * 1e6))
        over = now >= pd.Timestamp(key[1]).value // 1000 + _DAY_US  # the day is closed: no row of it can come
        return (None if over else (starts, ends)), out


class Pool(InOrder):
    """When the pool of a UTC day closes: with its last admission, or with the one that uses up the allowance. id: the request;
    amount: its cost. A day is one key, but only what visitors are let through to comes here."""

    kept, start = "n long, spent double, done boolean", (0, 0.0, False)
    columns = ("day", "closed_at", "closed_by", "why")

    def __init__(self, per_day: int, allowance: float):
        self.per_day, self.allowance = per_day, allowance

    def decide(self, key, state, rows, now):
        n, spent, done = state
        out = []
        for at, request, cost in rows:
            if done:
                break
            n, spent = n + 1, spent + cost
            if n >= self.per_day or spent >= self.allowance:
                done = True
                out.append((key[0], pd.Timestamp(at, unit="us"), request, "day_cap" if n >= self.per_day else "backstop"))
        return (n, spent, done), out


class Attach(InOrder):
    """Which job a request of a key belongs to: it starts one, or joins the one that runs. amount: seconds a job runs."""

    kept, start = "job long, until long", (-1, -1)
    columns = ("request_id", "app_id", "job")

    def decide(self, key, state, rows, now):
        job, until = state
        out = []
        for at, request, seconds in rows:
            if at >= until:
                job, until = request, at + round(seconds * 1e6)
            out.append((request, key[0], job))
        return (None if until <= now else (job, until)), out


def _stateful(rows: DataFrame, keys: list[str], processor: InOrder, schema: str, late: str) -> DataFrame:
    """rows: keys, at (timestamp), id, amount."""
    runs.keyed_state(rows.sparkSession)
    timed = rows.withWatermark("at", late)
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def visitor_verdicts(requests: DataFrame, per_ip: int = 5, late: str = "1 hour") -> DataFrame:
    """requests: request_id, visitor, at, seconds -> request_id, visitor, day, at, verdict (in_flight, ip_day_cap, free), starts, ends.

    A visitor's slot and count are those of the UTC day of the request."""
    rows = requests.select("visitor", F.date_format("at", "yyyy-MM-dd").alias("day"), "at", F.col("request_id").alias("id"), F.col("seconds").cast("double").alias("amount"))
    schema = "request_id long, visitor string, day string, at timestamp, verdict string, starts array<long>, ends array<long>"
    return _stateful(rows, ["visitor", "day"], VisitorDay(per_ip), schema, late)


def pool_closings(free: DataFrame, per_day: int = 50, allowance: float = 2.0, late: str = "1 hour") -> DataFrame:
    """free: request_id, day, at, cost, of what visitors are let through to -> day, closed_at, closed_by, why; a row a day at most."""
    rows = free.select("day", "at", F.col("request_id").alias("id"), F.col("cost").cast("double").alias("amount"))
    return _stateful(rows, ["day"], Pool(per_day, allowance), "day string, closed_at timestamp, closed_by long, why string", late)


def admitted(verdicts: DataFrame, closings: DataFrame, per_ip: int = 5) -> DataFrame:
    """Outcomes in the order of the guards: in_flight, ip_day_cap, day_cap, backstop, admitted.

    Nothing is admitted after the pool's closing; from then on a visitor's own guards hold with what was really admitted."""
    joined = verdicts.join(closings, "day", "left")
    at = F.struct("at", "request_id")
    closed = F.col("closed_at").isNotNull() & (at > F.struct(F.col("closed_at").alias("at"), F.col("closed_by").alias("request_id")))
    real = F.size(F.filter("starts", lambda s: s <= F.unix_micros("closed_at")))
    live = F.exists(F.slice("ends", F.lit(1), real), lambda e: e > F.unix_micros("at"))
    after = F.when(live, "in_flight").when(real >= per_ip, "ip_day_cap").otherwise(F.col("why"))
    outcome = F.when(closed, after).when(F.col("verdict") == "free", "admitted").otherwise(F.col("verdict"))
    return joined.select("request_id", "visitor", "day", outcome.alias("outcome"))


def attachments(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """requests: request_id, app_id, at, seconds -> request_id, app_id, job (the request that started it)."""
    rows = requests.select("app_id", "at", F.col("request_id").alias("id"), F.col("seconds").cast("double").alias("amount"))
    return _stateful(rows, ["app_id"], Attach(), "request_id long, app_id string, job long", late)


class Follow(StatefulProcessor):
    """A job's log as frames: each index once and in order, heartbeats in silence, an end. Rows ahead of a gap wait for it."""

    def __init__(self, heartbeat_s: float, forget_s: float):
        self.beat, self.forget = round(heartbeat_s * 1e6), round(forget_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "index long, at long, event string, data string")
        self.state = handle.getValueState("place", "next long, quiet long, ended boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """What a replay has delivered: next_index, at (of its last row), ended."""
        for after, at, ended in zip(initialState["next_index"], _us(initialState["at"]), initialState["ended"], strict=True):
            self.state.update((int(after), at, bool(ended)))
            self._wake(at, bool(ended))

    def _wake(self, quiet: int, ended: bool) -> None:
        self.handle.registerTimer((quiet + (self.forget if ended else self.beat)) // 1000 + 1)

    def _beats(self, quiet: int, until: int) -> tuple[int, list]:
        """Heartbeats before ``until``, and since when it is quiet then."""
        n = max(0, (until - quiet - 1) // self.beat)
        return quiet + n * self.beat, [(None, "heartbeat", None)] * n

    def _frames(self, key, place, rows, now=None) -> Iterator[pd.DataFrame]:
        """rows: (index, at, event, data), those that wait included; now: the watermark, when no row before it can come."""
        after, quiet, ended = place
        out, left = [], []
        for index, at, event, data in sorted(set(rows), key=lambda r: (r[0], r[1], str(r[2:]))):
            if ended or index < after:
                continue  # a repeat
            if left or index > after and (now is None or at > now):
                left.append((index, at, event, data))
                continue
            if index > after:
                out.append((None, "gap", f"{after}..{index - 1}"))  # cannot be closed any more
            if quiet is not None:
                out += self._beats(quiet, at)[1]
            ended = event == "end"
            out.append((None if ended else index, event, data))
            after, quiet = index + 1, at
        if now is not None and quiet is not None and not ended and not left:
            quiet, beats = self._beats(quiet, now)
            out += beats
        self.state.update((after, quiet, ended))
        if left:
            self.ahead.put(left)
            self.handle.registerTimer(min(r[1] for r in left) // 1000 + 1)
        else:
            self.ahead.clear()
        if quiet is not None:
            self._wake(quiet, ended)
        if out:
            yield pd.DataFrame([(key[0], *f) for f in out], columns=["job_id", "id", "event", "data"]).astype({"id": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place = tuple(self.state.get() or (0, None, False))
        came = [t for r in rows for t in zip(r["index"].tolist(), _us(r["at"]), r["event"].tolist(), r["data"].tolist(), strict=True)]
        yield from self._frames(key, place, came + [tuple(r) for r in self.ahead.get()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        place = tuple(self.state.get() or (0, None, False))
        if place[2]:
            if place[1] + self.forget <= now:
                self.state.clear()
                self.ahead.clear()
            return
        yield from self._frames(key, place, [tuple(r) for r in self.ahead.get()], now)

    def close(self) -> None:
        pass


FRAMES = "job_id string, id long, event string, data string"


def follow(live: DataFrame, replayed: DataFrame | None = None, heartbeat_s: float = 15, late: str = "1 hour", forget_s: float = 86_400) -> DataFrame:
    """Frames of a live log (job_id, index, at, event, data; event 'end' settles a job) after a replay.

    replayed: the log that a replay has delivered, as rows of the same columns; its place in each job is where this stream goes
    on, so a row that comes in both is a frame once. A gap that the watermark has passed is told by a frame ``gap``.
    """
    runs.keyed_state(live.sparkSession)
    begun = None
    if replayed is not None:
        ended = F.max(F.col("event") == "end")
        begun = replayed.groupBy("job_id").agg((F.max("index") + 1).alias("next_index"), F.max("at").alias("at"), ended.alias("ended")).groupBy("job_id")
    rows = live.select("job_id", "index", "at", "event", "data").withWatermark("at", late)
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Follow(heartbeat_s, forget_s), outputStructType=FRAMES, outputMode="Append", timeMode="EventTime", initialState=begun
    )
