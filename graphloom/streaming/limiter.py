"""A rate limiter with reservations, and tasks in flight: folds over ordered rows in batch, stateful operators on streams.

Requests reserve an estimate; completions replace it by what was used, cancellations free it. A request is admitted if
the minute's recorded use and all open reservations leave room. Keys hold one minute of records and their open
reservations, no more, in tasks that Spark deals by key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .usage import SAFETY, WINDOW_S

#: Which provider serves a model by the start of its name, and each provider's requests and tokens a minute.
ROUTES, DEFAULT = {"claude": "anthropic", "anthropic": "anthropic"}, "openai"
LIMITS = {"openai": (500, 500_000, 150_000), "anthropic": (50, 30_000, 8_000)}
#: Shortest and longest pause before the next try.
LEAST_US, MOST_US = 100_000, 5_000_000
MINUTE_US = WINDOW_S * 1_000_000
#: At one moment, what was used is recorded before new requests ask.
KINDS = {"record": 0, "cancel": 1, "reserve": 2}

RESULT = "account long, provider string, reservation long, us long, admitted boolean, retry_us long"
REQUEST = "account long, model string, kind string, reservation long, us long, tokens_in long, tokens_out long"

#: Ids of test calls.
PINGS = ("TEST", "TESTTASK", "PING", "DUMMY")


def provider(model: Column) -> Column:
    out = F.lit(DEFAULT)
    for start, name in ROUTES.items():
        out = F.when(model.startswith(start), name).otherwise(out)
    return out


@dataclass
class Minute:
    """What one account has used of one provider in the last minute, and its open reservations."""

    most: tuple[int, int, int]
    used: list[tuple[int, int, int]] = field(default_factory=list)
    open: dict[int, tuple[int, int]] = field(default_factory=dict)

    def see(self, kind: str, us: int, reservation: int, tokens_in: int, tokens_out: int) -> tuple[bool, int] | None:
        """Whether a request is admitted, and else the pause before it should ask again. None for completions; those of
        requests that hold no reservation change nothing."""
        self.used = [u for u in self.used if u[0] > us - MINUTE_US]
        if kind != "reserve":
            if self.open.pop(reservation, None) is not None and kind == "record":
                self.used.append((us, max(0, tokens_in), max(0, tokens_out)))
            return None
        requests = len(self.used) + len(self.open)
        now_in, now_out = (sum(u[i] for u in self.used) + sum(o[i - 1] for o in self.open.values()) for i in (1, 2))
        if requests + 1 <= self.most[0] and now_in + tokens_in <= self.most[1] and now_out + tokens_out <= self.most[2]:
            self.open[reservation] = (tokens_in, tokens_out)
            return True, 0
        free = min((u[0] for u in self.used), default=us + MINUTE_US) + MINUTE_US - us
        return False, min(MOST_US, max(LEAST_US, free))


def safe(limits: dict[str, tuple[int, int, int]]) -> dict[str, tuple[int, ...]]:
    return {k: tuple(int(x * SAFETY) for x in v) for k, v in limits.items()}


def _ordered(rows: DataFrame) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    amount = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    own = rows.filter(F.col("kind").isin(*KINDS)).withColumns({"provider": provider(F.coalesce("model", F.lit(""))), "ord": F.element_at(kinds, F.col("kind"))})
    return own.select("account", "provider", "us", "ord", "kind", "reservation", amount("tokens_in"), amount("tokens_out"))


def limited(rows: DataFrame, limits: dict[str, tuple[int, int, int]] = LIMITS) -> DataFrame:
    """RESULT for every reserving row of REQUEST, in order of time for each account and provider. Rows stream by, whatever
    their number; rows of an unknown kind are left out."""
    most = safe(limits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out = []
            for a, p, us, _, kind, r, i, o in b.itertuples(index=False):
                if (a, p) != key:
                    key, state = (a, p), Minute(most[p])
                got = state.see(kind, us, r, i, o)
                if got is not None:
                    out.append((a, p, r, us, *got))
            yield pd.DataFrame(out, columns=["account", "provider", "reservation", "us", "admitted", "retry_us"])

    dealt = _ordered(rows.filter("account is not null and us is not null")).repartition("account", "provider")
    return dealt.sortWithinPartitions("account", "provider", "us", "ord", "reservation").mapInPandas(run, RESULT)


class _Limiter(StatefulProcessor):
    """One account of one provider on a stream: a list of what was used, a map of open reservations, and a timer that lets
    go of records after their minute."""

    def __init__(self, limits: dict[str, tuple[int, int, int]]):
        self.most = safe(limits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getListState("used", "us long, tokens_in long, tokens_out long")
        self.open = handle.getMapState("open", "reservation long", "tokens_in long, tokens_out long")

    def _load(self, name: str) -> Minute:
        return Minute(self.most[name], [tuple(u) for u in self.used.get()], {k[0]: tuple(v) for k, v in self.open.iterator()})

    def _keep(self, state: Minute, before: dict[int, tuple[int, int]]) -> None:
        if state.used:
            self.used.put(state.used)
        else:
            self.used.clear()
        for r in before.keys() - state.open.keys():
            self.open.removeKey((r,))
        for r in state.open.keys() - before.keys():
            self.open.updateValue((r,), state.open[r])

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._load(key[1])
        before = dict(state.open)
        out = []
        for row in pd.concat(rows).sort_values(["us", "ord", "reservation"])[["kind", "us", "reservation", "tokens_in", "tokens_out"]].itertuples(index=False):
            got = state.see(*row)
            if got is not None:
                out.append((key[0], key[1], row.reservation, row.us, *got))
        self._keep(state, before)
        if state.used:
            self.handle.registerTimer((state.used[-1][0] + MINUTE_US) // 1000 + 1)
        yield pd.DataFrame(out, columns=["account", "provider", "reservation", "us", "admitted", "retry_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = expiredTimerInfo.getExpiryTimeInMs() * 1000 - MINUTE_US
        left = [tuple(u) for u in self.used.get() if u[0] >= last]
        if left:
            self.used.put(left)
        else:
            self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(rows: DataFrame, limits: dict[str, tuple[int, int, int]] = LIMITS, late: str = "2 minutes") -> DataFrame:
    """`limited` on a stream of REQUEST whose batches come in order of time; needs the RocksDB state store."""
    timed = _ordered(rows.filter("account is not null and us is not null")).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    return timed.groupBy("account", "provider").transformWithStateInPandas(_Limiter(limits), RESULT, "Append", "EventTime")


def admitted_calls(calls: DataFrame, token: str) -> DataFrame:
    """Calls (task_id, kind, authorization, repository, ...) with `status`: of submissions `unauthorized` or `test` where that
    is so, else null. Nothing of these two needs state."""
    task = F.coalesce("task_id", F.lit(""))
    test = (task == "") | F.upper(task).isin(*PINGS) | (F.coalesce("repository", F.lit("")) == "")
    submitted = F.col("kind") == "submit"
    return calls.withColumn("status", F.when(submitted & ~F.coalesce(F.col("authorization") == f"token {token}", F.lit(False)), "unauthorized").when(submitted & test, "test"))


def in_flight(calls: DataFrame, token: str) -> DataFrame:
    """(call_id, task_id, status) of all submissions: `accepted` if the task does not run, else `already_processing`.

    After any submission that counts the task runs, until its completion; so the last call before decides."""
    known = admitted_calls(calls, token)
    turns = known.filter("status is null and kind in ('submit', 'done')")
    before = F.lag("kind").over(Window.partitionBy("task_id").orderBy("us", "call_id"))
    ran = turns.withColumn("before", before).filter("kind = 'submit'").select("call_id", "task_id", F.when(F.col("before") == "submit", "already_processing").otherwise("accepted").alias("status"))
    return ran.unionByName(known.filter("status is not null").select("call_id", "task_id", "status"))


class _Flight(StatefulProcessor):
    """One task: a flag while it runs, gone with its completion."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "since long")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        running, out = self.running.exists(), []
        for call, kind, us in pd.concat(rows).sort_values(["us", "call_id"])[["call_id", "kind", "us"]].itertuples(index=False):
            if kind == "submit":
                out.append((call, key[0], "already_processing" if running else "accepted"))
                if not running:
                    self.running.update((us,))
            elif running:
                self.running.clear()
            running = kind == "submit"
        yield pd.DataFrame(out, columns=["call_id", "task_id", "status"])

    def close(self) -> None:
        pass


def in_flight_stream(calls: DataFrame, token: str) -> DataFrame:
    """`in_flight` of the submissions that count, on a stream whose batches come in order of time. Calls that need no state
    are left to a projection of `admitted_calls`."""
    known = admitted_calls(calls, token).filter("status is null and kind in ('submit', 'done')").select("call_id", "task_id", "kind", "us")
    return known.groupBy("task_id").transformWithStateInPandas(_Flight(), "call_id long, task_id string, status string", "Append", "None")
