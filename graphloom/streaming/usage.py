"""Usage accounting over a sliding minute: batch windows, ordered admission, and the streaming forms."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The window in seconds and the safety factor of the limits.
WINDOW_S, SAFETY = 60, 0.90


def sliding_usage(rows: DataFrame, key: str, ts: str, amount: str) -> DataFrame:
    """Adds `used` and `total`: requests and amount of the key in the WINDOW_S before each row, itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(WINDOW_S * 1_000_000 - 1), 0)
    return rows.withColumns({"used": F.count("*").over(w), "total": F.sum(amount).over(w)})


def admit(rows: DataFrame, requests: int = 50, tokens_in: float = 30_000, tokens_out: float = 8_000) -> DataFrame:
    """(event_id, user_id, admitted) of rows (event_id, user_id, ts, tokens_in, tokens_out): a request is admitted if the
    requests and both kinds of tokens that were admitted in the minute before it leave room within the safe part of the
    limits, rounded down. Rows of a user stream in order of time; no more are held than one minute admits."""
    most, most_in, most_out = (int(x * SAFETY) for x in (requests, tokens_in, tokens_out))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held, used_in, used_out = None, deque(), 0.0, 0.0
        for b in batches:
            out = []
            for u, t, i, o in zip(b["user_id"], b["us"], b["tokens_in"], b["tokens_out"], strict=True):
                if u != user:
                    user, held, used_in, used_out = u, deque(), 0.0, 0.0
                while held and held[0][0] <= t - WINDOW_S * 1_000_000:
                    _, a, c = held.popleft()
                    used_in, used_out = used_in - a, used_out - c
                ok = len(held) + 1 <= most and used_in + i <= most_in and used_out + o <= most_out
                if ok:
                    held.append((t, i, o))
                    used_in, used_out = used_in + i, used_out + o
                out.append(ok)
            yield pd.DataFrame({"event_id": b["event_id"], "user_id": b["user_id"], "admitted": out})

    amount = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    dealt = rows.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), amount("tokens_in"), amount("tokens_out"))
    return dealt.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(run, "event_id long, user_id long, admitted boolean")


def stream_usage(events: DataFrame, key: str = "user_id", ts: str = "ts", late: str = "2 minutes") -> DataFrame:
    """Streaming counts by key over sliding minutes, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, f"{WINDOW_S} seconds", "30 seconds")).agg(F.count("*").alias("used"), F.sum("value").alias("total"))


def stream_dedup(events: DataFrame, key: str = "task_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Streaming first-wins by key while its state lasts."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
