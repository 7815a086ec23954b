"""When to regroup: a debounced trigger over a stream of decisions, and its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CARDS, QUIET_S, SOON_S = 5, 30, 3


def batch_triggers(events: DataFrame, quiet: int = QUIET_S, cards: int = CARDS) -> DataFrame:
    """(drive, fired_at, n) from events(drive, at): a burst ends after `quiet` seconds without a decision, or at its `cards`-th.

    Bursts are found with session windows; a burst of many decisions fires once for every `cards` of them and once for the rest.
    """
    rows = events.select("drive", F.timestamp_seconds("at").alias("ts"))
    bursts = rows.groupBy("drive", F.session_window("ts", f"{quiet} seconds").alias("w")).agg(F.sort_array(F.collect_list(F.unix_seconds("ts"))).alias("at"))
    n = F.size("at")
    full = F.filter(F.sequence(F.lit(1), F.floor(n / cards).cast("int")), lambda i: i * cards <= n)
    fired = F.transform(full, lambda i: F.struct(F.element_at("at", (i * cards).cast("int")).alias("fired_at"), F.lit(cards).alias("n")))
    rest = F.when(n % cards != 0, F.array(F.struct((F.element_at("at", -1) + quiet).alias("fired_at"), (n % cards).cast("int").alias("n")))).otherwise(F.array().cast("array<struct<fired_at:bigint,n:int>>"))
    return bursts.select("drive", F.explode(F.concat(F.when(n >= cards, fired).otherwise(F.array().cast("array<struct<fired_at:bigint,n:int>>")), rest)).alias("f")).select("drive", "f.fired_at", "f.n")


def stream_triggers(events: DataFrame, quiet: int = QUIET_S, soon: int = SOON_S, cards: int = CARDS) -> DataFrame:
    """(drive, reason, n) as a stream from events(drive, what): decision counts towards `cards` and waits for `quiet` seconds of rest;
    soon waits `soon` seconds; now fires at once; left fires only if something is pending."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, until = state.get if state.exists else (0, 0)
        now = state.getCurrentProcessingTimeMs()
        fired: list[tuple] = []
        if state.hasTimedOut:
            if pending:
                fired.append((key[0], "quiet", pending))
            state.remove()
        else:
            wait = quiet
            for f in frames:
                for what in f["what"]:
                    if what == "decision":
                        pending += 1
                        if pending >= cards:
                            fired.append((key[0], "cards", pending))
                            pending = 0
                    elif what == "now" or (what == "left" and pending):
                        fired.append((key[0], what, pending))
                        pending = 0
                    elif what == "soon":
                        pending, wait = max(pending, 1), min(wait, soon)
            if pending:
                # A soon that is waited for is not put off by what comes after it.
                due = now + wait * 1000
                if until > now:
                    due = min(due, until)
                state.update((pending, due if wait == soon or until > now else 0))
                state.setTimeoutDuration(max(due - now, 1))
            elif state.exists:
                state.remove()
        if fired:
            yield pd.DataFrame(fired, columns=["drive", "reason", "n"]).astype({"drive": object, "reason": object})

    return events.groupBy("drive").applyInPandasWithState(step, "drive string, reason string, n int", "pending int, until bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def resumable(source: DataFrame, work, target: str, checkpoint: str):
    """Run `work` over new rows only: each micro-batch is written under its number, so a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
