"""Admission by a sliding window, whose own decisions count, and by a daily budget."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def decide(times: list[float], admitted: deque[float], limit: int, window: float) -> list[tuple[bool, float]]:
    """Whether each hit, in order of time, is admitted, and after how long to try again; ``admitted`` is the state."""
    out = []
    for t in times:
        while admitted and t - admitted[0] >= window:
            admitted.popleft()
        if len(admitted) < limit:
            admitted.append(t)
            out.append((True, 0.0))
        else:
            out.append((False, window - (t - admitted[0])))
    return out


def admit(hits: DataFrame, key: str, t: str, id_: str, limit: int, window: float) -> DataFrame:
    """Batch: id, key, admitted, retry_after. A key's hits are replayed in order by one task, with ``limit`` times in memory."""
    kind = hits.schema[id_].dataType.simpleString()

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, deque] = {}
        last = None
        for part in parts:
            out = []
            for name, at in zip(part[key], part[t], strict=True):
                if name != last:
                    state = {name: deque()}
                    last = name
                out.append(decide([at], state[name], limit, window)[0])
            yield pd.DataFrame({id_: part[id_], key: part[key], "admitted": [a for a, _ in out], "retry_after": [r for _, r in out]})

    ordered = hits.select(id_, key, t).repartition(key).sortWithinPartitions(key, t, id_)
    return ordered.mapInPandas(replay, f"{id_} {kind}, {key} string, admitted boolean, retry_after double")


def admit_stream(hits: DataFrame, key: str, t: str, id_: str, limit: int, window: float) -> DataFrame:
    """Stream: the same decisions, with the admitted times of each key as its state; hits of a micro-batch are put in order."""
    kind = hits.schema[id_].dataType.simpleString()

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        admitted = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(parts)).sort_values([t, id_])
        made = decide(rows[t].tolist(), admitted, limit, window)
        state.update((list(admitted),))
        yield pd.DataFrame({id_: rows[id_].to_numpy(), key: name[0], "admitted": [a for a, _ in made], "retry_after": [r for _, r in made]})

    return hits.groupBy(key).applyInPandasWithState(step, f"{id_} {kind}, {key} string, admitted boolean, retry_after double", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def daily_budget(hits: DataFrame, ts: str, id_: str, limit: int) -> DataFrame:
    """The first ``limit`` hits of each UTC day are allowed. Only the minute in which a day's budget ends is put in order."""
    minute = F.date_trunc("minute", ts)
    counts = hits.groupBy(minute.alias("__m")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.to_date("__m")).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = hits.select(id_, ts, minute.alias("__m")).join(counts.withColumn("__before", before), "__m")
    last = (F.col("__before") < limit) & (F.col("__before") + F.col("__n") > limit)
    nth = F.col("__before") + F.row_number().over(Window.partitionBy("__m").orderBy(ts, id_))
    ended = placed.where(last).select(id_, (nth <= limit).alias("allowed"))
    return placed.where(~last).select(id_, (F.col("__before") < limit).alias("allowed")).unionByName(ended)


def spend(hits: DataFrame, ts: str, id_: str, amount: str, limit: int) -> DataFrame:
    """Batch: id and allowed: each hit takes its amount from the budget of its UTC day if that holds it, or nothing at all.

    A hit that is refused takes nothing and later, smaller ones may still fit. A null amount counts as 1, a negative one
    is refused. Minutes of a day that together fit before any hit is refused need no order; of the rest, hits that
    ask for more than was left by then are refused at once, and the others are replayed in order with one number in memory.
    """
    asked = hits.select(id_, F.col(ts).alias("__at"), F.to_date(ts).alias("__day"), F.date_trunc("minute", ts).alias("__m"), F.coalesce(amount, F.lit(1)).cast("long").alias("__n"))
    valid = asked.where("__n >= 0")
    minutes = valid.groupBy("__day", "__m").agg(F.sum("__n").alias("__sum"))
    total = minutes.withColumn("__upto", F.sum("__sum").over(Window.partitionBy("__day").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)))
    # amounts are not negative, so the minutes that fit are the first ones of the day
    spent = total.groupBy("__day").agg(F.coalesce(F.max(F.when(F.col("__upto") <= limit, F.col("__upto"))), F.lit(0)).alias("__spent"))
    placed = valid.join(total.select("__m", (F.col("__upto") <= limit).alias("__fits")), "__m", "left").join(spent, "__day", "left")
    open_ = ~F.coalesce("__fits", F.lit(False))
    later = open_ & (F.col("__n") <= limit - F.coalesce("__spent", F.lit(0)))

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, left = None, 0
        for part in parts:
            allowed = []
            for d, n, before in zip(part["__day"], part["__n"], part["__spent"], strict=True):
                if d != day:
                    day, left = d, limit - before
                allowed.append(n <= left)
                left -= n if n <= left else 0
            yield pd.DataFrame({id_: part[id_], "allowed": allowed})

    kind = hits.schema[id_].dataType.simpleString()
    rest = placed.where(later).select(id_, "__at", "__day", "__n", "__spent").repartition("__day").sortWithinPartitions("__day", "__at", id_)
    decided = rest.mapInPandas(replay, f"{id_} {kind}, allowed boolean")
    sure = placed.where(~later).select(id_, (~open_).alias("allowed"))
    return sure.unionByName(decided).unionByName(asked.where("__n < 0").select(id_, F.lit(False).alias("allowed")))


def spend_stream(hits: DataFrame, budget: str, ts: str, id_: str, amount: str, limit: int, late: str = "1 hour") -> DataFrame:
    """Stream: the same decisions for each budget, with what a day has spent as state and a timer at its midnight that clears it.

    Hits of a micro-batch are put in order. Needs the RocksDB state store. Timestamps carry a zone.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    id_kind, key_kind = (hits.schema[c].dataType.simpleString() for c in (id_, budget))

    class Spender(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.spent = handle.getValueState("spent", "spent long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            if not self.spent.exists():
                self.handle.registerTimer((int(key[1]) + 1) * 86_400_000)
            spent = self.spent.get()[0] if self.spent.exists() else 0
            batch = pd.concat(list(rows)).sort_values(["at_", id_])
            allowed = []
            for n in batch["n_"]:
                allowed.append(0 <= n <= limit - spent)
                spent += n if allowed[-1] else 0
            self.spent.update((int(spent),))
            yield pd.DataFrame({id_: batch[id_].to_numpy(), budget: key[0], "allowed": allowed})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.spent.clear()
            yield pd.DataFrame({id_: pd.Series([], dtype="object"), budget: pd.Series([], dtype="object"), "allowed": pd.Series([], dtype="bool")})

        def close(self) -> None:
            pass

    day = F.floor(F.unix_seconds(ts) / 86_400).cast("long")
    asked = hits.select(id_, budget, F.col(ts).alias("at_"), day.alias("day_"), F.coalesce(amount, F.lit(1)).cast("long").alias("n_")).withWatermark("at_", late)
    return asked.groupBy(budget, "day_").transformWithStateInPandas(Spender(), f"{id_} {id_kind}, {budget} {key_kind}, allowed boolean", "append", "EventTime")
