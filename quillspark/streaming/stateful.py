"""Rate limiter, circuit breaker and metrics: over a table, and over a stream with state by key.

The limiter counts accepted events only and the breaker depends on its own past decisions, so both
walk the events of a key in order, which is sequential by definition. A key's events are sorted by
Spark and stream past a small state in Arrow batches; they are never held together. The stream form
keeps the same small state between batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions.lexicon import HISTOGRAM_BOUNDS


class SlidingWindow:
    """Accepted times of one key; a time exactly one window ago still counts, denied ones never do."""

    def __init__(self, limit: int, window_s: float, times=()):
        self.limit, self.window_s, self.times = limit, window_s, deque(times)

    def check(self, at: float) -> tuple[bool, int]:
        """(allowed, seconds to wait if not)."""
        while self.times and self.times[0] < at - self.window_s:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False, max(1, int(self.times[0] + self.window_s - at))
        self.times.append(at)
        return True, 0


class Breaker:
    """Opens after `most` failures in a row; after the cooldown one probe passes, and one more failure opens it again."""

    def __init__(self, most: int = 4, cooldown_s: float = 60.0, failures: int = 0, opened: float | None = None):
        self.most, self.cooldown_s, self.failures, self.opened = most, cooldown_s, failures, opened

    def is_open(self, at: float) -> bool:
        if self.opened is None:
            return False
        if at - self.opened >= self.cooldown_s:
            self.opened, self.failures = None, self.most - 1
            return False
        return True

    def record(self, ok: bool, at: float) -> None:
        if ok:
            self.failures, self.opened = 0, None
            return
        self.failures += 1
        if self.failures >= self.most:
            self.opened = at


def rate_limited(events: DataFrame, limit: int = 60, window_s: float = 60.0, key: str = "key") -> DataFrame:
    """event_id, key, ts, allowed, retry_after_s over a table (event_id, key, ts), by ts, then event_id.

    Rows of a key are taken in order batch by batch, so memory holds `limit` times and no more.
    """
    def start():
        window = SlidingWindow(limit, window_s)

        def feed(pdf: pd.DataFrame) -> pd.DataFrame:
            answers = [window.check(t) for t in pdf["at"]]
            return pdf[["event_id", key, "ts"]].assign(allowed=[a for a, _ in answers], retry_after_s=[r for _, r in answers])

        return feed

    return _walked(events, key, start, "allowed boolean, retry_after_s int")


def breaker_trace(events: DataFrame, most: int = 4, cooldown_s: float = 60.0, key: str = "key") -> DataFrame:
    """event_id, key, ts, blocked, failures over a table (event_id, key, ts, ok); blocked calls leave no trace in the state."""
    def start():
        breaker = Breaker(most, cooldown_s)

        def feed(pdf: pd.DataFrame) -> pd.DataFrame:
            blocked, failures = [], []
            for at, ok in zip(pdf["at"], pdf["ok"]):
                blocked.append(breaker.is_open(at))
                if not blocked[-1]:
                    breaker.record(bool(ok), at)
                failures.append(breaker.failures)
            return pdf[["event_id", key, "ts"]].assign(blocked=blocked, failures=failures)

        return feed

    return _walked(events, key, start, "blocked boolean, failures int")


def _walked(events: DataFrame, key: str, start, columns: str) -> DataFrame:
    """A key's events in order past a state that `start` makes; rows stream by in Arrow batches, so a large key needs no more memory than a small one.

    Keys travel as text, "k" before the value and "n" for null, so that a null key is one key like any other and no number loses digits.
    """
    kind = events.schema[key].dataType.simpleString()
    named = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    rows = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn(key, named)
    schema = f"event_id long, {key} string, ts {events.schema['ts'].dataType.simpleString()}, {columns}"

    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feed, last = None, None
        for pdf in batches:
            for k, part in pdf.groupby(key, sort=False):
                if k != last:
                    feed, last = start(), k
                yield feed(part)

    walked = rows.repartition(F.col(key)).sortWithinPartitions(key, "ts", "event_id").mapInPandas(partition, schema)
    return walked.withColumn(key, F.when(F.col(key) != "n", F.substr(key, F.lit(2))).cast(kind))


class OrderedProcessor(StatefulProcessor):
    """Events of a key in the order of their times, however the batches brought them: each waits until the watermark has passed it.

    A timer at the earliest waiting event wakes the key. `walk` takes the due events past the key's state; `rest_until` says when what is left of the
    state has no effect any more, and a timer then forgets it, so that idle keys hold nothing.
    """

    PENDING = "event_id long, at double, ok boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.PENDING)
        self.memory = handle.getListState("memory", "x double")

    def walk(self, memory: list[float], due: list[tuple]) -> tuple[list[float], list[tuple]]:
        """The new memory, and the answers to the due events (event_id, at, ok)."""
        raise NotImplementedError

    def rest_until(self, memory: list[float]) -> float | None:
        """The time from which an idle key's memory has no effect; null: never."""
        raise NotImplementedError

    def _wake(self, at: float | None) -> None:
        """One timer a key, at this time or, if that is null, none."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(int(at * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        ok = pdf["ok"].astype(bool) if "ok" in pdf else pd.Series(True, index=pdf.index)
        new = list(zip(pdf["event_id"].tolist(), (pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist(), ok.tolist()))
        first = min(at for _, at, _ in new)
        if self.pending.exists():
            first = min(first, min(at for _, at, _ in self.pending.get()))
            self.pending.appendList(new)
        else:
            self.pending.put(new)
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        waiting = sorted((tuple(r) for r in self.pending.get()), key=lambda r: (r[1], r[0])) if self.pending.exists() else []
        due, later = [r for r in waiting if r[1] < now], [r for r in waiting if r[1] >= now]
        memory, answers = self.walk([r[0] for r in self.memory.get()] if self.memory.exists() else [], due)
        self.pending.put(later) if later else self.pending.clear()
        rest = self.rest_until(memory) if memory else None
        if rest is not None and rest < now:
            memory, rest = [], None
        self.memory.put([(float(x),) for x in memory]) if memory else self.memory.clear()
        self._wake(later[0][1] if later else rest)
        if due:
            ids, at = [r[0] for r in due], pd.to_datetime(pd.Series([round(r[1] * 1e6) for r in due]), unit="us")
            yield pd.DataFrame({"event_id": ids, "key": [key[0]] * len(due), "ts": at, **dict(zip(self.COLUMNS, zip(*answers)))})

    def close(self) -> None:
        pass


class LimiterProcessor(OrderedProcessor):
    """The limiter over a stream: a key's memory are its accepted times of the last window."""

    COLUMNS = ("allowed", "retry_after_s")

    def __init__(self, limit: int, window_s: float):
        self.limit, self.window_s = limit, window_s

    def walk(self, memory, due):
        window = SlidingWindow(self.limit, self.window_s, memory)
        answers = [window.check(at) for _, at, _ in due]
        return list(window.times), answers

    def rest_until(self, memory):
        return memory[-1] + self.window_s


class BreakerProcessor(OrderedProcessor):
    """The breaker over a stream: failures in a row, and when it opened (-1: closed). A timer after the cooldown makes it half-open.

    A closed breaker without failures is forgotten at once; one with failures `forget_s` after its last event, if that is given.
    """

    COLUMNS = ("blocked", "failures")

    def __init__(self, most: int, cooldown_s: float, forget_s: float | None):
        self.most, self.cooldown_s, self.forget_s = most, cooldown_s, forget_s

    def walk(self, memory, due):
        failures, opened, last = memory or (0, -1, 0)
        breaker, answers = Breaker(self.most, self.cooldown_s, int(failures), None if opened < 0 else opened), []
        for _, at, ok in due:
            blocked = breaker.is_open(at)
            if not blocked:
                breaker.record(ok, at)
            answers.append((blocked, breaker.failures))
            last = at
        return ([breaker.failures, -1 if breaker.opened is None else breaker.opened, last] if breaker.failures else []), answers

    def rest_until(self, memory):
        return None if self.forget_s is None else memory[2] + max(self.forget_s, self.cooldown_s)


def _stream(events: DataFrame, key: str, late_s: float, processor: OrderedProcessor, columns: str) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts"), *[c for c in ("ok",) if c in events.columns])
    return rows.withWatermark("ts", f"{late_s} seconds").groupBy(key).transformWithStateInPandas(
        processor, f"event_id long, key {kind}, ts timestamp, {columns}", "append", "eventTime")


def rate_limited_stream(events: DataFrame, limit: int, window_s: float, key: str = "key", late_s: float = 0) -> DataFrame:
    """event_id, key, ts, allowed, retry_after_s of a stream (event_id, key, ts), as `rate_limited` gives them for a table.

    Events may come in any order within `late_s`; answers come when the watermark has passed them, later events are dropped by it. Needs the RocksDB state store.
    """
    return _stream(events, key, late_s, LimiterProcessor(limit, window_s), "allowed boolean, retry_after_s int")


def breaker_stream(events: DataFrame, most: int = 4, cooldown_s: float = 60.0, key: str = "key", late_s: float = 0, forget_s: float | None = None) -> DataFrame:
    """event_id, key, ts, blocked, failures of a stream (event_id, key, ts, ok), as `breaker_trace` gives them for a table."""
    return _stream(events, key, late_s, BreakerProcessor(most, cooldown_s, forget_s), "blocked boolean, failures int")


def attempted_hits(events: DataFrame, key: str, window_s: int = 60) -> DataFrame:
    """Adds n_attempts: events of the key within the window up to each event, denied or not."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-window_s * 1_000_000, 0)
    return events.withColumn("n_attempts", F.count("*").over(w))


def failure_runs(events: DataFrame, key: str) -> DataFrame:
    """key, run_no, length: stretches of failures in a row (gaps and islands)."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("run_no", F.sum(F.col("ok").cast("long")).over(w)).filter(~F.col("ok"))
    return runs.groupBy(key, "run_no").agg(F.count("*").alias("length"))


def counters(events: DataFrame, name: Column, labels: Column) -> DataFrame:
    """name, labels (canonical JSON of the map), value; also as a stream in update mode."""
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))
    return events.groupBy(name.alias("name"), canonical.alias("labels")).agg(F.count("*").alias("value"))


def histogram(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, le, n (cumulative), n_all, total: buckets of the fixed bounds and +Inf."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(HISTOGRAM_BOUNDS)]
    wide = events.groupBy(*keys).agg(*counts, F.count("*").alias("n_all"), F.sum(value).alias("total"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(HISTOGRAM_BOUNDS)],
                   F.struct(F.lit("+Inf").alias("le"), F.col("n_all").alias("n")))
    return wide.select(*keys, "n_all", "total", F.explode(rows).alias("r")).select(*keys, "r.le", "r.n", "n_all", "total")
