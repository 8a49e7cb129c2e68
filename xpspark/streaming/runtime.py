"""Queries over streams: documents in micro-batches, accumulators in document order, windows over event time."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import DynamicError
from ..sources import shred
from ..sources.storage import shared_path
from .analyzer import analyze


@dataclass
class Config:
    """``max_buffer`` bounds a Buffer; if ``strict``, a stream refuses queries that don't stream or hold more than ``max_footprint``."""

    max_buffer: int = 1000
    max_footprint: float = 0.1
    strict: bool = False


@dataclass
class Stats:
    processed: int = 0
    peak: int = 0
    refused: int = 0
    batches: list[int] = field(default_factory=list)
    #: How often a query was run that does not stream, by reason.
    not_streamable: dict[str, int] = field(default_factory=dict)

    @property
    def memory(self) -> int:
        """An estimate of the bytes held at most, 1,000 a row."""
        return 1000 * self.peak

    @property
    def efficiency(self) -> float:
        return 1.0 - self.peak / self.processed if self.processed else 1.0


class Buffer:
    """The last ``limit`` items."""

    def __init__(self, limit: int = 1000):
        self.items: deque = deque(maxlen=limit)

    def add(self, item) -> None:
        self.items.append(item)

    def last(self, n: int) -> list:
        return list(self.items)[-n:] if n else []

    def __contains__(self, item) -> bool:
        return item in self.items

    def __len__(self) -> int:
        return len(self.items)


def select_stream(spark: SparkSession, documents: DataFrame, form: str, id_col: str, text_col: str, query: str, config: Config | None = None, stats: Stats | None = None) -> DataFrame:
    """Runs a path query over a stream of documents until its source is exhausted; returns the selected nodes.

    Each micro-batch is shredded and queried by itself, which is exact as paths don't leave a document. Results are
    appended by batch number, so a batch that is repeated after a failure replaces its own output.
    """
    config, stats = config or Config(), stats or Stats()
    found = analyze(query)
    if not found.streamable:
        for reason in found.reasons:
            stats.not_streamable[reason] = stats.not_streamable.get(reason, 0) + 1
    if config.strict and (not found.streamable or found.footprint > config.max_footprint):
        stats.refused += 1
        raise DynamicError("XPDY0002", f"not streamable: {'; '.join(found.reasons)}")
    out, state = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    engine = Engine(spark)

    def batch(df: DataFrame, number: int) -> None:
        nodes = shred.shred(df, form, id_col, text_col)
        rows = engine.nodes(nodes, query).select("doc_id", "pre", "name", "str_val")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = documents.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    for p in run.recentProgress:
        stats.batches.append(p["numInputRows"])
        stats.processed += p["numInputRows"]
        stats.peak = max(stats.peak, p["numInputRows"])
    return spark.read.schema("doc_id long, pre long, name string, str_val string, batch int").parquet(out)


def windowed(spark: SparkSession, events: DataFrame, time_col: str, key_col: str, window: Column, late: str) -> DataFrame:
    """Counts by key and window of a stream with a watermark, run until its source is exhausted.

    Events more than ``late`` behind the latest one seen are dropped once their window's state is gone.
    """
    out, state = shared_path(spark, "windows"), shared_path(spark, "windows-state")
    counted = events.withWatermark(time_col, late).groupBy(window.alias("window"), F.col(key_col)).agg(F.count("*").alias("n"))
    rows = counted.select(F.col("window.start").alias("start"), key_col, "n")

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("seen", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = rows.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    # of a window's updates the last one counts
    kind = events.schema[key_col].dataType.simpleString()
    found = spark.read.schema(f"start timestamp, {key_col} {kind}, n long, seen int").parquet(out)
    return found.groupBy("start", key_col).agg(F.max_by("n", "seen").alias("n"))


def tumbling_counts(spark: SparkSession, events: DataFrame, time_col: str, key_col: str, width: str, late: str = "10 minutes") -> DataFrame:
    """``start, key, n`` of windows that don't overlap."""
    return windowed(spark, events, time_col, key_col, F.window(time_col, width), late)


def sliding_counts(spark: SparkSession, events: DataFrame, time_col: str, key_col: str, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """``start, key, n`` of windows of ``width`` that begin every ``slide``."""
    return windowed(spark, events, time_col, key_col, F.window(time_col, width, slide), late)


def session_counts(spark: SparkSession, events: DataFrame, time_col: str, key_col: str, gap: str) -> DataFrame:
    """``start, key, n`` of each key's sessions, which end ``gap`` after their last event.

    A session may grow with every batch, so each batch gives all sessions and the last one's count.
    """
    out, state = shared_path(spark, "sessions"), shared_path(spark, "sessions-state")
    counted = events.groupBy(F.session_window(time_col, gap).alias("window"), F.col(key_col)).agg(F.count("*").alias("n"))
    rows = counted.select(F.col("window.start").alias("start"), key_col, "n")
    last: list[int] = []

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last[:] = [number]

    run = rows.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    kind = events.schema[key_col].dataType.simpleString()
    schema = f"start timestamp, {key_col} {kind}, n long"
    return spark.read.schema(schema).parquet(f"{out}/batch={last[0]}") if last else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Accumulator:
    """A named fold over nodes in document order: rows that ``match`` add ``select`` by ``combine`` (sum, count, min, max)."""

    name: str
    match: Column
    select: Column
    combine: str = "sum"
    initial: float = 0.0


def accumulate(nodes: DataFrame, accumulators: list[Accumulator]) -> DataFrame:
    """Every node with ``<name>_before`` and ``<name>_after`` of each accumulator, as running aggregates of its document."""
    order = Window.partitionBy("doc_id").orderBy("pre")
    out = {}
    for a in accumulators:
        value = F.when(a.match, a.select if a.combine != "count" else F.lit(1.0))
        fold: Callable = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[a.combine]
        for when, end in (("before", -1), ("after", 0)):
            running = fold(value).over(order.rowsBetween(Window.unboundedPreceding, end))
            out[f"{a.name}_{when}"] = F.coalesce(running, F.lit(a.initial)) + (a.initial if a.combine in ("sum", "count") else 0)
    return nodes.withColumns(out)


def accumulate_stream(nodes: DataFrame, combine: Callable[[float, dict], float], initial: float = 0.0) -> DataFrame:
    """A keyed running state over a stream of node rows: ``doc_id, pre, before, after``; rows of a batch go by ``pre``."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else initial
        out = []
        for r in pd.concat(list(batches)).sort_values("pre").to_dict("records"):
            before, value = value, combine(value, r)
            out.append((key[0], r["pre"], before, value))
        state.update((value,))
        yield pd.DataFrame(out, columns=["doc_id", "pre", "before", "after"])

    return nodes.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, pre long, before double, after double", "value double", "append", "NoTimeout")


def run_accumulator(spark: SparkSession, rows: DataFrame, combine: Callable[[float, dict], float], initial: float = 0.0) -> DataFrame:
    """``accumulate_stream`` over a stream of rows ``doc_id, pre, ...`` until its source is exhausted."""
    out, state = shared_path(spark, "accumulator"), shared_path(spark, "accumulator-state")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    found = accumulate_stream(rows, combine, initial)
    found.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, pre long, before double, after double, batch int").parquet(out).drop("batch")


class Accumulators:
    """A host's accumulators by name, beside those that Spark computes: values that it sets before and after a node."""

    def __init__(self):
        self.states: dict[str, dict] = {}

    def register(self, states: dict[str, float]) -> None:
        self.states |= {name: {"value": value, "before": None, "after": None} for name, value in states.items()}

    def update(self, name: str, value, phase: str = "post") -> None:
        """A new value, as that before a node ("pre") or after it ("post"); an unknown name begins with it."""
        if name not in self.states:
            self.states[name] = {"value": value, "before": None, "after": None}
            return
        self.states[name] |= {"value": value, "before" if phase == "pre" else "after": value}

    def before(self, name: str):
        return self.read(name, "before")

    def after(self, name: str):
        return self.read(name, "after")

    def read(self, name: str, when: str):
        if name not in self.states:
            raise DynamicError("XPDY0002", f"no accumulator {name}")
        state = self.states[name]
        return state["value"] if state[when] is None else state[when]

    def snapshot(self) -> dict:
        return {name: s["value"] for name, s in self.states.items()}

    def restore(self, snapshot: dict) -> None:
        """Values of a snapshot; what was set before and after a node is forgotten."""
        for name in snapshot.keys() & self.states.keys():
            self.states[name] = {"value": snapshot[name], "before": None, "after": None}
