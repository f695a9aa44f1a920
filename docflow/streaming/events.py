"""Event logs: cursors, latest state, history, state machines; the same in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def sequenced(events: DataFrame) -> DataFrame:
    """``events`` with ``seq``: 1, 2, ... within a task, by time, then id."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))


def events_since(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events after each task's cursor (user_id, last_seq); tasks without a cursor give all."""
    return sequenced(events).join(cursors, "user_id", "left").where(F.col("seq") > F.coalesce("last_seq", F.lit(0))).drop("last_seq")


def last_events(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each task."""
    newest = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def latest_state(events: DataFrame) -> DataFrame:
    """Per task: last type and value, last value of a purchase, how many events."""
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(
        F.max_by("event_type", at).alias("last_type"),
        F.max_by("value", at).alias("last_value"),
        F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", at)).alias("last_purchase"),
        F.count("*").alias("n"),
    )


def transitions(events: DataFrame, state: str = "event_type") -> DataFrame:
    """``events`` with the state before, of those whose state changed or that are first."""
    before = F.lag(state).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(state)))


def violations(events: DataFrame, allowed: list[tuple[str, str]], state: str = "event_type") -> DataFrame:
    """Consecutive events of a task whose step is in no transition table."""
    before = F.lag(state).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = F.concat_ws(">", F.col("before"), F.col(state))
    return events.withColumn("before", before).where(F.col("before").isNotNull() & ~steps.isin(*(f"{a}>{b}" for a, b in allowed)))


def matches(types: list[str] | None = None, task: int | None = None) -> Column:
    """Subscription filter: an event of one of the types and of the task."""
    out = F.lit(True)
    if types is not None:
        out = out & F.col("event_type").isin(*types)
    return out if task is None else out & (F.col("user_id") == task)


def span_tree(spans: DataFrame) -> DataFrame:
    """Spans (id, parent, started, ended) with their duration, number of children and whether they are roots."""
    children = spans.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return spans.join(children, "id", "left").select("id", "parent", (F.col("ended") - F.col("started")).alias("duration"), F.coalesce("children", F.lit(0)).alias("children"), F.col("parent").isNull().alias("root"))


# ------------------------------------------------------------------- streams


def stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed counts and values per type; what comes later than ``late`` is left out and its state dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("started"), "event_type", "n", "value")


def stream_latest(events: DataFrame) -> DataFrame:
    """Latest state of each task as a stream in update mode."""
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", at).alias("last_type"), F.max_by("value", at).alias("last_value"), F.count("*").alias("n"))


def stream_changes(events: DataFrame) -> DataFrame:
    """(user_id, event_id, before, event_type) whenever a task's type changes; the last type of a task is its state."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for r in rows.itertuples():
            if r.event_type != last:
                out.append((key[0], r.event_id, last, r.event_type))
                last = r.event_type
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "before", "event_type"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, before string, event_type string", "last string", "append", "NoTimeout")


def stream_progress(events: DataFrame, least: float = 1.0) -> DataFrame:
    """(user_id, event_id, value) that rose by ``least`` over the value last let through, or is first."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable").itertuples():
            if last is None or r.value - last >= least:
                out.append((key[0], r.event_id, r.value))
                last = r.value
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "value"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, value double", "last double", "append", "NoTimeout")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there to Parquet, exactly once, and stop. Update and complete outputs replace by batch."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()


def dispatch(events: DataFrame, handlers: dict[str, object], dead_letters: str, checkpoint: str) -> None:
    """Each micro-batch to every handler by its filter; a batch that a handler fails on goes to its dead letters, whole."""

    def each(batch: DataFrame, n: int) -> None:
        for name, (test, handler) in handlers.items():
            part = batch.where(test)
            try:
                handler(part)
            except Exception as error:  # noqa: BLE001  a failing handler must not stop the others
                part.withColumns({"handler": F.lit(name), "error": F.lit(str(error)[:500])}).write.mode("append").parquet(dead_letters)

    events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
