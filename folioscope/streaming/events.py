"""Streams of events and messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_dir, ship


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, with ts as a timestamp. The path goes in as a pattern: the file source takes a single file only so."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, events, value_sum) per tumbling window; rows later than ``late`` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("value_sum")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value_sum")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, session_start, session_end, events) per user and pause of at least ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drain(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote."""
    import uuid

    spark = df.sparkSession
    base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    out = f"{base}/out"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def same_message(method: str, value: str, kept_method: str, kept_value: str) -> bool:
    """The row form of the batch operator's rule for repeated messages."""
    if method != "Progress" or kept_method != "Progress":
        return method == kept_method and value == kept_value

    def sides(v: str) -> tuple | None:
        w = [x for x in v.split(" ") if x]
        at = w.index("of") if "of" in w else -1
        return (at, len(w), " ".join(w[: at - 1]), " ".join(w[at + 2 :])) if 0 < at < len(w) - 1 else None

    if " of " in value:
        a = sides(value)
        if " of " in kept_value:
            b = sides(kept_value)
            return a[2:] == b[2:] if a and b and a[:2] == b[:2] else value == kept_value
        return bool(a) and kept_value.startswith(a[2]) and kept_value.endswith(a[3])
    if " of " in kept_value:
        return False
    return value == kept_value or any(value.startswith(s) and kept_value.startswith(s) for s in ("Export", "Parse", "Update"))


MESSAGE = "log long, seq long, method string, value string"


def collapsed_stream(messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Collapses Progress runs in a stream of (log, seq, method, value) whose logs arrive in order.

    A log's state is the one message that may still be replaced; it is given out when another follows, or after ``idle_ms`` (if
    given) without one. With ``idle_ms`` a query never ends by itself, since time alone can bring rows.
    """
    ship(messages.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(kept)
            state.remove()
        else:
            rows = [r for p in parts for r in p[["seq", "method", "value"]].itertuples(index=False, name=None)]
            for row in sorted(rows):
                if kept is not None and not (row[1] == "Progress" and same_message(row[1], row[2], kept[1], kept[2])):
                    out.append(kept)
                kept = row
            state.update(kept)
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *map(_plain, r)) for r in out], columns=["log", "seq", "method", "value"])

    return messages.groupBy("log").applyInPandasWithState(step, MESSAGE, "seq long, method string, value string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def _plain(x):
    return x.item() if hasattr(x, "item") else x
