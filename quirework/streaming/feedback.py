"""Feedback as a stream: windowed counts with a watermark, and the latest event per user as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quirework.operators.knowledge import windowed_feedback
from quirework.session import ensure_checkpoint_dir


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of events as a stream; new files in the folder become new micro-batches. A single file is read
    as a folder with that one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile():
        reader, path = reader.option("pathGlobFilter", jvm_path.getName()), str(jvm_path.getParent())
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    return windowed_feedback(events.withWatermark("ts", late), width)


def latest_per_user(events: DataFrame) -> DataFrame:
    """(user_id, ts, event_id, value, n_events) after each micro-batch for the users it touches, kept as state."""

    def update(key, batches: Iterator[pd.DataFrame], state):
        ts, event_id, value, n = state.get if state.exists else (None, None, None, 0)
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if ts is None or (top["ts"].to_pydatetime(), int(top["event_id"])) > (ts, event_id):
                ts, event_id, value = top["ts"].to_pydatetime(), int(top["event_id"]), float(top["value"])
        state.update((ts, event_id, value, n))
        yield pd.DataFrame({"user_id": [key[0]], "ts": [ts], "event_id": [event_id], "value": [value], "n_events": [n]})

    schema = "user_id bigint, ts timestamp, event_id bigint, value double, n_events bigint"
    state = "ts timestamp, event_id bigint, value double, n_events bigint"
    e = events.select("user_id", "ts", "event_id", "value")
    return e.groupBy("user_id").applyInPandasWithState(update, schema, state, "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, through the stream engine. Each micro-batch has its own folder, which a batch that comes
    again overwrites, so a replay counts once; of mode complete the last batch is the result."""
    import uuid

    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    schema = stream.schema

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
