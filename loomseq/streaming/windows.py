"""Windows over a stream in order of position or time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.sources.shared import new_path


def upserts(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an aggregated stream over what its source holds, and return the last state of each key.

    Every micro-batch writes its changed rows with its number, as Parquet in
    the shared folder. A batch run again after a failure overwrites its own
    folder, so no row counts twice.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, name + "-state")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    values = [c for c in stream.columns if c not in keys]
    schema = stream.schema.add("batch", "long")
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/batch=-1")  # a stream without rows
    rows = spark.read.schema(schema).parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v"))
    return last.select(*keys, *[F.col("v").getField(c).alias(c) for c in values])


def tumbling(stream: DataFrame, time: str, width: str, late: str, keys: list[str], **values: Column) -> DataFrame:
    """keys, start, and the aggregates, of windows of `width`. A window closes and its state goes once the stream is `late` beyond it."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*[v.alias(k) for k, v in values.items()])
    return w.select(*keys, F.col("window.start").alias("start"), *values)


def sessions(df: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """key, start, end, n: sessions of a key that end where nothing follows for `gap`. end is the last event's time. Batch or (with a watermark of its own) stream."""
    s = df.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"), F.max(time).alias("end"))
    return s.select(key, F.col("session_window.start").alias("start"), "end", "n")
