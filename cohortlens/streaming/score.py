"""Live scoring as Structured Streaming.

The batch and the streaming paths share one function (``score_events``), a
stateless projection, so a record scores the same whichever way it comes.
The stream reads files as they land (file source with an explicit schema),
writes scored rows to a parquet sink with a checkpoint in the shared folder
(exactly-once file sink; a restarted query resumes from its checkpoint),
and is triggered with ``availableNow`` so a run drains what is there and
stops.  Counts are then an ordinary batch aggregation over the sink.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.derive import (
    alert_names,
    dbl,
    prediction_text,
    risk_tier,
    sigmoid,
    stable_round,
    validation_status,
    violation_reason,
)
from ..session import shared_path, unique_suffix

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_score(value: str = "value"):
    logit = (dbl(value) - dbl(C.EVENT_CENTRE)) / dbl(C.EVENT_SCALE)
    return stable_round(sigmoid(logit), C.SCORE_DIGITS)


def score_events(events: DataFrame) -> DataFrame:
    """Stateless scoring of event rows (works on batch and streaming frames).

    Every row is kept; rows outside ``EVENT_BOUNDS`` or without a value are
    flagged with ``status``/``reason``.  A row without a value has no score,
    prediction or tier.
    """
    scored = events.select("event_id", "event_type", "value", event_score().alias("p"))
    reason = violation_reason(C.EVENT_BOUNDS)
    return scored.select(
        "*",
        F.when(F.col("p").isNotNull(), prediction_text(F.col("p"))).alias("prediction"),
        F.when(F.col("p").isNotNull(), risk_tier(F.col("p"))).alias("tier"),
        alert_names([("high_value", "value", ">", 95.0)]).alias("alerts"),
        validation_status(reason).alias("status"),
        F.coalesce(reason, F.lit(C.NO_REASON)).alias("reason"),
    )


def score_with(model, features: list[str]):
    """A scoring function for a stream that applies a saved or fitted ``PipelineModel``.

    The model is a chain of row-wise transformers, so it runs on streaming
    frames as it does on batches; rows with a missing input are kept without
    a score.
    """

    def run(events: DataFrame) -> DataFrame:
        missing = F.lit(False)
        for f in features:
            missing = missing | F.col(f).isNull()
        filled = events.withColumn("_missing", missing).fillna(0, subset=features)
        scored = model.transform(filled)
        p = F.when(~F.col("_missing"), vector_to_array(F.col("probability"))[1])
        scored = scored.withColumn("p", p)
        return scored.select(
            *[c for c in events.columns if c not in features],
            *[F.when(~F.col("_missing"), F.col(f)).alias(f) for f in features],
            "p",
            F.when(F.col("p").isNotNull(), prediction_text(F.col("p"))).alias("prediction"),
            F.when(F.col("p").isNotNull(), risk_tier(F.col("p"))).alias("tier"),
            F.when(F.col("_missing"), F.lit(C.REJECTED)).otherwise(F.lit(C.VALID)).alias("status"),
        )

    return run


def stream_to_table(spark: SparkSession, source: str, name: str = "event_scores", schema=EVENT_SCHEMA, score=score_events) -> str:
    """Drain the Parquet table at ``source`` (a folder of files, or one file)
    through the scoring stream into a parquet table.

    Returns the table path (a fresh folder below the shared checkpoint dir).
    """
    run = unique_suffix()
    sink = shared_path(spark, "streams", f"{name}-{run}", "data")
    checkpoint = shared_path(spark, "streams", f"{name}-{run}", "checkpoint")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if not _is_folder(spark, source):  # a file source reads folders: pick the one file in its folder
        source, _, file = source.rstrip("/").rpartition("/")
        reader = reader.option("pathGlobFilter", file)
    q = (
        score(reader.parquet(source))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(sink)
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return sink


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path is a folder, asked of the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return status.isDirectory()


def tier_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("event_type", "status", "tier").agg(F.count(F.lit(1)).alias("n"))
