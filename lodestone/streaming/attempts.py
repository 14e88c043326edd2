"""Attempts as a stream: sessions by watermark, and a running weakness table kept by upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.practice import scored, weakness


def stream(spark: SparkSession, folder: str, schema: T.StructType, files_a_batch: int = 100) -> DataFrame:
    """New files of a folder as they come, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def live_sessions(attempts: DataFrame, at: str, learner: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions ended by a gap in time; rows later than the watermark are dropped, so state stays bounded."""
    s = attempts.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(learner))
    return s.agg(F.count(F.lit(1)).alias("questions"), F.sum("attempted").alias("attempted"), F.sum("is_correct").alias("correct"), F.sum("score_delta").alias("score")).select(learner, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "questions", "attempted", "correct", "score")


def keep_weakness(attempts: DataFrame, keys: list[str], chosen: str, correct: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds each batch's counts to a table in ``out``; ``weakness_table`` reads it. A batch that is replayed after a
    failure overwrites its own part and is never counted twice."""
    graded = scored(attempts, chosen, correct)

    def add(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*keys).agg(F.count_if(F.col("result") == "wrong").alias("wrong"), F.count_if(F.col("result") == "skipped").alias("skipped"), F.sum("attempted").alias("attempted"), F.sum("is_correct").alias("correct"))
        part.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = graded.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def weakness_table(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    parts = spark.read.parquet(out)
    s = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("wrong", "skipped", "attempted", "correct")])
    acc = F.coalesce(F.try_divide(F.col("correct"), F.col("attempted")), F.lit(0.0))
    return s.withColumn("accuracy", F.round(acc, 4)).withColumn("weakness_score", F.round(2 * F.col("wrong") + 0.8 * F.col("skipped") + (1 - acc), 4))


def batch_weakness(attempts: DataFrame, keys: list[str], chosen: str, correct: str) -> DataFrame:
    return weakness(scored(attempts, chosen, correct), keys)
