"""Driving a streaming query to the end of its current input, into a current table that is compacted as it goes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingotide.session import scratch_path

# so many batches of updates lie beside the compacted table at most
COMPACT_EVERY = 8


def _schema(fields: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema.fields) + ", batch_id long"


def run_updates(
    stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None,
    keys: Sequence[str] | None = None, compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Process all available input in update mode and return the emitted rows with their ``batch_id``.

    Each batch replaces its own folder, so a batch repeated after a failure is not counted twice. With ``keys``, every
    ``compact_every`` batches the newest row per key of what has come so far is written as one table; later readers take that table
    and the batches after it, never all updates. A compaction counts once its number is in the log, so one that is cut short is ignored
    and written anew with its batch.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    schema = _schema(stream)

    def save(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/updates/batch_id={batch_id}")
        if keys and (batch_id + 1) % compact_every == 0:
            rows = current(session, path, schema, keys).filter(F.col("batch_id") <= batch_id)
            rows.write.mode("overwrite").parquet(f"{path}/compacted/upto={batch_id}")
            session.range(1).select(F.lit(batch_id).cast("long").alias("upto")).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # a base folder that is not there yet reads as empty
    spark.createDataFrame([], schema.replace(", batch_id long", "")).write.mode("append").parquet(f"{path}/updates/batch_id=-1")
    return current(spark, path, schema, keys) if keys else spark.read.schema(schema).parquet(f"{path}/updates")


def compacted_upto(spark: SparkSession, path: str) -> int:
    """Last batch of the newest finished compaction, -1 before the first."""
    log = spark.read.schema("upto long").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    spark.createDataFrame([(-1,)], "upto long").write.mode("ignore").parquet(f"{path}/log/batch=-1")
    return log.parquet(f"{path}/log").agg(F.max("upto")).first()[0]


def current(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key with the batch that emitted it: the compacted table and the batches after it."""
    upto = compacted_upto(spark, path)
    rows = spark.read.schema(schema).parquet(f"{path}/updates").filter(F.col("batch_id") > upto)
    if upto >= 0:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/compacted/upto={upto}"))
    rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("s"), F.max("batch_id").alias("batch_id"))
    return newest.select(*keys, "s.*", "batch_id")
