"""A stream of puts into a store of objects that are written once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "oid string, size long, first_seq long, first_agent string"


def stored(spark, path: str) -> DataFrame:
    """(oid, size, first_seq, first_agent) of all objects of a store; a batch that was written again after a failure counts once."""
    try:
        found = spark.read.schema(SCHEMA + ", batch long").parquet(path)
    except AnalysisException:  # nothing was put yet
        return spark.createDataFrame([], SCHEMA)
    first = found.groupBy("oid").agg(F.min(F.struct("batch", "first_seq", "first_agent", "size")).alias("f"))
    return first.select("oid", "f.size", "f.first_seq", "f.first_agent")


def put_stream(puts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the puts (content binary, agent, seq) of a stream into the store at `path`.

    Content that the store has, or that comes again in the same batch, is a dedup
    hit: the first put stays, with who made it. Each batch is a folder of its own,
    replaced if the batch runs again, so a restart loses and doubles nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        told = batch.select(F.sha2("content", 256).alias("oid"), F.octet_length("content").cast("long").alias("size"), "seq", "agent")
        fresh = told.groupBy("oid").agg(F.min(F.struct("seq", "agent", "size")).alias("f")).select("oid", "f.size", F.col("f.seq").alias("first_seq"), F.col("f.agent").alias("first_agent"))
        before = stored(spark, path) if number == 0 else spark.read.schema(SCHEMA + ", batch long").parquet(path).filter(F.col("batch") < number)
        fresh.join(before.select("oid").distinct(), "oid", "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = puts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
