"""Data sets that grow: new files are taken as a stream, and each batch is appended once.

The file sink's log and the checkpoint make an append happen exactly once, also when a job is started again: it goes on
after the last batch that it finished.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, rnd, table


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this machine only where Spark runs on it alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or tempfile.mkdtemp(prefix="tidegrove-")).rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: what follows starts from it, also after an executor is lost."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def grow(source: str, schema, target: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, files_a_batch: int = 1000) -> Callable[[SparkSession], None]:
    """Appends the changed rows of all files new in ``source`` since the last call to ``target``."""

    def run(spark: SparkSession) -> None:
        new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        change(new).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    return run


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 1 GROUP BY event_type")
def append_stream(spark, sf_dir):
    """Events taken as a stream, filtered, and appended; then counted from what was appended."""
    base = f"{shared_dir(spark)}/growth-{uuid.uuid4().hex}"
    # a pattern, as a stream takes a plain path for a folder and the table can be one file
    step = grow(f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema, f"{base}/rows", f"{base}/log", lambda df: df.where("value > 1").select("event_id", "event_type", "value"))
    step(spark)
    step(spark)  # nothing is new: nothing is appended again
    rows = spark.read.parquet(f"{base}/rows")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 2).alias("total"))
