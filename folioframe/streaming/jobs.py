"""Continuous page ingest and stage progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioframe.functions import numeric as N


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", max_files: int = 100) -> DataFrame:
    """New files of a folder, each exactly once per checkpoint."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(folder)
    )


def ingest(stream: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a page-local job on every batch and store its result.

    A batch writes its own folder and overwrites it when it is run again, so a
    restart leaves no doubles.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(events: DataFrame) -> DataFrame:
    """Latest state per job and path among the given events, in whatever order they came."""
    return events.groupBy("job_id", "path").agg(F.max(F.struct("seq", "status")).alias("l")).select("job_id", "path", "l.status", "l.seq")


def _runs(spark: SparkSession, out: str) -> dict[int, str]:
    """Written runs by the number of the last batch they cover."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
    return {int(n.removeprefix("run=")): f"{out}/{n}" for n in names if n.startswith("run=")}


def _parts(number: int) -> list[int]:
    """The runs that together cover batches 1 to ``number``: each covers as many as its lowest set bit says."""
    out = []
    while number:
        out.append(number)
        number &= number - 1
    return out


def follow_progress(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest states below ``out``, in few runs however many batches there were.

    The latest of several latest states is the latest of all, so an event may
    come late, twice, or in any batch. The run of a batch takes in the runs
    before it that are as long as its lower bits, like the sums of a binary
    indexed tree: a reader needs one run per set bit of the batch number. A batch
    that runs again writes the same run; runs taken in go one batch later, so
    that a reader of the former state can end.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, batch_id + 1
        taken = [n for n in _parts(number - 1) if n > number & (number - 1)]
        have = _runs(spark, out)
        states = batch.select("job_id", "path", "status", "seq")
        if taken:
            states = states.unionByName(spark.read.schema(states.schema).parquet(*[have[n] for n in taken]))
        latest_states(states).write.mode("overwrite").parquet(f"{out}/run={number}")
        still = {*_parts(number), *_parts(number - 1)}
        for n, path in have.items():
            if n not in still and n < number:
                gone = spark._jvm.org.apache.hadoop.fs.Path(path)
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_states(spark: SparkSession, out: str) -> DataFrame:
    """Latest state per job and path of all batches that :func:`follow_progress` has taken in."""
    have = _runs(spark, out)
    if not have:
        raise ValueError(f"no states below {out}")
    return latest_states(spark.read.parquet(*[have[n] for n in _parts(max(have))]))


def job_progress(states: DataFrame) -> DataFrame:
    """Percent per job from the latest states."""
    ended = F.count_if(F.col("status").isin("done", "failed", "skipped"))
    return states.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), ended.alias("ended")).withColumn(
        "percent", N.progress_percent(F.col("ended"), F.col("total")))
