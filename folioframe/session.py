"""Session helpers: lineage cuts and the settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs are written for; a cluster may override any of them.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760b",
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "folioframe"):
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    folder has to be shared, or a lost executor would take the data with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioframe-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application.

    Functions of the package run there by name, wherever the driver found it.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


_STATIC, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_MOVED: dict[str, str] = {}


def measured_broadcasts(spark: SparkSession, on: bool = True) -> None:
    """Let only measured sizes decide on broadcasts that no hint asks for; off gives back the session's own threshold.

    Before a job runs, a table counts as large as its compressed files, and an
    exploded one as large as what it came from: either may be broadcast at many
    times the threshold. The same threshold holds for the sizes of shuffles,
    which are known. A session that has a threshold for these keeps its settings.
    """
    app = spark.sparkContext.applicationId
    if on and app not in _MOVED and spark.conf.get(_MEASURED, None) is None:
        _MOVED[app] = spark.conf.get(_STATIC)
        spark.conf.set(_MEASURED, _MOVED[app])
        spark.conf.set(_STATIC, "-1")
    elif not on and app in _MOVED:
        spark.conf.set(_STATIC, _MOVED.pop(app))
        spark.conf.unset(_MEASURED)


_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, unless it already is.

    Geometry columns are long expressions over each other, and inferring
    constraints through them takes the optimizer exponential time; it is off
    while the plan is made.
    """
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRDD":
        return df
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CONSTRAINTS)
    spark.conf.set(_CONSTRAINTS, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_CONSTRAINTS, before)


def estimated_size(df: DataFrame) -> int:
    """Bytes of a table by the optimizer's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: A table whose share per core is below this cannot fill the cores by its splits.
SPREAD_SHARE = 16 * 1024 * 1024


def spread(df: DataFrame, least: int = 1024 * 1024) -> DataFrame:
    """Hand a small table with few row groups to all cores.

    Text work is heavy per byte, so one row group would keep one core busy.
    Tables with enough splits of their own are left alone: the exchange only
    ever moves a few megabytes per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if least < estimated_size(df) < cores * SPREAD_SHARE else df


#: Largest table (bytes, by the optimizer's estimate) that may be broadcast.
BROADCAST_LIMIT = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the optimizer's size estimate allows it.

    Beyond the limit the join is left to Catalyst, which shuffles both sides.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_size(df) <= limit else df


#: Rows of a table of a few short columns that may be broadcast.
FEW_ROWS = 500_000


def broadcast_if_few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """Hint a broadcast of a slim table that was written and counted to be small; else both sides are shuffled.

    Estimates say little of a table that was aggregated from exploded texts, or made by the driver.
    """
    from pyspark.sql import functions as F

    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= most else df
