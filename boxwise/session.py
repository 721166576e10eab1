"""Session helpers: builder for tests and benches, checkpoint folder, materialisation."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("boxwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves a local session, whose one machine is
    the cluster; anywhere else it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration with a reliable checkpoint."""
    folder = shared_folder(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_WRITTEN: dict[str, list[str]] = {}
_BUILDING = threading.local()
#: Whether the shuffle files of a write go when it ends, rather than when the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(spark: SparkSession, paths: list[str]) -> None:
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in known:
            known.remove(path)


def remove_written(spark: SparkSession) -> int:
    """Remove the tables that this application wrote by ``materialize``, and return their number.

    For the end of a job: frames made from these tables can't be read afterwards.
    """
    paths = list(_WRITTEN.get(spark.sparkContext.applicationId, []))
    _remove(spark, paths)
    _WRITTEN.pop(spark.sparkContext.applicationId, None)
    return len(paths)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table used several times to the shared folder and read it back.

    A written table survives lost executors, keeps later plans small, and its scans
    still prune columns and push filters. Inside ``written`` it is a step on the way and goes at its end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/boxwise-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    steps = getattr(_BUILDING, "steps", [])
    if steps:
        steps[-1].append(path)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def written(make: Callable[[], DataFrame], keep: bool = True) -> DataFrame:
    """The table that ``make`` returns, written; what ``materialize`` wrote on the way goes as soon as it stands.

    ``make`` may call for other tables made by ``written``: those stay, but for a table that isn't to be kept, which is a step
    of the one around it.
    """
    if not hasattr(_BUILDING, "steps"):
        _BUILDING.steps = []
    outer, own = _BUILDING.steps, []
    spark = None
    try:
        _BUILDING.steps = [*outer, own]
        df = make()
        spark = df.sparkSession
        _BUILDING.steps = [] if keep else outer
        return materialize(df)
    finally:
        _BUILDING.steps = outer
        if own:
            _remove(spark or SparkSession.getActiveSession(), own)
