"""Session construction, table loading and the shared scratch area."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[*]", app: str = "corpusloom", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every query here assumes: UTC, AQE, skew-join splitting."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (any path Spark's readers can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session does not set it (tests, one machine) a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(_remove_local, _OWN_DIRS[app])
    return f"file://{_OWN_DIRS[app]}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Seconds between two collections of what finished steps left with the executors.
RELEASE_SECONDS = 10.0
_RELEASED = [0.0]


def release_finished(spark: SparkSession) -> None:
    """Let executors drop broadcasts of finished steps, which Spark does only once the driver has collected their handles.

    The driver's heap fills slowly, so without this every list that a step broadcast stays in the executors' memory.
    """
    if time.monotonic() - _RELEASED[0] >= RELEASE_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _RELEASED[0] = time.monotonic()


#: Where Spark knows it: shuffle files go with the query that made them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs the readers nothing but a reread of the file. The shuffle files of the step go as it ends.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"
    if top not in _TOPS:
        _TOPS.add(top)
        atexit.register(_remove_shared, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    release_finished(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_TOPS: set[str] = set()


def _remove_shared(spark: SparkSession, top: str) -> None:
    """The application's tables go with it, if its session is still there to reach the store."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        path = context._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(*frames: DataFrame) -> None:
    """Delete the files of frames that ``persist_table`` returned and nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started from."""
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = tempfile.mkdtemp(prefix="corpusloom-zip-")
    atexit.register(_remove_local, out)
    stage = Path(out, "stage")
    shutil.copytree(root, stage / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{out}/corpusloom", "zip", stage))
    _SHIPPED.add(app)
