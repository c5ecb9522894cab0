"""Session settings and shared scratch space."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that hold from a laptop to a cluster: AQE sizes the shuffle
# partitions, splits skewed join partitions and turns a join into a broadcast
# only when the measured side is below the threshold.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Narrow rows that one file of an intermediate table holds, when their number is known: one task writes them in well under a second.
ROWS_A_FILE = 1 << 16

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so that they need no path to its source."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    source = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="basketry-package-")) / f"{source.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(source.rglob("*.py")):
            out.write(file, file.relative_to(source.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def build_session(app: str = "basketry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def _named_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is made only for a local master with nothing set; on a
    cluster an unset folder is an error, since executors could not share it.
    """
    named = _named_dir(spark)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="basketry-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, under this application's own name."""
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/basketry/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, when its results are stored elsewhere."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives the
    reader true sizes, which AQE and the broadcast threshold rely on. ``rows``,
    if known, is the most rows that can come: the number of files then follows
    it, where a shuffle of many partitions would leave a small file for each.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialize`` wrote and that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for parent in {file.rpartition("/")[0] for file in table.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(parent))
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def slots(spark: SparkSession) -> int:
    """Number of partitions of stages whose cost is computing."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key into a fixed number of partitions.

    For stages whose cost is computing, not bytes: AQE would merge their small
    partitions into few tasks. A grouping on the same key needs no more shuffle.
    """
    return df.repartition(slots(df.sparkSession), *keys)


def drop_past_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of stored results, which it does once the driver collects what stands for them.

    Frames that Python has dropped hold on to their plans until Python collects as well: they lie in cycles of references.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def short_lineage(spark: SparkSession, seconds: float = 10.0) -> Iterator[None]:
    """For trainings of many rounds that checkpoint each: the shuffle files of past rounds go while later ones run.

    Without a folder for checkpoints Spark keeps the files of all rounds. With one it removes those of a round
    whose result is checkpointed once the driver has collected the objects that stood for them; a driver with
    much free memory would hardly do so before the end.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoints"))
    done = threading.Event()

    def collect() -> None:
        while not done.wait(seconds):
            drop_past_shuffles(spark)

    collector = threading.Thread(target=collect, daemon=True)
    collector.start()
    try:
        yield
    finally:
        done.set()
        collector.join()
