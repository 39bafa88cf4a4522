"""Session settings, and the folder that executors and driver share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables that materialise() has written in this process, in order.
_WRITTEN: list[str] = []


def build_session(app: str = "stimframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the library's results rely on: UTC, AQE, Arrow."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (local runs, tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stimframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows reads files that outlive any executor, and steps that depend on how rows were
    partitioned (range bounds, for one) see one and the same partitioning. The files stay until clear_shared().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stimframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Delete every table that materialise() left in the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stimframe")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Within, a function that deletes the tables that materialise() has written since, but for those that the given tables read.

    For a job of several steps, each of which reads the one before alone.
    """
    begin = len(_WRITTEN)

    def clear(*keep: DataFrame) -> None:
        needed = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for df in keep for f in df.inputFiles()}
        for path in _WRITTEN[begin:]:
            if path.split(":", 1)[-1].lstrip("/") not in needed:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
                _WRITTEN.remove(path)

    yield clear
