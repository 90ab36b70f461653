"""Sessions, tables of a folder, and where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "kairolog", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='kairolog-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it. One of our own only in local mode, as in tests: on a cluster no
    folder of one machine will do, so a missing setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir()


_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder for each application, which :func:`clear` removes."""
    root = f"{shared_dir(spark)}/kairolog-{spark.sparkContext.applicationId}"
    _made[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes what :func:`scratch` and :func:`cut` left behind for this application; results not yet computed from it are lost."""
    for root in [r for r, s in _made.items() if s is spark]:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _made[root]


@atexit.register
def _clear_all() -> None:
    for spark in set(_made.values()):
        try:
            clear(spark)
        except Exception:  # the JVM is gone
            pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows neither repeats its work nor loses it with an executor."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
