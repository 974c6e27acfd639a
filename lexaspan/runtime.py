"""Session helpers: the shared folder, written intermediate tables and code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SCRATCH: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the session names none, the checkpoint folder set on the context serves.
    Only in local mode (tests, a laptop) is a folder made and set where there is neither;
    on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or _ROOTS.get(sc.applicationId) or sc.getCheckpointDir()
    if not found:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _ROOTS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="lexaspan-")
        sc.setCheckpointDir(found)
        atexit.register(_remove_local, found)
    return found.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` address or plain path, else None."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def _remove_local(uri: str) -> None:
    import shutil

    if path := local_path(uri):
        shutil.rmtree(path, ignore_errors=True)


def remove_tree(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared file system."""
    if local_path(uri):
        return _remove_local(uri)
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(uri)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may have ended first; the folder's owner cleans up then
        return None


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the session's own part of the shared folder, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_dir(spark)}/lexaspan-{app}"
        atexit.register(remove_tree, spark, _SCRATCH[app])
    return f"{_SCRATCH[app]}/{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table outlives lost executors, cuts the lineage and pins what sampling
    (range bounds) or non-deterministic order decided.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, however the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    base = local_path(shared_dir(spark)) or tempfile.gettempdir()
    os.makedirs(base, exist_ok=True)
    path = os.path.join(base, f"lexaspan-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path(here.name) / p.relative_to(here))
    sc.addPyFile(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows read from files, dealt out over all cores where they lie in fewer partitions than cores; larger data isn't moved."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
