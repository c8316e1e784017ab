"""Where what outlives a statement is written, and how the package reaches executors.

Everything goes below ``spark.checkpoint.dir``, the one folder that driver and
executors share, and is removed when the process ends. Only a local session
without that setting, as in tests, gets a temporary folder: on a cluster each
executor would write to a disk of its own, so there a missing setting is an
error.
"""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_WORKSPACES: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def workspace(spark: SparkSession) -> str:
    """URI of this application's folder in the shared storage."""
    app = spark.sparkContext.applicationId
    if app not in _WORKSPACES:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not local(spark):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        elif "://" not in base:
            base = f"file://{os.path.abspath(base)}"
        _WORKSPACES[app] = f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _WORKSPACES[app])
    return _WORKSPACES[app]


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder; at interpreter exit the JVM may be gone already."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001
        pass


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a folder at once, so that readers see all of it or nothing."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(make(new).getParent())
    if not fs.rename(make(old), make(new)):
        raise RuntimeError(f"{old} can't be moved")


def folders(spark: SparkSession, uri: str) -> list[str]:
    """Names of the folders in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().getName() for s in found if s.isDirectory())


def fresh(spark: SparkSession, name: str) -> str:
    """A new URI in the workspace."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(rows: DataFrame, name: str = "rows") -> DataFrame:
    """Write rows to the shared folder and read them back: lineage ends there."""
    spark = rows.sparkSession
    uri = fresh(spark, name)
    rows.write.parquet(uri)
    return spark.read.schema(rows.schema).parquet(uri)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each application.

    Where it is installed, on PYTHONPATH or in the folder a local session runs
    in, nothing is needed; else it is sent as a zip file.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or "site-packages" in root or (local(spark) and os.getcwd() == root):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quillon-ship-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for where, _, names in os.walk(package):
            for n in (n for n in names if n.endswith(".py")):
                z.write(full := os.path.join(where, n), os.path.relpath(full, root))
    spark.sparkContext.addPyFile(target)
    if root not in sys.path:
        sys.path.insert(0, root)
