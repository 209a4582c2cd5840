"""Session helpers: tables, cut points of long lineages, bounded driver values."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()
_HOMES: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless ``PYTHONPATH`` holds it."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    name = Path(tempfile.mkdtemp(prefix="treadle-")) / "treadle.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in (root / "treadle").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(name))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only on one machine (a ``local`` master, as in tests) a temporary folder is
    made where it is unset, and kept in the session's configuration; a cluster
    without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='treadle-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts ``done`` are deleted after that.

    Cuts the lineage as ``checkpoint()`` does, in Parquet: columns that a later
    step does not need are not read again, and the lost work of an executor is
    read from the folder instead of being computed anew. All cuts of an
    application lie in one folder, which is deleted when the driver ends.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/treadle-{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(_delete, spark.sparkContext, home)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in done:
        drop_cut(old)
    return spark.read.schema(df.schema).parquet(path)


def _delete(sc, path: str) -> None:
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    except Exception:  # the JVM has already ended
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a ``cut`` that nothing reads any more."""
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _delete(df.sparkSession.sparkContext, f)


def absent(c):
    """Null and ``""`` both stand for an absent string."""
    return F.nullif(c, F.lit(""))
