"""Getting the package to the executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, so that functions pickled by name are found there."""
    sc = spark.sparkContext
    if getattr(sc, "_tidepool_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tidepool-")) / "tidepool-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(_ROOT.rglob("*.py")):
            z.write(file, file.relative_to(_ROOT.parent))
    sc.addPyFile(str(path))
    sc._tidepool_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it. Where it is unset, a local session
    takes one in its warehouse; on a cluster nothing says that such a folder is shared, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-steps"


_FRAMES: list[tuple[SparkSession, str]] = []


def _forget() -> None:
    """Deletes the frames that were written; at exit the session may have ended, which is no error."""
    while _FRAMES:
        spark, path = _FRAMES.pop()
        with contextlib.suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(_forget)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again, for frames that several branches of a plan read. It is
    deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/frames/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _FRAMES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
