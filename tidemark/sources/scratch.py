"""The folder that the driver and all executors share: streams' checkpoints, tables between steps, and the package's own code for Python tasks."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def clear(spark: SparkSession) -> None:
    """Remove all tables this application has left in the shared folder; results that still read them can't be used any more."""
    files, path = _file_system(spark, shared_dir(spark))
    files.delete(path, True)
    _shipped.discard(spark.sparkContext.applicationId)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python tasks can import it from any working folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent).as_posix())
    target = f"{shared_dir(spark)}/{root.name}.zip"
    files, path = _file_system(spark, target)
    out = files.create(path, True)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def written(df, name: str):
    """``df`` as a table in the shared folder, read from there: the lineage ends, and a lost executor costs no more than what came since."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
