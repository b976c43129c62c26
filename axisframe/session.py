"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; make one only where it is unset and Spark runs on this machine alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="axisframe-checkpoint-")
    context.setCheckpointDir(named)


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application (served by the driver)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="axisframe-ship-"), "axisframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("axisframe", os.path.relpath(path, here)))
    context.addPyFile(archive)
    _shipped[context.applicationId] = archive


#: Folder of each table that ``cut`` wrote, by the id of the DataFrame that reads it.
_tables: dict[int, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/axisframe-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Later jobs start from that table, so they survive lost executors; a table is smaller than the rows of a
    plain checkpoint. All tables of an application lie in one folder named after it, which :func:`clear` removes;
    :func:`discard` removes a single one.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    _tables[id(held)] = path
    weakref.finalize(held, _tables.pop, id(held), None)
    return held


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`cut` that nothing will read again: all that came from them has been written itself."""
    for df in tables:
        path = _tables.pop(id(df), None)
        if path is not None:
            _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables this application has written; results that were not fetched or written yet are lost."""
    _remove(spark, scratch(spark))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
