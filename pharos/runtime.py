"""Session helpers: table access, the shared scratch folder, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch: the executor holds one on its way to and one on its way from each worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once per application, and bound the batches they get where
    the session leaves Spark's default (64 MB)."""
    if spark.conf.get(BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # the driver's file server hands this to the executors; nothing reads the folder itself
    zipped = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(zipped, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(zipped)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset (tests, local sessions) a temporary folder of the one machine takes its place;
    a cluster without the setting is refused, because its executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/pharos-{uuid.uuid4().hex}"


_base: list[str] = []


def _local_base() -> str:
    if not _base:
        _base.append(tempfile.mkdtemp(prefix="pharos-"))
    return _base[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
