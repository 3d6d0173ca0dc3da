"""Documents over time: primary keys, upserts, deletions, document ids, snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pharos.runtime import materialise

VALID_ID = "^[a-zA-Z0-9_-]+$"


class DocumentError(ValueError):
    pass


def infer_primary_key(columns: list[str], known: str | None = None, autogenerate: bool = False) -> str:
    """The index's key, or the one field whose lower-case name ends in ``id``."""
    if known is not None:
        return known
    guesses = sorted((c for c in columns if c.lower().endswith("id")), key=lambda c: (len(c), c))
    if len(guesses) == 1:
        return guesses[0]
    if not guesses and autogenerate:
        return "id"
    if not guesses:
        raise DocumentError("no field looks like a primary key: none ends in `id`")
    raise DocumentError(f"several fields could be the primary key: {', '.join(guesses)}")


def key_column(df: DataFrame, key: str) -> Column:
    """A field or a dotted path; a path that both a literal name and nesting satisfy is an error."""
    found = []
    if key in df.columns:
        found.append(F.col(f"`{key}`"))
    kind: T.DataType = df.schema
    for part in key.split("."):
        kind = kind[part].dataType if isinstance(kind, T.StructType) and part in kind.names else None
        if kind is None:
            break
    else:
        if "." in key:
            found.append(F.col(".".join(f"`{p}`" for p in key.split("."))))
    if len(found) > 1:
        raise DocumentError(f"`{key}` names several fields")
    return found[0] if found else F.lit(None).cast("string")


def with_ids(df: DataFrame, key: str, autogenerate: bool = False) -> DataFrame:
    """Adds ``ext_id``, trimmed to a string. Generated ids differ on every evaluation: write the result
    before using it twice."""
    ext = F.trim(key_column(df, key).cast("string"))
    return df.withColumn("ext_id", F.coalesce(ext, F.expr("uuid()")) if autogenerate else ext)


def invalid_ids(df: DataFrame) -> DataFrame:
    """Rows whose ``ext_id`` is missing or has other characters than letters, digits, - and _."""
    return df.where(F.col("ext_id").isNull() | ~F.col("ext_id").rlike(VALID_ID))


def geo_errors(df: DataFrame) -> DataFrame:
    """Rows whose ``_geo`` isn't an object of exactly a finite lat and lng (numeric strings count)."""
    if "_geo" not in df.columns:
        return df.where("false").withColumn("error", F.lit(None).cast("string"))
    kind = df.schema["_geo"].dataType
    if not isinstance(kind, T.StructType):
        return df.where("_geo is not null").withColumn("error", F.lit("_geo isn't an object"))
    extra = [f for f in kind.names if f not in ("lat", "lng")]
    error = F.lit(None).cast("string")
    if extra:
        error = F.when(F.coalesce(*[F.col(f"_geo.`{f}`").isNotNull() for f in extra]), F.lit(f"_geo has other fields: {', '.join(extra)}"))
    for part in ("lng", "lat"):
        if part not in kind.names:
            error = F.coalesce(F.lit(f"_geo.{part} is missing"), error)
            continue
        c = F.col(f"_geo.{part}")
        x = c.cast("double") if isinstance(kind[part].dataType, T.NumericType) else F.expr(f"try_cast(_geo.{part} as double)") if isinstance(kind[part].dataType, T.StringType) else F.lit(None).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        error = F.when(c.isNull(), f"_geo.{part} is missing").when(bad, f"_geo.{part} isn't a finite number").otherwise(error)
    return df.where("_geo is not null").withColumn("error", error).where("error is not null")


def latest(batch: DataFrame, key: str = "ext_id", seq: str = "seq") -> DataFrame:
    """Of each id the row of greatest ``seq``: one aggregation, no window."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*").select(batch.columns)


def upsert_replace(current: DataFrame, batch: DataFrame, key: str = "ext_id", seq: str = "seq") -> DataFrame:
    """New rows take the place of old ones of the same id; the last of a batch wins."""
    new = latest(batch, key, seq).drop(seq)
    return current.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_update(current: DataFrame, batch: DataFrame, key: str = "ext_id", seq: str = "seq") -> DataFrame:
    """Field by field, the last value given (not null) wins; fields that a batch lacks stay."""
    fields = [c for c in current.columns if c != key] + [c for c in batch.columns if c not in (*current.columns, key, seq)]
    old = current.withColumn(seq, F.lit(-1).cast(batch.schema[seq].dataType))
    both = old.unionByName(batch, allowMissingColumns=True)
    return both.groupBy(key).agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(seq))).alias(c) for c in fields]).select(key, *fields)


def changed(current: DataFrame, batch: DataFrame, key: str = "ext_id") -> DataFrame:
    """Rows of ``batch`` that aren't stored already as they are."""
    same = [c for c in batch.columns if c in current.columns]
    return batch.join(current.select(same), [batch[c].eqNullSafe(current[c]) for c in same], "left_anti") if same else batch


def allocate(used: DataFrame, new: DataFrame, order: str, column: str = "doc_id") -> DataFrame:
    """``new`` with the smallest free ids, in ``order``.

    Ranks are global, so only the narrow sort keys are ranked: rows are counted by range partition and
    each partition adds the count of those before it.
    """
    spark = new.sparkSession
    n = new.count()
    top = used.agg(F.max(column)).first()[0]
    free = spark.range(0, (-1 if top is None else top) + 1 + n).withColumnRenamed("id", column).join(used.select(column), column, "left_anti")
    return number(new, order, "_n").join(number(free, column, "_n").where(F.col("_n") < n), "_n").drop("_n")


def number(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 by ``order``: a range partitioning, then offsets of the partitions.

    The partitions are written once: were they counted in one run and numbered in another, the two could
    differ, since bounds are sampled and partitions joined by the size of what each run carries.
    """
    part = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    part = materialise(part.withColumn("_k", F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)).drop("_i"))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn(name, F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")  # a row a partition


def delete(current: DataFrame, ids: DataFrame, key: str = "ext_id") -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti")


def soft_delete(tombstones: DataFrame | None, ids: DataFrame, key: str = "ext_id") -> DataFrame:
    ids = ids.select(key)
    return (tombstones.select(key).union(ids) if tombstones is not None else ids).distinct()


def should_soft_delete(live: int, soft: int, document_bytes: float, limit: int = 1 << 30) -> bool:
    """Keep tombstones while they are fewer than live documents and hold less than ``limit`` bytes."""
    return soft < live and soft * document_bytes < limit


class Store:
    """Immutable snapshots in a folder: each version is a Parquet folder, ``CURRENT`` names the last.

    A version is complete before the pointer moves, so readers of an older one are never disturbed and a
    writer that dies leaves the store as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        p = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(p):
            return None
        s = self._fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8").strip()
        finally:
            s.close()

    def write(self, df: DataFrame, settings_json: str = "{}", partition_by: list[str] | None = None) -> str:
        name = f"v-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/{name}/documents")
        return self.publish(name, settings_json)

    def publish(self, name: str, settings_json: str) -> str:
        """Make the version of this name, whose files are complete, the current one."""
        self._put(f"{name}/settings.json", settings_json)
        self._put("CURRENT.next", name)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        mode = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        mode[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(f"{self.root}/CURRENT.next"), self._path(f"{self.root}/CURRENT"), mode)
        return name

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, version: str | None = None) -> DataFrame:
        v = version or self.version()
        if v is None:
            raise DocumentError("the store is empty")
        return self.spark.read.parquet(f"{self.root}/{v}/documents")

    def settings(self) -> dict:
        s = self._fs.open(self._path(f"{self.root}/{self.version()}/settings.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8"))
        finally:
            s.close()

    def clear(self) -> str:
        """No documents; the settings stay."""
        return self.write(self.read().where("false"), json.dumps(self.settings()))

    def size(self) -> int:
        """Bytes of the current version."""
        return self._fs.getContentSummary(self._path(f"{self.root}/{self.version()}")).getLength()

    def copy_to(self, root: str, files: int | None = None) -> str:
        """The current version written anew elsewhere, compacted to ``files`` files if given."""
        df = self.read()
        return Store(self.spark, root).write(df.coalesce(files) if files else df, json.dumps(self.settings()))
