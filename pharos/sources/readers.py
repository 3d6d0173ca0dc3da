"""Sources: JSON, JSON lines, CSV with typed headers, and flattening of nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    pass


def json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One object or one array of objects a file."""
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


def json_objects(spark: SparkSession, objects: list[dict]) -> DataFrame:
    import json

    return spark.createDataFrame([(json.dumps(o),) for o in objects], "json string").select(F.parse_json("json").alias("document"))


def variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents without a common schema: one VARIANT a line."""
    return spark.read.text(path).where("trim(value) != ''").select(F.parse_json("value").alias("document"))


def typed_header(header: str) -> tuple[str, str]:
    """``name:number`` and ``name:string``, split at the last colon; any other suffix belongs to the name."""
    name, colon, kind = header.rpartition(":")
    return (name, kind) if colon and kind in ("number", "string") else (header, "string")


def typed_csv(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """CSV whose header types its columns. Empty values are null; a number column of whole numbers is of
    longs, another of doubles (unchecked: always doubles); a value that isn't a number is an error that
    names an example and its file, raised before anything is returned."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    out, bad = [], []
    for c in raw.columns:
        name, kind = typed_header(c)
        v = F.col(f"`{c}`")
        empty = F.when(F.trim(v) == "", None).otherwise(v)
        if kind == "number":
            number = F.expr(f"try_cast(trim(`{c}`) as double)")
            plain = F.trim(v).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
            wrong = empty.isNotNull() & ~plain
            whole = F.expr(f"try_cast(trim(`{c}`) as bigint)")
            bad.append(F.struct(F.count_if(wrong).alias("n"), F.min(F.when(wrong, F.struct(F.col("_metadata.file_path").alias("file"), v.alias("value")))).alias("first"), F.bool_and(empty.isNull() | whole.isNotNull() & ~F.trim(v).contains(".")).alias("whole")).alias(name))
            out.append((name, F.when(plain, number), F.when(plain, whole)))
        else:
            out.append((name, empty, None))
    whole = set()
    if check and bad:
        found = raw.agg(*bad).first().asDict()
        if wrong := {k: r for k, r in found.items() if r["n"]}:
            raise SourceError("; ".join(f"{r['n']} values of `{k}` aren't numbers, such as {r['first']['value']!r} in {r['first']['file']}" for k, r in wrong.items()))
        whole = {k for k, r in found.items() if r["whole"]}
    return raw.select(*((integer if name in whole else column).alias(name) for name, column, integer in out))


def needs_flattening(schema: T.StructType) -> bool:
    return any(isinstance(f.dataType, T.StructType) or isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType)) for f in schema.fields)


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns: objects become ``a.b``, arrays of objects one array for each
    field, and a literal ``a.b`` that meets a flattened one becomes an array of both."""
    found: dict[str, list[tuple[Column, T.DataType]]] = {}

    def walk(c: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(c[f.name], f.dataType, f"{name}.{f.name}")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                walk(c.getField(f.name), T.ArrayType(f.dataType), f"{name}.{f.name}")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
            walk(F.flatten(c), kind.elementType, name)
        else:
            found.setdefault(name, []).append((c, kind))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    out = []
    for name, parts in found.items():
        if len(parts) == 1:
            out.append(parts[0][0].alias(name))
        else:
            arrays = [c.cast("array<string>") if isinstance(k, T.ArrayType) else F.when(c.isNotNull(), F.array(c.cast("string"))) for c, k in parts]
            out.append(F.flatten(F.filter(F.array(*arrays), lambda x: x.isNotNull())).alias(name))
    return df.select(*out)


def flatten_variant(df: DataFrame, column: str = "document", key: str = "doc_id", depth: int = 16) -> DataFrame:
    """(key, field, value) of schemaless documents: objects are opened level by level, array elements
    keep the array's name, scalars are values; ``value`` of an empty object or array is null. Levels
    beyond ``depth`` are an error rather than a loss."""
    level = df.select(key, F.lit("").alias("field"), F.col(column).alias("v"))
    out = None
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaf = level.where(~nested).select(key, "field", F.col("v").cast("string").alias("value"))
        opened = level.where(nested).select(key, "field", kind.startswith("OBJECT").alias("o"), "v")
        opened.createOrReplaceTempView("_opened")
        child = df.sparkSession.sql(f"select t.`{key}`, t.field, t.o, e.key as k, e.value as v from _opened t, lateral variant_explode_outer(t.v) e")
        name = F.when(~F.col("o"), F.col("field")).when(F.col("field") == "", F.col("k")).otherwise(F.concat_ws(".", "field", "k"))
        out = leaf if out is None else out.unionByName(leaf)
        empty = opened.where("field != ''").select(key, "field", F.lit(None).cast("string").alias("value"))
        out = out.unionByName(empty)
        level = child.where("v is not null").select(key, name.alias("field"), "v")
        if level.limit(1).count() == 0:
            return out
    raise SourceError(f"documents are nested deeper than {depth}")
