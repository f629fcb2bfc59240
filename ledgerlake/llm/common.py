"""What several operators share: the scratch folder, cutting lineage, and joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A key with more rows than HEAVY_ROWS is dealt over SALTS partitions.
HEAVY_ROWS, SALTS = 2_000, 48


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else a temporary one if all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="ledgerlake-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared folder, and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """df computed once as a table of the shared folder, whose size Spark knows when it chooses how to join. held: gets its path, for forget()."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def spare(name: str, columns: list[str]) -> str:
    """name, or if a column has it (in any case), with underscores after it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def plus(schema: StructType, **types: str) -> StructType:
    """schema with further columns, given by their DDL types."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in types.items())).fields])


def text_of(column: str = "text"):
    """A null text counts as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to right on `key`, right having a key at most once; a key may hold any share of left's rows.

    The keys that have over HEAVY_ROWS rows in left are found by a count with map-side combine and held as a table,
    which Spark broadcasts if it is small and joins if it isn't. Their rows are dealt over SALTS partitions, to each
    of which right's row is copied. left must be cheap to compute twice (a table, an exchange or a checkpoint).
    Null keys never match; how is "inner" or "left".
    """
    mark, salt = (spare(x, [*left.columns, *right.columns]) for x in ("_heavy", "_salt"))
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(mark))
    heavy = counts.where(F.col(mark) > HEAVY_ROWS).select(key, F.lit(True).alias(mark))
    if heavy.isEmpty():
        return left.join(right, key, how)
    heavy = stored(heavy, "heavy")
    spread = F.when(F.col(mark), F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")]), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    a = left.join(heavy, key, "left").withColumn(salt, spread).drop(mark)
    copies = F.when(F.col(mark), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(heavy, key, "left").withColumn(salt, F.explode(copies)).drop(mark)
    return a.join(b, [key, salt], how).drop(salt)
