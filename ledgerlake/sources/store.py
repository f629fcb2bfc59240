"""A store of payloads addressed by the SHA-256 of their bytes, as a table of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT, LEAST_PREFIX = 12, 8
BLOB = "hash string, bytes binary, len bigint"


def hashed(payloads: DataFrame, column: str = "bytes") -> DataFrame:
    """(hash, bytes, len) of each payload."""
    data = F.col(column).cast("binary")
    return payloads.select(F.sha2(data, 256).alias("hash"), data.alias("bytes"), F.octet_length(data).cast("bigint").alias("len"))


class HeldStore:
    """put is idempotent, get verifies what it reads; a blob whose bytes don't match its hash is as good as absent."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.range(0).selectExpr("cast(null as string) hash", "cast(null as binary) bytes", "cast(null as bigint) len").write.mode("append").parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(BLOB).parquet(self.path)

    def put(self, payloads: DataFrame, column: str = "bytes") -> DataFrame:
        """The hashes of the payloads, all of which are held afterwards."""
        new = hashed(payloads, column)
        new.dropDuplicates(["hash"]).join(self.table().select("hash"), "hash", "left_anti").select("hash", "bytes", "len").write.mode("append").parquet(self.path)
        return new.select("hash").distinct()

    def put_bytes(self, payload: bytes) -> str:
        return self.put(self.spark.createDataFrame([(bytearray(payload),)], "bytes binary")).first()[0]

    def verified(self) -> DataFrame:
        return self.table().where(F.sha2("bytes", 256) == F.col("hash")).dropDuplicates(["hash"])

    def get(self, handle: str) -> bytes | None:
        """The bytes under a full hash or a prefix of at least eight digits that is unique."""
        if not 0 < len(handle) <= 64 or handle.strip("0123456789abcdef") or len(handle) < LEAST_PREFIX:
            return None
        found = self.table().where(F.col("hash").startswith(handle)).select("hash").distinct().limit(2).collect()
        if len(found) != 1:
            return None
        row = self.verified().where(F.col("hash") == found[0][0]).select("bytes").first()
        return None if row is None else bytes(row[0])

    def contains(self, handle: str) -> bool:
        return not self.table().where(F.col("hash") == handle).isEmpty()

    def stats(self) -> DataFrame:
        """One row: blobs, bytes, and blobs whose bytes don't match."""
        one = self.table().dropDuplicates(["hash"])
        return one.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_bytes"), F.count_if(F.sha2("bytes", 256) != F.col("hash")).alias("corrupt"))

    def ingest(self, pattern: str) -> DataFrame:
        """Holds the files that match a path or glob; (path, hash, len)."""
        files = self.spark.read.format("binaryFile").load(pattern)
        self.put(files, "content")
        return files.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("len"))
