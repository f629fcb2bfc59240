"""Seeded rows shaped like a listing of pods, for tests and demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEEDLE = 99_999


def pods(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """n rows; the one in the middle has NEEDLE restarts, more than any other."""
    draw = lambda name, size: F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), "id"), F.lit(size))
    share = draw("status", 100)
    status = F.when(share < 70, "Running").when(share < 82, "Pending").when(share < 91, "Succeeded").when(share < 97, "Failed").otherwise("Unknown")
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.format_string("pod-%06d", "id").alias("name"), F.element_at(F.array(*map(F.lit, ("default", "web", "jobs", "system"))), (draw("namespace", 4) + 1).cast("int")).alias("namespace"),
        status.alias("status"), F.when(F.col("id") == n // 2, NEEDLE).otherwise(draw("restarts", 12)).alias("restarts"), (draw("cpu", 4000) + 1).alias("cpu_m"), (draw("mem", 8192) + 16).alias("mem_mib"),
        F.format_string("node-%02d", draw("node", 24)).alias("node"), (draw("ready", 10) > 0).alias("ready"),
    )
