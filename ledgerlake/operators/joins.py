"""Semi-joins to aggregate over, and joins that take a group from a dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.rel import Rel
from .aggregate import Agg, aggregate, finish
from .predicates import Predicate, keep


def semi_join(left: Rel, right: Rel, left_key: str, right_key: str, right_where: Sequence[Predicate] = ()) -> Rel:
    """Rows of left whose key some row of right has that meets right_where.

    Keys are equal if their canonical texts are: 1 is neither "1" nor 1.0 in JSON rows, null joins null, and an
    absent key joins nothing.
    """
    keys = keep(right, right_where)
    found = keys.df.select(keys.cell(right_key).canon.alias("_key")).where("_key is not null")
    df = left.df.withColumn("_key", left.cell(left_key).canon).join(found, "_key", "left_semi").drop("_key")
    return Rel(df, left.fields)


def join_aggregate(left: Rel, right: Rel, left_key: str, right_key: str, right_where: Sequence[Predicate], agg: Agg, scale: int | None = None) -> DataFrame:
    """(status, value, n_matched) over the rows of semi_join, which is also the provenance."""
    return aggregate(semi_join(left, right, left_key, right_key, right_where), agg, scale)


def join_group_aggregate(left: Rel, right: Rel, left_key: str, right_key: str, group_field: str, agg: Agg, scale: int | None = None) -> DataFrame:
    """(status, key, value, n_rows) by the group that right gives each key of left.

    A key with two groups makes the join ambiguous, which refuses the whole answer, whether or not left has it;
    so does a row of right that isn't an object. Rows of left without a partner don't count. Left is reduced to
    one row for each key before it meets the dimension, so a hot key isn't a hot partition.
    """
    group, key = right.cell(group_field).canon, right.cell(right_key).canon
    dim = right.df.select(key.alias("_key"), group.alias("key")).where("_key is not null and key is not null").groupBy("_key").agg(F.min("key").alias("key"), (F.min("key") != F.max("key")).alias("twice"))
    odd = F.lit(False) if right.typed else F.coalesce(F.bool_or(F.col("cells").isNull()), F.lit(False))
    ambiguous = dim.agg(F.coalesce(F.bool_or("twice"), F.lit(False)).alias("a")).crossJoin(right.df.agg(odd.alias("b"))).select((F.col("a") | F.col("b")).alias("ambiguous"))
    c = left.cell(agg.field) if agg.field else None
    bad, count = (F.count_if(c.present & ~c.is_num), F.count(c.num)) if c else (F.lit(0), F.count(F.lit(1)))
    x = c and (c.num if scale is None else F.round(c.exact.cast(f"decimal(38,{scale})"), scale))
    folded = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(x), "mean": lambda: F.sum(x), "min": lambda: F.min(c.num), "max": lambda: F.max(c.num)}[agg.kind]()
    by_key = left.df.withColumn("_key", left.cell(left_key).canon).where("_key is not null").groupBy("_key").agg(folded.alias("v"), bad.alias("bad"), count.alias("n"), F.count(F.lit(1)).alias("rows"))
    merge = {"count": F.sum("v"), "sum": F.sum("v"), "mean": F.sum("v").cast("double") / F.sum("n"), "min": F.min("v"), "max": F.max("v")}[agg.kind]
    groups = by_key.join(dim.select("_key", "key"), "_key").groupBy("key").agg(
        merge.cast("double").alias("value"), (((F.sum("bad") > 0) | (F.sum("n") == 0)) if agg.field else F.lit(False)).alias("refused"), F.sum("rows").alias("n_rows"),
    )
    told = ambiguous.where("ambiguous").select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("refused"), F.lit(None).cast("bigint").alias("n_rows"))
    return finish(groups.unionByName(told), "key")


