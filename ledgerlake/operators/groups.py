"""Bands, blocks of lines, extremes with ties, percentiles, ranges and counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import lines_of
from ..sources.rel import Rel
from .aggregate import Agg, finish, group_aggregate
from .predicates import OPS, Refused

#: From here on every double is whole, and floor() to a BIGINT would clamp.
WHOLE = 2.0**53


def band(x: Column, width: float) -> Column:
    """The lower bound of x's band; the band of -0.0 is that of 0."""
    q = x / F.lit(float(width))
    low = F.when(F.abs(q) < WHOLE, F.floor(q).cast("double")).otherwise(q)
    return low * F.lit(float(width)) + F.lit(0.0)


def bucket_aggregate(rel: Rel, field: str, width: float, agg: Agg, scale: int | None = None) -> DataFrame:
    """(status, lower, value, n_rows) by band of field, ascending. Absent cells are left out, any other non-number refuses."""
    if not (math.isfinite(width) and width > 0):
        raise Refused("a width is a positive number")
    c = rel.cell(field)
    held = Rel(rel.df.where(c.present).withColumn("lower", band(c.num, width)), rel.fields)
    odd = F.count_if(~c.is_num)
    groups = group_aggregate(held, ["lower"], agg, scale)
    bad = held.df.agg((odd > 0).alias("x")).where("x").select(F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("refused"), F.lit(None).cast("bigint").alias("n_rows"))
    return finish(groups.unionByName(bad), "lower")


def matches_per_block(texts: DataFrame, pattern: str, lines: int, text: str = "text", key: str | None = None) -> DataFrame:
    """([key,] block, key_text, n): lines that have the pattern, in any case, by block of so many lines; blocks without any are left out."""
    if lines < 1 or not pattern:
        raise Refused("a block has at least one line, and a pattern at least one character")
    by = [key] if key else []
    block = F.floor(F.col("pos") / lines).cast("bigint")
    hit = lines_of(texts, text, *by).where(F.contains(F.lower("line"), F.lit(pattern.lower())))
    out = hit.groupBy(*by, block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    shown = F.concat(F.lit("lines "), (F.col("block") * lines + 1).cast("string"), F.lit("-"), ((F.col("block") + 1) * lines).cast("string"))
    return out.select(*by, "block", shown.alias("key_text"), "n").orderBy(*by, "block")


def clean(rel: Rel, field: str) -> Column:
    """Whether the field has numbers, and nothing but numbers, over all rows."""
    c = rel.cell(field)
    return (F.count_if(c.present & ~c.is_num) == 0) & (F.count(c.num) > 0)


def group_extreme(rel: Rel, categories: Sequence[str], field: str, highest: bool = True, mean: bool = False, scale: int | None = None) -> DataFrame:
    """(status, key, value, n_ties): the groups with the extreme sum or mean; ties within rounding are all reported.

    Rows that lack any category are left out; keys of several are joined with " × ".
    """
    held = rel.df.where(F.lit(True))
    for c in categories:
        held = held.where(rel.cell(c).is_str)
    key = F.concat_ws(" × ", *[rel.cell(c).str for c in categories])
    named = Rel(held.withColumn("key", key), rel.fields)
    groups = group_aggregate(named, ["key"], Agg("mean" if mean else "sum", field), scale).where("value is not null")
    whole = rel.df.agg(clean(rel, field).alias("clean"))
    best = groups.agg((F.max if highest else F.min)("value").alias("best"))
    tied = groups.crossJoin(F.broadcast(best)).where(F.abs(F.col("value") - F.col("best")) <= 2.220446049250313e-16 * F.greatest(F.abs("best"), F.lit(1.0)))
    counted = tied.crossJoin(F.broadcast(tied.agg(F.count(F.lit(1)).alias("n_ties"))))
    good = counted.crossJoin(F.broadcast(whole)).where("clean").select(F.lit("ok").alias("status"), "key", "value", "n_ties")
    bad = whole.where("not clean").select(F.lit("refused").alias("status"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("bigint").alias("n_ties"))
    return good.unionByName(bad).orderBy("key")


def superlative(rel: Rel, field: str, highest: bool = True) -> DataFrame:
    """The rows with the greatest or least number, all of them; none if the field isn't clean."""
    c = rel.cell(field)
    best = rel.df.agg((F.max if highest else F.min)(c.num).alias("_best"), clean(rel, field).alias("_clean")).where("_clean").select("_best")
    return rel.df.join(F.broadcast(best), c.num == F.col("_best")).drop("_best")


def percentile(rel: Rel, field: str, p: int) -> DataFrame:
    """(status, value, n) by nearest rank: the number at place ceil(p / 100 * n) of those in order.

    An approximate quantile on each side narrows the numbers to a few ten-thousandths of all, counts say which
    place among them is wanted, and only those are ranked.
    """
    if not 1 <= p <= 99:
        raise Refused("a percentile is from 1 to 99")
    c = rel.cell(field)
    held = rel.df.select(c.num.alias("x"), (c.present & ~c.is_num).alias("odd"))
    sides = [max(0.0, p / 100 - 2e-4), min(1.0, p / 100 + 2e-4)]
    first = held.agg(F.count_if(F.col("odd")).alias("odd"), F.count("x").alias("n"), F.percentile_approx("x", sides, 10_000).alias("sides")).first()
    if first["odd"] or not first["n"]:
        return rel.df.sparkSession.range(1).select(F.lit("refused").alias("status"), F.lit(None).cast("double").alias("value"), F.lit(first["n"]).cast("bigint").alias("n"))
    (low, high), n = first["sides"], first["n"]
    rank = -(-p * n // 100)
    below, upto = held.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x") <= high)).first()
    if not below < rank <= upto:
        low, high, below, upto = -math.inf, math.inf, 0, n
    place = (rank - below - 0.5) / (upto - below)
    value = F.expr(f"percentile_disc({place!r}D) within group (order by x)")
    return held.where(F.col("x").between(low, high)).agg(value.alias("value")).select(F.lit("ok").alias("status"), "value", F.lit(n).cast("bigint").alias("n"))


def value_range(rel: Rel, field: str) -> DataFrame:
    """(status, value, low, high)."""
    c = rel.cell(field)
    x = rel.df.agg(clean(rel, field).alias("c"), F.min(c.num).alias("a"), F.max(c.num).alias("b"))
    only = lambda v: F.when(F.col("c"), v)
    return x.select(F.when(F.col("c"), "ok").otherwise("refused").alias("status"), only(F.col("b") - F.col("a")).alias("value"), only(F.col("a")).alias("low"), only(F.col("b")).alias("high"))


def count_threshold(rel: Rel, field: str, op: str, threshold: float) -> DataFrame:
    """(status, n) of numbers that compare so; a field that isn't clean refuses."""
    c = rel.cell(field)
    x = rel.df.agg(clean(rel, field).alias("c"), F.count_if(OPS[op](c.num, F.lit(float(threshold)))).alias("n"))
    return x.select(F.when(F.col("c"), "ok").otherwise("refused").alias("status"), F.when(F.col("c"), F.col("n")).alias("n"))


def count_distinct(rel: Rel, field: str) -> DataFrame:
    """n: different strings of the field."""
    return rel.df.agg(F.count_distinct(rel.cell(field).str).alias("n"))


def count_value(rel: Rel, field: str, value: str) -> DataFrame:
    """n: rows whose field is the string."""
    return rel.df.agg(F.count_if(rel.cell(field).str == value).alias("n"))


def count_records(rel: Rel) -> DataFrame:
    return rel.df.agg(F.count(F.lit(1)).alias("n"))
