"""Count, sum, mean, min and max with guards: a field that holds anything but numbers refuses the answer.

Absent cells are skipped. A present cell that isn't a number, or no number at all, refuses; a count never does.
Answers are one-row frames (status, value, n_matched), made in one pass; what backs them is a frame of row ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import plain
from ..sources.rel import Rel
from .predicates import Predicate, Refused, keep

KINDS = ("count", "sum", "mean", "min", "max")


@dataclass(frozen=True)
class Agg:
    kind: str
    field: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise Refused(f"unknown aggregate {self.kind!r}")
        if self.kind != "count" and not self.field:
            raise Refused(f"{self.kind} needs a field")

    def __str__(self):
        return "count" if self.kind == "count" else f"{self.kind}({self.field})"


@dataclass(frozen=True)
class Answer:
    """value is None if the question was refused; rows are the ids that back it."""

    value: float | None
    n_matched: int
    display: str | None
    rows: DataFrame

    @property
    def matched(self) -> list[int]:
        return [r[0] for r in self.rows.orderBy("row_id").collect()]


def parts(rel: Rel, agg: Agg, scale: int | None = None) -> tuple[Column, Column]:
    """(value, refused) as aggregates. scale: sum exactly, as decimals of so many places; else as doubles."""
    if agg.kind == "count":
        return F.count(F.lit(1)).cast("double"), F.lit(False)
    c = rel.cell(agg.field)
    refused = (F.count_if(c.present & ~c.is_num) > 0) | (F.count(c.num) == 0)
    x = c.num if scale is None else F.round(c.exact.cast(f"decimal(38,{scale})"), scale)
    value = {"sum": F.sum(x), "mean": F.sum(x).cast("double") / F.count(x), "min": F.min(c.num), "max": F.max(c.num)}[agg.kind]
    return value.cast("double"), refused


def aggregate(rel: Rel, agg: Agg, scale: int | None = None) -> DataFrame:
    """(status, value, n_matched) over all rows of rel."""
    value, refused = parts(rel, agg, scale)
    out = rel.df.agg(refused.alias("r"), value.alias("v"), F.count(F.lit(1)).alias("n_matched"))
    return out.select(F.when(F.col("r"), "refused").otherwise("ok").alias("status"), F.when(~F.col("r"), F.col("v")).alias("value"), "n_matched")


def aggregate_where(rel: Rel, predicates: Sequence[Predicate], agg: Agg, scale: int | None = None) -> DataFrame:
    return aggregate(keep(rel, predicates), agg, scale)


def provenance(rel: Rel, predicates: Sequence[Predicate]) -> DataFrame:
    """The ids of the rows that back an answer."""
    return keep(rel, predicates).df.select("row_id")


def shown(predicates: Sequence[Predicate], agg: Agg, n: int, value: float) -> str:
    where = " where " + " AND ".join(map(str, predicates)) if predicates else ""
    return f"[index] {agg}{where} over {n} matched records = {plain(value)}"


def ask(rel: Rel, predicates: Sequence[Predicate], agg: Agg, scale: int | None = None) -> Answer:
    """The answer as a number, with its text and its rows."""
    row = aggregate_where(rel, predicates, agg, scale).first()
    value = row["value"] if row["status"] == "ok" else None
    return Answer(value, row["n_matched"], None if value is None else shown(predicates, agg, row["n_matched"], value), provenance(rel, predicates))


def close(found: Column, claimed: Column) -> Column:
    """Equality up to 1e-9 and a share of 1e-9."""
    return F.abs(found - claimed) <= 1e-9 + 1e-9 * F.abs(found)


def check_claim(rel: Rel, predicates: Sequence[Predicate], agg: Agg, claimed: float, scale: int | None = None) -> DataFrame:
    """(verdict, value, claimed): AGREE, DISAGREE, or REFUSED if there is no exact answer."""
    verdict = F.when(F.col("status") != "ok", "REFUSED").when(close(F.col("value"), F.lit(float(claimed))), "AGREE").otherwise("DISAGREE")
    return aggregate_where(rel, predicates, agg, scale).select(verdict.alias("verdict"), "value", F.lit(float(claimed)).alias("claimed"))


def group_aggregate(rel: Rel, keys: Sequence[Column | str], agg: Agg, scale: int | None = None) -> DataFrame:
    """(keys..., value, refused, n_rows) by group."""
    value, refused = parts(rel, agg, scale)
    return rel.df.groupBy(*keys).agg(value.alias("value"), refused.alias("refused"), F.count(F.lit(1)).alias("n_rows"))


def finish(groups: DataFrame, *order: str) -> DataFrame:
    """(status, order..., value, n_rows), ordered; if any group refuses, one row that says so."""
    judged = groups.crossJoin(F.broadcast(groups.agg(F.coalesce(F.bool_or("refused"), F.lit(False)).alias("any_refused"))))
    good = judged.where("not any_refused").select(F.lit("ok").alias("status"), *order, "value", "n_rows")
    blank = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in order]
    bad = groups.agg(F.coalesce(F.bool_or("refused"), F.lit(False)).alias("x")).where("x").select(F.lit("refused").alias("status"), *blank, F.lit(None).cast("double").alias("value"), F.lit(None).cast("bigint").alias("n_rows"))
    return good.unionByName(bad).orderBy(*order)
