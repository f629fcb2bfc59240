"""Profiles of all fields: presence, distinct values, statistics of numbers, counts of few values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import canonical, plain
from ..sources.rel import Rel

#: A field with at most so many distinct values, some of them repeated, is shown by the counts of its values.
FEW = 12


def melted(rel: Rel) -> DataFrame:
    """(field, place, row_id, kind, num, canon) of every present cell; place orders fields as first seen."""
    if not rel.typed:
        entries = F.explode(F.map_entries("cells")).alias("e")
        return rel.df.where("cells is not null").select("row_id", entries, "keys").select(
            F.col("e.key").alias("field"), F.struct("row_id", F.array_position("keys", F.col("e.key")).alias("at")).alias("place"), "row_id",
            F.col("e.value.kind").alias("kind"), F.col("e.value.num").alias("num"), F.col("e.value.canon").alias("canon"),
        )
    rows = []
    for i, f in enumerate(rel.fields):
        c = rel.cell(f)
        kind = F.when(c.is_num, "num").when(c.is_str, "str").otherwise("other")
        rows.append(F.struct(F.lit(f).alias("field"), F.lit(i).alias("at"), c.present.alias("present"), kind.alias("kind"), c.num.alias("num"), c.canon.alias("canon")))
    return rel.df.select("row_id", F.explode(F.array(*rows)).alias("e")).where("e.present").select(
        F.col("e.field").alias("field"), F.struct(F.lit(0).cast("bigint").alias("row_id"), F.col("e.at").cast("bigint").alias("at")).alias("place"), "row_id",
        F.col("e.kind").alias("kind"), F.col("e.num").alias("num"), F.col("e.canon").alias("canon"),
    )


def value_counts(rel: Rel) -> DataFrame:
    """(field, canon, n): non-null values of every field, one pass over the cells."""
    return melted(rel).where("kind <> 'null'").groupBy("field", "canon").agg(F.count(F.lit(1)).alias("n"))


def describe(rel: Rel) -> DataFrame:
    """A row for each field, in first-seen order: present (non-null), n_distinct, is_number, low, high, mean, total.

    A field is a number if all its cells are numbers, nulls included. Cells are first counted by value, with
    map-side combine, and the profile is made from those counts.
    """
    cells = melted(rel)
    # a group for each value of a field; numbers that are written differently are different values
    by_value = cells.groupBy("field", "canon", "kind", "num").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    real = F.col("kind") != "null"
    out = by_value.groupBy("field").agg(
        F.min("place").alias("place"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("present"), F.count_if(real).alias("n_distinct"),
        F.bool_and(F.col("kind") == "num").alias("is_number"), F.min("num").alias("low"), F.max("num").alias("high"),
        (F.sum(F.col("num") * F.col("n")) / F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("mean"), F.sum(F.col("num") * F.col("n")).alias("total"),
    )
    only = [F.when(F.col("is_number"), F.col(c)).alias(c) for c in ("low", "high", "mean", "total")]
    return out.orderBy("place").select("field", "present", "n_distinct", "is_number", *only)


def few_values(rel: Rel, most: int = FEW) -> DataFrame:
    """(field, canon, n) of the fields that are shown by counts, by falling count."""
    counts = value_counts(rel)
    totals = counts.groupBy("field").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("p")).where((F.col("d") <= most) & (F.col("d") < F.col("p")))
    return counts.join(totals.select("field"), "field", "left_semi").orderBy("field", F.desc("n"), "canon")


def described(rel: Rel) -> str | None:
    """The profile as text, or None if no row is an object (an empty payload says so)."""
    n = rel.df.count()
    if n == 0:
        return "[describe] 0 records"
    fields = describe(rel).collect()
    if not fields:
        return None
    counts: dict[str, list] = {}
    for r in few_values(rel).collect():
        counts.setdefault(r["field"], []).append((r["canon"], r["n"]))
    lines = [f"[describe] {n} records, {len(fields)} fields"]
    for f in fields:
        head = f"  {f['field']}: "
        if f["is_number"]:
            lines.append(head + f"number present={f['present']} distinct={f['n_distinct']} min={plain(f['low'])} max={plain(f['high'])} mean={plain(f['mean'])} sum={plain(f['total'])}")
            continue
        line = head + f"present={f['present']} distinct={f['n_distinct']}"
        if f["field"] in counts:
            show = (lambda c: canonical(c)) if rel.typed else (lambda c: c)
            line += " — " + ", ".join(f"{show(c)}:{k}" for c, k in counts[f["field"]])
        lines.append(line)
    return "\n".join(lines)


def fact_card(rel: Rel) -> str | None:
    """One line a field: present of all rows, distinct values (a null is one), and statistics if all are numbers."""
    n = rel.df.count()
    by_value = melted(rel).groupBy("field", "canon", "kind", "num").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    rows = by_value.groupBy("field").agg(
        F.min("place").alias("place"), F.sum("n").alias("present"), F.count(F.lit(1)).alias("d"), F.bool_and(F.col("kind") == "num").alias("num"), F.min("num").alias("low"), F.max("num").alias("high"),
        (F.sum(F.col("num") * F.col("n")) / F.sum("n")).alias("mean"),
    ).orderBy("place").collect()
    if not rows:
        return None
    stats = lambda r: f" min={plain(r['low'])} max={plain(r['high'])} mean={r['mean']:.4f}" if r["num"] else ""
    return "\n".join([f"{n} records"] + [f"  {r['field']}: present={r['present']}/{n} distinct={r['d']}{stats(r)}" for r in rows])
