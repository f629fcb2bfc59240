"""Rows with ids, whose cells operators reach without knowing where they came from.

A typed table's cells are its columns: NULL means absent, NaN and infinities are present and not numbers. A
JSON payload's cells are a map from field to (kind, num, str, canon): JSON null is present, and a number that
no double holds is present and not a number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

CELL = "struct<kind:string,num:double,str:string,canon:string>"


@dataclass(frozen=True)
class Cell:
    """Columns that describe one field; num and str are null unless is_num and is_str."""

    present: Column
    is_num: Column
    num: Column
    is_str: Column
    str: Column
    canon: Column
    exact: Column


@dataclass(frozen=True)
class Rel:
    """df has row_id; fields are known for typed tables, and None for JSON rows, which have cells, keys and raw."""

    df: DataFrame
    fields: tuple[str, ...] | None = None

    @property
    def typed(self) -> bool:
        return self.fields is not None

    def cell(self, name: str) -> Cell:
        absent = F.lit(None)
        if not self.typed:
            c = F.col("cells")[name]
            is_num, is_str = c["kind"] == "num", c["kind"] == "str"
            yes = lambda x: F.coalesce(x, F.lit(False))
            return Cell(c.isNotNull(), yes(is_num), F.when(is_num, c["num"]), yes(is_str), F.when(is_str, c["str"]), c["canon"], F.when(is_num, c["num"]))
        if name not in self.fields:
            no = F.lit(False)
            return Cell(no, no, absent.cast("double"), no, absent.cast("string"), absent.cast("string"), absent.cast("double"))
        c, kind = F.col(f"`{name}`"), self.df.schema[name].dataType
        present = c.isNotNull()
        if isinstance(kind, NumericType):
            x = c.cast("double")
            finite = present & ~F.isnan(x) & (F.abs(x) != math.inf)
            return Cell(present, finite, F.when(finite, x), F.lit(False), absent.cast("string"), c.cast("string"), F.when(finite, c))
        if isinstance(kind, StringType):
            return Cell(present, F.lit(False), absent.cast("double"), present, c, c, absent.cast("double"))
        text = c.cast("string") if not isinstance(kind, BooleanType) else F.when(c, "true").otherwise("false")
        return Cell(present, F.lit(False), absent.cast("double"), F.lit(False), absent.cast("string"), F.when(present, text), absent.cast("double"))

    def where(self, condition: Column) -> Rel:
        return Rel(self.df.where(condition), self.fields)

    def numeric_fields(self) -> list[str]:
        return [f for f in self.fields or () if isinstance(self.df.schema[f].dataType, NumericType)]

    def string_fields(self) -> list[str]:
        return [f for f in self.fields or () if isinstance(self.df.schema[f].dataType, StringType)]


def from_table(df: DataFrame, key: str | None = None) -> Rel:
    """A typed table. key: a unique integer column that serves as row id; else rows are numbered over all columns.

    Numbering needs one global order, so a table without a key is for tests and small payloads.
    """
    fields = tuple(df.columns)
    if key is not None:
        return Rel(df.withColumn("row_id", F.col(key).cast("bigint")), fields)
    return Rel(df.withColumn("row_id", (F.row_number().over(Window.orderBy(*df.columns)) - 1).cast("bigint")), fields)


def union(rels: Sequence[Rel]) -> Rel:
    """All rows of all payloads, one after another; an absent column is absent cells. Row ids keep to their payloads."""
    first, *others = rels
    df = first.df
    for other in others:
        if other.typed != first.typed:
            raise ValueError("typed and JSON rows don't union")
        df = df.unionByName(other.df, allowMissingColumns=True)
    fields = tuple(dict.fromkeys(f for r in rels for f in r.fields or ())) if first.typed else None
    return Rel(df, fields)
