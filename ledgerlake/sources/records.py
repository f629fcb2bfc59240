"""JSON arrays and newline-delimited JSON as rows whose cells keep kinds and the text of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import Number, canonical, elements, parse
from .rel import CELL, Rel

ROW = f"row_id bigint, raw string, canon_row string, keys array<string>, cells map<string,{CELL}>"
_CELL = pa.struct([("kind", pa.string()), ("num", pa.float64()), ("str", pa.string()), ("canon", pa.string())])
_TYPES = {"row_id": pa.int64(), "raw": pa.string(), "canon_row": pa.string(), "keys": pa.list_(pa.string()), "cells": pa.map_(pa.string(), _CELL)}


def cell(value) -> dict:
    """kind is num, bignum (no double holds it), str, bool, null or other."""
    text = canonical(value)
    if isinstance(value, Number):
        return {"kind": "bignum" if value.value is None else "num", "num": value.value, "str": None, "canon": text}
    if isinstance(value, str):
        return {"kind": "str", "num": None, "str": value, "canon": text}
    kind = "bool" if isinstance(value, bool) else "null" if value is None else "other"
    return {"kind": kind, "num": None, "str": None, "canon": text}


def row(row_id: int, raw: str, value) -> dict:
    """A record; values that aren't objects are rows without cells."""
    is_object = isinstance(value, dict)
    return {
        "row_id": row_id, "raw": raw, "canon_row": canonical(value),
        "keys": list(value) if is_object else None, "cells": [(k, cell(v)) for k, v in value.items()] if is_object else None,
    }


def rows_of(text: str) -> list[dict] | None:
    """The rows of a JSON array, or None if the text isn't one."""
    try:
        return [row(i, text[a:b], value) for i, (a, b, value) in enumerate(elements(text))]
    except ValueError:
        return None


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in _TYPES.items()], names=list(_TYPES))


def from_json(spark: SparkSession, payload: str | bytes) -> Rel | None:
    """The rows of one held JSON array, or None if it isn't one. The payload is parsed on an executor."""
    text = payload.decode("utf-8", "strict") if isinstance(payload, bytes) else payload
    try:
        for _ in elements(text):
            pass
    except ValueError:
        return None

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                found = rows_of(x) or []
                for at in range(0, len(found), 5000):
                    yield _batch(found[at : at + 5000])

    return Rel(spark.createDataFrame([(text,)], "payload string").mapInArrow(parsed, ROW))


def from_lines(lines: DataFrame, line: str = "value", position: str = "pos") -> Rel:
    """The rows of newline-delimited JSON: lines that don't parse are left out, and rows numbered by position.

    Lines are parsed where they are, so this is the way in for large payloads. Call accepted() before trusting it.
    """
    held = lines.where(F.trim(line) != "").select(F.col(position).cast("bigint").alias("row_id"), F.col(line).alias("raw"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    out.append(row(i, raw, parse(raw)))
                except ValueError:
                    continue
            yield _batch(out)

    return Rel(held.mapInArrow(parsed, ROW))


def accepted(lines: DataFrame, rel: Rel, line: str = "value") -> bool:
    """Whether at least four fifths of the lines that aren't blank parsed, and any did."""
    whole, good = lines.where(F.trim(line) != "").count(), rel.df.count()
    return good > 0 and good * 5 >= whole * 4


def lines_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., pos, line): lines from 0, split at LF, one CR before it dropped, no line after a final LF."""
    parts = F.split(F.col(text), "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.select(*keep, F.posexplode(whole).alias("pos", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))
