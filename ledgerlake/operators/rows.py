"""Subsets, picks, pages, windows of bytes and lines, searches, JSON paths and runs of dropped rows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_text import parse, pretty
from ..sources.records import lines_of
from ..sources.rel import Rel
from .predicates import Predicate, Refused, conjunction, keep

MOST_ROWS, MOST_BYTES, PAGE, WINDOW, LINES, HITS = 200, 1 << 20, 20, 64 << 10, 80, 20


def subset(rel: Rel, predicates: Sequence[Predicate]) -> Rel:
    """The rows that meet all predicates, as they are; a chain of subsets is the conjunction."""
    return keep(rel, predicates)


def payload(rel: Rel, raw: str = "raw", order: str = "row_id") -> DataFrame:
    """One row: the rows' texts as a JSON array, in order. For payloads that are to be held, so of a payload's size."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(raw).alias("raw"))))
    return rel.df.agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda r: r["raw"]), ","), F.lit("]")).alias("payload"))


def pick(rel: Rel, wanted: DataFrame) -> DataFrame:
    """The rows whose ids are in wanted (ord, row_id), in that order, repeats included; an id that isn't there refuses."""
    if not wanted.join(rel.df.select("row_id"), "row_id", "left_anti").isEmpty():
        raise Refused("a row id is out of range")
    return wanted.join(rel.df, "row_id").orderBy("ord")


def pick_ids(rel: Rel, ids: Sequence[int]) -> DataFrame:
    spark = rel.df.sparkSession
    return pick(rel, spark.createDataFrame(list(enumerate(ids)), "ord bigint, row_id bigint"))


def page(rel: Rel, start: int = 0, limit: int = PAGE, most: int = MOST_ROWS) -> DataFrame:
    """Rows start up to start + limit, by id; ids are dense from 0."""
    return rel.df.where(F.col("row_id").between(start, start + min(limit, most) - 1)).orderBy("row_id")


def page_header(n: int, start: int, limit: int) -> str:
    a = min(start, n)
    b = min(a + limit, n)
    return f"rows {a}..{b} of {n} ({a} before, {n - b} after)"


def byte_window(data: Column, start: int = 0, size: int = WINDOW, full: bool = False, most: int = MOST_BYTES) -> Column:
    """A struct (text, start, end, total, data) of bytes from start on; text has replacement marks where code points are split, data is the bytes."""
    if full and start:
        raise Refused("all bytes, or a window of them")
    total = F.octet_length(data).cast("bigint")
    a = F.least(F.lit(start).cast("bigint"), total)
    b = F.least(a + min(size, most), total) if not full else F.least(total, F.lit(most).cast("bigint"))
    piece = F.substring(data, (a + 1).cast("int"), (b - a).cast("int"))
    return F.struct(F.make_valid_utf8(piece.cast("string")).alias("text"), a.alias("start"), b.alias("end"), total.alias("total"), piece.alias("data"))


def line_range(texts: DataFrame, first: int | None = None, last: int | None = None, head: int | None = None, tail: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_no, line, n_lines): lines first to last from 1, or the first or last few; without any, the first LINES."""
    if sum((first is not None or last is not None, head is not None, tail is not None)) > 1:
        raise Refused("a range, a head or a tail")
    held = lines_of(texts, text, key).select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    counted = held.withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy(key)))
    if tail is not None:
        wanted = F.col("line_no") > F.col("n_lines") - tail
    elif first is not None or last is not None:
        wanted = F.col("line_no").between(first or 1, last if last is not None else 2**62)
    else:
        wanted = F.col("line_no") <= (LINES if head is None else head)
    return counted.where(wanted).orderBy(key, "line_no")


def search_lines(texts: DataFrame, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_no, line) of the lines that have the pattern, in any case."""
    if not pattern:
        raise Refused("a pattern has at least one character")
    hit = lines_of(texts, text, key).where(F.contains(F.lower("line"), F.lit(pattern.lower())))
    return hit.select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def search_rows(rel: Rel, pattern: str) -> DataFrame:
    """(row_id, canon_row) of the JSON rows whose canonical text has the pattern, in any case."""
    return rel.df.where(F.contains(F.lower("canon_row"), F.lit(pattern.lower()))).select("row_id", "canon_row").orderBy("row_id")


def clip(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def top(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first rows in an order."""
    return df.orderBy(*order).limit(limit)


def head_tail(df: DataFrame, key: str, keep_rows: int) -> DataFrame:
    """The first ceil(m / 2) and the last floor(m / 2) rows by key; each end is a bounded top-k, not a global numbering."""
    first, last = -(-keep_rows // 2), keep_rows // 2
    return top(df, first, key).unionByName(top(df, last, F.desc(key))).dropDuplicates([key])


def path_steps(path: str) -> list[str | int]:
    """The steps of $.field[0].field."""
    if not path.startswith("$"):
        raise Refused("a path starts with $")
    steps, at = [], 1
    for m in re.finditer(r"\.([^.\[\]]+)|\[([0-9]+)\]", path[1:]):
        if m.start() + 1 != at:
            raise Refused(f"can't read the path at {path[at:]!r}")
        steps.append(m[1] if m[1] is not None else int(m[2]))
        at = m.end() + 1
    if at != len(path):
        raise Refused(f"can't read the path at {path[at:]!r}")
    return steps


def at_path(value, path: str):
    """What a JSON value has at a path."""
    for step in path_steps(path):
        if isinstance(step, str):
            if not isinstance(value, dict):
                raise Refused(f"{step!r} is asked of what isn't an object")
            if step not in value:
                raise Refused(f"there is no field {step!r}")
        else:
            if not isinstance(value, list):
                raise Refused(f"[{step}] is asked of what isn't an array")
            if step >= len(value):
                raise Refused(f"[{step}] is past the end")
        value = value[step]
    return value


def shown_at_path(value, path: str) -> str:
    return pretty(at_path(value, path))


def at_paths(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, shown, refused) of many JSON texts: what each has at a path, or why it has nothing there."""
    path_steps(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown, refused = [], []
            for t in b.column(1).to_pylist():
                found = reason = None
                try:
                    found = shown_at_path(parse(t or ""), path)
                except ValueError as e:  # Refused is one
                    reason = str(e)
                shown.append(found)
                refused.append(reason)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shown, pa.string()), pa.array(refused, pa.string())], names=[key, "shown", "refused"])

    return df.select(key, text).mapInArrow(read, f"`{key}` {df.schema[key].dataType.simpleString()}, shown string, refused string")


def runs(rel: Rel, predicates: Sequence[Predicate], block: int = 100_000) -> DataFrame:
    """(start, end, n): the maximal runs of consecutive rows that don't meet the predicates. Ids are dense from 0.

    Rows are cut into blocks of ids; a block's runs are found alone, and those that touch a block's edge are then
    joined over the few rows that are left.
    """
    drop = rel.df.where(~conjunction(rel, predicates)).select("row_id", F.floor(F.col("row_id") / block).alias("b"))
    w = Window.partitionBy("b").orderBy("row_id")
    local = drop.withColumn("island", F.col("row_id") - F.row_number().over(w)).groupBy("b", "island").agg(F.min("row_id").alias("start"), F.max("row_id").alias("end"))
    edge = (F.col("start") % block == 0) | (F.col("end") % block == block - 1)
    over = Window.orderBy("start")
    joined = (
        local.where(edge).withColumn("new", (F.coalesce(F.lag("end").over(over), F.lit(-2)) + 1 != F.col("start")).cast("int"))
        .withColumn("g", F.sum("new").over(over)).groupBy("g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    return local.where(~edge).select("start", "end").unionByName(joined.select("start", "end")).withColumn("n", F.col("end") - F.col("start") + 1).orderBy("start")


def drop_repeats(df: DataFrame, value: str, order: str, within: str | None = None, block: int = 100_000) -> DataFrame:
    """Rows whose value differs from the one before it in the order. Without `within`, order is dense from 0 and cut into blocks."""
    if within is not None:
        w = Window.partitionBy(within).orderBy(order)
        return df.withColumn("_before", F.lag(F.struct(value)).over(w)).where(F.col("_before").isNull() | ~F.col("_before").getField(value).eqNullSafe(F.col(value))).drop("_before")
    # the last row of a block is also the guest that begins the next one
    guests = F.when(F.col(order) % block == block - 1, F.array(F.struct(F.floor(F.col(order) / block).alias("b"), F.lit(False).alias("g")), F.struct((F.floor(F.col(order) / block) + 1).alias("b"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(F.floor(F.col(order) / block).alias("b"), F.lit(False).alias("g"))))
    dealt = df.withColumn("_at", F.explode(guests))
    w = Window.partitionBy("_at.b").orderBy(order)
    out = dealt.withColumn("_before", F.lag(F.struct(value)).over(w)).where(~F.col("_at.g"))
    return out.where(F.col("_before").isNull() | ~F.col("_before").getField(value).eqNullSafe(F.col(value))).drop("_at", "_before")
