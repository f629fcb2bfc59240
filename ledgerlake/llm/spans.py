"""Spans of regular expressions in whole texts, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
#: Matches whose ends are summed in one go; bounds the copying of arrays in texts with very many matches.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once; else a value used inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Code points before a match that are looked at for words.
REACH = 48


def _end(*parts: Column) -> Column:
    return F.right(F.concat(*parts), F.lit(REACH))


def _running(rows: Column, at: Column) -> Column:
    """(start, end, hit, before) of each (gap, tail, hit), from the position and the last code points in `at` on."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string,before:string>>)")

    def step(state: Column, row: Column) -> Column:
        start = state["pos"] + row["gap"]
        end = start + F.char_length(row["hit"])
        before = _end(state["tail"], row["tail"])
        found = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), row["hit"].alias("hit"), before.alias("before"))
        return F.struct(end.cast("bigint").alias("pos"), _end(before, row["hit"]).alias("tail"), F.concat(state["out"], F.array(found)).alias("out"))

    return F.aggregate(rows, F.struct(at["pos"].alias("pos"), at["tail"].alias("tail"), empty.alias("out")), step, lambda s: s["out"])


def find(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit,before>> of the leftmost non-overlapping matches, in code points, end exclusive.

    before has the REACH code points before a match. The pattern must not match the empty string. A text is split at
    the matches, so positions are running sums of the lengths of what lies between and of the matches themselves;
    the time grows with the text's length and the number of its matches.
    """
    def located(between: Column) -> Column:
        gap = lambda i: F.get(between, i)
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda hit, i: F.struct(F.char_length(gap(i)).cast("bigint").alias("gap"), _end(gap(i)).alias("tail"), hit.alias("hit")),
        )

    def placed(rows: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda c: F.slice(rows, c * CHUNK + 1, CHUNK))
        first = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("tail"))

        def after(at: Column, chunk: Column) -> Column:
            return F.aggregate(
                chunk, F.struct(at["pos"].alias("pos"), at["tail"].alias("tail")),
                lambda a, r: F.struct((a["pos"] + r["gap"] + F.char_length(r["hit"])).alias("pos"), _end(a["tail"], r["tail"], r["hit"]).alias("tail")),
            )

        starts = F.aggregate(
            chunks,
            F.struct(first.alias("at"), F.expr("cast(array() as array<struct<pos:bigint,tail:string>>)").alias("out")),
            lambda s, c: F.struct(after(s["at"], c).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )
        none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string,before:string>>)")
        many = F.flatten(F.zip_with(chunks, starts, _running))
        return F.when(F.size(rows) == 0, none).when(F.size(rows) <= CHUNK, _running(rows, first)).otherwise(many)

    return let(let(F.split(text, pattern, -1), located), placed)


def spans(text: Column, kind: str, pattern: str, guard: Column, valid: Callable[[Column], Column], score: Callable[[Column], Column]) -> Column:
    """SPAN of the matches that are valid; texts without the guard are not searched. score: of the text before a match."""
    kept = F.filter(find(text, pattern), lambda m: valid(m["hit"]))
    out = F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score(m["before"]).cast("double").alias("score")))
    return F.when(guard, out).otherwise(F.expr(f"cast(array() as {SPAN})"))


def near(before: Column, words: str) -> Column:
    """Whether one of `words` (a pattern) stands before a match."""
    return F.lower(before).rlike(words)


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked_piece(piece: Column, spans_: Column) -> Column:
    """A short text, masked; spans_ (start, end, mark) by start."""
    def step(state: Column, s: Column) -> Column:
        between = F.substring(piece, (state["pos"] + 1).cast("int"), F.greatest(s["start"] - state["pos"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= state["pos"], s["mark"]).otherwise(F.lit(""))
        return F.struct(F.greatest(state["pos"], s["end"]).alias("pos"), F.concat(state["out"], between, mark).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(piece, (s["pos"] + 1).cast("int"), F.char_length(piece)))
    return F.aggregate(spans_, F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out")), step, rest)


def _by_pieces(text: Column, spans_: Column, sizes: tuple[int, ...]) -> Column:
    """text in pieces of so many code points, those in pieces of the next size, each masked with its own spans."""
    if not sizes:
        return _masked_piece(text, spans_)
    size = sizes[0]

    def one(piece: Column, i: Column) -> Column:
        low, high = (i * size).cast("bigint"), ((i + 1) * size).cast("bigint")
        own = F.transform(
            F.filter(spans_, lambda s: (s["start"] < high) & (s["end"] > low)),
            lambda s: F.struct(F.greatest(s["start"] - low, F.lit(0)).alias("start"), F.least(s["end"] - low, F.lit(size)).alias("end"), F.when(s["start"] >= low, s["mark"]).otherwise("").alias("mark")),
        )
        return let(own, lambda o: F.when(F.size(o) == 0, piece).otherwise(_by_pieces(piece, o, sizes[1:])))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)), one), "")


def masked(text: Column, found: Column) -> Column:
    """text with <KIND> in place of each span; where spans overlap, all that they cover is gone, and the first one's mark (of those the longest one's) stands for them."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))))
    marks = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), (-s["to"]).alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("mark")))
    return F.when(F.size(found) == 0, text).otherwise(let(marks, lambda m: _by_pieces(text, m, (1 << 20, 1 << 12))))
