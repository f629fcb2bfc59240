"""Document fingerprints: threshold-scaled sketches of word shingles.

Of the hashes of a text's five-word shingles, all that lie below a fixed fraction of the range are kept, so a
sketch grows with its text, sketches of a union are unions of sketches, and the share of a small text that a
large one contains can be read off theirs. A text that would keep fewer than LEAST hashes keeps them all; so a
sketch carries its limit, and two are compared, and merged, below the lower one. If the smaller one has no hash
there, its sketch can't tell, and containment is null. likeness, which has the shingles themselves, then compares
both texts with all their hashes, so a text that another one contains always has the likeness 1. Texts of one to
four words have one shingle, texts without words have an empty sketch.

DataFrame functions only. A null text counts as empty. Rows that repeat an id are each fingerprinted; the
document after one of them is its equal with the next larger text hash, then the next id; null ids come last. An
empty table gives an empty result. Likeness of two empty sketches is 1, of one empty and one other 0. fingerprint
replaces a column named like its result and keeps all others; with_next keeps only the id and the text, whose names
may not be next_text. A very long text is one row like any other, its shingles one array.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, text_of
from .spans import let

WORDS, FRACTION, LEAST = 5, 1 / 8, 8
LIMIT, ALL = -(2**63) + int(2**64 * FRACTION), 2**63 - 1
#: Rows of a range of ids between which the documents are dealt, and the most ranges (beyond, they hold more rows).
BLOCK_ROWS, MOST_BLOCKS = 250, 65_536


def shingle_hashes(text: Column) -> Column:
    """array<bigint>: a hash for each place of a text, repeats included."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        each = F.transform(F.slice(h, F.lit(1), F.size(h) - (WORDS - 1)), lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, WORDS)]))
        return F.when(F.size(h) == 0, F.expr("cast(array() as array<bigint>)")).when(F.size(h) < WORDS, F.array(F.xxhash64(h))).otherwise(each)

    return let(hashed, shingles)


def _below(hashes: Column, limit: Column | int) -> Column:
    """Those below the limit, or all of them, if it is ALL."""
    return F.filter(hashes, lambda x: (x < limit) | (F.lit(limit) == ALL))


def _kept(hashes: Column) -> Column:
    return F.array_sort(F.array_distinct(hashes))


def sketch_of(hashes: Column) -> Column:
    """struct<limit, hashes>: the kept hashes, ascending, and the limit below which they are (ALL: all are kept)."""
    made = lambda limit, h: F.struct(F.lit(limit).cast("bigint").alias("limit"), h.alias("hashes"))
    return let(_kept(F.filter(hashes, lambda x: x < LIMIT)), lambda low: F.when(F.size(low) < LEAST, made(ALL, _kept(hashes))).otherwise(made(LIMIT, low)))


def sketch(text: Column) -> Column:
    """The sketch of a text."""
    return let(shingle_hashes(text), sketch_of)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together, below the lower of their limits."""
    limit = F.least(a["limit"], b["limit"])
    return F.struct(limit.alias("limit"), _kept(_below(F.concat(a["hashes"], b["hashes"]), limit)).alias("hashes"))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the other one has, below the lower limit; null if the smaller text, though not empty, has no hash there."""
    limit = F.least(a["limit"], b["limit"])

    def share(x: Column, y: Column) -> Column:
        least = F.least(F.size(x), F.size(y))
        empty = lambda s: (s["limit"] == ALL) & (F.size(s["hashes"]) == 0)
        return F.when(empty(a) & empty(b), 1.0).when(empty(a) | empty(b), 0.0).when(least > 0, F.size(F.array_intersect(x, y)) / least).cast("double")

    return let(F.struct(_below(a["hashes"], limit).alias("x"), _below(b["hashes"], limit).alias("y")), lambda both: share(both["x"], both["y"]))


def likeness(a: Column, b: Column, a_sketch: Column, b_sketch: Column) -> Column:
    """containment of the sketches of two texts; of all their hashes, a and b, if one of them has fewer than LEAST below the limit."""
    whole = lambda h: F.struct(F.lit(ALL).cast("bigint").alias("limit"), F.array_distinct(h).alias("hashes"))
    return F.when((a_sketch["limit"] == LIMIT) & (b_sketch["limit"] == LIMIT), containment(a_sketch, b_sketch)).otherwise(containment(whole(a), whole(b)))


def written(found: Column) -> Column:
    """A sketch as text: "all:" if it has all hashes, then these in hexadecimal."""
    return F.concat(F.when(found["limit"] == ALL, "all:").otherwise(""), F.array_join(F.transform(found["hashes"], lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ""))


def _list(values: list[int | None]) -> Column:
    """An array that is one literal, however long it is."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _place(cuts: list[int], key: Column) -> Column:
    """How many of the ascending cuts are less than key: among every so-manieth first, then among those from there."""
    count = lambda array: F.size(F.filter(array, lambda c: c < key))
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    near = lambda n: F.slice(_list(cuts), (n - 1) * step + 1, step)
    return let(count(_list(cuts[::step])), lambda n: F.when(n == 0, 0).otherwise((n - 1) * step + count(near(n))))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, next_text) by falling key; the next of the last is the first.

    Ranges of keys are cut at quantiles, which the driver holds (at most MOST_BLOCKS), and each range
    is one window. The greatest row of a range also goes, as a guest, to the range above it, where it follows
    the least row there; so texts cross the network once.
    """
    n, low = docs.agg(F.count(F.lit(1)), F.min(F.col(key).cast("bigint"))).first()
    # null ids stand below all others, by their texts' hashes as far as there is room for that
    room = -(2**62) if low is None or low >= -(2**62) else None
    none = F.lit(-(2**63)) if room is None else F.lit(room - 1) - F.shiftrightunsigned(F.xxhash64(text_of(text)), 2)
    held = docs.select(F.coalesce(F.col(key).cast("bigint"), none).alias("_k"), F.col(key), text_of(text).alias(text))
    ids = held.select("_k")
    if n == 0:
        return held.select(key, text, F.col(text).alias("next_text"))
    blocks = min(MOST_BLOCKS, -(-n // BLOCK_ROWS))
    cuts = sorted({int(x) for x in ids.agg(F.percentile_approx("_k", [i / blocks for i in range(1, blocks)] or [1.0], 10 * blocks + 100)).first()[0]}) if blocks > 1 else []
    # a range: keys above the cut before it, up to its own
    block = _place(cuts, F.col("_k"))
    tops = {r["b"]: r["top"] for r in ids.groupBy(block.alias("b")).agg(F.max("_k").alias("top")).collect()}
    order = sorted(tops)
    above = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    every = range(max(order) + 1)
    own = let(block, lambda b: F.struct(b.cast("bigint").alias("b"), F.get(_list([tops.get(k) for k in every]), b).alias("top"), F.get(_list([above.get(k) for k in every]), b).alias("above")))
    # a range's greatest key is the guest of the range above; the greatest of all is that of the lowest range
    host = F.array(F.struct(F.col("_own.b").alias("b"), F.lit(0).alias("guest")))
    guest = F.array(F.struct(F.col("_own.above").alias("b"), F.lit(1).alias("guest")))
    placed = held.withColumn("_own", own).withColumn("_at", F.explode(F.when(F.col("_own.top") == F.col("_k"), F.concat(host, guest)).otherwise(host)))
    w = Window.partitionBy("_at.b").orderBy("_at.guest", F.desc("_k"), F.xxhash64(text))
    return placed.withColumn("next_text", F.lead(text).over(w)).where(F.col("_at.guest") == 0).select(key, text, "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """text with its last half replaced by as many code points from the start of next_text, or all of it."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprint(docs: DataFrame, text: str = "text", into: str = "sketch") -> DataFrame:
    """docs with their sketches."""
    held = docs.select(*[c for c in docs.columns if c != into])
    return held.withColumn(into, sketch(text_of(text)))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    pairs = with_next(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("edited", edited(F.col("text"), F.col("next_text")))
    hashed = pairs.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shingle_hashes(F.col("text")).alias("a"), shingle_hashes(F.col("edited")).alias("b"), shingle_hashes(F.col("next_text")).alias("c"),
    )
    kept = hashed.select("*", *[sketch_of(F.col(x)).alias(f"{x}_kept") for x in "abc"])
    near = lambda x: likeness(F.col("a"), F.col(x), F.col("a_kept"), F.col(f"{x}_kept"))
    return kept.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("a_kept")).alias("fingerprint"), written(F.col("b_kept")).alias("edited_fingerprint"),
        near("b").alias("near_edited"), near("c").alias("near_next"),
    )
