"""Suffix-array dedup: bytes of repeated 100-byte strings are removed, except where each string comes first.

Strings of LENGTH bytes ("windows") are dealt by content: the k-gram of a window with the least hash is its
anchor, and windows side by side that share an anchor are a run. Equal windows have equal anchors, at equal
places; so only windows of one anchor have to be compared, and about one row for 35 bytes crosses the network.

Equal runs (XXH3 of the bytes) are settled first: all but the earliest are repeats as a whole. They are found
within each batch before the shuffle and then while streaming through each partition, sorted by anchor, so a
hot anchor is one row for each batch that has it. What is left are different runs of one anchor; the windows of an
anchor with very many of them are dealt by their hashes to so many parts that each is small, after equal windows of
a batch are settled (their bytes are compared), so a hot window too is one row for each batch. The windows of an
anchor, or of a part,
are the suffixes that start at one distance before the anchor; each such bucket is sorted by mergesort, two
suffixes being compared by prefix polynomial hashes and a binary search for their common extension. Neighbours
that agree in LENGTH bytes are verified byte by byte; should hashes collide, that bucket is sorted anew by its
bytes. All but the earliest of equal windows are repeats.

A null text counts as empty, texts shorter than LENGTH bytes keep all bytes. Each row is a document of its own.
Ids order the documents, null ids first; rows with equal ids, null ones too, are ordered by their texts' SHA-256,
and of rows with equal id and text all but one lose what they have, if that is LENGTH bytes or more. An empty table
gives an empty result. Of further columns none is kept. A very long text is searched in pieces of CHUNK bytes that
overlap; the runs of a document, about one for 35 bytes, are gathered in its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, plus, read, stored, text_of

LENGTH, ANCHOR = 100, 32
#: Bytes hashed, and suffixes sorted, at a time.
CHUNK, SUFFIXES = 1 << 20, 400_000
#: An anchor with more different runs than HEAVY_RUNS is dealt in parts of about so many windows.
HEAVY_RUNS, PART = 300, 10_000
BASE = 0x9E3779B97F4A7C15
NULL_ID = -(2**63)
RUNS = "key bigint, doc bigint, start bigint, n int, content bigint"


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0 to n - 1, and its inverse likewise, modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """s: the bytes from i up to j have the hash (s[j] - s[i]) * BASE^-i."""
    up, _ = powers(max(CHUNK + LENGTH, 1 << (len(data) + 1).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + 1) * up[: len(data)], out=out[1:])
    return out


def hashes_at(s: np.ndarray, at: np.ndarray, size) -> np.ndarray:
    down = powers(max(CHUNK + LENGTH, 1 << len(s).bit_length()))[1]
    return (s[at + size] - s[at]) * down[at]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes, in place, with their bits mixed."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each k-gram, its bits mixed so that any may be the least."""
    s = prefix_hashes(data)
    down = powers(max(CHUNK + LENGTH, 1 << len(s).bit_length()))[1]
    return mixed((s[ANCHOR:] - s[:-ANCHOR]) * down[: len(s) - ANCHOR])


def runs_of(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor hash) of each run in data; docs says which document a byte is of. No window spans two."""
    m = len(data) - LENGTH + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    wide, least = 1, h
    while 2 * wide <= LENGTH - ANCHOR + 1:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    rest = LENGTH - ANCHOR + 1 - wide
    least = np.minimum(least[: len(least) - rest], least[rest:])[:m]
    valid = docs[:m] == docs[LENGTH - 1 :]
    first = valid.copy()
    # a run goes on while the anchor is the same one: the least hash is the same and has not left the window
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (h[: m - 1] == least[:-1])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], m)
    upto = np.cumsum(valid)
    return starts, upto[ends - 1] - upto[starts] + 1, least[starts]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, which document, its id, byte 0's place in it) of parts of a batch of (id, text) in which each window is once."""
    ids = batch.column(0).to_pylist()
    texts = batch.column(1).cast(pa.large_binary()).to_pylist()
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def made():
        which = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        return np.frombuffer(b"".join(x[2] for x in held), np.uint8), which, np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)

    for id_, text in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            piece = text[at : at + CHUNK + LENGTH - 1]
            if len(piece) >= LENGTH:
                held.append((id_, at, piece))
                size += len(piece)
            if size >= CHUNK:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents, joined where they touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    # ends so far, kept apart by document
    rank = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * span)
    new[1:] = (start + rank * span)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end + rank * span, at) - rank[at] * span


def find_runs(docs: DataFrame) -> DataFrame:
    """RUNS of (doc, text). Runs settled here are intervals instead: n is minus the length, the key any."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for data, which, ids, base in chunks(batch):
                starts, n, anchors = runs_of(data, which)
                raw = data.tobytes()
                content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), (starts + n + LENGTH - 1).tolist(), strict=True)), np.uint64, len(starts))
                firsts = np.searchsorted(which, np.arange(len(ids)))
                w = which[starts]
                parts.append((anchors, ids[w], starts - firsts[w] + base[w], n, content))
            if not parts:
                continue
            key, doc, start, n, content = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, doc, n, content, key))
            key, doc, start, n, content = key[order], doc[order], start[order], n[order], content[order]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1]) & (n[1:] == n[:-1])
            group = np.cumsum(~again) - 1
            lead = np.flatnonzero(~again)[group]
            same = again & (doc == doc[lead]) & (start == start[lead])  # a repeated row
            d, a, b = merged(doc[again & ~same], start[again & ~same], start[again & ~same] + n[again & ~same] + LENGTH - 1)
            keep = ~again
            # an interval's key only deals it out
            dealt = (d.view(np.uint64) * np.uint64(BASE)) ^ a.view(np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((key[keep], dealt)).view(np.int64)), pa.array(np.concatenate((doc[keep], d))), pa.array(np.concatenate((start[keep], a))),
                pa.array(np.concatenate((n[keep], a - b)).astype(np.int32)), pa.array(np.concatenate((content[keep], np.zeros(len(d), np.uint64))).view(np.int64)),
            ], names=["key", "doc", "start", "n", "content"])

    return docs.mapInArrow(found, RUNS)


def settle(runs: DataFrame) -> DataFrame:
    """RUNS: equal runs but the earliest as intervals, and the different runs of anchors that have several."""
    dealt = runs.repartition("key").sortWithinPartitions("key", "content", "n", "doc", "start")

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, doc, start, n, content):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(start), pa.array(n.astype(np.int32)), pa.array(content)], names=["key", "doc", "start", "n", "content"])

        # the earliest run of the last content, and whether it was given out as one of several
        last: tuple[int, ...] | None = None
        given = False
        for b in batches:
            if not b.num_rows:
                continue
            key, doc, start, n, content = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
            ready = n < 0
            if ready.any():
                yield out(key[ready], doc[ready], start[ready], n[ready], content[ready])
                key, doc, start, n, content = (x[~ready] for x in (key, doc, start, n, content))
            if not len(key):
                continue
            if last is not None:
                key, doc, start, n, content = (np.concatenate(([x], y)) for x, y in zip(last, (key, doc, start, n, content), strict=True))
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1]) & (n[1:] == n[:-1])
            lead = np.flatnonzero(~again)
            of = lead[np.cumsum(~again) - 1]
            repeat = again & ((doc != doc[of]) | (start != start[of]))
            d, a, e = merged(doc[repeat], start[repeat], start[repeat] + n[repeat] + LENGTH - 1)
            if len(d):
                yield out(np.zeros(len(d), np.int64), d, a, a - e, np.zeros(len(d), np.int64))
            several = np.zeros(len(lead), bool)
            beside = key[lead][1:] == key[lead][:-1]
            several[1:] |= beside
            several[:-1] |= beside
            now_given = bool(several[-1]) or (given and len(lead) == 1)
            if given:
                several[0] = False
            pick = lead[several]
            if len(pick):
                yield out(key[pick], doc[pick], start[pick], n[pick], content[pick])
            k = lead[-1]
            last, given = (key[k], doc[k], start[k], n[k], content[k]), now_given

    return dealt.mapInArrow(settled, RUNS)


class Suffixes:
    """Suffixes of one text, compared by prefix hashes: order and equality within LENGTH bytes."""

    def __init__(self, data: np.ndarray):
        self.data, self.s = data, prefix_hashes(data)

    def equal(self, a: np.ndarray, b: np.ndarray, size) -> np.ndarray:
        return hashes_at(self.s, a, size) == hashes_at(self.s, b, size)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, up to LENGTH, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH, np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(a, b, mid)
            low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        k = self.extension(a, b)
        same = k >= LENGTH
        k = np.minimum(k, LENGTH - 1)
        return np.where(same, or_equal, self.data[a + k] < self.data[b + k])

    def sort(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Order of the suffixes at `at` within each bucket (buckets ascend); stable.

        Bottom-up mergesort of all buckets at once. A suffix's place in a merge is its place in its own run
        and the number of suffixes of the sibling run before it, found by binary search.
        """
        order = np.arange(len(at))
        firsts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        sizes = np.diff(np.append(firsts, len(at)))
        first, size = np.repeat(firsts, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            place = np.flatnonzero(size > width)  # the others are sorted
            within = place - first[place]
            run = within // width
            sibling = (run ^ 1) * width
            base = first[place] + np.minimum(sibling, size[place])
            low, high = np.zeros(len(place), np.int64), np.clip(size[place] - sibling, 0, width)
            own, right = at[order[place]], (run & 1).astype(bool)
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) // 2
                other = at[order[base[todo] + mid]]
                before = self.less(other, own[todo], right[todo])  # equal ones of the left run come first
                low[todo[before]] = mid[before] + 1
                high[todo[~before]] = mid[~before]
            to = first[place] + (run & ~1) * width + within % width + low
            order[to] = order[place].copy()
            width *= 2
        return order


def repeats(text: bytes, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether each suffix agrees in LENGTH bytes with an earlier one of its bucket (buckets ascend)."""
    data = np.frombuffer(text, np.uint8)
    suffixes = Suffixes(data)
    order = suffixes.sort(at, bucket)
    a, b = at[order[:-1]], at[order[1:]]
    same = (bucket[order[1:]] == bucket[order[:-1]]) & suffixes.equal(a, b, LENGTH)
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    found = np.zeros(len(at), bool)
    found[order[1:][same]] = True
    hit = np.flatnonzero(same)
    for k in range(0, len(hit), 20_000):  # verified byte by byte
        part = hit[k : k + 20_000]
        wrong = (windows[a[part]] != windows[b[part]]).any(1)
        for x in np.unique(bucket[order[1:]][part[wrong]]):
            own = np.flatnonzero(bucket == x)
            seen: set[bytes] = set()
            for i in own:
                w = text[at[i] : at[i] + LENGTH]
                found[i] = w in seen
                seen.add(w)
    return found


PIECES = "key bigint, part int, parts int, doc bigint, start bigint, n int, piece binary"


def deal(runs: DataFrame) -> DataFrame:
    """PIECES of (key, parts, doc, start, n, piece): a run goes to each part that one of its windows belongs to.

    parts is null for an anchor that isn't dealt. Windows that an earlier one of the batch equals are intervals
    instead (n is minus the length) and need no part.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            light = b.filter(pa.compute.is_null(b.column(1)))
            if light.num_rows:
                whole = pa.array(np.zeros(light.num_rows, np.int32))
                yield pa.RecordBatch.from_arrays([light.column(0), whole, pa.array(np.ones(light.num_rows, np.int32)), *light.columns[2:]], names=[x.split()[0] for x in PIECES.split(", ")])
            b = b.filter(pa.compute.is_valid(b.column(1)))
            if not b.num_rows:
                continue
            key, parts, doc, start, n = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            pieces = b.column(5).to_pylist()
            data = np.frombuffer(b"".join(pieces), np.uint8)
            offset = np.append(0, np.cumsum([len(x) for x in pieces]))[:-1]
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = offset[row] + k
            hashes = mixed(hashes_at(prefix_hashes(data), at, LENGTH))
            order = np.lexsort((start[row] + k, doc[row], hashes, key[row]))
            new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (key[row[order]][1:] != key[row[order]][:-1]))
            lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            again = np.flatnonzero(~new & ((doc[row[order]] != doc[row[lead]]) | (start[row[order]] + k[order] != start[row[lead]] + k[lead])))
            windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
            equal = np.concatenate([np.zeros(0, bool), *((windows[at[order[x]]] == windows[at[lead[x]]]).all(1) for x in np.split(again, range(20_000, len(again), 20_000)))])
            settled = order[again[equal]]
            d, s, e = merged(doc[row[settled]], start[row[settled]] + k[settled], start[row[settled]] + k[settled] + LENGTH)
            if len(d):
                none = pa.array([b""] * len(d), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(d ^ s), pa.array(np.zeros(len(d), np.int32)), pa.array(np.ones(len(d), np.int32)), pa.array(d), pa.array(s), pa.array((s - e).astype(np.int32)), none], names=[x.split()[0] for x in PIECES.split(", ")])
            left = np.ones(len(row), bool)
            left[settled] = False
            to = np.unique(np.stack([row[left], (hashes[left] % parts[row[left]].astype(np.uint64)).astype(np.int64)], axis=1), axis=0)
            r = pa.array(to[:, 0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(r), pa.array(to[:, 1].astype(np.int32)), *(b.column(c).take(r) for c in range(1, 6))], names=[x.split()[0] for x in PIECES.split(", ")]
            )

    return runs.mapInArrow(dealt, PIECES)


def compare(pieces: DataFrame) -> DataFrame:
    """Intervals (doc, start, n) of windows that an earlier run of the same anchor has; those that pieces brings are passed on."""
    placed = pieces.repartition("key", "part").sortWithinPartitions("key", "part", "doc", "start")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def intervals(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """rows: whole anchors, or parts; their suffixes are taken by the distances from the anchor, as many at a time as fit."""
            part, parts, doc, start, n = (np.array([r[k] for r in rows], np.int64) for k in range(1, 6))
            group = np.cumsum(np.append(0, [x[:2] != y[:2] for x, y in zip(rows[1:], rows, strict=False)]))
            text = b"".join(r[6] for r in rows)
            offset = np.append(0, np.cumsum([len(r[6]) for r in rows]))[:-1]
            data = np.frombuffer(text, np.uint8)
            sums = prefix_hashes(data)
            # the anchor: the first k-gram of the first window with the least hash
            grams = np.lib.stride_tricks.sliding_window_view(gram_hashes(data), LENGTH - ANCHOR + 1)
            ahead = np.concatenate([grams[offset[i : i + 50_000]].argmin(1) for i in range(0, len(rows), 50_000)])
            step = max(1, SUFFIXES // len(rows))
            for low in range(0, LENGTH - ANCHOR + 1, step):
                a = np.maximum(ahead - (low + step - 1), 0)
                z = np.minimum(ahead - low, n - 1)
                count = np.maximum(z - a + 1, 0)
                row = np.repeat(np.arange(len(rows)), count)
                if not len(row):
                    continue
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + a[row]
                own = (parts[row] == 1) | (mixed(hashes_at(sums, offset[row] + k, LENGTH)) % parts[row].astype(np.uint64) == part[row].astype(np.uint64))
                row, k = row[own], k[own]
                bucket = group[row] * LENGTH + ahead[row] - k
                by = np.argsort(bucket, kind="stable")
                row, k, bucket = row[by], k[by], bucket[by]
                hit = repeats(text, offset[row] + k, bucket)
                d, s, e = merged(doc[row[hit]], start[row[hit]] + k[hit], start[row[hit]] + k[hit] + LENGTH)
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(s - e)], names=["doc", "start", "n"])

        for b in batches:
            ready = pa.compute.less(b.column(5), 0)
            if pa.compute.any(ready).as_py():
                settled = b.filter(ready)
                yield pa.RecordBatch.from_arrays([settled.column(3), settled.column(4), settled.column(5).cast(pa.int64())], names=["doc", "start", "n"])
                b = b.filter(pa.compute.invert(ready))
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:5] == held[-1][:5]:  # a repeated row
                    continue
                if held and row[:2] != held[-1][:2] and size >= SUFFIXES:
                    yield from intervals(held)
                    held, size = [], 0
                held.append(row)
                size += row[5]
        if held:
            yield from intervals(held)

    return placed.mapInArrow(found, "doc bigint, start bigint, n bigint")


def spans_of(held: DataFrame) -> DataFrame:
    """(doc, bytes, found) of (doc, bytes), doc ascending and unique: the repeats as an array of [start, end) in bytes, in any order."""
    known = stored(settle(find_runs(held)), "runs")
    open_ = known.where("n > 0")
    heavy = stored(open_.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).where(F.col("c") > HEAVY_RUNS).select("key", F.ceil(F.col("w") / PART).cast("int").alias("parts")), "heavy")
    dealt = open_.join(heavy, "key", "left")
    asked = dealt.groupBy("doc").agg(F.collect_list(F.struct("key", "parts", "start", "n")).alias("asked"))
    # both joins deal out the same columns of the texts, so Spark does it once
    opened = held.join(asked, "doc", "left").select("doc", "bytes", F.explode("asked").alias("r"))
    piece = F.expr(f"substring(bytes, cast(r.start + 1 as int), r.n + {LENGTH - 1})")
    runs = opened.select("r.key", "r.parts", "doc", "r.start", "r.n", piece.alias("piece"))
    fine = compare(runs.select("key", F.lit(0).alias("part"), F.lit(1).alias("parts"), "doc", "start", "n", "piece") if heavy.isEmpty() else deal(runs))
    spans = (
        known.where("n < 0").select("doc", "start", F.col("n").cast("bigint").alias("n")).unionByName(fine)
        .groupBy("doc").agg(F.collect_list(F.struct("start", (F.col("start") - F.col("n")).alias("end"))).alias("found"))
    )
    return held.join(spans, "doc", "left").select("doc", "bytes", "found")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (bytes) and found (array of [start, end) in bytes, in any order) of each row of docs."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_ID)).alias("doc"), text_of(text).cast("binary").alias("bytes"))
    named = lambda doc: F.when(F.col(doc) != NULL_ID, F.col(doc)).cast(docs.schema[key].dataType).alias(key)
    if rows.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        return spans_of(rows.select("doc", "bytes")).select(named("doc"), F.col("bytes").alias(text), "found")
    # ids that don't tell rows apart: different (id, text) get numbers in order, and one row of each is searched
    hashed = rows.select("doc", "bytes", F.sha2("bytes", 256).alias("sha"))
    classes = hashed.groupBy("doc", "sha").agg(F.count(F.lit(1)).alias("copies")).orderBy("doc", "sha")
    classes = cut(cut(classes).withColumn("number", F.monotonically_increasing_id()))
    texts = hashed.join(classes, ["doc", "sha"]).select(F.col("number").alias("doc"), "bytes", "copies")
    once = texts.where("copies = 1").select("doc", "bytes").unionByName(texts.where("copies > 1").groupBy("doc").agg(F.min("bytes").alias("bytes")))
    found = spans_of(once).join(classes.select(F.col("number").alias("doc"), F.col("doc").alias("own"), "copies"), "doc")
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    all_ = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.octet_length("bytes").cast("bigint").alias("end")))
    spans = F.when((F.col("copy") > 1) & (F.octet_length("bytes") >= LENGTH), all_).otherwise(F.col("found")).alias("found")
    return found.select("own", "bytes", "found", copy).select(named("own"), F.col("bytes").alias(text), spans)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (the bytes that remain) of each row of docs."""
    found = repeated_spans(docs, key, text)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for value, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                pairs = np.array([(x["start"], min(x["end"], len(value))) for x in spans or [] if x["start"] < len(value)], np.int64).reshape(-1, 2)
                _, start, end = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                kept = b"".join(value[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(value)], strict=True))
                for column, x in zip(rows, (len(value), len(value) - len(kept), len(start), kept), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    return found.mapInArrow(removed, plus(found.select(key).schema, n_bytes="bigint", n_removed="bigint", n_spans="bigint", kept="binary"))


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, ENCODE(COALESCE(text, '')) AS b FROM documents),
h AS (SELECT doc_id, UNNEST(RANGE(0, OCTET_LENGTH(b) - 99)) AS p, UNNEST(LIST_TRANSFORM(RANGE(0, OCTET_LENGTH(b) - 99), lambda i: MD5(b[i + 1:i + 100]))) AS w FROM d WHERE OCTET_LENGTH(b) >= 100),
r AS (SELECT doc_id, p, ROW_NUMBER() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM h),
s AS (SELECT doc_id, p, CASE WHEN p <= LAG(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM r WHERE k > 1),
g AS (SELECT doc_id, p, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM s),
spans AS (SELECT doc_id, MIN(p) AS a, MAX(p) + 100 AS z FROM g GROUP BY doc_id, g),
sums AS (SELECT doc_id, SUM(z - a) AS n, COUNT(*) AS c, LIST(a ORDER BY a) AS starts, LIST(z ORDER BY a) AS ends FROM spans GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, b, n, c,
         CASE WHEN n IS NULL THEN HEX(b) ELSE ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(0, c + 1), lambda i:
           HEX(b[CASE WHEN i = 0 THEN 1 ELSE ends[i] + 1 END:CASE WHEN i = c THEN OCTET_LENGTH(b) ELSE starts[i + 1] END])), '') END AS k
  FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id)
SELECT doc_id, OCTET_LENGTH(b)::BIGINT AS n_bytes, COALESCE(n, 0)::BIGINT AS n_removed, COALESCE(c, 0)::BIGINT AS n_spans, SHA256(UNHEX(k)) AS kept_sha256 FROM kept
"""
