"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are four segments of 16. If two fingerprints differ in at most three bits, either two
segments are equal, and a pair of exact segments is a common key; or just one is, and each of the others
differs in one bit: then a segment and the code word nearest to the following one are a key of the first, and
one of the second, which takes as keys all code words within one bit more than the covering radius of the
(23,12) Golay code (segments are padded with zeros). Fingerprints that meet under a key are compared; links
found are joined to components.

Equal fingerprints are one node, so copies are never paired. A key that very many fingerprints share is dealt
in blocks (groups.linked). Within a block, each fingerprint that is reached is compared once with those that are
not yet, and only a spanning forest of the links is kept; which of a cycle's links it has changes no component.

A null text counts as empty; texts without words have the fingerprint 0, those with fewer words than a shingle
are one shingle. A very long text is hashed whole, its shingles one after another. Rows that repeat an id are nodes
by their fingerprints. A null id is never a component's name unless all its ids are null. Columns of the input named
fp (in fingerprints) or component_id (in near_duplicates) are replaced, others are kept. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, plus, read, salted_join
from .groups import Forest, components, linked

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of a key that are compared in one block, and columns of a batch of keys.
BLOCK, BATCH = 4096, 50_000


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes ("<u8"), unsigned: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `shingle` words, or of all words if there are fewer."""
    n = len(words) - shingle + 1
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if n > 0 else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), "<u8", max(1, n))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; of bytes, so A-Z and ASCII white space only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text, unsigned."""
    words = words_of(text)
    return bits_of(shingle_hashes(words, shingle, seed)) if words else 0


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED, into: str = "fp") -> DataFrame:
    """docs with the fingerprint, as a signed bigint, in place of the text."""
    keys = [c for c in docs.columns if c not in (text, into)]
    held = docs.select(*keys, text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([simhash(t, shingle, seed) for t in b.column(len(keys)).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(found)], names=[*keys, into])

    return held.mapInArrow(made, plus(docs.select(*keys).schema, **{into: "bigint"}))


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 16-bit word: the nearest code word, and (as starts and a flat array) all within distance 4.

    The code is cyclic, with generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1. It is perfect: every word has
    one code word within distance 3.
    """
    words = np.arange(4096, dtype=np.uint32)
    code = np.zeros(4096, np.uint32)
    for bit in range(12):
        code ^= np.where(words >> bit & 1, np.uint32(0xC75 << bit), np.uint32(0))
    tail = np.bitwise_count(code >> 16).astype(np.uint8)
    nearest, starts, flat = np.zeros(1 << 16, np.int64), np.zeros((1 << 16) + 1, np.int64), []
    for at in range(0, 1 << 16, 1024):
        v = np.arange(at, at + 1024, dtype=np.uint32)
        d = np.bitwise_count((code & 0xFFFF)[None, :] ^ v[:, None]).astype(np.uint8) + tail
        nearest[at : at + 1024] = d.argmin(1)
        row, col = np.nonzero(d <= 4)
        starts[at + 1 : at + 1025] = np.bincount(row, minlength=1024)
        flat.append(col)
    return nearest, np.cumsum(starts), np.concatenate(flat)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, key) of all keys of unsigned fingerprints."""
    _, starts, flat = golay()
    s = [(fps >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    rows, keys = [], []
    for kind, (i, j) in enumerate((i, j) for i in range(4) for j in range(i)):
        rows.append(np.arange(len(fps)))
        keys.append(kind << 40 | s[i] << 16 | s[j])
    for i in range(4):
        near = s[(i + 1) % 4]
        counts = starts[near + 1] - starts[near]
        row = np.repeat(np.arange(len(fps)), counts)
        within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        rows.append(row)
        keys.append((6 + i) << 40 | s[i][row] << 16 | flat[starts[near][row] + within])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, fp) for each key of each distinct fp."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(fps), 2000):
                part = fps[at : at + 2000]
                row, key = keys_of(part.view("<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(made, "key bigint, fp bigint")


def forest(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, int]]:
    """Links of a spanning forest of distinct unsigned fingerprints, as (some, the one each is linked to)."""
    rest = fps
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            one = reached.pop()
            hit = np.bitwise_count(rest ^ one) <= distance
            if hit.any():
                yield rest[hit], one
                reached.extend(rest[hit])
                rest = rest[~hit]


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v), u > v: links of distinct fingerprints that join all that are reachable over links of at most `distance` bits."""
    if distance > 3:
        raise ValueError("four segments find all pairs up to three bits apart")
    rows = cut(keyed(nodes)).select(F.col("key").alias("g"), F.col("fp").alias("node"), F.lit(1).alias("n"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, held = Forest(), np.zeros((0, 3), "<i8")
        u: list[int] = []
        v: list[int] = []

        def compare(rows: np.ndarray) -> None:
            edges = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(rows)]))
            many = ends - starts > 1
            for a, b in zip(starts[many], ends[many], strict=True):
                for some, one in forest(np.unique(rows[a:b, 2]).view("<u8"), distance):
                    y = int(one.view("<i8"))
                    for x in some.view("<i8").tolist():
                        if joined.join(x, y):
                            u.append(max(x, y))
                            v.append(min(x, y))

        for b in batches:
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype("<i8") for k in range(3)], axis=1)
            rows = np.concatenate((held, rows))
            if not len(rows):
                continue
            last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
            whole = last[-1] + 1 if len(last) else 0
            compare(rows[:whole]) if whole else None
            held = rows[whole:]
            if len(u) >= BATCH:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u.clear(), v.clear()
        if len(held):
            compare(held)
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def compared(parts: DataFrame) -> DataFrame:
        return parts.select("g", "part", "node").repartition("g", "part").sortWithinPartitions("g", "part", "node").mapInArrow(found, "u bigint, v bigint")

    return linked(rows, compared, BLOCK)


def near_duplicates(fps: DataFrame, key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """fps (key, fp, ...) with component_id, the least key reachable over links of at most `distance` bits. fps is read several times."""
    fps = fps.drop("component_id")
    nodes = cut(fps.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(nodes, distance))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = salted_join(named.select("fp", "root"), least, "root").select("fp", "component_id")
    return salted_join(fps, ids, "fp")


def written(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    fps = cut(fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return near_duplicates(fps).select("doc_id", written(F.col("fp")).alias("fingerprint"), "component_id")
