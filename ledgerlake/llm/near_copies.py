"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Texts with equal words (A-Z lower-cased) are one node. SimHash proposes first: fingerprints of the shingles that are
within three bits meet under Golay keys (simhash.near_duplicates), and each component is compared by its exact sets.
That joins most near copies, but a similarity of 0.8 leaves about ten of 64 bits different, so prefixes find the
rest: with all shingles in one order, two sets that are alike share one of the first fifth of either. Nodes that
share a shingle there and are not joined yet are compared by their sets. So all pairs that are alike count.

Shingles are ordered by their hashes. A shingle that is in the prefixes of over HOT nodes is hot, unless these are
joined already; nodes that share no other one go to a further round, among themselves, in which all shingles found
hot so far come last and so others take their places in the prefixes. It ends when no more get hot. Texts that are
made of hot shingles alone are compared by those. Counts are over all texts, and groups are compared in blocks
(groups.linked). Nodes that meet are first compared by bitmaps of parities, about one bit for a shingle: these differ
in no more bits than the sets do in shingles, so what they exclude isn't alike, and few texts are left whose sets have
to be compared, by a search that never compares two nodes that are already joined.

A null text counts as empty; texts with fewer words than a shingle are one shingle, so they are copies of equal
ones only. Of a component the row with the least key stays, null keys last; of rows that repeat key and words one
stays. Equal keys with other words are other nodes. An empty table gives an empty result. Columns keep their names
whatever they are. A very long text is one node like any other; a worker holds the shingles of a block's texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, forget, spare, stored, text_of
from .groups import Forest, components, linked
from .simhash import bits_of, near_duplicates, shingle_hashes, words_of

WORDS, SIMILARITY = 5, 0.8
#: A shingle in the prefixes of more nodes than this is hot.
HOT = 4096
#: Rows and shingles of a group of texts that are compared in one block, and rows of one by their parities.
GROUP_ROWS, GROUP_SHINGLES, GROUP_BITS = 1024, 500_000, 8192
#: Texts of a batch, links of one, and exact copies beyond which the other texts are written once more.
TEXTS, BATCH, COPIES = 200, 50_000, 10_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(words_of(text), words).view("<i8"))


def prefix_length(n: int, similarity: float = SIMILARITY) -> int:
    """Two sets that are alike share one of the first so many of n, whatever the order."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def content(text: str) -> Column:
    """The words of a text as 16 bytes."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.translate(text_of(text), UPPER, LOWER), r"[\x20\x09-\x0D]+", " ")).cast("binary")))


def parity(own: np.ndarray) -> bytes:
    """For each remainder of the shingles' hashes whether an odd number has it; as many bits as shingles, up to the next power of two, and 64 at least."""
    width = max(64, 1 << (len(own) - 1).bit_length())
    odd = np.bincount(own & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def profiles(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, fp, n, prefix, bits) of (node, text): the fingerprint, the number of different shingles, the first of them by hash, and parity()."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                rows: list[list] = [[], [], [], []]
                for t in b.column(1)[at : at + TEXTS].to_pylist():
                    hashes = shingle_hashes(words_of(t), words)
                    own = np.unique(hashes.view("<i8"))
                    for column, x in zip(rows, (bits_of(hashes), len(own), own[: prefix_length(len(own), similarity)], parity(own)), strict=True):
                        column.append(x)
                fps = pa.array(np.array(rows[0], "<u8").view("<i8"))
                rest = (pa.array(x, t) for x, t in zip(rows[1:], (pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + TEXTS], fps, *rest], names=["node", "fp", "n", "prefix", "bits"])

    return texts.select("node", "text").mapInArrow(made, "node bigint, fp bigint, n int, prefix array<bigint>, bits binary")


MET = "shingle bigint, g bigint, node bigint, n bigint"


def by_shingle(prefixes: DataFrame, similarity: float) -> DataFrame:
    """MET of (node, n, prefix): groups (g, node, n) of nodes that share a shingle, named by their least, and (shingle, node, n) of hot ones.

    Nodes whose sizes n are too far apart aren't together. Groups with an equal least node are one, so the many
    shingles that near copies share make few groups. Of a batch at most HOT + 1 rows of a shingle are dealt by it.
    """
    names = ["key", "n", "node", "hot"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            shingle = b.column(2).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(node)), np.diff(b.column(2).offsets.to_numpy()))
            order = np.argsort(shingle, kind="stable")
            shingle, row = shingle[order], row[order]
            starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
            place = np.arange(len(shingle)) - np.repeat(starts, np.diff(np.append(starts, len(shingle))))
            over = place > HOT
            key = np.where(over, node[row] * np.int64(0x9E3779B97F4A7C15 - (1 << 64)), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n[row]), pa.array(node[row]), pa.array(shingle, mask=~over)], names=names)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3
        going: int | None = None  # the hot shingle that the last rows were of
        out: set[tuple[int, int, int]] = set()

        def batch(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "g", "node", "n"])

        def light() -> pa.RecordBatch:
            g, node, n = np.array(list(out), np.int64).reshape(-1, 3).T.copy()
            out.clear()
            return batch(pa.nulls(len(g), pa.int64()), g, node, n)

        def group(shingle: np.ndarray, n: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            """Takes whole shingles; returns the rows of those that are hot."""
            starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            counts = np.diff(np.append(starts, len(shingle)))
            hot = np.repeat((counts > HOT) | (shingle[starts] == going if going is not None else False), counts)
            # a run: one shingle, and no step in size over which nothing is alike
            runs = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (n[:-1] < similarity * n[1:] - 1e-6)))
            ends = np.append(runs[1:], len(shingle))
            many = (ends - runs > 1) & ~hot[runs]
            for a, z in zip(runs[many].tolist(), ends[many].tolist(), strict=True):
                lead = int(node[a:z].min())
                out.update((lead, x, k) for x, k in zip(node[a:z].tolist(), n[a:z].tolist(), strict=True))
            return batch(shingle[hot], pa.nulls(int(hot.sum()), pa.int64()), node[hot], n[hot])

        for b in batches:
            ready = b.column(3).is_valid()
            if pa.compute.any(ready).as_py():
                those = b.filter(ready)
                yield batch(those.column(3), pa.nulls(those.num_rows, pa.int64()), those.column(2), those.column(1))
                b = b.filter(pa.compute.invert(ready))
            if not b.num_rows:
                continue
            rows = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(last, (b.column(0), b.column(1), b.column(2)), strict=True)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))
            if whole:
                yield group(*(r[:whole] for r in rows))
            last = [r[whole:] for r in rows]
            if len(last[0]) > HOT:  # so it is hot, and can go
                going = int(last[0][0])
                yield group(*last)
                last = [np.zeros(0, np.int64)] * 3
            if len(out) >= BATCH:
                yield light()
        if len(last[0]):
            yield group(*last)
        yield light()

    rows = prefixes.select("node", "n", "prefix").mapInArrow(dealt, "key bigint, n bigint, node bigint, hot bigint")
    return rows.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(grouped, MET)


def meeting(found: DataFrame, texts: DataFrame, words: int, similarity: float, roots: DataFrame, held: list[str]) -> DataFrame:
    """(g, node, n), distinct: groups such that each pair that is alike and not joined in roots is together in one at least."""

    def all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + TEXTS], pa.array([shingle_set(t, words) for t in b.column(1)[at : at + TEXTS].to_pylist()], pa.list_(pa.int64()))], names=["node", "own"])

    prefixes, groups, known = found.select("node", "n", "prefix"), None, None
    while True:
        met = stored(by_shingle(prefixes, similarity), "met", held)
        own = met.where("g is not null").select("g", "node", "n")
        groups = own if groups is None else groups.unionByName(own)
        rows = met.where("shingle is not null")
        if rows.isEmpty():
            break
        root = F.coalesce("root", "node")
        mixed = rows.join(roots, "node", "left").groupBy("shingle").agg(F.min("node").alias("g"), F.min(root).alias("a"), F.max(root).alias("b")).where("a < b").select("shingle", "g")
        mixed = stored(mixed, "mixed", held)
        new = mixed.select("shingle")
        if known is not None:
            dense = mixed.join(known, "shingle")
            groups = groups.unionByName(rows.drop("g").join(dense, "shingle").select("g", "node", "n"))
            new = new.join(known, "shingle", "left_anti")
        new = stored(new, "new", held)
        if new.isEmpty():
            break
        known = new if known is None else stored(known.unionByName(new), "known", held)
        nodes = rows.join(new, "shingle", "left_semi").select("node").distinct()
        sets = stored(texts.select("node", "text").join(stored(nodes, "nodes", held), "node", "left_semi").mapInArrow(all_shingles, "node bigint, own array<bigint>"), "sets", held)
        hot = sets.select("node", F.explode("own").alias("shingle")).join(known, "shingle").groupBy("node").agg(F.array_sort(F.collect_list("shingle")).alias("hot"))  # at most a document's
        n = F.size("own")
        first = F.concat(F.array_except("own", "hot"), "hot")
        prefixes = sets.join(hot, "node").select("node", n.alias("n"), F.slice(first, F.lit(1), n - F.ceil(similarity * n - 1e-9).cast("int") + 1).alias("prefix"))
    return groups.distinct()


def alike(sets: list[np.ndarray], similarity: float = SIMILARITY, labels: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Links between sets, each without repeats, whose Jaccard similarity is at least `similarity`; with them, sets of
    equal labels that are joined already, all are joined that are reachable.

    A tree grows from the largest component. What it has that is new is compared with the sets outside, the fewer
    of them taken one by one, and brings in whole components; so joined sets are never compared. One less the
    similarity is a metric: sets whose distances from the tree's first one differ by more than the limit are skipped.
    """
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(ids), bool)
    label = np.unique(labels, return_inverse=True)[1] if labels is not None else np.arange(len(sets))

    def compared(one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether alike, distance) of each of the others."""
        marked[own[one]] = True
        shared = np.add.reduceat(marked[np.concatenate([own[k] for k in others.tolist()])], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        marked[own[one]] = False
        union = sizes[one] + sizes[others] - shared
        return shared >= similarity * union - 1e-9, 1 - shared / union

    rest = np.argsort(-np.bincount(label)[label], kind="stable")
    while len(rest):
        root = int(rest[0])
        away = np.zeros(len(sets))
        if (label[rest] == label[root]).all():
            return
        away[rest] = compared(root, rest)[1]

        def near(one: int, others: np.ndarray) -> np.ndarray:
            """Those of the others that are alike to one."""
            may = others[(np.abs(away[others] - away[one]) <= 1 - similarity + 1e-6) & (np.minimum(sizes[others], sizes[one]) >= similarity * np.maximum(sizes[others], sizes[one]) - 1e-6)]
            return may[compared(one, may)[0]] if len(may) else may

        fresh, rest = rest[label[rest] == label[root]], rest[label[rest] != label[root]]
        while len(fresh) and len(rest):
            hits: list[tuple[int, int]] = []
            if len(fresh) <= len(rest):
                one, fresh = int(fresh[0]), fresh[1:]
                hits = [(k, one) for k in near(one, rest).tolist()]
            else:
                for k in rest.tolist():
                    hit = near(k, fresh)
                    if len(hit):
                        hits.append((k, int(hit[0])))
                fresh = fresh[:0]
            yield from hits
            if hits:
                inside = np.isin(label[rest], label[[k for k, _ in hits]])
                fresh, rest = np.concatenate((fresh, rest[inside])), rest[~inside]


def maybe_alike(n: np.ndarray, bits: list[bytes], similarity: float) -> Iterator[tuple[int, int]]:
    """Links that join all sets, of n shingles and with these parities, whose similarity may be high enough.

    Parities of twice the width are folded to compare them; sets whose widths differ more aren't alike.
    """
    width = np.array([len(x) for x in bits]) // 8
    plain = {int(w): np.frombuffer(b"".join(x for x in bits if len(x) == 8 * w), "<u8").reshape(-1, w) for w in np.unique(width)}
    folded = {w: x[:, : w // 2] ^ x[:, w // 2 :] for w, x in plain.items() if w > 1}
    place = np.zeros(len(n), np.int64)
    for w in plain:
        place[width == w] = np.arange(len(plain[w]))

    def near(one: int, others: np.ndarray) -> np.ndarray:
        w, at = int(width[one]), place[one]
        out = []
        for v, own, table in ((w, plain[w][at], plain), (2 * w, plain[w][at], folded), (w // 2, folded[w][at] if w > 1 else None, plain)):
            these = others[width[others] == v] if v else others[:0]
            if len(these):
                both = n[one] + n[these]
                most = both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9).astype(np.int64)
                out.append(these[np.bitwise_count(table[v][place[these]] ^ own).sum(1, dtype=np.int64) <= most])
        return np.concatenate(out) if out else others[:0]

    rest = np.arange(len(n))
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            one = reached.pop()
            hits = near(one, rest)
            if len(hits):
                yield from ((k, one) for k in hits.tolist())
                reached.extend(hits.tolist())
                rest = np.setdiff1d(rest, hits, assume_unique=True)


def in_parts(columns: str, linked_in: Callable[..., Iterator[tuple[int, int]]]) -> Callable[[DataFrame], DataFrame]:
    """From (g, part, node, and columns) to (u, v): linked_in of the columns' values of each (g, part) makes places of linked nodes."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, at = Forest(), None
        rows: list[tuple] = []
        links: list[tuple[int, int]] = []

        def compare() -> None:
            if len(rows) > 1:
                nodes, *values = zip(*rows, strict=True)
                for a, b in linked_in(nodes, *values):
                    if joined.join(nodes[a], nodes[b]):
                        links.append((max(nodes[a], nodes[b]), min(nodes[a], nodes[b])))
            rows.clear()

        def batch() -> pa.RecordBatch:
            u, v = np.array(links, np.int64).reshape(-1, 2).T.copy()
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            for k in range(0, b.num_rows, TEXTS):
                for g, part, *row in zip(*(c.to_pylist() for c in b.slice(k, TEXTS).columns), strict=True):
                    if (g, part) != at:
                        compare()
                        at = g, part
                    rows.append(tuple(row))
            if len(links) >= BATCH:
                yield batch()
        compare()
        yield batch()

    def compared(parts: DataFrame) -> DataFrame:
        held = parts.select("g", "part", "node", *columns.split())
        return held.repartition("g", "part").sortWithinPartitions("g", "part", "node").mapInArrow(found, "u bigint, v bigint")

    return compared


def by_sets(texts: DataFrame, words: int, similarity: float, held: list[str]) -> Callable[[DataFrame], DataFrame]:
    """compare of groups.linked: by the texts' sets."""

    def linked_in(nodes: tuple[int, ...], roots: tuple[int | None, ...], held: tuple[str, ...]) -> Iterator[tuple[int, int]]:
        return alike([shingle_set(t, words) for t in held], similarity, [n if r is None else r for n, r in zip(nodes, roots, strict=True)])

    compared = in_parts("root text", linked_in)

    def of_texts(parts: DataFrame) -> DataFrame:
        # as tables, so that Spark knows their sizes and, where they are small, leaves the texts where they are
        parts = stored(parts, "parts", held)
        wanted = stored(parts.select("node").distinct(), "wanted", held)
        return compared(texts.select("node", "text").join(wanted, "node", "left_semi").join(parts, "node"))

    return of_texts


def by_bits(found: DataFrame, similarity: float) -> Callable[[DataFrame], DataFrame]:
    """compare of groups.linked: by what parities don't exclude."""
    compared = in_parts("n bits", lambda nodes, n, bits: maybe_alike(np.array(n, np.int64), bits, similarity))
    return lambda parts: compared(parts.join(found.select("node", "n", "bits"), "node"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(content, key, node, root, repeated, alone): each different text with its least key, its node and its component's
    least node; repeated, if several rows have that key and these words; alone, if no key of docs has two texts."""
    spark, held = docs.sparkSession, []
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    copies = cut(rows.select("key", content("text").alias("content")).groupBy("content", "key").agg(F.count(F.lit(1)).alias("copies")))
    alone = copies.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("copies").alias("copies"))
    classes = copies.groupBy("content").agg(F.min(order).alias("least")).select("content", "least.key", (F.col("least.copies") > 1).alias("repeated"))
    if alone and isinstance(docs.schema[key].dataType, IntegralType) and copies.where("copies > 1 or key is null").isEmpty():
        # ids that tell all rows apart are nodes themselves
        classes = cut(classes.withColumn("node", F.col("key").cast("bigint")))
        others = stored(copies.join(classes.select("key"), "key", "left_anti").select(F.col("key").cast("bigint").alias("node")), "others", held)
        texts = rows.select(F.col("key").cast("bigint").alias("node"), "text").join(others, "node", "left_anti")
        if others.count() > COPIES:
            texts = stored(texts, "texts", held)
    else:
        classes = cut(cut(classes).withColumn("node", F.monotonically_increasing_id()))
        named = classes.select(F.col("content").alias("_c"), F.col("key").alias("_k"), "node", "repeated")
        match = F.col("key").eqNullSafe(F.col("_k")) & (F.col("content") == F.col("_c"))
        texts = rows.withColumn("content", content("text")).join(named, match).select("node", "text", "repeated")
        once = texts.where("repeated").groupBy("node").agg(F.min("text").alias("text"))
        texts = stored(texts.where("not repeated").select("node", "text").unionByName(once), "texts", held)
    found = stored(profiles(texts, words, similarity), "profiles", held)
    sets, sized = by_sets(texts, words, similarity, held), found.select("node", F.col("n").cast("bigint").alias("n"))
    # SimHash
    proposed = stored(near_duplicates(found.select("node", "fp"), "node").select(F.col("component_id").alias("g"), "node"), "proposed", held)
    several = proposed.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g")
    groups = stored(proposed.join(several, "g").join(sized, "node").select("g", "node", "n"), "groups", held)
    by_simhash = cut(linked(groups, sets, GROUP_ROWS, GROUP_SHINGLES, held=held))
    # what is alike besides: groups that are not in one component already
    roots = components(by_simhash)
    met = stored(meeting(found, texts, words, similarity, roots, held), "met", held)
    apart = met.join(roots, "node", "left").groupBy("g").agg(F.min(F.coalesce("root", "node")).alias("a"), F.max(F.coalesce("root", "node")).alias("b")).where("a < b").select("g")
    groups = stored(met.join(apart, "g"), "groups", held)
    maybe = components(linked(groups, by_bits(found, similarity), GROUP_BITS, 64 * GROUP_SHINGLES, held=held))
    groups = stored(maybe.select(F.col("root").alias("g"), "node").join(sized, "node").select("g", "node", "n"), "groups", held)
    edges = by_simhash.unionByName(linked(groups, sets, GROUP_ROWS, GROUP_SHINGLES, roots, by_simhash, held))
    out = cut(classes.join(components(edges), "node", "left").select("content", "key", "node", F.coalesce("root", "node").alias("root"), "repeated", F.lit(alone).alias("alone")))
    forget(spark, held)
    return out


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of near copies, that with the least key."""
    order = F.struct(F.col("key").isNull().alias("none"), *[F.col(c).alias(c) for c in ("key", "content", "repeated", "alone")])
    kept = near_copies(docs, key, text, words, similarity).groupBy("root").agg(F.min(order).alias("least"))
    kept = stored(kept.select("least.content", "least.key", "least.repeated", "least.alone"), "kept")
    c, k = (spare(x, docs.columns) for x in ("_content", "_key"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    if kept.where("repeated or not alone").isEmpty():
        # keys tell the rows apart: those that go are fewer than those that stay
        gone = stored(docs.select(F.col(key).alias(k)).join(kept.select("key"), same(k, "key"), "left_anti"), "gone")
        return docs.join(gone, same(key, k), "left_anti").select(*docs.columns)
    own = docs.withColumn(c, content(text))
    kept = kept.select(F.col("content").alias(c + "_"), F.col("key").alias(k + "_"), F.col("repeated").alias(spare("_repeated", docs.columns) + "_"))
    chosen = own.join(kept, same(c, c + "_") & same(key, k + "_"))
    again = F.col(kept.columns[2])
    return chosen.where(~again).unionByName(chosen.where(again).dropDuplicates([c + "_", k + "_"])).select(*docs.columns)
