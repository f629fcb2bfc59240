"""Links within groups of any size, and the components that links make.

Nodes are in groups (g, node); a comparison of some nodes of a group finds links that join all of them that belong
together. A group of more than one block's rows is compared in two rounds. First each block by itself, the group's
least node being in every block. Then only nodes that are still apart have to meet: those outside the group's
largest component are compared, in blocks of their own, with all of the group. A group of near copies is one
component after the first round but for a few, so its rows grow with its size; nothing is left out, however many
groups are large and however large they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join, stored


class Forest:
    """Union-find: which links of a task join what was not joined yet."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, nodes = Forest(), set()
    for b in batches:
        for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            forest.join(u, v)
            nodes.update((u, v))
    found = sorted(nodes)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([forest.root(x) for x in found], pa.int64())], names=["node", "root"])


#: Edges up to which one task finds the components of all.
FEW = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (u, v): the root is the least node reachable.

    Up to FEW edges, the distinct ones are joined by one task, in some ten megabytes. Beyond that, each node hooks to its least neighbour, hooks are followed to their ends by doubling, and edges between
    what remains go to the next round; at least half of the nodes that have edges go each time.
    """
    edges = cut(edges.where("u <> v").distinct())
    if edges.count() <= FEW:
        return cut(edges.coalesce(1).mapInArrow(_joined, "node bigint, root bigint"))
    labels = None
    while not edges.isEmpty():
        hooks = cut(
            edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            .groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("root"))
        )
        while True:
            further = cut(salted_join(hooks, hooks.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            hooks = further.select("node", "root")
            if further.where("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = hooks if labels is None else cut(salted_join(labels, to, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        first = salted_join(edges.select(F.col("u").alias("root"), "v"), to, "root").select(F.col("next").alias("u"), "v")
        both = salted_join(first.select("u", F.col("v").alias("root")), to, "root").select("u", F.col("next").alias("v"))
        edges = cut(both.where("u <> v").distinct())
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _blocks(rows: Column, size: Column, most_rows: int, most_size: int) -> Column:
    return F.greatest(F.ceil(rows / most_rows), F.ceil(size / most_size), F.lit(1)).cast("int")


def linked(
    groups: DataFrame, compare: Callable[[DataFrame], DataFrame], most_rows: int, most_size: int = 1 << 62, roots: DataFrame | None = None, before: DataFrame | None = None, held: list[str] | None = None,
) -> DataFrame:
    """(u, v), u > v: links that join the nodes of each group that belong together, if compare finds those of a part of one.

    groups: (g, node, n), distinct; n is a node's size, and a block has about most_rows rows and most_size in all.
    compare: of (g, part, node) with the components so far as `root` (null: the node alone) makes (u, v). before: links
    that are known, and roots: their components. groups is read several times. held: gets tables, for forget().
    """
    own = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    upto = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"), F.min("node").alias("lead"))
    heavy = stored(sizes.withColumn("blocks", _blocks(F.col("rows"), F.col("size"), most_rows, most_size)).where("blocks > 1").select("g", "blocks", "lead"), "sizes", held)
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(F.col("node") == F.col("lead"), upto("blocks")).otherwise(F.array(own("blocks")))
    first = groups.join(heavy, "g", "left").withColumn("part", F.explode(parts)).select("g", "part", "node")
    found = cut(compare(first.withColumn("root", F.lit(None).cast("bigint")) if roots is None else first.join(roots, "node", "left")))
    if heavy.isEmpty():
        return found
    joined = components(found if before is None else found.unionByName(before))
    rest = groups.join(heavy.select("g"), "g").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = stored(rest, "rest", held)
    per = rest.groupBy("g", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"))
    first_of = F.struct("rows", "root")
    apart = (
        per.groupBy("g").agg(F.max_by("root", first_of).alias("main"), F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.max("rows").alias("main_rows"), F.max_by("size", first_of).alias("main_size"))
        .where("rows > main_rows")
        .select("g", "main", _blocks(F.col("rows") - F.col("main_rows"), F.col("size") - F.col("main_size"), most_rows // 2, most_size // 2).alias("others"), _blocks(F.col("rows"), F.col("size"), most_rows // 2, most_size // 2).alias("all"))
    )
    apart = stored(apart, "apart", held)
    as_any = F.transform(upto("others"), lambda o: o * F.col("all") + own("all"))
    as_other = F.transform(upto("all"), lambda a: own("others") * F.col("all") + a)
    second = rest.join(apart, "g").withColumn("part", F.explode(F.when(F.col("root") == F.col("main"), as_any).otherwise(F.array_union(as_any, as_other))))
    return found.unionByName(cut(compare(second.select("g", "part", "node", "root"))))
