"""Mixing sources to target weights by Poisson replication.

A source's target rate is its share of the wanted total size over its own size. Each document is repeated by a
Poisson count with that mean, got by inverting the distribution at a number hashed from the seed and the
document's id; so a count depends on nothing but id, seed and rate, and a lost task makes the same copies
again. Copies are then put in one global order by the hash of (id, seed, copy).

Sources without a target, null ones included, form one group with the weight `other`. A group whose documents
are all empty has the rate 1, and a target for an absent source has no effect. Rows that repeat an id get the
same count each. A null size counts as the text's length, and a null id as "". An empty table gives an
empty result. Columns of the input named copy or shuffle_key are replaced, all others are kept. A text is copied
whole, however long it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, spare

#: The mix that the query and the pipeline make: twenty sources alike, and all others together like one.
WEIGHTS = {f"src{i}": 1.0 for i in range(20)}
OTHER, SEED = 1.0, 20


def cdf(rate: float) -> tuple[int, list[float]]:
    """The least count that can be drawn, and the distribution function from there to where it rounds to 1."""
    reach = 10 * math.sqrt(rate) + 40
    low = max(0, int(rate - reach))
    out, total = [], 0.0
    for k in range(low, int(rate + reach) + 1):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else 1.0
        out.append(total)
        if total >= 1 - 2**-53:
            break
    return low, out


def target_rates(docs: DataFrame, weights: dict[str, float], other: float, source: str, size: Column, total: float | None = None) -> dict[str | None, float]:
    """Mean copies of a document of each source; None is the group of the sources without a target.

    What comes to the driver is one sum for each target and one for the rest.
    """
    group = F.when(F.col(source).isin(*weights), F.col(source))
    sizes = {r["g"]: float(r["n"] or 0) for r in docs.groupBy(group.alias("g")).agg(F.sum(size).alias("n")).collect()}
    share = {g: weights.get(g, other) if g is not None else other for g in sizes}
    wanted, all_shares = sum(sizes.values()) if total is None else total, sum(share.values())
    return {g: share[g] / all_shares * wanted / n if n else 1.0 for g, n in sizes.items()}


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, seed: int = SEED, total: float | None = None, key: str = "doc_id", source: str = "source", text: str = "text", size: str = "n_chars") -> DataFrame:
    """Copies of docs in a global order, with copy (from 0) and shuffle_key. total: the wanted size, by default that of docs."""
    held = docs.select(*[c for c in docs.columns if c not in ("copy", "shuffle_key")])
    length = F.coalesce(F.col(size).cast("bigint"), F.char_length(text).cast("bigint"), F.lit(0).cast("bigint"))
    rates = target_rates(held, weights, other, source, length, total)
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)))
    uniform = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
    u, n = (spare(x, [*held.columns, "copy", "shuffle_key"]) for x in ("_u", "_count"))
    count = F.lit(0)
    for group, rate in rates.items():
        low, steps = cdf(rate)
        drawn = F.lit(low) + F.size(F.filter(F.array(*map(F.lit, steps)), lambda c: c <= F.col(u)))
        count = F.when(F.col(source) == group if group is not None else ~F.coalesce(F.col(source).isin(*weights), F.lit(False)), drawn).otherwise(count)
    copies = F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(1), F.col(n)), lambda k: (k - 1).cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    repeated = held.withColumn(u, uniform).withColumn(n, count).withColumn("copy", F.explode(copies)).drop(u, n)
    return repeated.withColumn("shuffle_key", F.md5(F.concat_ws(":", name, F.col("copy").cast("string")).cast("binary"))).orderBy("shuffle_key", "copy")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH sized AS (
  SELECT *, CASE WHEN source IN ({", ".join(f"'{s}'" for s in WEIGHTS)}) THEN source END AS grp,
         COALESCE(n_chars, LENGTH(text), 0) AS size
  FROM documents),
sums AS (SELECT grp, SUM(size)::DOUBLE AS size FROM sized GROUP BY grp),
rates AS (
  SELECT grp, CASE WHEN size = 0 THEN 1.0 ELSE 1.0 / (SELECT COUNT(*) FROM sums) * (SELECT SUM(size) FROM sums) / size END AS rate
  FROM sums),
steps AS (
  SELECT grp, k, SUM(EXP(k * LN(rate) - rate - LGAMMA(k + 1))) OVER (PARTITION BY grp ORDER BY k) AS upto
  FROM rates, (SELECT UNNEST(RANGE(0, 150)) AS k)),
arrays AS (SELECT grp, LIST(upto ORDER BY k) AS upto FROM steps GROUP BY grp),
drawn AS (
  SELECT s.*, LEN(LIST_FILTER(a.upto, lambda c: c <= CAST('0x' || SUBSTR(MD5(COALESCE(s.doc_id::VARCHAR, '') || ':{SEED}'), 1, 13) AS BIGINT) / 4503599627370496.0)) AS n
  FROM sized s JOIN arrays a ON s.grp IS NOT DISTINCT FROM a.grp),
copies AS (SELECT doc_id, text, lang, source, n_chars, UNNEST(RANGE(0, n)) AS copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy, MD5(COALESCE(doc_id::VARCHAR, '') || ':{SEED}:' || copy) AS shuffle_key FROM copies
"""
