"""Quality rules: a cascade that stops at the first rule that rejects, ordered by rejections per cost.

Each rule looks at one whole text and rejects it or not; a text is kept if no rule rejects it, so the order
changes the cost and never the verdict. What rules share (words, lines, counts) is computed on first use and kept
for the text; a rule costs what it needs and no earlier rule has made. A random sample of whole texts from all
partitions tells which rules reject together and what each shared value costs: its rates by byte, word and line
(COSTS) times the sample's bytes, words and lines. The cascade then takes, again and again, the rule with the most
rejections of texts not yet rejected for its cost. Rates are constants, so a run over the same table has the same order.

Null texts count as empty. Empty texts have no words, and are rejected by `few_words`. Repeated rows and
equal ids are judged row by row; of rules that are worth the same the one given first goes first. An empty table
gives an empty result, and rules keep their order. Columns of the input named like the results are replaced, all
others kept. A very long text is one row like any other, its words one list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plus, read

SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
WINDOW = 8
#: Texts, about, on which cost and selectivity are estimated.
SAMPLE_ROWS = 300
#: Nanoseconds by byte, word and line that the values of a text take beyond those they are made of (measured on prose).
COSTS = {
    "words": (4.0, 0, 0), "n_words": (0, 0, 0), "word_chars": (0.4, 0, 0), "n_symbols": (0.5, 0, 0), "lines": (0.5, 0, 40), "n_dup_lines": (0, 0, 60), "dup_line_bytes": (0, 0, 80),
    "n_stutter": (0, 40, 0), "n_repeat_words": (0, 350, 0), "upper_share": (3.0, 0, 0),
}
MADE_OF = {"n_words": ("words",), "n_dup_lines": ("lines",), "dup_line_bytes": ("lines",), "n_stutter": ("words",), "n_repeat_words": ("words",)}


class Text:
    """A text and what rules ask of it; words are runs of bytes other than ASCII white space."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.raw.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def dup_line_bytes(self) -> int:
        return sum(map(len, self.lines)) - sum(map(len, set(self.lines)))

    @cached_property
    def n_stutter(self) -> int:
        """Words equal to the one before."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by a window of eight words that occurs at least twice.

        Windows get exact ids by doubling: pairs of words, pairs of those, pairs of those.
        """
        n = self.n_words
        if n <= WINDOW:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, n)
        many, step = len(seen), 1
        if many == n:
            return 0
        while step < WINDOW:
            found, ids, counts = np.unique(ids[:-step] * many + ids[step:], return_inverse=True, return_counts=True)
            many, step = len(found), 2 * step
            if many == len(ids):
                return 0
        at = np.flatnonzero(counts[ids] > 1)
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + WINDOW, -1)
        return int((np.cumsum(edges[:n]) > 0).sum())

    @cached_property
    def upper_share(self) -> float:
        """Of the letters A-Z and a-z."""
        upper, lower = (len(self.raw) - len(self.raw.translate(None, x)) for x in (UPPER, LOWER))
        return upper / max(1, upper + lower)


@dataclass(frozen=True)
class Rule:
    """rejects: True if the text is not to be kept. needs: the values of the text that it asks for, a key of COSTS each (none: it costs as much as the words do)."""

    name: str
    rejects: Callable[[Text], bool]
    needs: tuple[str, ...] = ()

    def values(self) -> set[str]:
        """What is made for it."""
        return {x for value in self.needs or ("words",) for x in (value, *MADE_OF.get(value, ()))}


#: The verdict's rules: the two of the contract's base, then those of the cascade.
BASE = (
    Rule("few_words", lambda t: t.n_words < 20, ("n_words",)),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 30 * t.n_words, ("n_repeat_words", "n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words, ("n_symbols", "n_words")),
    Rule("duplicate_lines", lambda t: 10 * t.dup_line_bytes > 3 * len(t.raw), ("dup_line_bytes",)),
    Rule("stutter", lambda t: 10 * t.n_stutter > 3 * t.n_words, ("n_stutter", "n_words")),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words, ("word_chars", "n_words")),
    Rule("upper_case", lambda t: t.upper_share > 0.5, ("upper_share",)),
)


def sampled(docs: DataFrame, rules: tuple[Rule, ...], text: str, sample_rows: int) -> tuple[dict[tuple[int, ...], int], dict[str, float]]:
    """(how many texts of the sample just these rules reject, by their places; what each value costs over the sample)."""
    share = max(1.0, docs.count() / sample_rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together: Counter[str] = Counter()
        sizes: Counter[str] = Counter()
        for b in batches:
            for value in b.column(0).to_pylist():
                t = Text(value or "")
                together[",".join(str(k) for k, rule in enumerate(rules) if rule.rejects(t))] += 1
                sizes.update({"bytes": len(t.raw), "words": t.n_words, "lines": len(t.lines)})
        kind = ["rules"] * len(together) + ["size"] * len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array([*together, *sizes], pa.string()), pa.array([*together.values(), *sizes.values()], pa.int64())], names=["kind", "of", "n"])

    held = docs.select(text).where(F.rand(7) * share < 1).mapInArrow(measured, "kind string, of string, n bigint")
    found = {(r["kind"], r["of"]): r["n"] for r in held.groupBy("kind", "of").agg(F.sum("n").alias("n")).collect()}
    sizes = [found.get(("size", x), 0) for x in ("bytes", "words", "lines")]
    costs = {value: sum(rate * size for rate, size in zip(rates, sizes, strict=True)) for value, rates in COSTS.items()}
    return {tuple(int(x) for x in of.split(",") if x): n for (kind, of), n in found.items() if kind == "rules"}, costs


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """rules in the order of the cascade."""
    together, costs = sampled(docs, rules, text, sample_rows)
    ordered: list[int] = []
    made: set[str] = set()
    while len(ordered) < len(rules):
        def worth(k: int) -> float:
            rejected = sum(n for places, n in together.items() if k in places and not set(places) & set(ordered))
            return rejected / (1 + sum(costs[x] for x in rules[k].values() - made))  # what is made already is free

        best = max((k for k in range(len(rules)) if k not in ordered), key=lambda k: (worth(k), -k))
        ordered.append(best)
        made |= rules[best].values()
    return tuple(rules[k] for k in ordered)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", metrics: bool = False) -> DataFrame:
    """docs with `kept` and `rejected_by` (null if kept: the first rule of the cascade that rejects).

    With metrics, also n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.
    """
    ordered = order_rules(docs, rules, text)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if metrics else []
    new = {"kept": pa.bool_(), "rejected_by": pa.string()} | dict.fromkeys(names, pa.int64())
    held = docs.select(*[c for c in docs.columns if c not in new])
    place = held.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in new}
            for value in batch.column(place).to_pylist():
                t = Text(value or "")
                by = next((r.name for r in ordered if r.rejects(t)), None)
                out["kept"].append(by is None)
                out["rejected_by"].append(by)
                for name in names:
                    out[name].append(getattr(t, name))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[c], new[c]) for c in new)], names=[*batch.schema.names, *new])

    types = {"kept": "boolean", "rejected_by": "string"} | dict.fromkeys(names, "long")
    return held.mapInArrow(scored, plus(held.schema, **types))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), metrics=True)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, t, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         LIST_FILTER(STRING_SPLIT(t, CHR(10)), lambda x: REGEXP_MATCHES(x, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents)),
places AS (SELECT doc_id, ws, UNNEST(RANGE(1, LEN(ws) - 6)) AS i FROM d WHERE LEN(ws) >= 8),
windows AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, ARRAY_TO_STRING(ws[i:i + 7], ' ')) AS n FROM places),
covered AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM windows, (SELECT UNNEST(RANGE(0, 8)) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, LEN(ws)::BIGINT AS n_words, COALESCE(LIST_SUM(LIST_TRANSFORM(ws, lambda x: LENGTH(x))), 0)::BIGINT AS word_chars,
         LENGTH(REGEXP_REPLACE(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (LEN(ls) - LEN(LIST_DISTINCT(ls)))::BIGINT AS n_dup_lines, COALESCE(c.n, 0)::BIGINT AS n_repeat_words,
         COALESCE(LIST_SUM(LIST_TRANSFORM(ls, lambda x: STRLEN(x))), 0) - COALESCE(LIST_SUM(LIST_TRANSFORM(LIST_DISTINCT(ls), lambda x: STRLEN(x))), 0) AS dup_bytes, STRLEN(t) AS n_bytes,
         LEN(LIST_FILTER(RANGE(2, LEN(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter,
         LENGTH(REGEXP_REPLACE(t, '[^A-Z]', '', 'g')) AS upper, LENGTH(REGEXP_REPLACE(t, '[^a-z]', '', 'g')) AS lower
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 10 * dup_bytes > 3 * n_bytes OR 10 * n_stutter > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * upper > GREATEST(1, upper + lower)) AS kept
FROM m
"""
