"""Questions in English, read into a spec and answered by the operators; what can't be read is refused.

Whole words are matched. The first reading that applies wins: extreme group, extreme record, sum or mean
(with one equality if a value of a named field occurs), percentile, range, then counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import plain
from ..operators import groups
from ..operators.aggregate import Agg, ask
from ..operators.predicates import Predicate, Refused
from ..sources.records import accepted, from_lines
from ..sources.rel import Rel, union

# The words and phrases by which questions are read.
GROUP_HIGH, GROUP_LOW = {"highest", "largest", "most", "greatest", "maximum", "top"}, {"lowest", "smallest", "least", "minimum", "fewest"}
HIGH, LOW = {"largest", "highest", "max", "most", "greatest", "biggest"}, {"smallest", "lowest", "min", "least", "fewest"}
GROUPING = {"total", "sum", "average", "mean", "per", "each", "by"}
SUMS, MEANS = {"sum", "total"}, {"average", "mean"}
COMPARATORS = (
    ("at least", "ge"), ("greater than or equal", "ge"), ("at most", "le"), ("less than or equal", "le"),
    ("greater than", "gt"), ("more than", "gt"), ("above", "gt"), ("less than", "lt"), ("fewer than", "lt"), ("below", "lt"), ("under", "lt"),
)
RECORDS = {"record", "records", "item", "items", "entry", "entries", "element", "elements", "object", "objects", "array"}
WINNERS = 6


@dataclass(frozen=True)
class Spec:
    """What a question asks for."""

    kind: str
    field: str | None = None
    categories: tuple[str, ...] = ()
    highest: bool = True
    mean: bool = False
    p: int = 50
    op: str = "ge"
    threshold: float = 0.0
    value: str | None = None


@dataclass(frozen=True)
class Shape:
    """Field names and kinds by the first object, in its order."""

    n: int
    numbers: tuple[str, ...]
    strings: tuple[str, ...]


def shape_of(rel: Rel) -> Shape:
    n = rel.df.count()
    if rel.typed:
        return Shape(n, tuple(rel.numeric_fields()), tuple(rel.string_fields()))
    first = rel.df.where("cells is not null").orderBy("row_id").select("keys", "cells").first()
    keys, cells = (first["keys"], first["cells"]) if first else ([], {})
    return Shape(n, tuple(k for k in keys if cells[k]["kind"] == "num"), tuple(k for k in keys if cells[k]["kind"] == "str"))


def named(fields: Sequence[str], question: str) -> str | None:
    return next((f for f in fields if re.search(rf"(?<![a-z0-9_]){re.escape(f.lower())}(?![a-z0-9_])", question)), None)


def value_in(rel: Rel, field: str, question: str) -> str | None:
    """The longest value of a field that stands in the question as whole words, of those the first by text."""
    literal = F.regexp_replace(F.lower("v"), r"([^A-Za-z0-9_\s])", r"\\$1")
    whole = F.rlike(F.lit(question), F.concat(F.lit(r"(?U)(?<!\w)"), literal, F.lit(r"(?!\w)")))
    v = rel.cell(field).str
    hit = rel.df.select(v.alias("v")).where((F.col("v") != "") & F.contains(F.lit(question), F.lower("v"))).distinct().where(whole)
    row = hit.orderBy(F.desc(F.char_length("v")), "v").first()
    return row and row[0]


def read(rel: Rel, question: str, shape: Shape | None = None) -> Spec:
    """The spec of a question; Refused if none applies."""
    shape = shape or shape_of(rel)
    q = question.lower()
    if not shape.n:
        raise Refused("there are no records")
    words = set(re.findall(r"[a-z0-9_]+", q.replace("at least", " ").replace("at most", " ")))
    number = named(shape.numbers, q)
    category = named(shape.strings, q)
    if bool(words & GROUP_HIGH) != bool(words & GROUP_LOW) and words & GROUPING:
        by = [f for f in shape.strings if named([f], q)]
        sizes = {f: rel.df.agg(F.count_distinct(rel.cell(f).str)).first()[0] for f in by}
        by = sorted((f for f in by if sizes[f] < shape.n), key=lambda f: (sizes[f], f))
        field = named(shape.numbers, q) or (shape.numbers[0] if shape.numbers else None)
        if by and field:
            return Spec("group_extreme", field, tuple(by), bool(words & GROUP_HIGH), bool(words & MEANS))
    if bool(words & HIGH) != bool(words & LOW) and (number or shape.numbers):
        return Spec("record_extreme", number or shape.numbers[0], highest=bool(words & HIGH))
    if words & (SUMS | MEANS):
        if number is None:
            raise Refused("no number is named")
        return Spec("sum", number, (category,) if category else (), mean=bool(words & MEANS), value=value_in(rel, category, q) if category else None)
    m = re.search(r"\bp([1-9][0-9]?)\b", q) or ("percentile" in q and re.search(r"\b([1-9][0-9]?)(?:st|nd|rd|th)?\b", q)) or None
    if ("median" in words or m) and number:
        return Spec("percentile", number, p=50 if "median" in words else int(m[1]))
    if "range" in words and number:
        return Spec("range", number)
    if "how many" in q or "number of" in q:
        for phrase, op in COMPARATORS:
            if (at := q.find(phrase)) >= 0 and (x := re.search(r"-?[0-9]+(?:\.[0-9]+)?", q[at + len(phrase) :])):
                if number is None:
                    raise Refused("no number is named")
                return Spec("threshold", number, op=op, threshold=float(x[0]))
        if words & {"distinct", "unique", "different"} and category:
            return Spec("distinct", category)
        if category and (value := value_in(rel, category, q)) is not None:
            return Spec("value", category, value=value)
        if words & RECORDS or "in total" in q or "are there" in q:
            return Spec("records")
    raise Refused("the question has no reading")


def answer(rel: Rel, spec: Spec, n: int) -> tuple[str, DataFrame | None]:
    """(text, the rows of the result); Refused if a field isn't clean."""
    f = spec.field
    if spec.kind == "group_extreme":
        out = groups.group_extreme(rel, spec.categories, f, spec.highest, spec.mean)
        rows = out.collect()
        if not rows or rows[0]["status"] != "ok":
            raise Refused(f"{f} isn't all numbers")
        head = f"[index] {'max' if spec.highest else 'min'} {'mean' if spec.mean else 'sum'}({f}) by {','.join(spec.categories)} = "
        return head + (f'"{rows[0]["key"]}" ({plain(rows[0]["value"])})' if len(rows) == 1 else tie([r["key"] for r in rows], f"each {plain(rows[0]['value'])}")), out
    if spec.kind == "record_extreme":
        out = groups.superlative(rel, f, spec.highest)
        id_ = next(iter(shape_of(rel).strings), None)
        c = rel.cell(f).num
        best = out.select(F.max(c).alias("v"), F.count(F.lit(1)).alias("n")).first()
        if not best["n"]:
            raise Refused(f"{f} isn't all numbers")
        head = f"[index] {'max' if spec.highest else 'min'}({f}) over {n} records: "
        if id_ is None:
            return f"{head.removesuffix(': ')} = {plain(best['v'])}", out
        ids = [r[0] for r in out.select(rel.cell(id_).str.alias("i")).orderBy("i").limit(WINNERS).collect()]
        if best["n"] == 1:
            return f'{head}{id_}="{ids[0]}" ({f}={plain(best["v"])})', out
        return head + tie(ids, f"{f}={plain(best['v'])}", best["n"]) + " (no unique max)", out
    if spec.kind == "sum":
        by = [Predicate(spec.categories[0], "eq", spec.value)] if spec.value is not None else []
        if not rel.df.agg(groups.clean(rel, f)).first()[0]:
            raise Refused(f"{f} isn't all numbers")
        found = ask(rel, by, Agg("mean" if spec.mean else "sum", f))
        if found.value is None:
            raise Refused("no row is left")
        where = f" where {spec.categories[0]}={spec.value}" if by else ""
        return f"[index] {'mean' if spec.mean else 'sum'}({f}{where}) over {found.n_matched} records = {plain(found.value)}", found.rows
    if spec.kind in ("percentile", "range", "threshold"):
        out = {"percentile": lambda: groups.percentile(rel, f, spec.p), "range": lambda: groups.value_range(rel, f), "threshold": lambda: groups.count_threshold(rel, f, spec.op, spec.threshold)}[spec.kind]()
        r = out.first()
        if r["status"] != "ok":
            raise Refused(f"{f} isn't all numbers")
        if spec.kind == "percentile":
            return f"[index] {'median' if spec.p == 50 else f'p{spec.p}'}({f}) over {n} records = {plain(r['value'])}", out
        if spec.kind == "range":
            return f"[index] range({f}) over {n} records = {plain(r['value'])} (min {plain(r['low'])}, max {plain(r['high'])})", out
        sign = {"ge": ">=", "le": "<=", "gt": ">", "lt": "<"}[spec.op]
        return f"[index] count({f} {sign} {plain(spec.threshold)}) over {n} records = {r['n']}", out
    if spec.kind == "distinct":
        out = groups.count_distinct(rel, f)
        return f"[index] distinct({f}) over {n} records = {out.first()[0]} values", out
    if spec.kind == "value":
        out = groups.count_value(rel, f, spec.value)
        return f'[index] count({f}="{spec.value}") over {n} records = {out.first()[0]}', out
    return f"[index] count over {n} records = {n}", groups.count_records(rel)


def tie(names: Sequence[str], value: str, n: int | None = None) -> str:
    n = len(names) if n is None else n
    more = f", +{n - WINNERS} more" if n > WINNERS else ""
    return f"{n}-way TIE: " + ", ".join(f'"{x}"' for x in names[:WINNERS]) + f"{more} ({value})"


def digest(rel: Rel, question: str) -> str | None:
    """The answer's text, or None if the question is refused."""
    shape = shape_of(rel)
    try:
        return answer(rel, read(rel, question, shape), shape.n)[0]
    except Refused:
        return None


def digest_across(rels: Sequence[Rel | None], question: str) -> str | None:
    """Over all rows of several payloads; those that aren't arrays (None) are left out."""
    held = [r for r in rels if r is not None]
    return digest(union(held), question) if held else None


def digest_lines(lines: DataFrame, question: str) -> str | None:
    """Over newline-delimited JSON, if at least four fifths of its lines are JSON."""
    rel = from_lines(lines)
    return digest(rel, question) if accepted(lines, rel) else None
