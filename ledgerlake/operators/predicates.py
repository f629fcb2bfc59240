"""Comparisons of a field with a value, and their conjunctions.

Two numbers or two strings compare in all six ways; anything else only by equality of values, so an order
between kinds is false and "not equal" is true. A field that is absent fails every comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.json_text import Number, canonical, parse, plain
from ..sources.rel import Rel

OPS = {"eq": eq, "ne": ne, "gt": gt, "ge": ge, "lt": lt, "le": le}
SIGNS = {"eq": "==", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
NAMES = {"=": "eq", "==": "eq", "!=": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"} | {k: k for k in OPS}


class Refused(ValueError):
    """A question that has no exact answer, with the reason."""


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: object

    def __post_init__(self):
        if self.op not in OPS:
            raise Refused(f"unknown comparison {self.op!r}")

    def __str__(self):
        return f"{self.field} {SIGNS[self.op]} {literal(self.value)}"


def literal(value) -> str:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return plain(float(value))
    return canonical(value)


def parse_op(sign: str) -> str:
    """The name of a comparison; an unknown one is refused, not taken for equality."""
    if sign not in NAMES:
        raise Refused(f"unknown comparison {sign!r}")
    return NAMES[sign]


def parse_value(text: str):
    """A JSON value, else the text itself; numbers become numbers."""
    try:
        value = parse(text)
    except ValueError:
        return text
    return value.value if isinstance(value, Number) and value.value is not None else value


def parse_predicates(items: Iterable[dict]) -> list[Predicate]:
    """From {field, op, value} with the value as JSON text or a JSON value."""
    out = []
    for x in items:
        if not isinstance(x.get("field"), str) or "value" not in x:
            raise Refused("a predicate has a field, an op and a value")
        value = x["value"]
        out.append(Predicate(x["field"], parse_op(x.get("op", "eq")), parse_value(value) if isinstance(value, str) else value))
    return out


def condition(rel: Rel, p: Predicate) -> Column:
    c, compare = rel.cell(p.field), OPS[p.op]
    unlike = F.lit(p.op == "ne")
    if isinstance(p.value, (int, float)) and not isinstance(p.value, bool) and math.isfinite(p.value):
        met = F.when(c.is_num, compare(c.exact if rel.typed else c.num, F.lit(p.value))).otherwise(unlike)
    elif isinstance(p.value, str) and not isinstance(p.value, Number):
        met = F.when(c.is_str, compare(c.str, F.lit(p.value))).otherwise(unlike)
    elif p.op in ("eq", "ne"):
        same = ~c.is_num & ~c.is_str & (c.canon == F.lit(canonical(p.value)))
        met = same if p.op == "eq" else ~same
    else:
        met = F.lit(False)
    return c.present & F.coalesce(met, F.lit(False))


def conjunction(rel: Rel, predicates: Sequence[Predicate]) -> Column:
    return reduce(and_, (condition(rel, p) for p in predicates), F.lit(True))


def keep(rel: Rel, predicates: Sequence[Predicate]) -> Rel:
    """Rows that meet all predicates; without any, all rows."""
    return rel.where(conjunction(rel, predicates)) if predicates else rel
