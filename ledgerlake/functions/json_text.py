"""JSON values that keep the text of their numbers, and their canonical text."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal


class Number(str):
    """A number as it was written."""

    __slots__ = ()

    @property
    def value(self) -> float | None:
        """As a double; None if it is out of range."""
        x = float(self)
        return x if math.isfinite(x) else None


def _refuse(text: str):
    raise ValueError(f"{text} is not JSON")


DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)
SPACE = " \t\n\r"
BLANK = re.compile(r"[ \t\n\r]*")


def parse(text: str):
    """The value of a JSON text; ValueError if it isn't one."""
    try:
        value, end = DECODER.raw_decode(text, len(text) - len(text.lstrip(SPACE)))
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    if text[end:].strip(SPACE):
        raise ValueError("text after the value")
    return value


def elements(text: str) -> Iterator[tuple[int, int, object]]:
    """(start, end, value) of each element of a top-level array, in characters; ValueError if it isn't one array."""
    skip = lambda at: BLANK.match(text, at).end()
    at = skip(0)
    if text[at : at + 1] != "[":
        raise ValueError("not an array")
    at = skip(at + 1)
    if text[at : at + 1] == "]":
        if text[at + 1 :].strip(SPACE):
            raise ValueError("text after the array")
        return
    while True:
        try:
            value, end = DECODER.raw_decode(text, at)
        except RecursionError as e:
            raise ValueError("nested too deeply") from e
        yield at, end, value
        at = skip(end)
        mark = text[at : at + 1]
        if mark == "]":
            if text[at + 1 :].strip(SPACE):
                raise ValueError("text after the array")
            return
        if mark != ",":
            raise ValueError("expected , or ]")
        at = skip(at + 1)


def canonical(value) -> str:
    """Compact JSON text; numbers as they were written, keys in their order."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def pretty(value, indent: str = "") -> str:
    """Indented JSON text, by two spaces."""
    inner = indent + "  "
    if isinstance(value, dict) and value:
        return "{\n" + ",\n".join(f"{inner}{json.dumps(k, ensure_ascii=False)}: {pretty(v, inner)}" for k, v in value.items()) + f"\n{indent}}}"
    if isinstance(value, list) and value:
        return "[\n" + ",\n".join(inner + pretty(v, inner) for v in value) + f"\n{indent}]"
    return canonical(value)


def plain(x: float) -> str:
    """A double in decimal without an exponent, and without a fraction if it is whole."""
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    return f"{int(x)}" if x == int(x) and abs(x) < 1e16 else f"{Decimal(repr(x)):f}"


def group_value(x: float) -> str:
    """How a group's value is shown: whole numbers below 10^15 as integers."""
    return f"{int(x)}" if x == int(x) and abs(x) < 1e15 else plain(x)
