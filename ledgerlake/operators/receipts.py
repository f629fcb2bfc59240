"""Receipts: an aggregate's question, answer and backing rows, to be verified later against the same data."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from ..sources.rel import Rel
from .aggregate import Agg, ask
from .predicates import Predicate, Refused
from .rows import payload, pick_ids

VALID, MALFORMED, REFUSED, VALUE, TAMPERED = "Valid", "MalformedReceipt", "Refused", "ValueMismatch", "BackingTampered"


@dataclass(frozen=True)
class Receipt:
    query: list[dict]
    agg: str
    agg_field: str | None
    value: float
    matched: list[int]
    backing_sha256: str
    input_len: int
    input_sha256: str
    issued_unix: int | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Receipt:
        return cls(**json.loads(text))


def backing(rel: Rel, ids: list[int], raw: str) -> str:
    """SHA-256 of the picked rows as a JSON array."""
    picked = pick_ids(rel, ids)
    row = payload(Rel(picked, rel.fields), raw, "ord").first()
    return hashlib.sha256((row[0] or "[]").encode()).hexdigest()


def issue(rel: Rel, predicates: list[Predicate], agg: Agg, held: bytes, raw: str = "raw") -> Receipt | None:
    """A receipt, or None if the question is refused. held: the bytes of the payload."""
    answer = ask(rel, predicates, agg)
    if answer.value is None:
        return None
    ids = answer.matched
    return Receipt([asdict(p) for p in predicates], agg.kind, agg.field, answer.value, ids, backing(rel, ids, raw), len(held), hashlib.sha256(held).hexdigest())


def verify(receipt: Receipt, rel: Rel, raw: str = "raw") -> str:
    """The verdict. The payload's own hash is on the receipt for information and isn't compared."""
    try:
        predicates = [Predicate(q["field"], q["op"], q["value"]) for q in receipt.query]
        agg = Agg(receipt.agg, receipt.agg_field)
    except (Refused, KeyError, TypeError):
        return MALFORMED
    answer = ask(rel, predicates, agg)
    if answer.value is None:
        return REFUSED
    if abs(answer.value - receipt.value) > 1e-9 + 1e-9 * abs(receipt.value):
        return VALUE
    try:
        return VALID if answer.matched == list(receipt.matched) and backing(rel, list(receipt.matched), raw) == receipt.backing_sha256 else TAMPERED
    except Refused:
        return TAMPERED
