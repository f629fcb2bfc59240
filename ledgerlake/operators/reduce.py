"""Reduction of payloads to a view within a token budget, of which every byte can be had back.

A payload is tiled by segments: bytes shown as they are, and references to bytes that are held under their
hash. Units are the elements of a top-level JSON array or the lines of a text; the view keeps the first and
last of them, and each maximal run of dropped units is one reference. Payloads are independent, so Spark's
part is to reduce many of them at once (`reduce_payloads`), each within a task.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import elements, parse
from ..functions.payload import JSON, LOG, MARK, TEXT, detect, lines, outline, tokens

LEAST_BYTES, REDUCTION, CEILING, LEAST_BODY = 256, 0.8, 4_000, 1024
OFFLOAD_TOKENS, PREVIEW, DESCRIBED = 10_000, 400, 1200
EXPLAINER = "[Parts of this output are held back; <<ref:HASH ...>> marks can be retrieved by their hash.]\n"


class Lost(ValueError):
    """A reference can't be resolved: MissingOriginal, LengthMismatch or HashMismatch."""


@dataclass(frozen=True)
class Segment:
    """Bytes as they are, or (hash, summary) of bytes that are held."""

    data: bytes
    hash: str | None = None
    summary: str | None = None

    @property
    def shown(self) -> str:
        return self.data.decode("utf-8", "replace") if self.hash is None else f"{MARK}:{self.hash[:12]} {self.summary}>>"


def ref(data: bytes, summary: str) -> Segment:
    return Segment(data, hashlib.sha256(data).hexdigest(), summary)


def render(segments: Sequence[Segment]) -> str:
    return "".join(s.shown for s in segments)


def reconstruct(segments: Sequence[tuple[bytes | None, str | None, int]], get: Callable[[str], bytes | None]) -> bytes:
    """The bytes of (data or None, hash, original length) segments; get resolves hashes."""
    out = []
    for data, digest, length in segments:
        if digest is None:
            out.append(data)
            continue
        held = get(digest)
        if held is None:
            raise Lost(f"MissingOriginal {digest}")
        if len(held) != length:
            raise Lost(f"LengthMismatch {digest}")
        if hashlib.sha256(held).hexdigest() != digest:
            raise Lost(f"HashMismatch {digest}")
        out.append(held)
    return b"".join(out)


def units(payload: bytes, kind: str | None = None) -> tuple[list[tuple[int, int]], str]:
    """(byte ranges, noun): elements of a JSON array, or lines with their ends; a text has none."""
    kind = kind or detect(payload)
    if kind == JSON:
        text = payload.decode()
        try:
            found = [(a, b) for a, b, _ in elements(text)]
        except ValueError:
            return [], "items"
        if len(text) != len(payload):  # characters to bytes
            at = np.cumsum([0, *(len(c.encode()) for c in text)])
            found = [(int(at[a]), int(at[b])) for a, b in found]
        return found, "items"
    return (line_units(payload), "lines") if kind == LOG else ([], "lines")


def line_units(payload: bytes) -> list[tuple[int, int]]:
    """Byte ranges of lines, ends included."""
    ends = [i + 1 for i, c in enumerate(payload) if c == 10]
    if payload and (not ends or ends[-1] < len(payload)):
        ends.append(len(payload))
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def tile(payload: bytes, found: Sequence[tuple[int, int]], kept: Sequence[bool], noun: str) -> list[Segment]:
    """Segments in which each maximal run of units that aren't kept is one reference."""
    out, shown, k = [], 0, 0
    while k < len(found):
        if kept[k]:
            k += 1
            continue
        first = k
        while k < len(found) and not kept[k]:
            k += 1
        start, end = found[first][0], found[k - 1][1]
        if start > shown:
            out.append(Segment(payload[shown:start]))
        out.append(ref(payload[start:end], f"+{k - first} {noun}"))
        shown = end
    if shown < len(payload) or not out:
        out.append(Segment(payload[shown:]))
    return out


def keep_units(payload: bytes, keep: Callable[[bytes], bool]) -> list[Segment]:
    """Keeps the units that a predicate on their bytes keeps."""
    found, noun = units(payload)
    return tile(payload, found, [keep(payload[a:b]) for a, b in found], noun)


def first_of_runs(payload: bytes, found: Sequence[tuple[int, int]]) -> list[bool]:
    """Whether a unit's bytes differ from those of the unit before it."""
    return [k == 0 or payload[a:b] != payload[slice(*found[k - 1])] for k, (a, b) in enumerate(found)]


def drop_repeats(payload: bytes) -> list[Segment]:
    found, noun = units(payload)
    return tile(payload, found, first_of_runs(payload, found), noun)


def summary(payload: bytes, kind: str) -> str:
    if kind == LOG:
        return f"log, {len(lines(payload.decode('utf-8', 'replace')))} lines"
    if kind == TEXT:
        return f"text, {len(payload)} bytes"
    value = parse(payload.decode())
    keys = ",".join(value if isinstance(value, dict) else value[0] if value and isinstance(value[0], dict) else ())
    if isinstance(value, list):
        return f"json array, {len(value)} items" + (f", keys: {keys}" if keys else "")
    return f"json object, keys: {keys}"


def offload(payload: bytes, least: int = LEAST_BYTES, any_kind: bool = False) -> list[Segment]:
    """The whole payload as one reference, if it is large enough and JSON or a log (or any kind)."""
    kind = detect(payload)
    if len(payload) < least or kind == TEXT and not any_kind:
        return [Segment(payload)]
    return [ref(payload, summary(payload, kind))]


def target_for(raw: int, reduction: float) -> int:
    """Tokens that are left after a reduction; nothing if it isn't a number."""
    return 0 if math.isnan(reduction) else int(math.floor(raw * (1 - min(max(reduction, 0.0), 1.0)) + 0.5))


def window_mask(n: int, candidates: np.ndarray, m: int) -> np.ndarray:
    """The first half of m candidates, rounded up, and the last half."""
    mask = np.zeros(n, bool)
    mask[candidates[: -(-m // 2)]] = True
    if m // 2:
        mask[candidates[-(m // 2) :]] = True
    return mask


def shown_chars(chars_at: np.ndarray, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, noun: str) -> int:
    """Characters of the view that a mask of kept units makes, without making it."""
    edge = np.diff(np.concatenate(([0], (~mask).astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    hidden = int((chars_at[ends[last]] - chars_at[starts[first]]).sum())
    marks = sum(len(f"{MARK}:") + 12 + len(f" +{n} {noun}>>") for n in (last - first + 1).tolist())
    return int(chars_at[-1]) - hidden + marks


def reduce_to(payload: bytes, target: int | None = None, reduction: float | None = None, whole: bool = False, least: int = LEAST_BYTES) -> list[Segment]:
    """Segments whose view fits `target` tokens, or a reduction of the payload's; whole: as small as can be."""
    text = payload.decode("utf-8", "replace")
    raw = tokens(text)
    if whole:
        return offload(payload, least, any_kind=True)
    if target is None:
        if reduction is None or math.isnan(reduction) or reduction <= 0:
            return [Segment(payload)]
        target = target_for(raw, reduction)
    if target >= raw:
        return [Segment(payload)]
    kind = detect(payload)
    found, noun = units(payload, LOG if kind == TEXT else kind)
    if kind == TEXT and len(found) < 2 or not found:
        return offload(payload, least, any_kind=True)
    starts, ends = (np.array(x) for x in zip(*found, strict=True))
    lead = np.frombuffer(payload, np.uint8)
    valid = len(text.encode("utf-8", "replace")) == len(payload)
    chars_at = np.append(0, np.cumsum((lead & 0xC0) != 0x80)) if valid else np.append(0, np.cumsum([1] * len(payload)))
    candidates = np.flatnonzero(first_of_runs(payload, found)) if kind == LOG else np.arange(len(found))
    low, high = 0, len(candidates)
    while low < high:
        mid = (low + high + 1) // 2
        if -(-shown_chars(chars_at, starts, ends, window_mask(len(found), candidates, mid), noun) // 4) <= target:
            low = mid
        else:
            high = mid - 1
    return tile(payload, found, window_mask(len(found), candidates, low), noun)


def compact_view(payload: bytes, target: int) -> tuple[str, Segment]:
    """(outline that fits `target` tokens, the reference to the whole): a mark, then the outline's first and last lines."""
    held = ref(payload, f"code view, {len(payload)} bytes")
    view, header = outline(payload.decode("utf-8", "replace")), held.shown + "\n"
    if tokens(header + view) <= target:
        return header + view, held
    if tokens(header) >= target:
        return header, held
    rows = lines(view)

    def some(m: int) -> str:
        if m >= len(rows):
            return "".join(f"{x}\n" for x in rows)
        if not m:
            return ""
        gap = [f"... {len(rows) - m} compact-view lines omitted to fit budget ..."]
        return "".join(f"{x}\n" for x in [*rows[: -(-m // 2)], *gap, *(rows[-(m // 2) :] if m // 2 else [])])

    low, high = 0, len(rows)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if tokens(header + some(mid)) <= target else (low, mid - 1)
    return header + some(low), held


def rewrite_text(text: str, least: int = LEAST_BODY, reduction: float = REDUCTION, ceiling: int = CEILING, explain: bool = True) -> tuple[str, list[Segment]] | None:
    """A shorter text and its segments, or None: prose is left alone up to the ceiling, and nothing may grow."""
    data = text.encode()
    if len(data) < least:
        return None
    if not (math.isfinite(reduction) and 0 <= reduction < 1):
        reduction = REDUCTION
    raw = tokens(text)
    if detect(data) == TEXT:
        if not ceiling or raw <= ceiling:
            return None
        target = ceiling
    else:
        target = int(raw * (1 - reduction))
        target = max(1, min(target, ceiling) if ceiling else target)
    segments = reduce_to(data, target, least=0)
    out = (EXPLAINER if explain else "") + render(segments)
    return (out, segments) if len(out.encode()) < len(data) else None


def body_texts(value, shape: str) -> Iterator[tuple[dict | list, object]]:
    """(holder, key) of each tool-output string of a request body: messages, responses or chat."""
    rows = value.get("input" if shape == "responses" else "messages") if isinstance(value, dict) else None
    for m in rows if isinstance(rows, list) else []:
        if not isinstance(m, dict):
            continue
        if shape == "chat":
            if m.get("role") == "tool" and isinstance(m.get("content"), str):
                yield m, "content"
            continue
        if shape == "responses":
            holders = [(m, "output")] if str(m.get("type", "")).endswith("_call_output") else []
        else:
            content = m.get("content")
            holders = [(b, "content") for b in content if isinstance(b, dict) and b.get("type") == "tool_result"] if isinstance(content, list) else []
        for holder, field in holders:
            held = holder.get(field)
            if isinstance(held, str):
                yield holder, field
            elif isinstance(held, list):
                for c in held:
                    if isinstance(c, dict) and isinstance(c.get("text"), str) and (shape == "responses" or c.get("type") == "text"):
                        yield c, "text"


def rewrite_body(body: str, shape: str = "messages", **options) -> tuple[str, str, list[Segment]]:
    """(body, kind, segments): compressed, no_shrink, or passthrough of what can't be read."""
    if len(body.encode()) < options.get("least", LEAST_BODY):
        return body, "passthrough", []
    try:
        value = json.loads(body)
    except ValueError:
        return body, "passthrough", []
    if not isinstance(value, dict) or not isinstance(value.get("input" if shape == "responses" else "messages"), list):
        return body, "passthrough", []
    found, some, held = False, False, []
    for holder, key in body_texts(value, shape):
        some = True
        if (new := rewrite_text(holder[key], **options)) is not None:
            holder[key], found = new[0], True
            held += new[1]
    if not found:
        return body, "no_shrink" if some or shape != "messages" else "passthrough", []
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")), "compressed", held


SEGMENTS = "array<struct<data:binary,hash:string,summary:string,original_len:bigint>>"
_SEGMENTS = pa.list_(pa.struct([("data", pa.binary()), ("hash", pa.string()), ("summary", pa.string()), ("original_len", pa.int64())]))


def reduce_payloads(df: DataFrame, key: str, payload: str, method: Callable[[bytes], list[Segment]]) -> DataFrame:
    """(key, view, tokens_before, tokens_after, segments): method over many payloads; references keep their bytes in data, to be held."""
    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", "view string", "tokens_before bigint", "tokens_after bigint", f"segments {SEGMENTS}"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                data = data or b""
                segments = method(data)
                view = render(segments)
                rows.append((view, tokens(data.decode("utf-8", "replace")), tokens(view), [{"data": s.data, "hash": s.hash, "summary": s.summary, "original_len": len(s.data)} for s in segments]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.int64(), pa.int64(), _SEGMENTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "view", "tokens_before", "tokens_after", "segments"])

    return df.select(key, F.col(payload).cast("binary").alias(payload)).mapInArrow(made, schema)


def attest(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(samples, passed, bytes_round_tripped, first_failure): each payload is offloaded as far as it can be and had back."""
    out = reduce_payloads(df, key, payload, lambda data: reduce_to(data, 0)).join(df.select(key, F.col(payload).cast("binary").alias("_p")), key)
    back = F.aggregate("segments", F.lit("").cast("binary"), lambda a, s: F.concat(a, s["data"]))
    sound = F.forall("segments", lambda s: s["hash"].isNull() | (F.sha2(s["data"], 256) == s["hash"]))
    ok = (back == F.coalesce("_p", F.lit("").cast("binary"))) & sound
    return out.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(ok).alias("passed"), F.coalesce(F.sum(F.when(ok, F.octet_length("_p"))), F.lit(0)).cast("bigint").alias("bytes_round_tripped"), F.min(F.when(~ok, F.col(key))).alias("first_failure"),
    )


def offload_card(text: str, described: str | None, threshold: int = OFFLOAD_TOKENS, is_error: bool = False) -> str | None:
    """A card in place of a text above the threshold, or None: hash, profile or shape, and a preview. Errors are left alone."""
    size = tokens(text)
    if is_error or size <= threshold:
        return None
    data = text.encode()
    clip = lambda s, n: s if len(s) <= n else s[:n] + "…"
    try:
        value = parse(text)
        if isinstance(value, list):
            fields = ", ".join(list(value[0])[:12]) if value and isinstance(value[0], dict) else ""
            shape = f"shape: JSON array, {len(value)} rows; fields: {fields}" if fields else f"shape: JSON array, {len(value)} elements"
        else:
            shape = f"shape: JSON object, {len(value)} top-level keys" if isinstance(value, dict) else "shape: JSON scalar"
    except ValueError:
        shape = f"shape: text, {text.count(chr(10)) + 1} lines"
    return "\n".join([f"[held] {len(data)} bytes, about {size} tokens, over the threshold of {threshold}", f"handle: {hashlib.sha256(data).hexdigest()}", clip(described, DESCRIBED) if described else shape, "preview:", clip(text, PREVIEW)])


@dataclass(frozen=True)
class Compressor:
    """Settings for reducing payloads; exactly one of target, reduction and whole is set."""

    target: int | None = None
    reduction: float | None = None
    whole: bool = False
    least: int = LEAST_BYTES

    def __post_init__(self):
        if (self.target is not None) + (self.reduction is not None) + self.whole != 1:
            raise ValueError("a target, a reduction, or the whole")

    def __call__(self, payload: bytes) -> list[Segment]:
        return reduce_to(payload, self.target, self.reduction, self.whole, self.least)


def rewrite_bodies(df: DataFrame, key: str, body: str, shape: str = "messages", **options) -> DataFrame:
    """(key, body, kind, bytes_before, bytes_after, segments) of many request bodies; what can't be read passes through."""
    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", "body string", "kind string", "bytes_before bigint", "bytes_after bigint", f"segments {SEGMENTS}"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                new, kind, held = rewrite_body(text or "", shape, **options)
                rows.append((new, kind, len((text or "").encode()), len(new.encode()), [{"data": s.data, "hash": s.hash, "summary": s.summary, "original_len": len(s.data)} for s in held if s.hash]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), _SEGMENTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "body", "kind", "bytes_before", "bytes_after", "segments"])

    return df.select(key, body).mapInArrow(made, schema)


def metrics(rewritten: DataFrame) -> DataFrame:
    """(kind, bodies, bytes_before, bytes_saved) of rewrite_bodies."""
    return rewritten.groupBy("kind").agg(F.count(F.lit(1)).alias("bodies"), F.sum("bytes_before").alias("bytes_before"), F.sum(F.col("bytes_before") - F.col("bytes_after")).alias("bytes_saved"))


def capture(rewritten: DataFrame, path: str) -> None:
    """Writes what was done to each body as JSON lines, without the bodies."""
    rewritten.select(F.col(rewritten.columns[0]).alias("seq"), "kind", "bytes_before", "bytes_after", (F.col("bytes_before") - F.col("bytes_after")).alias("delta")).write.mode("append").json(path)


def truncation_window(costs: Sequence[int], budget: int) -> list[int]:
    """Rows that a view without an index keeps: from the front and the back in turn while they fit the budget."""
    kept, front, back, left, at_front = [], 0, len(costs) - 1, budget, True
    while front <= back:
        k = front if at_front else back
        if costs[k] > left:
            break
        kept.append(k)
        left -= costs[k]
        front, back, at_front = (front + 1, back, False) if at_front else (front, back - 1, True)
    return sorted(kept)
