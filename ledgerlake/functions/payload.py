"""Functions of one whole payload: its type, its secrets, its outline, its size in tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json_text import parse

JSON, LOG, TEXT = "json", "log", "text"
# What git status prints.
BRANCH = ("On branch ", "HEAD detached", "Not currently on any branch")
SECTIONS = {"Changes to be committed:", "Changes not staged for commit:", "Untracked files:", "Unmerged paths:"}
ENTRIES = ("modified:", "new file:", "deleted:", "renamed:", "copied:", "both modified:", "both deleted:", 'use "git add')
# Beginnings of secret tokens, the length from which they count (bytes), and what parts tokens.
SECRET_PREFIXES = ("sk-", "sk_live_", "pk_live_", "rk_live_", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "AKIA", "ASIA", "AIza", "ya29.", "AGPA")
SECRET_BYTES = 12
SEPARATORS = r"""[^\s"',:;=(){}\[\]<>&?/\\`|]+"""
# Beginnings of lines that an outline of code keeps, and what such a line may have within.
OUTLINE = (
    "#[", "@", "use ", "pub use ", "mod ", "pub mod ", "struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "type ", "pub type ", "const ", "pub const ", "static ", "pub static ",
    "impl ", "class ", "export class ", "interface ", "export interface ", "function ", "export function ", "export type ", "fn ", "pub fn ", "async fn ", "pub async fn ",
)
OUTLINE_WITHIN = " fn "
MARK = "<<ref"


def lines(text: str) -> list[str]:
    """Lines without their ends; CR LF counts as one end, and a final end begins no line."""
    found = text.split("\n")
    if found[-1] == "":
        found.pop()
    return [x.removesuffix("\r") for x in found]


def detect(payload: bytes) -> str:
    """json if the whole is valid JSON that begins as array or object; log for bulk output; else text."""
    head = payload.lstrip(b" \t\n\r")[:1]
    try:
        text = payload.decode("utf-8")
    except UnicodeDecodeError:
        return TEXT
    if head in (b"[", b"{"):
        try:
            parse(text)
            return JSON
        except ValueError:
            pass
    found = lines(text)
    return LOG if is_bulk(found) or is_git_status(found) else TEXT


def is_bulk(found: list[str]) -> bool:
    """Most lines begin with a digit or a bracket, or first words repeat very much."""
    if len(found) >= 8 and 2 * sum(bool(re.match(r"\s*[0-9\[]", x)) for x in found) >= len(found):
        return True
    words = [re.match(r"[^\s:]*", x.lstrip())[0] for x in found if x.strip()]
    return len(found) >= 16 and len(words) >= 16 and 10 * len(set(words)) <= len(words)


def is_git_status(found: list[str]) -> bool:
    return (
        len(found) >= 8 and any(x.startswith(BRANCH) for x in found[:4])
        and any(x.rstrip() in SECTIONS for x in found) and any(x.lstrip().startswith(ENTRIES) for x in found)
    )


def redact(text: str, mark: str = MARK) -> tuple[str, list[tuple[str, str, str]]]:
    """(masked text, (marker, value, hash) of each secret in order)."""
    secrets: list[tuple[str, str, str]] = []

    def masked(m: re.Match) -> str:
        token = m[0]
        if len(token.encode()) < SECRET_BYTES or not token.startswith(SECRET_PREFIXES):
            return token
        digest = hashlib.sha256(token.encode()).hexdigest()
        secrets.append((f"{mark}-redacted:{digest[:12]}>>", token, digest))
        return secrets[-1][0]

    return re.sub(SEPARATORS, masked, text), secrets


def redact_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, masked, secrets) of many texts: a marker for each secret token, and the tokens in order with their hashes, to be held."""
    kind = pa.list_(pa.struct([("marker", pa.string()), ("value", pa.string()), ("hash", pa.string())]))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [redact(t or "") for t in b.column(1).to_pylist()]
            secrets = [[dict(zip(("marker", "value", "hash"), x, strict=True)) for x in held] for _, held in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array(secrets, kind)], names=[key, "masked", "secrets"])

    return df.select(key, text).mapInArrow(made, f"`{key}` {df.schema[key].dataType.simpleString()}, masked string, secrets array<struct<marker:string,value:string,hash:string>>")


def outline(text: str) -> str:
    """Structural lines of code, with the number of other lines between them; the text itself if it has none."""
    out = []
    structural_ = lambda x: x.lstrip().startswith(OUTLINE) or OUTLINE_WITHIN in x.lstrip()
    kept = [(structural_(x), x) for x in lines(text) if x.strip()]
    if not any(k for k, _ in kept):
        return f"// ... {len(kept)} non-structural lines omitted ...\n" if kept else text
    for structural, group in groupby(kept, key=lambda x: x[0]):
        rows = [x for _, x in group]
        out += [x.rstrip() for x in rows] if structural else [f"// ... {len(rows)} non-structural lines omitted ..."]
    return "".join(f"{x}\n" for x in out)


def tokens(text: str) -> int:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return -(-len(text) // 4)


def token_estimate(text: Column) -> Column:
    """The same as a column."""
    return F.ceil(F.char_length(text) / 4).cast("bigint")


def secret_tokens(text: Column) -> Column:
    """The secret tokens of a text, in order, without Python."""
    begins = "|".join(map(re.escape, SECRET_PREFIXES))
    return F.filter(F.regexp_extract_all(text, F.lit(SEPARATORS), F.lit(0)), lambda t: (F.octet_length(t) >= SECRET_BYTES) & t.rlike(f"^(?:{begins})"))
