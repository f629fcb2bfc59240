"""Packing: vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Every document is an item with the vector (tokens, 1 segment, loss-bearing tokens). A sequence is a bin. Among
a pool of pending items the one that fits with the largest dot product of its vector and the bin's free space,
both in units of the limits, is placed next. If no item fits, one is cut: of all heads that the bin has room for the
one with the largest dot product is placed, and the tail stays in the pool. So a bin closes short of its tokens
only if segments are used up, or loss-bearing tokens are and no item begins with others. A bin that is short, as
at a partition's end, is laid out in sequences whose lengths are powers of two, which need no padding. A partition
is packed by itself, in one pass, holding the pool and one batch.

A document's ids are those of its whole text followed by the closing id; null and empty texts have the closing
id alone. Rows that repeat an id are separate documents, null ids too. Ties go to the item that stands first in the
pool. An empty table gives no pieces. Of further columns only those named in `keys` are kept, with their names; keys
named like a result are refused. A very long text is held once as ids, four bytes each, and cut like any other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import plus, read, spare

TOKENS, CLOSING_ID, POOL = 4096, 2, 512
#: Tokens, segments and loss-bearing tokens of a sequence.
LIMITS = (TOKENS, 64, 3584)
#: The characters at a document's start for one of its first ids that bear no loss, so that about the first quarter counts as its prompt.
PROMPT = 16
#: Bytes that a Python worker remembers of words and of their parts, which cost more to make, and of the longest of either.
WORD_BYTES, PART_BYTES, LONGEST = 48 << 20, 64 << 20, 100
ID = attrgetter("id")
RESULTS = ("start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset")


class Words(dict):
    """Values by key; one that is missing is made, and kept if its key is short. When half of `most` bytes are full, what it
    has becomes the old half, from which keys that are asked for again come back; the old half before is dropped."""

    def __init__(self, made: Callable, most: int):
        super().__init__()
        self.made, self.most, self.bytes, self.old = made, most, 0, {}

    def __missing__(self, key) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.made(key)
        if len(key) <= LONGEST:
            self.bytes += len(key) + len(found) + 160  # with what Python needs for both and their place
            if self.bytes > self.most // 2:
                self.old, self.bytes = dict(self), 0
                self.clear()
            self[key] = found
        return found


class WordIds:
    """The ids of whole texts, as bytes of little-endian uint32, by way of a table of words.

    The tokenizer drops white space after its normaliser, and neither its normaliser nor its splitter looks
    past white space, nor does an added token hold any; so a text's ids are those of its words in turn. A run of Latin-1 letters is split from
    the ASCII marks that follow it and lower-cased, so such a word's ids are those of the run and of the marks.
    """

    LETTERS_THEN_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=?@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.parts = Words(self.whole, WORD_BYTES), Words(self.part, PART_BYTES)
        # the signs by which a byte-level model writes bytes: printable Latin-1 as it is, the others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.signs = dict(zip(plain, plain, strict=True)) | {b: 256 + k for k, b in enumerate(others)}

    def part(self, text: str) -> bytes:
        """Ids of a run of lower-case letters or of marks, straight from the model."""
        if not text:
            return b""
        signs = text if text.isascii() else text.encode().decode("latin-1").translate(self.signs)  # ASCII marks and letters are their own signs
        return np.array([*map(ID, self.model.tokenize(signs))], "<u4").tobytes()

    def whole(self, w: bytes) -> bytes:
        """Ids of a word. One with an added token such as <|endoftext|> is never letters and then marks, so the tokenizer sees it."""
        if w.isalpha():  # of bytes: ASCII letters alone
            return self.parts[w.decode().lower()]
        word = w.decode("utf-8", "replace")
        if m := self.LETTERS_THEN_MARKS.fullmatch(word):
            letters, marks = m.groups()
            return self.parts[letters.lower()] + self.parts[marks] if marks else self.parts[letters.lower()]
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").split()))


@cache
def word_ids(path: str) -> WordIds:
    """One table for all tasks of a Python worker."""
    return WordIds(path)


@dataclass
class Item:
    """ids from start on are still to be placed; those from `loss` on bear loss."""

    key: tuple
    ids: bytes
    n: int
    loss: int
    start: int = 0


class Packer:
    """Places items one bin after another; `limits` are tokens, segments and loss-bearing tokens of a bin."""

    def __init__(self, limits: tuple[int, int, int], pool: int = POOL):
        self.limits, self.size = np.array(limits, np.float64), pool
        self.items: list[Item] = []
        self.vectors = np.zeros((pool, 3))

    def add(self, item: Item) -> None:
        self._set(len(self.items), item)

    def full(self) -> bool:
        return len(self.items) >= self.size

    def _set(self, k: int, item: Item) -> None:
        if k == len(self.items):
            self.items.append(item)
        self.vectors[k] = (item.n - item.start, 1, item.n - max(item.start, item.loss))

    def _drop(self, k: int) -> None:
        last = self.items.pop()
        if k < len(self.items):
            self.items[k] = last
            self.vectors[k] = self.vectors[len(self.items)]

    def next_bin(self) -> list[tuple[Item, int, int]]:
        """Pieces (item, start, length) of one bin."""
        free, pieces = self.limits.copy(), []
        while self.items and free[0] > 0 and free[1] > 0:
            have = self.vectors[: len(self.items)]
            worth = free / self.limits**2
            fits = (have <= free).all(1)
            if fits.any():
                k = int(np.argmax(np.where(fits, have @ worth, -1)))
                took = int(have[k, 0])
            else:  # heads that bear no more loss than is free
                others = have[:, 0] - have[:, 2]
                heads = np.minimum(np.minimum(have[:, 0], free[0]), others + free[2])
                scores = heads * worth[0] + worth[1] + np.maximum(heads - others, 0) * worth[2]
                k = int(np.argmax(np.where(heads > 0, scores, -1)))
                took = int(heads[k])
                if took <= 0:
                    break
            item = self.items[k]
            bears = item.start + took - max(item.start, item.loss)
            free -= (took, 1, max(0, bears))
            pieces.append((item, item.start, took))
            item.start += took
            if item.start == item.n:
                self._drop(k)
            else:
                self._set(k, item)
        return pieces


def by_powers_of_two(pieces: list[tuple[Item, int, int]]) -> Iterator[list[tuple[Item, int, int]]]:
    """The pieces of a bin that isn't full, dealt to sequences whose lengths are powers of two."""
    pieces, left = pieces[::-1], sum(p[2] for p in pieces)
    while left:
        room, out = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            item, start, length = pieces.pop()
            took = min(length, room)
            out.append((item, start, took))
            room -= took
            if took < length:
                pieces.append((item, start + took, length - took))
        yield out


def pack(
    docs: DataFrame, tokenizer: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", loss_from: str | None = None,
    limits: tuple[int, int, int] = LIMITS, closing_id: int = CLOSING_ID, pool: int = POOL,
) -> DataFrame:
    """A row for each piece: keys, start, length, ids (little-endian uint32), doc_tokens, loss_tokens, sequence_id, offset.

    tokenizer: path of its file, as the driver and all executors see it. loss_from: a column with the first
    id that bears loss (null or no column: the first).
    """
    if clash := {k.lower() for k in keys} & set(RESULTS):
        raise ValueError(f"keys named like results: {sorted(clash)}")
    held = docs.select(*keys, text, *([loss_from] if loss_from else []))
    schema = plus(StructType(held.schema.fields[: len(keys)]), start="bigint", length="bigint", ids="binary", doc_tokens="bigint", loss_tokens="bigint", sequence_id="bigint", offset="bigint")
    types = [*held.schema.names[: len(keys)]]
    closing = np.array([closing_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = word_ids(tokenizer), Packer(limits, pool)
        sequence, out, key_types = TaskContext.get().partitionId() << 32, [], None

        def put(whole):
            nonlocal sequence
            for pieces in [whole] if sum(p[2] for p in whole) == limits[0] else by_powers_of_two(whole):
                offset = 0
                for item, start, length in pieces:
                    out.append((*item.key, start, length, item.ids[4 * start : 4 * (start + length)], item.n, max(0, start + length - max(start, item.loss)), sequence, offset))
                    offset += length
                sequence += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, [*key_types, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4], strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*types, *RESULTS])

        for b in batches:
            key_types = [b.schema.field(i).type for i in range(len(keys))]
            rows = zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)
            loss = b.column(len(keys) + 1).to_pylist() if loss_from else [0] * b.num_rows
            texts = ["" if x is None else x for x in b.column(len(keys)).to_pylist()]
            for key, ids, first in zip(rows, ids_of(texts), loss, strict=True):
                while packer.full():
                    put(packer.next_bin())
                ids += closing
                n = len(ids) // 4
                packer.add(Item(key, ids, n, min(n, max(0, first or 0))))
                if len(out) >= 2000:
                    yield batch()
        while packer.items:
            put(packer.next_bin())
        if out:
            yield batch()

    return held.mapInArrow(packed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """pack() with limits that bind: a document's first ids, one for PROMPT of its characters, bear no loss."""
    held = docs.select(F.col(key), F.col(text), F.floor(F.char_length(text) / PROMPT).alias(spare("first", [key, text])))
    return pack(held, tokenizer, (key,), text, held.columns[2])


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
