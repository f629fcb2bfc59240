"""All questions about held payloads, by handle: what a user calls, with texts as answers."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import group_value, parse, plain
from ..operators import groups, reduce, rows
from ..operators.aggregate import Agg, ask
from ..operators.joins import join_aggregate, join_group_aggregate, semi_join
from ..operators.predicates import Predicate, Refused, conjunction, parse_predicates
from ..operators.profile import described, fact_card
from ..operators.receipts import Receipt, issue, verify
from ..operators.rows import HITS, PAGE, WINDOW
from ..sources.records import from_json
from ..sources.rel import Rel
from ..sources.store import HeldStore
from . import digest as questions

SHOWN, CACHED = 64, 8


class Engine:
    """Payloads are held under their hashes; parsed ones are kept for the next question, the latest CACHED of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, HeldStore(spark, path)
        self._parsed: OrderedDict[str, Rel | None] = OrderedDict()

    def _bytes(self, handle: str) -> bytes:
        data = self.store.get(handle)
        if data is None:
            raise Refused(f"nothing is held under {handle!r}")
        return data

    def rel(self, handle: str) -> Rel:
        if handle not in self._parsed:
            found = from_json(self.spark, self._bytes(handle))
            self._parsed[handle] = found and Rel(found.df.cache())
            if len(self._parsed) > CACHED:
                _, old = self._parsed.popitem(last=False)
                if old is not None:
                    old.df.unpersist()
        self._parsed.move_to_end(handle)
        if self._parsed[handle] is None:
            raise Refused("the payload isn't a JSON array")
        return self._parsed[handle]

    def ingest(self, payload: bytes, view: str | None = None, target: int = 800) -> str:
        """Holds a payload; its handle and its fact card, outline or summary."""
        handle = self.store.put_bytes(payload)
        if view == "outline":
            return f"{handle}\n{reduce.compact_view(payload, target)[0]}"
        try:
            card = fact_card(self.rel(handle))
        except Refused:
            card = None
        return f"{handle}\n{card or reduce.summary(payload, reduce.detect(payload))}"

    def describe(self, handle: str) -> str | None:
        return described(self.rel(handle))

    def digest(self, handle: str, question: str) -> str | None:
        return questions.digest(self.rel(handle), question)

    def query(self, handle: str, field: str, op: str, value) -> str:
        """The payload with the rows that meet the predicate, and a mark for each run of others."""
        data, r = self._bytes(handle), self.rel(handle)
        kept = {x[0] for x in r.df.where(conjunction(r, [Predicate(field, op, value)])).select("row_id").collect()}
        found, noun = reduce.units(data)
        return reduce.render(reduce.tile(data, found, [k in kept for k in range(len(found))], noun))

    def select(self, handle: str, where: Sequence[dict]) -> str:
        """The handle of the rows that meet all predicates, as a payload of its own."""
        kept = rows.subset(self.rel(handle), parse_predicates(where))
        return self.store.put_bytes(rows.payload(kept).first()[0].encode())

    def pick(self, handle: str, ids: Sequence[int]) -> str:
        r = self.rel(handle)
        return self.store.put_bytes(rows.payload(Rel(rows.pick_ids(r, ids)), order="ord").first()[0].encode()) if ids else self.store.put_bytes(b"[]")

    def aggregate(self, handle: str, agg: Agg, where: Sequence[dict] = ()) -> str | None:
        found = ask(self.rel(handle), parse_predicates(where), agg)
        if found.value is None:
            return None
        ids = [x[0] for x in found.rows.orderBy("row_id").limit(SHOWN).collect()]
        more = f", +{found.n_matched - len(ids)} more" if found.n_matched > len(ids) else ""
        return f"{found.display}\nrows: {', '.join(map(str, ids))}{more}"

    def bucket(self, handle: str, field: str, width: float, agg: Agg) -> str | None:
        n, found = self._first(groups.bucket_aggregate(self.rel(handle), field, width, agg))
        return self._grouped(f"[index] {agg} bucketed by {field} width {plain(float(width))} -> {n} buckets", n, [(plain(r["lower"]) if r["status"] == "ok" else None, r) for r in found])

    def window(self, handle: str, pattern: str, lines: int) -> str:
        df = self.spark.createDataFrame([(self._bytes(handle).decode("utf-8", "replace"),)], "text string")
        n, found = self._first(groups.matches_per_block(df, pattern, lines))
        return "\n".join([f"[lines] '{pattern}' per {lines}-line window -> {n} non-empty windows", *(f"  {r['key_text']}: {r['n']}" for r in found)])

    def join(self, left: str, right: str, left_key: str, right_key: str, agg: Agg, where: Sequence[dict] = (), group: str | None = None) -> str | None:
        a, b = self.rel(left), self.rel(right)
        if group is not None:
            n, found = self._first(join_group_aggregate(a, b, left_key, right_key, group, agg))
            return self._grouped(f"[index] {agg} by right.{group} on {left_key}={right_key} -> {n} groups", n, [(r["key"], r) for r in found])
        predicates = parse_predicates(where)
        got = join_aggregate(a, b, left_key, right_key, predicates, agg).first()
        if got["status"] != "ok":
            return None
        said = " where " + " AND ".join(f"right.{p}" for p in predicates) if predicates else ""
        ids = [x[0] for x in semi_join(a, b, left_key, right_key, predicates).df.select("row_id").orderBy("row_id").limit(SHOWN).collect()]
        return f"[index] {agg} over left ⋉ right on {left_key}={right_key}{said} ({got['n_matched']} matched left records) = {plain(got['value'])}\nrows: {', '.join(map(str, ids))}"

    def _first(self, found: DataFrame) -> tuple[int, list[Row]]:
        """How many rows there are, and the first that are shown; the others stay where they are."""
        return found.count(), found.limit(SHOWN).collect()

    def _grouped(self, head: str, n: int, found: list) -> str | None:
        if any(r["status"] != "ok" for _, r in found):
            return None
        more = [f"  +{n - SHOWN} more"] if n > SHOWN else []
        return "\n".join([head, *(f"  {k}: {group_value(r['value'])} ({r['n_rows']} rows)" for k, r in found), *more])

    def check_claim(self, handle: str, agg: Agg, claimed: float, where: Sequence[dict] = ()) -> str:
        value = ask(self.rel(handle), parse_predicates(where), agg).value
        if value is None:
            return "REFUSED"
        same = abs(value - claimed) <= 1e-9 + 1e-9 * abs(value)
        return f"{'AGREE' if same else 'DISAGREE'}: claimed {plain(float(claimed))}, found {plain(value)}"

    def receipt(self, handle: str, agg: Agg, where: Sequence[dict] = ()) -> str | None:
        got = issue(self.rel(handle), parse_predicates(where), agg, self._bytes(handle))
        return got and got.to_json()

    def verify_receipt(self, handle: str, receipt: str) -> str:
        try:
            got = Receipt.from_json(receipt)
        except (ValueError, TypeError):
            return "MalformedReceipt"
        return verify(got, self.rel(handle))

    def rows(self, handle: str, start: int = 0, limit: int = PAGE) -> str:
        r = self.rel(handle)
        limit = min(limit, rows.MOST_ROWS)
        return "\n".join([rows.page_header(r.df.count(), start, limit), *(x["raw"] for x in rows.page(r, start, limit).select("raw").collect())])

    def json(self, handle: str, path: str) -> str:
        return rows.shown_at_path(parse(self._bytes(handle).decode()), path)

    def lines(self, handle: str, **which) -> str:
        df = self.spark.createDataFrame([(0, self._bytes(handle).decode("utf-8", "replace"))], "doc_id long, text string")
        found = rows.line_range(df, **which).collect()
        if not found:
            return "no lines"
        a, b, n = found[0]["line_no"], found[-1]["line_no"], found[0]["n_lines"]
        return "\n".join([f"lines {a}..{b} of {n} ({a - 1} before, {n - b} after)", *(f"{r['line_no']:>6}|{r['line']}" for r in found)])

    def search(self, handle: str, pattern: str, limit: int = HITS) -> str:
        data = self._bytes(handle).decode("utf-8", "replace")
        df = self.spark.createDataFrame([(0, data)], "doc_id long, text string")
        hits = rows.search_lines(df, pattern)
        n, some = hits.count(), hits.orderBy("line_no").limit(limit).collect()
        total = df.select(F.size(F.split(F.lit(data), "\n", -1)) - F.lit(int(data.endswith("\n") or not data))).first()[0]
        head = f'{n} matches for "{pattern}" in {total} lines' + (f" (showing {len(some)}, {n - len(some)} omitted)" if n else "")
        return "\n".join([head, *(f"{r['line_no']:>6}|{r['line']}" for r in some)])

    def retrieve(self, handle: str, start: int = 0, size: int = WINDOW, full: bool = False) -> str:
        df = self.spark.createDataFrame([(bytearray(self._bytes(handle)),)], "b binary")
        w = df.select(rows.byte_window(F.col("b"), start, size, full).alias("w")).first()["w"]
        return f"bytes {w['start']}..{w['end']} of {w['total']} ({w['start']} before, {w['total'] - w['end']} after)\n{w['text']}"

    def unfold(self, prefix: str, **window) -> str:
        """What is behind a mark, by the hash that it shows."""
        return self.retrieve(prefix, **window)

    def reduce(self, payload: bytes, **budget) -> str:
        """The view of a payload within a budget; what it leaves out is held."""
        segments = reduce.Compressor(**budget)(payload)
        held = [(bytearray(s.data),) for s in segments if s.hash]
        if held:
            self.store.put(self.spark.createDataFrame(held, "bytes binary"))
        return reduce.render(segments)

    def status(self) -> str:
        r = self.store.stats().first()
        return f"{r['blobs']} payloads, {r['total_bytes']} bytes, {r['corrupt']} damaged"
