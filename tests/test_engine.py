"""Questions by handle, from end to end."""

import json

import pytest

from ledgerlake.operators import reduce
from ledgerlake.operators.aggregate import Agg
from ledgerlake.operators.predicates import Refused
from ledgerlake.plans.engine import Engine
from ledgerlake.sources.rel import Rel
from ledgerlake.sources.synthetic import NEEDLE, pods

DATA = [{"name": f"n{i}", "dock": i % 3, "v": i * 1.5, "s": "ok" if i % 4 else "bad"} for i in range(30)]


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "held"))
    h = e.ingest(json.dumps(DATA).encode()).split("\n")[0]
    right = e.ingest(b'[{"berth":0,"g":"x"},{"berth":1,"g":"y"},{"berth":2,"g":"x"}]').split("\n")[0]
    assert e.aggregate(h, Agg("sum", "v"), [{"field": "s", "op": "=", "value": "bad"}]).startswith('[index] sum(v) where s == "bad" over 8 matched records = 168\nrows: 0, 4, 8')
    part = e.select(h, [{"field": "v", "op": "<", "value": 4}])
    assert json.loads(e.store.get(part)) == DATA[:3]
    assert json.loads(e.store.get(e.pick(h, [5, 1, 5]))) == [DATA[5], DATA[1], DATA[5]] and e.store.get(e.pick(h, [])) == b"[]"
    with pytest.raises(Refused):
        e.pick(h, [99])
    assert e.bucket(h, "v", 20, Agg("count")).splitlines()[1] == "  0: 14 (14 rows)"
    assert e.join(h, right, "dock", "berth", Agg("count"), group="g").splitlines()[1:] == ['  "x": 20 (20 rows)', '  "y": 10 (10 rows)']
    assert "(10 matched left records) = 10" in e.join(h, right, "dock", "berth", Agg("count"), [{"field": "g", "op": "eq", "value": "y"}])
    assert e.digest(h, "how many records are there").endswith("= 30") and "30 records, 4 fields" in e.describe(h)
    receipt = e.receipt(h, Agg("max", "v"))
    assert e.verify_receipt(h, receipt) == "Valid" and e.verify_receipt(h, "{}") == "MalformedReceipt" and e.verify_receipt(part, receipt) == "ValueMismatch"
    assert e.check_claim(h, Agg("count"), 30).startswith("AGREE") and e.check_claim(h, Agg("sum", "s"), 1) == "REFUSED"
    assert e.rows(h, 28, 5).splitlines()[0] == "rows 28..30 of 30 (28 before, 0 after)" and e.json(h, "$[2].name") == '"n2"'
    view = e.query(h, "v", "lt", 3)
    assert "+28 items>>" in view and '"n1"' in view
    text = e.ingest(b"alpha\nbeta\nAlphabet\n").split("\n")[0]
    assert e.search(text, "alpha").splitlines()[0] == '2 matches for "alpha" in 3 lines (showing 2, 0 omitted)'
    assert e.lines(text, tail=1).splitlines() == ["lines 3..3 of 3 (2 before, 0 after)", "     3|Alphabet"]
    assert e.window(text, "ALPHA", 2).splitlines()[1] == "  lines 1-2: 1"
    assert e.retrieve(text, 6, 4) == "bytes 6..10 of 20 (6 before, 10 after)\nbeta"
    reduced = e.reduce(json.dumps(DATA).encode(), target=150)
    mark = reduced.split("<<ref:")[1][:12]
    assert '"n15"' in e.unfold(mark) and e.status().endswith("0 damaged")
    with pytest.raises(Refused):
        e.describe("0" * 64)


def test_bodies_and_baseline(spark):
    log = "\n".join(f"2024 event {i}" for i in range(900))
    body = json.dumps({"messages": [{"role": "tool", "content": log}]})
    out = reduce.rewrite_bodies(spark.createDataFrame([(1, body), (2, "no json " * 300), (3, None)], "id long, body string"), "id", "body", "chat")
    got = {r["kind"]: (r["bodies"], r["bytes_saved"]) for r in reduce.metrics(out).collect()}
    assert got["passthrough"] == (2, 0) and got["compressed"][1] > 5000
    assert reduce.truncation_window([5, 5, 5, 5, 5], 16) == [0, 1, 4] and reduce.truncation_window([], 5) == []
    with pytest.raises(ValueError):
        reduce.Compressor()


def test_the_needle_is_found(spark):
    from ledgerlake.operators import groups

    df = pods(spark, 500)
    r = Rel(df, tuple(c for c in df.columns if c != "row_id"))
    assert [(x["row_id"], x["restarts"]) for x in groups.superlative(r, "restarts").collect()] == [(250, NEEDLE)]
