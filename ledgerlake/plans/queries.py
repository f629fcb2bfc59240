"""The core library's queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import redact_texts, secret_tokens, token_estimate
from ..operators import groups, rows
from ..operators.aggregate import Agg, aggregate_where, check_claim, provenance
from ..operators.joins import join_aggregate, join_group_aggregate
from ..operators.predicates import Predicate
from ..operators.profile import describe, value_counts
from ..operators.receipts import Receipt, issue, verify
from ..operators.reduce import reduce_payloads, reduce_to
from ..sources.records import from_lines
from ..sources.rel import Rel, from_table, union
from ..sources.store import HeldStore, hashed
from .digest import digest, digest_across

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id", "documents": "doc_id", "part": "p_partkey", "supplier": "s_suppkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rel(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Rel:
    df = table(spark, sf_dir, name)
    return from_table(df.select(*dict.fromkeys([KEYS[name], *columns])) if columns else df, KEYS[name])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LARGE = [Predicate("o_orderstatus", "eq", "F"), Predicate("o_totalprice", "gt", 100000)]
_WHERE = "FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"
DEC = "CAST(ROUND(SUM(CAST({} AS DECIMAL(38, 2))), 2) AS DOUBLE)"


@query(f"SELECT 'ok' AS status, COUNT(*)::DOUBLE AS value, COUNT(*) AS n_matched {_WHERE}")
def agg_count_where(spark, d):
    return aggregate_where(rel(spark, d, "orders"), LARGE, Agg("count"))


@query(f"SELECT 'ok' AS status, {DEC.format('o_totalprice')} AS value, COUNT(*) AS n_matched {_WHERE}")
def agg_sum_where(spark, d):
    return aggregate_where(rel(spark, d, "orders"), LARGE, Agg("sum", "o_totalprice"), scale=2)


@query(f"SELECT 'ok' AS status, ROUND({DEC.format('o_totalprice')} / COUNT(o_totalprice), 4) AS value, COUNT(*) AS n_matched {_WHERE}")
def agg_mean_where(spark, d):
    return aggregate_where(rel(spark, d, "orders"), LARGE, Agg("mean", "o_totalprice"), scale=2).withColumn("value", F.round("value", 4))


@query(f"SELECT 'ok' AS status, MIN(o_totalprice) AS value, COUNT(*) AS n_matched {_WHERE}")
def agg_min_where(spark, d):
    return aggregate_where(rel(spark, d, "orders"), LARGE, Agg("min", "o_totalprice"))


@query(f"SELECT 'ok' AS status, MAX(o_totalprice) AS value, COUNT(*) AS n_matched {_WHERE}")
def agg_max_where(spark, d):
    return aggregate_where(rel(spark, d, "orders"), LARGE, Agg("max", "o_totalprice"))


@query("SELECT 'refused' AS status, NULL::DOUBLE AS value, COUNT(*) AS n_matched FROM orders")
def agg_refused_mixed(spark, d):
    odd = table(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") == 7, F.lit(float("nan"))).otherwise(F.col("o_totalprice")))
    return aggregate_where(from_table(odd, "o_orderkey"), [], Agg("sum", "o_totalprice"))


@query("SELECT 'refused' AS status, NULL::DOUBLE AS value, 0::BIGINT AS n_matched")
def agg_refused_empty(spark, d):
    return aggregate_where(rel(spark, d, "orders"), [Predicate("o_totalprice", "lt", -1)], Agg("mean", "o_totalprice"))


@query(f"SELECT o_orderkey AS row_id {_WHERE}")
def agg_provenance(spark, d):
    return provenance(rel(spark, d, "orders", "o_orderstatus", "o_totalprice"), LARGE)


@query("SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderpriority, '1-URGENT') AS p FROM orders) WHERE p <> '2-HIGH'")
def pred_ne_missing(spark, d):
    odd = table(spark, d, "orders").withColumn("p", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return groups.count_records(rows.subset(from_table(odd, "o_orderkey"), [Predicate("p", "ne", "2-HIGH")]))


@query("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderpriority >= '3' GROUP BY o_orderpriority")
def pred_string_order(spark, d):
    return rows.subset(rel(spark, d, "orders"), [Predicate("o_orderpriority", "ge", "3")]).df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT COUNT(*) FILTER (o_totalprice IS NOT NULL) AS n_ne, 0::BIGINT AS n_lt FROM orders")
def pred_across_kinds(spark, d):
    r = rel(spark, d, "orders")
    ne, lt = rows.subset(r, [Predicate("o_totalprice", "ne", "10")]).df, rows.subset(r, [Predicate("o_totalprice", "lt", "10")]).df
    return ne.agg(F.count(F.lit(1)).alias("n_ne")).crossJoin(lt.agg(F.count(F.lit(1)).alias("n_lt")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 50000")
def subset_chain(spark, d):
    first = rows.subset(rel(spark, d, "orders"), [Predicate("o_orderstatus", "eq", "O")])
    return rows.subset(first, [Predicate("o_totalprice", "le", 50000)]).df.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT v.ord, o.o_orderkey, o.o_totalprice FROM (VALUES (0, 30), (1, 7), (2, 30), (3, 0)) v(ord, id) JOIN orders o ON o.o_orderkey = v.id")
def pick_rows_ordered(spark, d):
    return rows.pick_ids(rel(spark, d, "orders"), [30, 7, 30, 0]).select(F.col("ord").cast("int").alias("ord"), "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def rows_page(spark, d):
    return rows.page(rel(spark, d, "orders"), 40, 20).select("o_orderkey", "o_totalprice")


_LINES = """lines AS (
  SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, CHR(10)), 1) - 1 AS pos,
         LEN(STRING_SPLIT(text, CHR(10))) AS parts FROM documents),
l AS (SELECT doc_id, pos, RTRIM(line, CHR(13)) AS line FROM lines WHERE NOT (pos = parts - 1 AND line = ''))"""


@query(f"WITH {_LINES}, c AS (SELECT *, COUNT(*) OVER (PARTITION BY doc_id) AS n_lines FROM l) SELECT doc_id, (pos + 1)::BIGINT AS line_no, line, n_lines FROM c WHERE pos BETWEEN 1 AND 3")
def lines_page(spark, d):
    return rows.line_range(table(spark, d, "documents").select("doc_id", "text"), first=2, last=4)


@query(f"WITH {_LINES}, c AS (SELECT *, COUNT(*) OVER (PARTITION BY doc_id) AS n_lines FROM l) SELECT doc_id, (pos + 1)::BIGINT AS line_no, line, n_lines FROM c WHERE pos >= n_lines - 2")
def lines_tail(spark, d):
    return rows.line_range(table(spark, d, "documents").select("doc_id", "text"), tail=2)


@query(f"WITH {_LINES} SELECT doc_id, (pos + 1)::BIGINT AS line_no, line FROM l WHERE CONTAINS(LOWER(line), 'license')")
def text_search(spark, d):
    return rows.search_lines(table(spark, d, "documents").select("doc_id", "text"), "License")


@query("SELECT doc_id, HEX(ENCODE(text)[11:30]) AS data, LEAST(10, n) AS a, LEAST(30, n) AS b, n AS total FROM (SELECT doc_id, text, OCTET_LENGTH(ENCODE(text))::BIGINT AS n FROM documents)")
def byte_windows(spark, d):
    """Bytes 10 to 30 of every text, split code points included; SQL has no repair of UTF-8, so the bytes are compared."""
    w = table(spark, d, "documents").select("doc_id", rows.byte_window(F.col("text").cast("binary"), 10, 20).alias("w"))
    return w.select("doc_id", F.hex("w.data").alias("data"), F.col("w.start").alias("a"), F.col("w.end").alias("b"), "w.total")


@query("""WITH dropped AS (SELECT event_id FROM events WHERE NOT (event_type = 'click')),
isle AS (SELECT event_id, event_id - ROW_NUMBER() OVER (ORDER BY event_id) AS g FROM dropped)
SELECT MIN(event_id) AS start, MAX(event_id) AS "end", COUNT(*) AS n FROM isle GROUP BY g""")
def keep_where_runs(spark, d):
    return rows.runs(rel(spark, d, "events", "event_type"), [Predicate("event_type", "eq", "click")])


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, LAG(event_type) OVER (ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def dedup_consecutive(spark, d):
    return rows.drop_repeats(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS a, ROW_NUMBER() OVER (ORDER BY o_orderkey DESC) AS b FROM orders) WHERE a <= 13 OR b <= 12")
def head_tail_window(spark, d):
    return rows.head_tail(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 25)


_SEMI = "FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


@query(f"SELECT 'ok' AS status, {DEC.format('o_totalprice')} AS value, COUNT(*) AS n_matched {_SEMI}")
def semi_join_sum(spark, d):
    return join_aggregate(rel(spark, d, "orders"), rel(spark, d, "customer"), "o_custkey", "c_custkey", [Predicate("c_mktsegment", "eq", "BUILDING")], Agg("sum", "o_totalprice"), scale=2)


@query("SELECT 'ok' AS status, COUNT(*)::DOUBLE AS value, COUNT(*) AS n_matched FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def semi_join_dup_right(spark, d):
    return join_aggregate(rel(spark, d, "customer"), rel(spark, d, "orders"), "c_custkey", "o_custkey", [Predicate("o_totalprice", "gt", 200000)], Agg("count"))


@query(f"SELECT 'ok' AS status, c_mktsegment AS key, {DEC.format('o_totalprice')} AS value, COUNT(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_group_revenue(spark, d):
    return join_group_aggregate(rel(spark, d, "orders", "o_custkey", "o_totalprice"), rel(spark, d, "customer", "c_mktsegment"), "o_custkey", "c_custkey", "c_mktsegment", Agg("sum", "o_totalprice"), scale=2)


@query("SELECT 'ok' AS status, c_nationkey::VARCHAR AS key, MAX(o_totalprice) AS value, COUNT(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def join_group_max(spark, d):
    return join_group_aggregate(rel(spark, d, "orders", "o_custkey", "o_totalprice"), rel(spark, d, "customer", "c_nationkey"), "o_custkey", "c_custkey", "c_nationkey", Agg("max", "o_totalprice"))


@query("SELECT 'refused' AS status, NULL::VARCHAR AS key, NULL::DOUBLE AS value, NULL::BIGINT AS n_rows")
def join_group_refused(spark, d):
    return join_group_aggregate(rel(spark, d, "customer", "c_custkey"), rel(spark, d, "orders", "o_custkey", "o_orderpriority"), "c_custkey", "o_custkey", "o_orderpriority", Agg("count"))


@query("SELECT 'ok' AS status, FLOOR(value / 50) * 50 AS lower, COUNT(*)::DOUBLE AS value, COUNT(*) AS n_rows FROM events WHERE value IS NOT NULL GROUP BY FLOOR(events.value / 50) * 50")
def bucket_count(spark, d):
    return groups.bucket_aggregate(rel(spark, d, "events", "value"), "value", 50, Agg("count"))


@query(f"SELECT 'ok' AS status, FLOOR(value / 10) * 10 AS lower, {DEC.format('value')} AS value, COUNT(*) AS n_rows FROM events WHERE value IS NOT NULL GROUP BY FLOOR(events.value / 10) * 10")
def bucket_sum(spark, d):
    return groups.bucket_aggregate(rel(spark, d, "events", "value"), "value", 10, Agg("sum", "value"), scale=2)


@query(f"""WITH {_LINES} SELECT doc_id, pos // 10 AS block, 'lines ' || (pos // 10 * 10 + 1) || '-' || (pos // 10 * 10 + 10) AS key_text, COUNT(*) AS n
FROM l WHERE CONTAINS(LOWER(line), 'the') GROUP BY doc_id, pos // 10""")
def log_window(spark, d):
    return groups.matches_per_block(table(spark, d, "documents").select("doc_id", "text"), "The", 10, key="doc_id")


_LI = "SELECT {0} AS key, {1} AS v FROM lineitem GROUP BY {0}"
_KEY2 = "l_returnflag || ' × ' || l_linestatus"
_EXTREME = "WITH g AS ({}) SELECT 'ok' AS status, key, v AS value, COUNT(*) OVER () AS n_ties FROM g WHERE v = (SELECT {}(v) FROM g)"


def lineitem(spark, d, *columns):
    df = table(spark, d, "lineitem").select(*columns)
    return Rel(df.withColumn("row_id", F.lit(0).cast("bigint")), tuple(df.columns))


@query(_EXTREME.format(_LI.format("l_returnflag", DEC.format("l_extendedprice")), "MAX"))
def group_extreme_sum(spark, d):
    return groups.group_extreme(lineitem(spark, d, "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", scale=2)


@query(_EXTREME.format(_LI.format("l_linestatus", f"{DEC.format('l_quantity')} / COUNT(l_quantity)"), "MIN"))
def group_extreme_mean(spark, d):
    return groups.group_extreme(lineitem(spark, d, "l_linestatus", "l_quantity"), ["l_linestatus"], "l_quantity", highest=False, mean=True, scale=2)


@query(_EXTREME.format(_LI.format(_KEY2, DEC.format("l_quantity")), "MAX"))
def group_extreme_composite(spark, d):
    return groups.group_extreme(lineitem(spark, d, "l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag", "l_linestatus"], "l_quantity", scale=2)


@query("SELECT o_orderkey AS row_id, o_totalprice FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)")
def superlative_max(spark, d):
    return groups.superlative(rel(spark, d, "orders"), "o_totalprice").select("row_id", "o_totalprice")


@query("SELECT COUNT(*) AS n, MIN(l_quantity) AS quantity FROM lineitem WHERE l_quantity = (SELECT MAX(l_quantity) FROM lineitem)")
def superlative_ties(spark, d):
    return groups.superlative(lineitem(spark, d, "l_quantity"), "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("quantity"))


@query("SELECT 'ok' AS status, QUANTILE_DISC(value, 0.95) AS value, COUNT(value) AS n FROM events")
def percentile_p95(spark, d):
    return groups.percentile(rel(spark, d, "events", "value"), "value", 95)


@query("SELECT 'ok' AS status, QUANTILE_DISC(o_totalprice, 0.5) AS value, COUNT(o_totalprice) AS n FROM orders")
def median(spark, d):
    return groups.percentile(rel(spark, d, "orders", "o_totalprice"), "o_totalprice", 50)


@query("SELECT 'ok' AS status, MAX(value) - MIN(value) AS value, MIN(value) AS low, MAX(value) AS high FROM events")
def value_range(spark, d):
    return groups.value_range(rel(spark, d, "events", "value"), "value")


@query("SELECT 'ok' AS status, COUNT(*) FILTER (o_totalprice >= 150000) AS n FROM orders")
def count_threshold(spark, d):
    return groups.count_threshold(rel(spark, d, "orders", "o_totalprice"), "o_totalprice", "ge", 150000)


@query("SELECT COUNT(DISTINCT o_orderpriority) AS n FROM orders")
def count_distinct(spark, d):
    return groups.count_distinct(rel(spark, d, "orders", "o_orderpriority"), "o_orderpriority")


@query("SELECT COUNT(*) FILTER (event_type = 'click') AS n FROM events")
def count_value(spark, d):
    return groups.count_value(rel(spark, d, "events", "event_type"), "event_type", "click")


@query("SELECT COUNT(*) AS n FROM lineitem")
def count_records(spark, d):
    return groups.count_records(lineitem(spark, d, "l_quantity"))


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
_NUM = ("o_orderkey", "o_custkey", "o_totalprice")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS field, COUNT({c}) AS present, COUNT(DISTINCT {c}) AS n_distinct, {str(c in _NUM).lower()} AS is_number, "
    + (f"MIN({c})::DOUBLE AS low, MAX({c})::DOUBLE AS high, ROUND(SUM({c}::DECIMAL(38, 2))::DOUBLE / COUNT({c}), 3) AS mean, ROUND(SUM({c}::DECIMAL(38, 2))::DOUBLE, 1) AS total" if c in _NUM else "NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean, NULL::DOUBLE AS total")
    + " FROM orders" for c in _ORDERS))
def describe_orders(spark, d):
    return describe(rel(spark, d, "orders", *_ORDERS)).withColumn("mean", F.round("mean", 3)).withColumn("total", F.round("total", 1))


@query("SELECT 'o_orderstatus' AS field, o_orderstatus AS canon, COUNT(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, COUNT(*) FROM orders GROUP BY 2")
def value_counts_orders(spark, d):
    return value_counts(rel(spark, d, "orders", "o_orderstatus", "o_orderpriority")).where("field <> 'o_orderkey'")


@query(f"SELECT 'ok' AS status, {DEC.format('o_totalprice')} AS value, COUNT(*) AS n_matched FROM orders WHERE o_orderstatus IN ('F', 'O')")
def digest_union(spark, d):
    r = rel(spark, d, "orders")
    both = union([rows.subset(r, [Predicate("o_orderstatus", "eq", s)]) for s in "FO"])
    return aggregate_where(both, [], Agg("sum", "o_totalprice"), scale=2)


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_path_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT 'ok' AS status, SUM((props ->> '$.k')::BIGINT)::DOUBLE AS value, COUNT(*) AS n_matched FROM events WHERE (props ->> '$.k')::BIGINT > 50")
def json_lines_sum(spark, d):
    lines = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("props").alias("value"))
    return aggregate_where(from_lines(lines), [Predicate("k", "gt", 50)], Agg("sum", "k"))


@query("SELECT doc_id, SHA256(text) AS hash, OCTET_LENGTH(ENCODE(text))::BIGINT AS len FROM documents")
def sha256_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.octet_length("text").cast("bigint").alias("len"))


@query("SELECT COUNT(DISTINCT SHA256(text)) AS blobs, (SELECT SUM(l) FROM (SELECT DISTINCT text, OCTET_LENGTH(ENCODE(text)) AS l FROM documents))::BIGINT AS total_bytes FROM documents")
def store_dedup(spark, d):
    one = hashed(table(spark, d, "documents"), "text").select("hash", "len").dropDuplicates(["hash"])
    return one.agg(F.count(F.lit(1)).alias("blobs"), F.sum("len").alias("total_bytes"))


@query("SELECT doc_id, CEIL(LENGTH(text) / 4.0)::BIGINT AS n_tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("n_tokens"))


@query("SELECT CASE WHEN ABS(v - 1000000) <= 1e-9 + 1e-9 * ABS(v) THEN 'AGREE' ELSE 'DISAGREE' END AS verdict, v AS value, 1000000::DOUBLE AS claimed FROM (SELECT " + DEC.format("o_totalprice") + f" AS v {_WHERE})")
def claim_check(spark, d):
    return check_claim(rel(spark, d, "orders"), LARGE, Agg("sum", "o_totalprice"), 1_000_000, scale=2)


@query("SELECT SHA256('[' || STRING_AGG(o_orderkey || ':' || o_orderpriority, ',' ORDER BY o_orderkey) || ']') AS backing_sha256, COUNT(*) AS n FROM orders WHERE o_totalprice > 400000")
def receipt_backing_hash(spark, d):
    held = rows.subset(rel(spark, d, "orders"), [Predicate("o_totalprice", "gt", 400000)])
    raw = Rel(held.df.withColumn("raw", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderpriority")), held.fields)
    return rows.payload(raw).select(F.sha2(F.col("payload").cast("binary"), 256).alias("backing_sha256")).crossJoin(groups.count_records(raw))


@query("""SELECT doc_id, LEN(LIST_FILTER(REGEXP_EXTRACT_ALL(t, '[^\\s"'',:;=(){}\\[\\]<>&?/\\\\`|]+'), lambda x: LENGTH(x) >= 12 AND REGEXP_MATCHES(x, '^(sk-|AKIA|ghp_)')))::BIGINT AS n
FROM (SELECT doc_id, text || ' key=sk-' || REPEAT('a', (doc_id % 20)::INT) || ' (AKIA' || doc_id || 'ABCDEFGH) ghp_x' AS t FROM documents)""")
def redact_synthetic(spark, d):
    docs = table(spark, d, "documents")
    tokens = F.concat(F.lit(" key=sk-"), F.expr("repeat('a', cast(doc_id % 20 as int))"), F.lit(" (AKIA"), F.col("doc_id").cast("string"), F.lit("ABCDEFGH) ghp_x"))
    return docs.select("doc_id", F.size(secret_tokens(F.concat("text", tokens))).cast("bigint").alias("n"))


@query()
def reduce_documents(spark, d):
    """Views of all documents at a fifth of their tokens, and whether their segments are the whole document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = reduce_payloads(docs, "doc_id", "text", lambda data: reduce_to(data, reduction=0.8))
    whole = F.sha2(F.aggregate("segments", F.lit("").cast("binary"), lambda a, s: F.concat(a, s["data"])), 256)
    return out.select("doc_id", "tokens_before", "tokens_after", F.size("segments").alias("n_segments"), whole.alias("sha256"))


@query("SELECT doc_id, CEIL(LENGTH(text) / 4.0)::BIGINT AS tokens_before, TRUE AS no_longer, SHA256(text) AS sha256 FROM documents")
def reduce_round_trip(spark, d):
    """Every document reduced to a tenth and put together again from its segments."""
    out = reduce_payloads(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", lambda data: reduce_to(data, reduction=0.9))
    whole = F.sha2(F.aggregate("segments", F.lit("").cast("binary"), lambda a, s: F.concat(a, s["data"])), 256)
    return out.select("doc_id", "tokens_before", (F.col("tokens_after") <= F.greatest("tokens_before", F.lit(40))).alias("no_longer"), whole.alias("sha256"))


_QUESTIONS = ("how many records are there", "how many distinct o_orderstatus", "how many o_orderstatus f", "how many have o_totalprice above 150000", "how many o_orderpriority 1-urgent", "who ordered this")


@query("""WITH n AS (SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderstatus) AS s, COUNT(*) FILTER (o_orderstatus = 'F') AS f, COUNT(*) FILTER (o_totalprice > 150000) AS t, COUNT(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders)
SELECT 'how many records are there' AS question, '[index] count over ' || n || ' records = ' || n AS answer FROM n
UNION ALL SELECT 'how many distinct o_orderstatus', '[index] distinct(o_orderstatus) over ' || n || ' records = ' || s || ' values' FROM n
UNION ALL SELECT 'how many o_orderstatus f', '[index] count(o_orderstatus="F") over ' || n || ' records = ' || f FROM n
UNION ALL SELECT 'how many have o_totalprice above 150000', '[index] count(o_totalprice > 150000) over ' || n || ' records = ' || t FROM n
UNION ALL SELECT 'how many o_orderpriority 1-urgent', '[index] count(o_orderpriority="1-URGENT") over ' || n || ' records = ' || u FROM n
UNION ALL SELECT 'who ordered this', NULL""")
def digest_questions(spark, d):
    r = rel(spark, d, "orders", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return spark.createDataFrame([(q, digest(r, q)) for q in _QUESTIONS], "question string, answer string")


@query("SELECT '[index] count over ' || COUNT(*) || ' records = ' || COUNT(*) AS answer FROM orders WHERE o_orderstatus IN ('F', 'O')")
def digest_two_payloads(spark, d):
    r = rel(spark, d, "orders", "o_orderstatus")
    parts = [rows.subset(r, [Predicate("o_orderstatus", "eq", s)]) for s in "FO"]
    return spark.createDataFrame([(digest_across([*parts, None], "how many records"),)], "answer string")


@query("SELECT event_id, props ->> '$.k' AS shown FROM events")
def json_path_at(spark, d):
    return rows.at_paths(table(spark, d, "events"), "event_id", "props", "$.k").select("event_id", "shown")


@query("""SELECT doc_id, 'key=' || CASE WHEN LENGTH(a) >= 12 THEN '<<ref-redacted:' || SUBSTR(SHA256(a), 1, 12) || '>>' ELSE a END || ' (<<ref-redacted:' || SUBSTR(SHA256(b), 1, 12) || '>>) ghp_x' AS masked,
CASE WHEN LENGTH(a) >= 12 THEN a || ',' ELSE '' END || b AS secrets FROM (SELECT doc_id, 'sk-' || REPEAT('a', (doc_id % 20)::INT) AS a, 'AKIA' || doc_id || 'ABCDEFGH' AS b FROM documents)""")
def redact_marked(spark, d):
    tokens = F.concat(F.lit("key=sk-"), F.expr("repeat('a', cast(doc_id % 20 as int))"), F.lit(" (AKIA"), F.col("doc_id").cast("string"), F.lit("ABCDEFGH) ghp_x"))
    out = redact_texts(table(spark, d, "documents").select("doc_id", tokens.alias("text")), "doc_id", "text")
    return out.select("doc_id", "masked", F.array_join(F.transform("secrets", lambda x: x["value"]), ",").alias("secrets"))


_RAW = "c_custkey || ':' || c_mktsegment"


@query(f"SELECT 'Valid' AS verdict, COUNT(*)::DOUBLE AS value, COUNT(*) AS n, SHA256('[' || STRING_AGG({_RAW}, ',' ORDER BY c_custkey) || ']') AS backing_sha256 FROM customer WHERE c_mktsegment = 'BUILDING'")
def receipt_round_trip(spark, d):
    """A receipt issued, written, read and verified."""
    r = rel(spark, d, "customer", "c_mktsegment")
    r = Rel(r.df.withColumn("raw", F.concat_ws(":", F.col("c_custkey").cast("string"), "c_mktsegment")), r.fields)
    got = Receipt.from_json(issue(r, [Predicate("c_mktsegment", "eq", "BUILDING")], Agg("count"), b"held").to_json())
    return spark.createDataFrame([(verify(got, r), got.value, len(got.matched), got.backing_sha256)], "verdict string, value double, n bigint, backing_sha256 string")


@query("SELECT COUNT(*) AS blobs, SUM(OCTET_LENGTH(ENCODE(text)))::BIGINT AS total_bytes, 0::BIGINT AS corrupt FROM (SELECT DISTINCT text FROM documents)")
def store_held(spark, d):
    """All documents put into a store, twice."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="ledgerlake-")
    store = HeldStore(spark, f"{folder.rstrip('/')}/held-{uuid.uuid4().hex}")
    for _ in range(2):
        store.put(table(spark, d, "documents"), "text")
    return store.stats()
