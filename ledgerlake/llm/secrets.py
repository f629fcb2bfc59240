"""Secret scans over an incremental ledger of blobs.

Every historical version of a path is a row with its text, addressed by the SHA-256 of its content. The ledger
is a table of (blob, rule_version, spans): a blob that it holds under the present rule version is not scanned
again, each new blob is scanned once however many paths hold it, and findings are joined back to all paths.
A change of the rules is a new rule version, under which every blob is unseen.

DataFrame functions only. Kinds assign, access and hex are the base and are always reported; jwt, pem and
vendor (prefixed tokens of hosting services) are added. A null text counts as empty. Rows that repeat a path and
text share one blob, which is scanned once; rows that repeat a path with different texts are versions of it. A null
path is a path like any other. An empty table gives an empty result. Very long texts are scanned whole, in time that
grows with their length. Of the input's columns only the path is kept; it may not be named blob or spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, salted_join, scratch_path, text_of
from .spans import SPAN, joined, near, spans

KINDS = ("assign", "access", "hex", "jwt", "pem", "vendor")
BASE_KINDS = KINDS[:3]
RULE_VERSION = "2"

KEY = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of the class shorter than the least length holds no match, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
PEM = r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"
VENDOR = r"(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"
SECRET_WORDS = r"(key|token|secret|passw|auth|credential)"


def secret_spans(text: Column) -> Column:
    """All spans, by start, then by kind as listed."""
    raised = lambda low, high: lambda before: F.when(near(before, SECRET_WORDS), high).otherwise(F.lit(low))
    whole = lambda hit: F.lit(True)
    found = (
        spans(text, "assign", ASSIGN, text.rlike(KEY), lambda hit: F.char_length(F.regexp_extract(hit, f"^{ASSIGN}", 2)) >= 6, raised(0.8, 0.9)),
        spans(text, "access", ACCESS, text.contains("AKIA"), whole, raised(0.9, 1.0)),
        spans(text, "hex", HEX, text.rlike(HEX), whole, raised(0.5, 0.8)),
        spans(text, "jwt", JWT, text.contains("eyJ"), whole, raised(0.9, 1.0)),
        spans(text, "pem", PEM, text.contains("-----BEGIN"), whole, raised(1.0, 1.0)),
        spans(text, "vendor", VENDOR, text.rlike(r"gh[opsur]_|glpat-|xox[abp]-|sk_live_"), whole, raised(0.9, 1.0)),
    )
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(F.concat(*found), lambda s: F.struct(s["start"], place[s["kind"]].alias("place"), s["end"], s["kind"].alias("kind"), s["score"]))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))


class BlobLedger:
    """The ledger at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, rule_version: str = RULE_VERSION):
        self.spark, self.path, self.rule_version = spark, path, rule_version

    def findings(self) -> DataFrame:
        """(blob, rule_version, spans) of every scan so far."""
        return self.spark.read.schema(f"blob binary, rule_version string, spans {SPAN}").parquet(self.path)

    def scan(self, docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
        """(path, blob, spans) of every row of docs; what the ledger lacked is added to it first.

        Texts cross the network once, and only those of unseen blobs are searched. If a blob was added twice
        by two runs at a time, its findings are equal and count once.
        """
        if path.lower() in ("blob", "spans"):
            raise ValueError(f"the path's column is named like a result: {path}")
        nothing = self.spark.range(0).selectExpr("cast(null as binary) blob", "cast(null as string) rule_version", f"cast(null as {SPAN}) spans")
        nothing.write.mode("append").parquet(self.path)
        held = docs.select(F.col(path).alias("path"), text_of(text).alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        paths = cut(held.select("path", "blob"))
        known = self.findings().where(F.col("rule_version") == self.rule_version).select("blob")
        # a blob is scanned in the row of its least path
        rows = paths.groupBy("blob", "path").agg(F.count(F.lit(1)).alias("copies"))
        order = F.struct(F.col("path").isNull().alias("none"), F.col("path").alias("path"), F.col("copies").alias("copies"))
        unseen = rows.groupBy("blob").agg(F.min(order).alias("at")).join(known, "blob", "left_anti").select("blob", "at.path", (F.col("at.copies") > 1).alias("repeated"))
        unseen = cut(unseen)
        match = (F.col("h.blob") == F.col("n.blob")) & F.col("h.path").eqNullSafe(F.col("n.path"))
        texts = held.alias("h").join(unseen.alias("n"), match).select("h.blob", "h.text", "n.repeated")
        if not unseen.where("repeated").isEmpty():
            once = texts.where("repeated").groupBy("blob").agg(F.min("text").alias("text"))
            texts = texts.where("not repeated").select("blob", "text").unionByName(once)
        scanned = texts.select("blob", F.lit(self.rule_version).alias("rule_version"), secret_spans(F.col("text")).alias("spans"))
        scanned.write.mode("append").parquet(self.path)
        found = self.findings().where(F.col("rule_version") == self.rule_version).groupBy("blob").agg(F.first("spans").alias("spans"))
        return salted_join(paths, found, "blob").select(F.col("path").alias(path), "blob", "spans")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    found = BlobLedger(spark, scratch_path(spark, "ledger")).scan(read(spark, sf_dir, "documents"))
    kinds = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select(
        "doc_id", *[F.size(kinds(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(kinds(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
