"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is a row; its blob is the SHA-256 of its text.  A ledger table records which (blob, rule)
pairs have been scanned and what was found.  A run scans only the pairs the ledger does not hold, appends them, and joins
findings back to all versions and paths with that blob.  A changed rule has a new version, so only that rule runs again
over the history.

Only numbers and hashes are shuffled; a text moves at most once, from its scan to the one task that scans its blob.

Defined cases: a null text is the empty blob; equal texts are scanned once, whatever their ids; a path may repeat, with
one text or several; a missing or empty ledger means that nothing has been scanned; columns beyond the named ones stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetflow.llm.tables import as_texts, free_name, quoted, table
from packetflow.session import new_folder, settle

#: Kinds of the contract, in its order; then the kinds this scan adds.  A rule's version is part of the ledger's key.
BASE = ("assign", "access", "hex")
RULES = {
    "assign": (1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": (1, r"AKIA[A-Z0-9]+"),
    "hex": (1, r"[0-9a-f]{24,}"),
    "private_key": (1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?"),
    "jwt": (1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "vendor_token": (1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
    "url_password": (1, r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{3,100}@"),
}
#: A text without any of these (lower-cased ASCII) cannot match the rule: a cheap test before the expression.
_NEEDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "private_key": ("private key-----",),
    "jwt": ("eyj",),
    "vendor_token": ("gh", "xox", "sk_live_", "aiza"),
    "url_password": ("://",),
}
LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
    ]
)
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("version", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))


def _keep(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    return kind != "access" or m.end() - m.start() >= 20


def scan_text(text: str, kinds: list[str]) -> list[dict]:
    """The spans of each kind, leftmost and not overlapping within a kind, in code points; kinds without spans too."""
    lower, out = text.lower(), []
    for kind in kinds:
        version, pattern = RULES[kind]
        needs = _NEEDS.get(kind)
        hit = needs is None or any(x in lower for x in needs)
        spans = [{"start": m.start(), "stop": m.end()} for m in re.finditer(pattern, text) if _keep(kind, m)] if hit else []
        out.append({"rule": kind, "version": version, "spans": spans})
    return out


@F.arrow_udf(T.ArrayType(T.StructType(LEDGER.fields[1:])))
def _scan(texts: pa.Array, kinds: pa.Array) -> pa.Array:
    return pa.array([scan_text(t, k) for t, k in zip(as_texts(texts), kinds.to_pylist())], _FOUND)


def versions(docs: DataFrame, text: str = "text", name: str = "blob") -> DataFrame:
    """The rows with the content address of their text instead of the text, as the last column."""
    others = [F.col(quoted(c)) for c in docs.columns if c != text]
    return docs.select(*others, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias(free_name(docs, name)))


def unseen(blobs: DataFrame, ledger: DataFrame, rules: list[str]) -> DataFrame:
    """Distinct blobs with the rules (``kinds``) that the ledger does not hold for them in today's version."""
    wanted = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(RULES[r][0]).alias("version")) for r in rules])
    held = ledger.groupBy(F.col("blob").alias("_blob")).agg(F.collect_set(F.struct("rule", "version")).alias("_held"))
    pairs = blobs.join(held, F.col("blob") == F.col("_blob"), "left")
    missing = F.filter(wanted, lambda x: ~F.coalesce(F.exists("_held", lambda h: (h["rule"] == x["rule"]) & (h["version"] == x["version"])), F.lit(False)))
    return pairs.select(*blobs.columns, F.transform(missing, lambda x: x["rule"]).alias("kinds")).where(F.size("kinds") > 0)


def scan(docs: DataFrame, ledger: str, rules: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Bring the ledger (a folder of Parquet) up to date with ``docs``; returns the versions (rows without text; the last column is the address).

    One row of each unseen blob carries its text to the scan.  Two runs that meet may scan a blob twice; reads of the ledger
    take distinct findings, so results stay right.
    """
    spark, rules = docs.sparkSession, rules or list(RULES)
    rows = docs.select(F.col(key).alias("_key"), "text").withColumn("blob", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    firsts = rows.groupBy("blob").agg(F.min(F.coalesce(F.col("_key").cast("string"), F.lit(""))).alias("_first"))
    todo = settle(unseen(firsts, read_ledger(spark, ledger), rules), "unseen")
    # The rows of one blob that share the first key are equal; where there are several, one is enough.
    texts = rows.withColumn("_name", F.coalesce(F.col("_key").cast("string"), F.lit(""))).withColumnRenamed("blob", "_b")
    picked = texts.hint("shuffle_hash").join(todo.hint("shuffle_hash"), (F.col("_name") == F.col("_first")) & (F.col("_b") == F.col("blob")))
    found = picked.select("blob", F.explode(_scan("text", "kinds")).alias("f")).select("blob", "f.rule", "f.version", "f.spans")
    found.write.mode("append").parquet(ledger)
    return versions(docs)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    exists = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.schema(LEDGER).parquet(ledger) if exists else spark.createDataFrame([], LEDGER)


def findings(rows: DataFrame, ledger: DataFrame, rules: list[str] | None = None, name: str = "findings") -> DataFrame:
    """The versions (address in the last column), each with all findings of its blob under today's rules: array of (kind, start, stop), by start, then kind."""
    rules, address, held, blob = rules or list(RULES), rows.columns[-1], free_name(rows, "_found"), free_name(rows, "_blob")
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r), F.lit(RULES[r][0]))])
    now = ledger.where((F.col("version") == F.get(F.array(current[F.col("rule")]), F.lit(0))) & (F.size("spans") > 0))
    # Distinct first: two runs may have scanned one blob.
    spans = now.select("blob", "rule", F.explode("spans").alias("s")).distinct()
    per_blob = spans.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), order[F.col("rule")].alias("place"), F.col("s.stop").alias("stop"), F.col("rule").alias("kind")))).alias(held))
    empty = F.array().cast("array<struct<start:int,place:int,stop:int,kind:string>>")
    return rows.join(per_blob, F.col(quoted(address)) == F.col(blob), "left").select(*[F.col(quoted(c)) for c in rows.columns], F.coalesce(held, empty).alias(free_name(rows, name)))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), new_folder(spark, "ledger")
    found = findings(scan(docs, ledger), read_ledger(spark, ledger))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
