"""Secret scanning over an incremental blob ledger.

Every text version is addressed by the SHA-256 of its bytes. The ledger keeps two tables: ``versions``, which blob each
path had in each delivery, and ``blobs``, what each version of a rule found in each blob. A scan takes the distinct blobs of a
delivery, leaves out the (blob, rule version) pairs that the ledger has, scans the rest once however many
rows hold the blob, appends them, and joins the findings back to every row. ``history`` joins them to every path
and version that was ever delivered. Changing a rule changes its version, so only that rule runs again over known blobs, and
what its old version found is no longer returned.

All of it is DataFrame functions: no Python runs on the executors. Rows that hold one blob are dealt over ``SALTS`` keys in the
join back, so a blob that most rows hold is no single task's.

Cases: a null text is the empty blob and has no findings; repeated rows each get their findings; null
keys are kept; no rows give no rows; the result has the columns of the input plus ``secrets``
(array of kind, start, end, value by start, then kind), which replaces a column of that name, and
columns with a leading ``_ll_`` are dropped. Matching and redaction take time linear in a text, matches included.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .store import materialise, shared_dir


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:password|passwd|secret|token|api_?key)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24),
)
#: The same matches sooner: only the runs that are long enough can pass, and the shorter ones never overlap them; a run that no dot follows is not given back.
FAST = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}", "web_token": r"eyJ[A-Za-z0-9_-]{10,200}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}"}
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,200}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10}"),
    Rule("host_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})", r"gh[pousr]_|glpat-|xox[abprs]-"),
)
RULES = BASE + ADDED
KINDS = [r.kind for r in RULES]
SALTS = 8
BLOBS = f"blob string, results array<struct<rule:string,found:{spans.SPAN}>>"
VERSIONS = "path string, delivery int, blob string"


def _scan(text, rule: Rule):
    keep = (lambda g: F.length(g) >= rule.least) if rule.least else None
    return spans.find(text, rule.kind, FAST.get(rule.kind, rule.pattern), rule.hint, keep, rule.group)


def _blob(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class BlobLedger:
    """Versions of paths and findings by content address, kept as Parquet below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "ledger")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else None

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{name}")

    def unseen(self, docs: DataFrame, rules=RULES) -> DataFrame:
        """(blob, text, rules): each blob that lacks a rule version, with the versions that it lacks."""
        wanted = F.array(*[F.lit(r.version) for r in rules])
        blobs = docs.select(_blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        known = self._read("blobs", BLOBS)
        if known is None:
            return blobs.withColumn("rules", wanted)
        had = known.groupBy("blob").agg(F.flatten(F.collect_list(F.transform("results", lambda r: r["rule"]))).alias("had"))  # a name for each scan of one blob
        lacking = F.array_except(wanted, F.coalesce("had", F.array().cast("array<string>")))
        return blobs.join(had, "blob", "left").withColumn("rules", lacking).filter(F.size("rules") > 0).select("blob", "text", "rules")

    def found(self, rules=RULES) -> DataFrame:
        """(blob, secrets) of the blobs in which these versions of the rules found something."""
        versions, kinds = [r.version for r in rules], [r.kind for r in rules]
        pairs = self._read("blobs", BLOBS).select("blob", F.filter("results", lambda r: r["rule"].isin(versions) & (F.size(r["found"]) > 0)).alias("results"))
        every = pairs.filter(F.size("results") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("results"))).alias("results"))
        return every.select("blob", spans.ordered(F.flatten(F.transform("results", lambda r: r["found"])), kinds, True).alias("secrets"))

    def _joined(self, keyed: DataFrame, rules) -> DataFrame:
        """``keyed`` (with _ll_blob) with its secrets."""
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_ll_salt")
        found = materialise(self.found(rules).select(F.col("blob").alias("_ll_blob"), "secrets"), "found").select("*", salts)
        salted = keyed.withColumn("_ll_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        out = salted.join(found, ["_ll_blob", "_ll_salt"], "left").drop("_ll_salt")
        return out.withColumn("secrets", F.coalesce("secrets", F.array().cast(spans.SPAN)))

    def scan(self, docs: DataFrame, rules=RULES, path: str | None = "doc_id") -> DataFrame:
        """``docs`` with ``secrets``; scans what the ledger lacks, adds it there, and notes the blob of each ``path``."""
        docs = docs.drop("secrets", *[c for c in docs.columns if c.startswith("_ll_")])
        new = self.unseen(docs, rules)
        fresh = self._read("blobs", BLOBS) is None
        none, text = F.array().cast(spans.SPAN), F.col("text")
        each = [F.struct(F.lit(r.version).alias("rule"), (_scan(text, r) if fresh else F.when(F.array_contains("rules", r.version), _scan(text, r)).otherwise(none)).alias("found")) for r in rules]
        self._append(new.select("blob", F.filter(F.array(*each), lambda x: F.array_contains("rules", x["rule"])).alias("results")), "blobs")
        keyed = docs.withColumn("_ll_blob", _blob(F.col("text")))
        if path in docs.columns:
            before = self._read("versions", VERSIONS)
            last = before.agg(F.max("delivery")).first()[0] if before is not None else None
            noted = keyed.select(F.col(path).cast("string").alias("path"), F.lit(0 if last is None else last + 1).alias("delivery"), F.col("_ll_blob").alias("blob"))
            self._append(noted, "versions")
        return self._joined(keyed, rules).drop("_ll_blob")

    def history(self, rules=RULES) -> DataFrame | None:
        """(path, delivery, blob, secrets) of every version of every path, by what these rules found in the blobs they have seen."""
        versions = self._read("versions", VERSIONS)
        return versions and self._joined(versions.withColumn("_ll_blob", F.col("blob")), rules).drop("_ll_blob")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` of a scan with every found span replaced by [kind]; overlapping spans become one."""
    return docs.withColumn("text", spans.replaced(F.col("text"), F.col("secrets")))


def scan_deliveries(docs: DataFrame, deliveries: int = 2) -> DataFrame:
    """Scans a whole table with a fresh ledger, fed in ``deliveries`` by ascending doc_id: later ones scan only blobs not seen before."""
    ledger = BlobLedger(docs.sparkSession)
    bounds = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if bounds.lo is None:
        return ledger.scan(docs)
    step = (bounds.hi - bounds.lo) // deliveries + 1
    place = (F.col("doc_id").cast("double") - F.lit(float(bounds.lo))) / F.lit(float(step))  # doubles: no overflow
    number = F.coalesce(F.least(F.floor(place), F.lit(deliveries - 1)), F.lit(0))
    out = None
    for i in range(deliveries):
        part = ledger.scan(docs.filter(number == i))
        out = part if out is None else out.union(part)
    return out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_deliveries(docs).select("doc_id", "secrets")
    base = F.filter("secrets", lambda x: x["kind"].isin([r.kind for r in BASE]))
    return found.select(
        "doc_id",
        *[spans.count(F.col("secrets"), r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(spans.written(base), 256).alias("base_sha256"),
        spans.written(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op2_secret_scan": op2_secret_scan}


def _duckdb() -> str:
    """The same spans by splitting at each rule's matches and adding up lengths."""
    found = []
    for i, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        found.append(f"""SELECT r, {i} AS o, '{rule.kind}' AS kind, unnest(regexp_extract_all(t, '{pattern}')) AS hit, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS part,
        unnest(string_split_regex(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))]) AS gap, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i, {rule.least} AS least FROM d""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(found)}),
    p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, o ORDER BY i) AS e FROM m),
    s AS (SELECT r, o, kind, (e - length(hit))::BIGINT AS a, kind || ':' || (e - length(hit))::BIGINT || ':' || e::BIGINT AS span FROM p WHERE length(part) >= least),
    g AS (SELECT r, {counts}, string_agg(span, ',' ORDER BY a, o) FILTER (o < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, o) AS spans FROM s GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


ORACLE_SQL = {"op2_secret_scan": _duckdb()}
