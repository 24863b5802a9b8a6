"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. toxicity: documents whose score reaches the threshold go; terms and weights are learned from ``labels``.
2. jaccard_join: of each group of near copies the document with the smallest id stays.
3. substring_dedup: words of passages that an earlier document has go; other texts stay byte for byte.
4. secret_scan: every secret is replaced by the name of its kind in brackets.
5. best_fit_packing: token pieces with their sequence and offset.

Stages 1 to 4 return the columns of their input. Rows with a null doc_id stay in stages 1 to 4. Rows that
share a doc_id count as documents of their own in stage 2: only those whose own text is a copy go.

Executors run one stage after the other and keep much of what each took, so texts go to Python workers in small Arrow
batches (``small_batches``). Stage 1 ends with a pass over texts and so returns a table that is written already. Stage 3
ends with one too, but a copy more would nearly use up the disk's budget: that pass is lazy and takes the session's batches.
Stages 2 and 3 pack what they find by batch and so take batches of a whole chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import flat, jaccard_join, packing, secret_scan, substring_dedup, toxicity
from lakeloom.llm.store import materialise, small_batches


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return materialise(toxicity.score(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select(*docs.columns), "toxicity")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = docs.filter("doc_id is not null").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids.n > ids.d:  # rows that share an id: each has a key of its own
        keyed = materialise(docs.withColumn("row_key", F.monotonically_increasing_id()), "keyed")
        named = keyed.filter("doc_id is not null")
        with small_batches(spark, flat.CHUNK_BYTES):
            groups = jaccard_join.jaccard_components(named.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component_id")
        first = named.select("row_key", "doc_id").join(groups, "row_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
        kept = keyed.join(first.select("first.row_key"), "row_key", "left_semi").unionByName(keyed.filter("doc_id is null"))
        return kept.select(*docs.columns)
    with small_batches(spark, flat.CHUNK_BYTES):
        groups = materialise(jaccard_join.jaccard_components(docs), "groups")
    kept = docs.join(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark, flat.CHUNK_BYTES):
        out = substring_dedup.dedup_substrings(docs, untouched=True)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out.select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.redact(secret_scan.BlobLedger(spark).scan(docs))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        found = found.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return found.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return packing.pack(docs, with_ids=False)


#: Stages whose result is a written table.
WRITTEN = {"toxicity"}
STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]
#: Scores and tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name in WRITTEN else materialise(docs, name)
    return docs
