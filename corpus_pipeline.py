"""A cleaning pipeline over documents: each stage calls one operator and keeps the columns of documents until the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL can't express the classifiers' decisions; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with row_key: the doc_id where it is one row's alone, else (null, or shared by several rows) a number from 2**62
    on that follows from doc_id and text, so that every row is a document, and rows equal in both are one. Texts are only
    shuffled where there are shared ids."""
    own = F.lit(1 << 62) + F.when(F.col("doc_id").isNull(), F.lit(1 << 61)).otherwise(F.lit(0)) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("shared"))
    if several.isEmpty():
        return docs.withColumn("row_key", F.coalesce(F.col("doc_id").cast("long"), own))
    met = docs.join(several, "doc_id", "left").select(*docs.columns, "shared")
    return met.withColumn("row_key", F.when(F.col("shared") | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id").cast("long"))).drop("shared")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, with its threshold for their language, does not reject. Each row is judged by its text, also
    where doc_id is null or shared."""
    from kindred.llm.toxicity import toxicity, train

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).where("not toxic_rejected").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): that of the smallest doc_id. Rows without
    doc_id and rows that share one are documents of their own, after all others, those without doc_id last; of rows equal in
    doc_id and text one stays."""
    from kindred.llm.ngram_join import jaccard_components

    keyed = row_keys(docs)
    groups = jaccard_components(keyed.select(F.col("row_key").alias("doc_id"), "text"), k=5, percent=80)
    kept = keyed.join(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("row_key")), "row_key", "left_anti")
    return kept.where(F.col("row_key") < 1 << 62).unionByName(kept.where(F.col("row_key") >= 1 << 62).dropDuplicates(["row_key"])).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any ten-word window of a benchmark item, each judged by its own text, also where doc_id is null or
    shared."""
    from kindred.llm.decontaminate import decontaminate

    keyed = row_keys(docs)
    found = decontaminate(keyed.select(F.col("row_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return keyed.join(found.where("contaminated").select(F.col("doc_id").alias("row_key")), "row_key", "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind."""
    from kindred.llm.pii import redact, train

    return redact(docs, train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each row the mix takes, by sources' target weights."""
    from kindred.llm.mixing import mix

    return mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again, and deleted when the next one is written.
    The last stage's is read by what it returns and stays."""
    from kindred.llm._graph import delete, written

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = written(docs, name)
            if before:
                delete(spark, before)
            before = path
    return docs
