"""From documents to packed sequences: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), with the tables of labels and benchmark items below sf_dir, and works on all rows that
the one before kept. All but the last return the columns of documents. Nulls are documents with an empty text or an unknown id;
an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import cotraining, jaccard, packing, secret_scan, winnowing
from millrace.llm.queries import Query, documents
from millrace.llm.workspace import Workspace, small, temporary


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents with two hashes of doc_id and text, by which stages find rows again, under names that no column has."""
    keys = ["k1", "k2"]
    while set(keys) & set(docs.columns):
        keys = [f"_{k}" for k in keys]
    return docs.withColumns(dict(zip(keys, (F.xxhash64("doc_id", "text"), F.hash("text", "doc_id"))))), keys


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    made = cotraining.features(docs, Workspace(spark, "quality"))
    return cotraining.accepted(docs, cotraining.fit(made, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link by five-word shingles at 0.8 or more, the one with the smallest doc_id.

    Texts without words are in no group and all stay. A row is known by its doc_id and text, so that rows without doc_id, or with the
    same one and another text, are judged by their own groups; a row without doc_id comes after all others. Rows equal in
    both are one document and stay once.
    """
    space = Workspace(spark, "near-duplicates")
    keyed, keys = _keyed(docs)
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *(F.col(k).alias(n) for k, n in zip(keys, ("k1", "k2")))).alias("row_id")
    found = space.keep(jaccard.similar_classes(keyed.select(name, "text"), id_col="row_id", n=5, percent=80))
    of = [F.col(f"id.{n}").alias(k) for k, n in zip(keys, ("k1", "k2"))]
    gone = space.keep(found.where("not (id <=> component)").select(*of).distinct())
    again = space.keep(found.where("size > 0").groupBy(*of).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    stay = keyed.join(small(gone), keys, "left_anti")
    once = stay.join(small(again), keys, "left_anti")
    repeated = stay.join(small(again), keys, "left_semi").dropDuplicates(keys)
    return once.select(docs.columns).unionByName(repeated.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    space = Workspace(spark, "decontamination")
    keyed, keys = _keyed(docs)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text")
    hits = winnowing.shared_windows(keyed.select(*(F.col(k).alias(a) for k, a in zip(keys, ("k1", "k2"))), "text"), bench, space)
    hit = space.keep(hits.select(*(F.col(a).alias(k) for k, a in zip(keys, ("k1", "k2")))).distinct())
    return keyed.join(small(hit), keys, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets blotted out; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.withColumn("n_chars", length)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("secret scans", secrets), ("best-fit packing", pack)]

#: Learned models and token ids are beyond SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the shared folder and read again, and what led to it is removed."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        space = Workspace(spark, f"stage-{name.replace(' ', '-')}")
        with temporary():
            docs = space.keep(stage(spark, docs, sf_dir))
        if before:
            before.remove()
        before = space
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
