"""The corpus pipeline over ``documents``: toxicity, near duplicates, repeated passages, personal data, packing.

Every stage gets all that its predecessor kept, as stored rows, and its decisions take effect: toxic documents go, one
document of each group of near duplicates stays, repeated passages are cut out of the later documents, personal data
is replaced by its kind, and what is left is packed into sequences. All stages but the last return the columns of
``documents``; a document whose text is cut down stays, with an empty text at least. Null texts count as empty, documents with a null
id are never removed by a join on ids, extra columns pass through to the last stage.

SQL cannot express the stages (trained models, a tokenizer), so the tests hold each of them against a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polarframe.llm import jaccard, packing, passages, pii, toxicity
from polarframe.llm.shared import join_checked, stored, table
from polarframe.plans.registry import Query

#: Near duplicates share at least so many percent of their five-word shingles.
WIDTH, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), F.col("toxic").alias("toxicity"))
    chain = toxicity.fit_chain(docs, labels, ["junk", "toxicity"])
    kept = docs.withColumnsRenamed({c: f"_d_{c}" for c in docs.columns})
    return chain.score(kept, "_d_text").where(~F.col("toxic")).select(*[F.col(f"_d_{c}").alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; documents without words or with a null id all stay."""
    classes = jaccard.classes(docs, WIDTH, PERCENT)
    # Documents that are not their class's first, by id: a fraction of the documents, as narrow rows. An id that
    # stands on several rows goes only if all of them do.
    named = classes.where("n_shingles > 0 and doc_id is not null")
    gone = named.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("all")).where("all").select("doc_id")
    kept = join_checked(docs, stored(gone, "gone"), ["doc_id"], "left_anti")
    # Rows that repeat an id within their class: one of them stays.
    repeated = named.groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    first = Window.partitionBy("doc_id", "text").orderBy(F.lit(0))
    again = kept.join(repeated.select("doc_id"), "doc_id", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(again).select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.remove(docs, stored(passages.find(docs), "passages"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The spans are computed once a row; the array keeps the optimizer from repeating them inside the redaction.
    found = pii.find(docs.withColumnsRenamed({c: f"_d_{c}" for c in docs.columns}), "_d_text", "_d_doc_id")
    text = F.when(F.size("spans") > 0, pii.redact(F.col("_d_text"), F.col("spans"))).otherwise(F.col("_d_text"))
    return found.select(*[(text if c == "text" else F.col(f"_d_{c}")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each),
    ("compact_windows", cut_passages),
    ("personal_data", redact),
    ("best_fit", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


PIPELINE: dict[str, Query] = {"pipeline": Query(run, ORACLE_SQL)}
