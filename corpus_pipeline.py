"""The corpus pipeline: documents in, sampled segmentations of the clean, distinct and mixed documents out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import packed, table, written
from daybook.llm.line_dedup import line_dedup
from daybook.llm.mixing import resampled, soft_mix
from daybook.llm.near_copies import near_groups
from daybook.llm.sentencepiece_sampling import sample_segmentations
from daybook.llm.toxicity import toxicity

#: Target shares of tokens; a domain is the language of a document, or "junk" where its quality label is 0.
WEIGHTS = {"en": 0.52, "fr": 0.14, "de": 0.14, "es": 0.10, "junk": 0.10}


def _identified(docs: DataFrame) -> DataFrame:
    """All columns in one struct, `row`, so that no column's name meets one of ours, and doc_id. Rows without a doc_id can't be traced: every stage drops them."""
    return packed(docs).withColumn("doc_id", F.col("row.doc_id").cast("long")).filter("doc_id IS NOT NULL")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network flags, by the threshold of their language, go.

    A null text counts as empty and is judged as such; of rows that repeat a doc_id all go if one is flagged. A score at the threshold is flagged.
    Rows without a doc_id go. Other columns may have any name. No rows give no rows.
    """
    rejected = toxicity(docs, table(spark, sf_dir, "labels")).filter("flagged").select("doc_id")
    return _identified(docs).join(rejected, "doc_id", "left_anti").select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, but for their first place; n_chars, if docs has it, follows the text. All rows with a doc_id stay.

    A null text stays null and its n_chars as it is; empty texts and a text that loses all lines are empty. Rows that repeat a doc_id are told
    apart by their texts. Columns n_lines and n_removed of docs are kept as they are; others may have any name. No rows give no rows.
    """
    counts = [c for c in docs.columns if c in ("n_lines", "n_removed")]
    kept = {c: f"kept_{uuid.uuid4().hex}" for c in counts}
    clean = line_dedup(docs.filter("doc_id IS NOT NULL").withColumnsRenamed(kept)).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in kept.items()})
    length = lambda c: F.coalesce(F.char_length("text").cast(docs.schema[c].dataType), F.col(c)).alias(c)
    return clean.select(*[length(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles >= 0.8) the document with the smallest doc_id stays.

    SimHash's links are verified by the similarity, and what they miss is found by shared rare shingles. Null texts, empty texts and those without words are
    copies of each other. Rows that repeat the smallest doc_id of a group all stay. Rows without a doc_id go. Other columns may have any name. No rows give no rows.
    """
    kept = near_groups(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return _identified(docs).join(kept, "doc_id", "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their rates. The total is the least at which no domain has to shrink, so clean documents stay.

    A null or empty text has its domain's rate by the priors; a null lang is a domain of its own, which gets no more than it has. Rows that repeat a doc_id
    are rated as one text and repeat alike. Rows without a doc_id go. Columns may have any name. No rows give no rows.
    """
    labels = table(spark, sf_dir, "labels").filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    domains = _identified(docs).select("doc_id", F.col("row.lang").alias("lang")).join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "junk").otherwise(F.col("lang")).alias("domain"))
    rates = soft_mix(docs.select("doc_id", "text"), domains, WEIGHTS, total="cover")
    return resampled(docs, rates.withColumn("rate", F.greatest(F.col("rate"), F.lit(1.0))))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two different segmentations of each document, with their ids.

    A null text counts as empty and has one segmentation, without pieces. Rows that repeat a doc_id are drawn alike. Rows without a doc_id go. Other columns
    are left out. No rows give no rows.
    """
    return sample_segmentations(docs, samples=2, return_ids=True)


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_boilerplate), ("simhash", keep_one_of_group), ("mixing", mix), ("sentencepiece", segment)]
#: SQL can express neither the network nor the sampling; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
