"""A corpus pipeline of five stages, each written as Parquet and read by the next.

1. Quality rules: documents that fail the base rule or a certified cutoff go.
2. N-gram Jaccard join: one document of each component of documents whose sets
   of five-word shingles have a similarity of 0.8 or more stays.
3. Suffix-array dedup: passages that stand in a document with a smaller doc_id
   go, as whole characters; documents of which nothing is left go.
4. Benchmark decontamination: documents with a benchmark passage go.
5. Best-fit packing: what is left becomes sequences of at most 2048 tokens.

All but the last return the columns of ``documents``; ``n_chars`` follows the
text.  Rows with null ids or texts are handled as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.llm import decontaminate, ngram_join, packing, quality, suffix_dedup
from facetgrid.llm.common import materialize, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    cutoffs = quality.calibrate(quality.measure_labelled(docs.select("doc_id", "text", "lang"), labels), labels)
    judged = quality.judge(quality.measure(docs), cutoffs)
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, k=5, percent=80).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(docs).where("n_removed < n_bytes or n_bytes = 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    small = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(small, rows=packing.estimated_pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("best_fit", best_fit),
]

#: Certified cutoffs, suffix removal and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
