"""A cleaned and tokenised corpus from the documents table.

Stages, in order: language ID, line dedup, SimHash near-dedup, benchmark decontamination, encoding. Each takes
(spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. ``run`` writes each
stage's result to the shared folder as Parquet and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quelora.llm import decontaminate, encode, langid, lines, simhash
from quelora.llm.common import identity, materialize, packed, table, unpacked

#: Posterior of the predicted language from which a document stays.
MIN_LANGUAGE_SCORE = 0.5

#: The stages can't be expressed in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no language that is likelier than all others. The
    model learns from the documents' own labels; without any, all documents with a letter stay."""
    model = langid.fit(docs, F.col("lang").isNotNull())
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = langid.predict(packed(docs, text=F.col("text").cast("string")), model)
    return unpacked(found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes lines that stand elsewhere already; documents of which nothing is left go, and n_chars follows."""
    left = lines.dedup_lines(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies: five-word shingles, similarity 4/5 or more."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    a, b = identity("doc_id", "text")
    rows = docs.select(a.alias("a"), b.alias("b"), "text")
    index = decontaminate.build_index(rows, id_col="a", tag_col="b")
    hit = decontaminate.search(index, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    leaks = materialize(hit.select(F.col("id").alias("a"), F.col("tag").alias("b")).distinct(), "leaks")
    return unpacked(packed(docs, a=a, b=b).join(leaks, ["a", "b"], "left_anti"), docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, checked by decoding them."""
    return encode.round_trip(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
