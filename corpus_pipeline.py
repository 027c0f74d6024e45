"""Corpus pipeline: language identification, quality, near-duplicates, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of docs, so extra columns pass through
whatever their names; only doc_id, text, lang and source are read.

Contract for odd input: rows without words have no language and go in the first stage, and with them null texts. Rows
that repeat an id are documents of their own in every stage; of rows that agree in id and text, near-duplicates keeps one. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.llm import language, mixing, neardup, packing, quality
from candlemill.llm.common import new_path, table
from candlemill.llm.queries import tokenizer_path

#: A document needs this quality score.
LEAST_QUALITY = 0.5


def _fresh(label: str) -> str:
    """A column name that clashes with none."""
    return f"__{label}_{uuid.uuid4().hex[:12]}"


def _only(docs: DataFrame, df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is determined; the text model is trained on the documents' own labels."""
    name = _fresh("language")
    found = language.identify_documents(docs, language.train(docs), out=name)
    return _only(docs, found.where(language.kept(name)))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quadratic discriminant, fitted on the labelled ones that are left, holds for good."""
    model = quality.fit(quality.features(docs, "doc_id"), table(spark, sf_dir, "labels"))
    return docs.where(quality.score_text_column(model, F.col("text")) >= LEAST_QUALITY)


def _joined(docs: DataFrame, decided: DataFrame, key: Column, value: str) -> DataFrame:
    """docs with the column value of decided (key, value), by the hash key of both; rows without one go, and of rows with
    one key the first stays."""
    name, copy = _fresh("key"), _fresh("copy")
    keyed = docs.withColumn(name, key)
    once = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(name).orderBy(name))).where(F.col(copy) == 1)
    return once.join(decided.select(F.col("key").alias(f"{name}_d"), F.col(value)), F.col(name) == F.col(f"{name}_d"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component."""
    kept = neardup.near_duplicates(docs, text_hash=True).where("kept").select(F.xxhash64("doc_id", "text_hash").alias("key"), "kept").distinct()
    return _only(docs, _joined(docs, kept, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("binary"))), "kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: repeated rows are epochs."""
    copies, copy = _fresh("copies"), _fresh("copy")
    taken = mixing.mix_sources(docs).where("copies > 0").groupBy(F.xxhash64("doc_id", "source", "text_hash").alias("key")).agg(F.sum("copies").alias(copies))
    joined = _joined(docs, taken, F.xxhash64("doc_id", "source", F.xxhash64("text")), copies)
    return _only(docs, joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language identification", identify_language),
    ("quality classifier", classify_quality),
    ("near-duplicates", remove_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages are tested against brute force and by their invariants: SQL expresses neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
