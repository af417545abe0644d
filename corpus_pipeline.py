"""Corpus pipeline: documents to tokens in five stages.

Each stage takes the table that its predecessor wrote (the first one:
documents), whole, and its decisions take effect; all but the last return the
columns of documents.

* quality: texts that the CRF classifier rejects go;
* near_duplicates: of each component of near copies the document with the
  smallest doc_id stays (equal rows once; NULL ids last, then by text);
* decontaminate: texts that overlap a benchmark item go;
* pii: personal data is replaced, disclosing terms are generalised or removed;
* tokens: SentencePiece ids instead of the text.

Defined cases are those of the operators: NULL and empty texts are scored by
the classifier like any other and are no near copies; a NULL doc_id stays
unless it is a near copy of a row that stays; an empty table gives an empty
result; columns beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainline.llm.decontaminate import decontaminate
from grainline.llm.ngram_join import keep_one
from grainline.llm.pii import sanitise
from grainline.llm.quality_crf import keep_good
from grainline.llm.sentencepiece_codec import encode
from grainline.session import stage_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The cleaned text; n_chars follows it."""
    return (sanitise(docs, "text", "text", min_support=1).withColumn("n_chars", _length("text")).select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs.select("doc_id", "lang", "source", "text"))


def _length(col: str):
    from pyspark.sql import functions as F

    return F.length(col).cast("long")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontamination), ("pii", pii), ("tokens", tokens)]

#: The classifier, the spans of the corpus statistics and the Viterbi pieces
#: have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = stage_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
