"""Registered queries of the training-data operators, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.quality_crf import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per (document, benchmark item) whose overlap is 0.75 or more."""
    from grainline.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_matched").cast("long").alias("n_matched"), "overlap")


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.url_lists import url_filter_report

    return url_filter_report(_table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.pii import span_report

    return span_report(_table(spark, sf_dir, "documents"), min_support=1)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.sentencepiece_codec import encode

    return encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.hilbert_ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.html_render import extract_text

    text = extract_text(_table(spark, sf_dir, "pages").select("page_id", "html"))
    return text.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.warc import archive_report

    return archive_report(_table(spark, sf_dir, "pages"))


def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.license_templates import license_report

    return license_report(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.minhash_hamming import near_duplicate_classes

    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.norm_buckets import ranked

    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainline.llm.prefix_trie import trie_report

    return trie_report(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_crf, op2_decontamination, op3_url_lists, op4_pii, op5_sentencepiece, op6_hilbert_ann,
                                   op7_html_text, op8_warc, op9_license_templates, op10_ngram_join, op11_minhash_dedup, op12_norm_buckets, op13_prefix_trie, pipeline)}
