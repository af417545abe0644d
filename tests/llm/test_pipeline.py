"""The pipeline, its stages, and the registered queries."""
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from grainline.llm import decontaminate, ngram_join, pii, quality_crf
from tests.llm.test_pairs import brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's written output on the documents of sf0.001."""
    root, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES:
        out[name, "in"] = docs
        stage(spark, docs, SF).write.parquet(str(root / name))
        docs = out[name] = spark.read.parquet(str(root / name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "pii", "tokens"]
    assert all(stages[n].columns == COLUMNS for n in names[:-1])
    assert C.ORACLE_SQL is None


def test_quality_stage(spark, stages):
    report = quality_crf.quality_report(stages["quality", "in"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(stages["quality"]) == ids(report.where("predicted = 1"))
    assert 0 < stages["quality"].count() < stages["quality", "in"].count()


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages["near_duplicates", "in"].collect()]
    assert ids(stages["near_duplicates"]) == sorted(d for d, _, c in brute_components(rows) if d == c)


def test_decontamination_stage(spark, stages):
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    bench = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r.doc_id for r in stages["decontaminate", "in"].collect()
           if any(" " + " ".join(b) + " " in " " + " ".join(words(r.text or "")) + " " for b in bench)}
    assert set(ids(stages["decontaminate", "in"])) - set(ids(stages["decontaminate"])) == hit


def test_pii_stage(stages):
    before = {r.doc_id: r.text for r in stages["pii", "in"].collect()}
    after = {r.doc_id: r for r in stages["pii"].collect()}
    assert set(before) == set(after)
    clean = pii.span_report(stages["pii"])
    assert clean.where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    marked = {r.doc_id for r in pii.span_report(stages["pii", "in"]).where("spans <> ''").collect()}
    assert all((after[i].text == t) == (i not in marked) and after[i].n_chars == len(after[i].text) for i, t in before.items())


def test_token_stage(spark, stages):
    from grainline.llm.sentencepiece_codec import decode
    out = stages["tokens"]
    assert out.where("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in decode(out.select("doc_id", "tokens")).collect()}
    assert back == {r.doc_id: r.text for r in stages["tokens", "in"].collect()}


def test_run_and_odd_rows(spark, tmp_path, stages):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some clean words, and more of them. The end.", "en", "s", 1)]
    sf = tmp_path / "sf"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit(1)).write.parquet(f"{sf}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    got = C.run(spark, str(sf))
    assert set(ids(stages["tokens"])) <= {r.doc_id for r in got.collect()}
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert C.run(spark, f"{tmp_path}/none").collect() == []


def test_registered_queries(spark):
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in E.queries()


def test_rest_works_without_the_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__ as E
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n == "grainline.llm" else find(n, *a))
    assert not [n for n in E.queries() if n.startswith("op")] and "pipeline" not in E.queries()
    assert "op10_ngram_join" not in E.oracle_sql()
