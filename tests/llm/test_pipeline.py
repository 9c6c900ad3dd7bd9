"""The registered queries against their SQL, and the pipeline's stages against plain versions."""

import glob
import importlib.util
import os

import duckdb
import pytest

from roadsift.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", os.path.join(ROOT, "corpus_pipeline.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = c.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert columns == sorted(names)
    assert sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(repr(tuple(row[names.index(x)] for x in columns)) for row in rel.fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_stages(spark, sf_dir, pipeline):
    from roadsift.llm import dedup, language, secrets, toxicity
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.dtypes, lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where(pipeline.fold("doc_id") != 0)
    model = toxicity.fit(docs, toxic)
    one = pipeline.remove_toxic(spark, docs, sf_dir).cache()
    assert one.dtypes == columns and ids(one) == sorted(r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5)
    two = pipeline.keep_languages(spark, one, sf_dir).cache()
    found = language.identify(one, language.fit(one.where("lang IS NOT NULL").where(pipeline.fold("doc_id") != 0)))
    assert two.dtypes == columns and ids(two) == sorted(r.doc_id for r in found.collect() if r.score >= 0.4)
    three = pipeline.drop_near_duplicates(spark, two, sf_dir).cache()
    assert three.dtypes == columns and ids(three) == sorted(r.doc_id for r in dedup.near_duplicates(two).collect() if r.kept)
    four = pipeline.mask_secrets(spark, three, sf_dir).cache()
    scan, before = secrets.scanner(), {r.doc_id: r.text for r in three.collect()}
    after = {r.doc_id: r for r in four.collect()}
    assert four.dtypes == columns and {d: secrets.masked(t, s, "[secret]") for (d, t), s in zip(before.items(), scan(list(before.values())))} == {d: r.text for d, r in after.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())
    five = pipeline.pack(spark, four, sf_dir).collect()
    assert {r.doc_id for r in five} == set(after)


def test_stages_take_empty_tables(spark, sf_dir, pipeline):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []
