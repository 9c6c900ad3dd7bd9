"""Memory of Python tasks: few texts are Python objects at once, and only wanted ones come back to Python."""

import pyarrow as pa

from pyspark.sql import functions as F

from roadsift.llm import common, dedup


def test_batches_are_cut():
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1201)])], names=["text"])
    parts = list(common.slices([batch, batch.slice(0, 0), batch.slice(0, 1)]))
    assert max(p.num_rows for p in parts) <= common.SLICE_ROWS
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*batch.column(0).to_pylist(), "0"]


def test_texts_of_wanted_classes_only(spark):
    """Texts without a partner aren't hashed twice; an id with two texts, and the null id, keep the right one."""
    words = lambda s: " ".join(f"{s}{i}" for i in range(9))
    docs = spark.createDataFrame([(words("x"), 1), (words("y"), 1), (words("z"), None), (words("q"), 4), (None, 5)], "text string, doc_id long")
    rows = dedup.signatures(docs, "bigint").where("node IS NOT NULL")
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("first_id")).localCheckpoint()
    node = dict(zip([words(s) for s in "xyzq"], [dedup.hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in dedup.shingle_sets([words(s) for s in "xyzq"])]))
    wanted = spark.createDataFrame([(node[words(s)],) for s in "xz"], "node binary")
    got = dedup.class_texts(docs, classes, wanted, "bigint")
    assert {bytes(r.node): r.text for r in got.collect()} == {node[words(s)]: words(s) for s in "xz"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("LeftSemi")      # printed from the top: the join feeds Python
