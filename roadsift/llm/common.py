"""Helpers shared by the operators: column hygiene, blocks of rows in Python tasks, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roadsift.session import materialize, shared_dir

__all__ = ["FOLDS", "blocks", "documents", "fold", "keep_rows", "map_rows", "materialize", "slim", "shared_dir", "slices"]

#: Characters of text that a Python task handles at once (a longer text is a block of its own), and rows it makes Python objects of.
BLOCK_CHARS, SLICE_ROWS = 400_000, 500
FOLDS = 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slim(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash."""
    return docs.select(*[docs[source].alias(name) for name, source in columns.items()])


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def blocks(rows: Iterable[tuple], size: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Lists of rows whose first values (texts) have at most ``size`` characters together, but at least one row."""
    block, total = [], 0
    for row in rows:
        if block and total + len(row[0]) > size:
            yield block
            block, total = [], 0
        block.append(row)
        total += len(row[0])
    if block:
        yield block


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``SLICE_ROWS`` rows, without copies: a batch of Spark's has 10,000 texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[list[tuple]], dict], schema: str, size: int = BLOCK_CHARS, change: Callable[[Iterator[tuple]], Iterator[tuple]] = iter) -> DataFrame:
    """``make`` gets lists of rows (the first column is a text, null read as empty) and returns columns by name.

    ``change`` may turn a partition's rows into others before, without a second pass through Python.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def rows():
            for batch in slices(batches):
                values = [batch.column(i).to_pylist() for i in range(len(columns))]
                yield from zip([x or "" for x in values[0]], *values[1:])

        for block in blocks(change(rows()), size):
            out = make(block)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type, from_pandas=False) for f, x in ((f, out[f.name]) for f in arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, text_col: str, decide: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Rows, with all their columns, for whose text ``decide`` says true (a null text is read as empty); no shuffle."""
    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            kept = [np.zeros(0, bool)] + [decide([t for t, in block]) for block in blocks((t or "",) for t in texts)]
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the size of each list."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
