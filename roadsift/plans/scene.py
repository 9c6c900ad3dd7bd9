"""Tables shared by many queries of one driver folder.

In production these are stored tables (tracks, actors, candidate frames); here they are derived
from the driver tables once per session and folder, and written to the shared folder.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from roadsift import adapters
from roadsift.rules.detector import scan_actors
from roadsift.session import materialize

_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], write: bool = True) -> DataFrame:
    """A table built once per session and folder.  The planner sees the compressed bytes of its files, a small part of what its rows take
    in memory: joins with it are never broadcast by their size."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = (materialize(build(), name) if write else build()).hint("merge")
    return _TABLES[key]


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "states", lambda: adapters.track_states(spark, sf_dir))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.map_polylines(spark, sf_dir)


def spread_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map for row-local work on lines: distinct scenario ids are so few bytes that they would all end in one task."""
    return adapters.map_polylines(spark, sf_dir, 4 * spark.sparkContext.defaultParallelism)


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "actors", lambda: scan_actors(states(spark, sf_dir), roads(spark, sf_dir)), write=False)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "candidates", lambda: spark.sql(adapters.CANDIDATES_SQL, states=states(spark, sf_dir)))
