"""Resumable rule scan: Structured Streaming takes the scenario files in by micro-batches, the detector runs once over all that came in."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadsift.rules.catalog import RULES, Rule
from roadsift.rules.detector import MATCH, detect
from roadsift.session import materialize
from roadsift.sources.scenarios import RAW_SCHEMA, to_states


def rule_fingerprint(rules: list[Rule]) -> str:
    """Changes with any rule or threshold, and so names a fresh progress folder."""
    text = json.dumps([[r.skill_id, r.strategy, r.history, r.metric, r.low, r.high, sorted(r.thresholds.items())] for r in rules], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def run(spark: SparkSession, scenario_root: str, polylines: DataFrame, out_root: str, rules: list[Rule] | None = None, total: int = 110, files_per_batch: int = 1000) -> str:
    """Scan the files not scanned yet and return the folder of the results.

    Files are taken in by micro-batches of ``files_per_batch``; what they brought is scanned together, since a run of the
    detector costs its many small plans however few files it gets.  Each scenario lies in one file, so no state crosses
    batches.  A scan batch writes its own folder and overwrites it when it is replayed, which makes a resumed run equal
    to an uninterrupted one.
    """
    rules = list(RULES.values()) if rules is None else rules
    base = f"{out_root.rstrip('/')}/{rule_fingerprint(rules)}"
    raw = (spark.readStream.schema(RAW_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(scenario_root))
    taken = to_states(raw, total)
    # the sink's log shows whole batches only, and so whole scenarios
    take = taken.writeStream.format("parquet").option("path", f"{base}/states").option("checkpointLocation", f"{base}/taken").trigger(availableNow=True).start()
    take.awaitTermination()

    lines = materialize(polylines, "scan-roads")    # made once, not by every batch

    def scan_batch(batch: DataFrame, number: int) -> None:
        # the detector reads states and roads several times: a batch's files are opened once
        states = materialize(batch, "scan-states")
        roads = materialize(lines.join(states.select("scenario_id").distinct(), "scenario_id", "left_semi"), "scan-batch-roads")
        found = detect(states, roads, rules, 1)
        keep = [c for c in MATCH if c not in ("measured", "context")]
        found.select(*keep).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/matches/batch_id={number}")

    query = (spark.readStream.schema(taken.schema).parquet(f"{base}/states").writeStream.option("checkpointLocation", f"{base}/progress")
             .trigger(availableNow=True).foreachBatch(scan_batch).start())
    query.awaitTermination()
    return f"{base}/matches"
