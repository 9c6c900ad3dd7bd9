"""Generation tasks from seed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.functions.ids import latent_group_id, seed_record_id, task_id


def build_tasks(seeds: DataFrame, roles: DataFrame, budget: int = 16) -> tuple[DataFrame, DataFrame]:
    """Tasks with the track of the skill's primary role as target, and the seeds that lack that role."""
    s = seeds.join(roles, "skill_id", "left").withColumn("target_track_id", F.expr("try_element_at(role_track_ids, primary_role)"))
    s = s.withColumn("seed_record_id", F.expr(seed_record_id("seed_risk_metric"))).withColumn("task_id", F.expr(task_id("target_track_id", budget)))
    return s.where("target_track_id IS NOT NULL"), s.where("target_track_id IS NULL")


def paired_tasks(seeds: DataFrame) -> DataFrame:
    """Every task with a learned condition gets a control twin without condition, sharing its latent group."""
    s = seeds.withColumn("target_track_id", F.col("initiator_track_id")).withColumn("seed_record_id", F.expr(seed_record_id("seed_risk_metric")))
    s = s.withColumn("latent_group_id", F.expr(latent_group_id()))
    return s.withColumn("condition", F.expr("explode(IF(learned, array(skill_id, '<none>'), array(skill_id)))")).withColumn(
        "arm", F.expr("IF(condition = '<none>', 'null_condition', 'skill_condition')"))
