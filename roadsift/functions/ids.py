"""Content-hash ids (stable inside this library)."""

from __future__ import annotations

from roadsift.operators.ranking import digest


def seed_record_id(*more: str) -> str:
    return digest("scenario_id", "skill_id", "initiator_track_id", "responder_track_id", *more)


def task_id(target: str, budget: int) -> str:
    return digest("'task'", "seed_record_id", target, f"'{budget}'")


def candidate_id() -> str:
    return digest("'candidate'", "task_id", "CAST(candidate_index AS STRING)", "CAST(latent_seed AS STRING)")


def latent_group_id() -> str:
    """Shared by a conditioned task and its control twin."""
    return digest("'latent'", "seed_record_id", "target_track_id")


def evaluation_id() -> str:
    return digest("'filter'", "candidate_id", "coalesce(first_failed_stage, 'accepted')")
