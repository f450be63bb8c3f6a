"""Imports every plan module so that its queries register."""
from tidebar.plans import q_causality, q_detect, q_ingest, q_models, q_outcomes, q_search, q_stats, q_triggers, q_windows  # noqa: F401
from tidebar.plans.registry import ORACLES, QUERIES  # noqa: F401
