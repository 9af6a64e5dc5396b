"""Medallion marts on Spark: raw extracts to a checked dimensional model."""

from .config import Model, compile_rules, load_config, load_dq_rules
from .plans.medallion import Medallion, run_all, run_ingestion, run_provisioning, run_transformation

__all__ = [
    "Medallion",
    "Model",
    "compile_rules",
    "load_config",
    "load_dq_rules",
    "run_all",
    "run_ingestion",
    "run_provisioning",
    "run_transformation",
]
