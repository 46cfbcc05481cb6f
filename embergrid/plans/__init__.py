"""Registered queries with their SQL twins."""

from . import q_calibration, q_chains, q_extra, q_files, q_models, q_noise, q_records, q_reports, q_retrieval, q_spatial, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
